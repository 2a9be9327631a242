"""Main text of pages by a site style tree.

The pages of one host are merged into a tree of elements. For each element of
the tree the entropy of its presentation (the child sequences it has) and of
its content (the texts below it) over the pages says how important it is: what
looks and reads alike on every page of a site is its frame, not its articles.
Branches of low importance are then removed from each page.

Every branch is judged by a sum of log-odds. The tree speaks the louder the
more pages it has seen. What the markup declares (menus, footers, class names,
articles) and how much of the page's text a branch holds are evidence beside
it; none of them decides alone, and a page with content never ends up empty.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from twinfold.llm.dom import BLOCK, Element, parse
from twinfold.llm.frames import pick, position, slices, stage, tidy, unstage
from twinfold.llm.urlfilter import host

# fixed values: elements whose content is no text that a page shows
_UNSHOWN = frozenset(
    "script style noscript template head title iframe object embed svg math canvas audio video "
    "button select textarea input datalist xmp noembed noframes map".split()
)
# fixed values: log-odds that a tag or a role means article text
_TAGS = {"nav": -4.0, "menu": -4.0, "footer": -3.0, "aside": -3.0, "dialog": -3.0, "search": -3.0, "header": -2.7, "form": -2.1}
_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split()
)
# fixed values: words of class names and ids that mean something else than an article
_FRAME_WORDS = frozenset(
    "nav navbar navigation menu submenu header footer sidebar aside ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended breadcrumb "
    "breadcrumbs pagination pager toolbar widget masthead copyright disclaimer".split()
)
_COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())
# fixed values: words that add nothing to the one before them, and words that turn it round
_EMPTY_WORDS = frozenset("area bar block box button buttons container content form inner item items list panel section wrap wrapper".split())
_TURNING_WORDS = frozenset("has have hide no non not show with without".split())
_ARTICLE = frozenset(["article", "main"])
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd caption figcaption td th tr tbody thead tfoot".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: A branch goes if its log-odds are this low; a page that would be left empty
#: keeps the least doubtful of its branches down to the second figure.
CUT, LAST_CUT = -2.0, -2.6
#: Log-odds from the tree for each bit that its pages could have told apart by
#: text and did not (texts alike on four pages go), and did tell by layout.
REPEAT_WEIGHT, LAYOUT_WEIGHT = -1.0, 2.0
#: Log-odds of holding all the text of a page, and of lying outside its article.
MASS_WEIGHT, OUTSIDE_WEIGHT = 1.5, -3.0
#: Characters from which on the share of a page's text counts in full, and
#: characters that a declared article, or main part, counts beyond its own.
MASS_CHARS, ARTICLE_CHARS, MAIN_CHARS = 200, 60, 400
#: Low nodes that a host sends to each of its pages; of more, each page gets its own.
LIST = 512


def _is_main(e: Element) -> bool:
    return e.tag == "main" or e.attributes.get("role") == "main" or "articlebody" in e.attributes.get("itemprop", "").lower()


def _is_article(e: Element) -> bool:
    return e.tag in _ARTICLE or _is_main(e)


def _unshown(e: Element) -> bool:
    """Whether an element shows no text, whatever site it is on."""
    if e.tag in _UNSHOWN:
        return True
    a = e.attributes
    return bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "").lower())))


def _name_says(name: str, inside: bool) -> float:
    """Log-odds from one class name or id.

    A name of nothing but frame words says most. In a compound the last word
    counts (``site-footer``), unless one before turns it round (``no-sidebar``);
    a frame word before another one (``related-work``) says little.
    """
    words = [w.lower() for w in _WORD.findall(name)]
    words = [w for w in words if w not in _EMPTY_WORDS] or words
    frame = [w in _COMMENT_WORDS or (w in _FRAME_WORDS and not (inside and w == "header")) for w in words]
    if not any(frame):
        return 0.0
    if all(frame):
        return -4.0 if not _COMMENT_WORDS.isdisjoint(words) else -2.5
    return -2.2 if frame[-1] and _TURNING_WORDS.isdisjoint(words) else -0.75


def declared(e: Element, inside: bool) -> float:
    """Log-odds that an element is article text, by its own markup.

    ``inside`` says whether an article element is around it.
    """
    said = _TAGS.get(e.tag, 0.0)
    if e.tag == "header" and inside:
        said = -1.0
    a = e.attributes
    if a:
        if a.get("role", "").lower() in _ROLES:
            said = min(said, -3.0)
        if e.tag not in ("html", "body"):
            names = [*a.get("class", "").split(), *([a["id"]] if a.get("id") else [])]
            said = min([said, *[_name_says(n, inside) for n in names]])
    return said + (1.5 if _is_article(e) else 0.0)


def presentation(e: Element) -> str:
    """Tag, class, id and role, without the digits that number them."""
    a = e.attributes
    if not a:
        return e.tag + "|||"
    marks = " ".join(sorted(a.get("class", "").split())), a.get("id", ""), a.get("role", "")
    return e.tag + re.sub(r"\d+", "#", "".join(f"|{m}" if m else "|" for m in marks))


def _tidied(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class Page:
    """The elements of a page, what they say, and its blocks of text.

    Elements are numbered in page order, so a parent comes before its children;
    a block is a list of ``(element, text)``.
    """

    def __init__(self, markup: str):
        self.parent, self.node, self.said = [-1], [0], [0.0]
        self.mass = [0]  # characters of text in an element itself, links left out
        self.judged = [False]  # whether the tree may speak about it
        self.article = [0]  # 1: an article, 2: the main part
        self.styles: dict[int, int] = {}
        self.blocks: list[list[tuple[int, str]]] = []
        self._read(parse(markup))
        self._weigh()

    def _enter(self, e: Element, above: int, inside: bool) -> int:
        """Number an element. Inline elements, and the paragraphs, headings and
        items of an article, are judged as branches only if they are marked."""
        look = presentation(e)
        node = xxhash.xxh64_intdigest(f"{self.node[above]}>{look}") >> 1
        if node not in self.styles:
            seen, last = [], None
            for c in e.children:
                if not isinstance(c, str) and (now := presentation(c)) != last:
                    seen.append(now)
                    last = now
            self.styles[node] = xxhash.xxh64_intdigest(">".join(seen)) >> 1
        self.parent.append(above)
        self.node.append(node)
        self.said.append(declared(e, inside))
        self.mass.append(0)
        marked = not look.endswith("|||")
        self.judged.append((marked or e.tag in BLOCK and not (inside and e.tag in _PROSE)) and e.tag not in ("html", "body"))
        self.article.append(2 if _is_main(e) else 1 if e.tag == "article" else 0)
        return len(self.parent) - 1

    def _read(self, root: Element) -> None:
        """Number the elements and cut the text into blocks, without recursion."""
        block: list[tuple[int, str]] = []
        # element, its next child, its number, whether in a link, whether in an article
        stack: list[list] = [[root, 0, 0, False, False]]

        def flush() -> None:
            nonlocal block
            if any(not t.isspace() for _, t in block):
                self.blocks.append(block)
            block = []

        while stack:
            top = stack[-1]
            e, i, at, link, inside = top
            if i >= len(e.children):
                if e.tag in BLOCK:
                    flush()
                stack.pop()
                continue
            top[1] = i + 1
            child = e.children[i]
            if isinstance(child, str):
                if child:
                    block.append((at, child))
                    if not link:
                        self.mass[at] += len(child.strip())
            elif child.tag == "br" or child.tag == "wbr":
                block.append((at, " " if child.tag == "br" else ""))
            elif _unshown(child):
                if child.tag in BLOCK:
                    flush()
            else:
                if child.tag in BLOCK:
                    flush()
                number = self._enter(child, at, inside)
                stack.append([child, 0, number, link or child.tag == "a", inside or self.article[number] > 0])
        flush()

    def _weigh(self) -> None:
        """Characters below each element, and the log-odds of its share of the page."""
        own, n = self.mass, len(self.parent)
        self.total = total = list(own)  # characters below, what the markup doubts left out
        for i in range(n - 1, 0, -1):
            if self.said[i] > CUT:
                total[self.parent[i]] += total[i]
        doubted = [False] * n
        for i in range(1, n):
            doubted[i] = doubted[self.parent[i]] or self.said[i] <= CUT
            if total[i]:
                share = total[i] / (total[0] + (total[i] if doubted[i] else 0))
                if share > 0.5:
                    self.said[i] += MASS_WEIGHT * (2 * share - 1) * min(1.0, total[i] / MASS_CHARS)

    def texts(self) -> dict[int, set[str]]:
        """The distinct texts that each node itself has on this page."""
        out: dict[int, set[str]] = {}
        for block in self.blocks:
            own: dict[int, str] = {}
            for at, piece in block:
                own[at] = own.get(at, "") + piece
            for at, piece in own.items():
                if at and (text := _tidied(piece)):
                    out.setdefault(at, set()).add(text)
        by_node: dict[int, set[str]] = {}
        self.owners: dict[int, int] = {}
        for at, found in out.items():
            by_node.setdefault(self.node[at], set()).update(found)
            self.owners.setdefault(self.node[at], at)
        return by_node

    def path(self, at: int) -> list[int]:
        """The nodes of an element and of all above it."""
        out = []
        while at:
            out.append(self.node[at])
            at = self.parent[at]
        return out

    def _worst(self, site: dict[int, float]) -> list[float]:
        """For each element the least log-odds of it and of all above it."""
        worst = [0.0]
        for i in range(1, len(self.parent)):
            odds = self.said[i] + (site.get(self.node[i], 0.0) if site and self.judged[i] else 0.0)
            worst.append(min(worst[self.parent[i]], odds))
        return worst

    def _outside(self, worst: list[float]) -> list[float]:
        """The same after what lies outside the declared articles was doubted by
        the part of the page's text that these hold."""
        n = len(worst)
        within, holds = [False] * n, [False] * n
        most = 0
        for i in range(1, n):
            within[i] = within[self.parent[i]] or (self.article[i] > 0 and worst[i] > CUT)
            if within[i] and not within[self.parent[i]]:
                most = max(most, self.article[i])
        if not most:
            return worst
        inner = outer = 0
        for i in range(n - 1, -1, -1):
            if worst[i] > CUT:
                if within[i]:
                    inner += self.mass[i]
                else:
                    outer += self.mass[i]
            if i and (holds[i] or within[i]):
                holds[self.parent[i]] = True
        inner += MAIN_CHARS if most == 2 else ARTICLE_CHARS
        doubt = OUTSIDE_WEIGHT * inner / (inner + outer)
        out, odds = [doubt], [0.0]
        for i in range(1, n):
            if within[i]:
                odds.append(worst[i])
                out.append(worst[i])
                continue
            # an element that holds an article is not outside it, its own text is
            odds.append(min(odds[self.parent[i]], worst[i]))
            out.append(odds[i] + doubt)
        return out

    def text(self, site: dict[int, float] | None = None) -> str:
        """The blocks that are article text, joined by a space.

        ``site`` has the log-odds of the tree by node. If nothing were left,
        the tree is not heard, and then the least doubtful branches stay.
        """
        worst = self._worst(site or {})
        odds = self._outside(worst)
        out = self._join(odds, CUT)
        if not out and site:
            return self.text()
        if not out:
            found = [worst[at] for block in self.blocks for at, t in block if not t.isspace()]
            if found and max(found) > LAST_CUT:
                out = self._join(worst, max(found) - 1e-9)
        return out

    def _join(self, odds: list[float], cut: float) -> str:
        parts = []
        for block in self.blocks:
            text = _tidied("".join([t for at, t in block if odds[at] > cut]))
            if text:
                parts.append(text)
        return " ".join(parts)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _observed(batches):
    """For each page its host, a fingerprint of its text, its nodes and their texts."""
    for part in slices(batches, most_rows=256):
        names, fingerprints, marks, nodes, texts = part.column(0), [], [], [], []
        for markup in part.column(1).to_pylist():
            page = Page(markup or "")
            found = page.texts()
            fingerprints.append(_hash(page.text()))
            nodes.append([{"node": k, "style": s} for k, s in page.styles.items()])
            texts.append(
                [
                    {"node": k, "texts": sorted(map(_hash, t)), "above": page.path(page.owners[k])}
                    for k, t in sorted(found.items())
                ]
            )
            marks.append(_hash(repr((nodes[-1], texts[-1]))))
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(fingerprints, pa.int64()), pa.array(marks, pa.int64()), pa.array(nodes, _NODES), pa.array(texts, _TEXTS)],
            names=["host", "page", "mark", "nodes", "texts"],
        )


_LONGS = pa.list_(pa.int64())
_NODES = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())]))
_TEXTS = pa.list_(pa.struct([("node", pa.int64()), ("texts", _LONGS), ("above", _LONGS)]))
_OBSERVED = (
    "host string, page long, mark long, nodes array<struct<node:long,style:long>>, "
    "texts array<struct<node:long,texts:array<long>,above:array<long>>>"
)


def style_tree(pages: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """The merged tree of each host, one row for each element of it.

    ``pages`` has ``host`` and ``html``. Returns ``host, node, site_pages,
    pages`` (distinct pages of the host, and those with the element),
    ``styles``, ``presentation`` and ``content`` (entropy-based importance,
    from 0 to 1: of the child sequences, and of the most important texts on
    the element or below it) and ``importance``, which blends them as in the
    published method, presentation weighing more the more styles there are.
    Pages of a host with the same text count once. ``held`` gets the staged
    table that can be deleted once the tree has been read.
    """
    seen = stage(
        pages.where("host IS NOT NULL AND host != ''")
        .select("host", "html")
        .mapInArrow(tidy(_observed), _OBSERVED)
        .groupBy("host", "page")
        # of pages with one text, always the same one
        .agg(F.min_by(F.struct("nodes", "texts"), "mark").alias("x"))
        .select("host", "page", "x.nodes", "x.texts")
    )
    if held is not None:
        held.append(seen)
    site = seen.groupBy("host").agg(F.count("*").alias("site_pages"))
    n = F.col("n").cast("double")
    elements = (
        seen.select("host", F.explode("nodes").alias("x"))
        .groupBy("host", "x.node", "x.style")
        .agg(F.count("*").alias("n"))
        .groupBy("host", "node")
        .agg(F.sum("n").alias("pages"), F.count("*").alias("styles"), F.sum(n * F.log(n)).alias("n_log_n"))
        .withColumn("size", F.log(F.col("pages").cast("double")))
        .withColumn("presentation", F.when(F.col("pages") > 1, 1 - F.col("n_log_n") / F.col("pages") / F.col("size")).otherwise(1.0))
    )
    texts = (
        seen.select("host", F.explode("texts").alias("x"))
        .select("host", "x.node", "x.above", F.explode("x.texts").alias("text"))
        .groupBy("host", "node", "text")
        .agg(F.count("*").alias("n"), F.min("above").alias("above"))  # a node has one path
        .groupBy("host", "node")
        .agg(F.avg(F.log(n)).alias("mean_log"), F.min("above").alias("above"))
    )
    own = elements.join(texts, ["host", "node"]).select(
        "host",
        "above",
        F.when(F.col("pages") > 1, 1 - F.col("mean_log") / F.col("size")).otherwise(1.0).alias("content"),
    )
    below = (
        own.select("host", F.explode("above").alias("node"), "content")
        .groupBy("host", "node")
        .agg(F.max("content").alias("content"))
    )
    weight = F.pow(F.lit(0.9), F.col("styles"))
    content = F.coalesce("content", F.lit(0.0))
    return (
        elements.join(below, ["host", "node"], "left")
        .join(site, "host")
        .select(
            "host",
            "node",
            "site_pages",
            "pages",
            "styles",
            "presentation",
            content.alias("content"),
            ((1 - weight) * F.col("presentation") + weight * content).alias("importance"),
        )
    )


def tree_odds() -> Column:
    """The log-odds that the tree gives a branch, from its row of the tree.

    What importance lacks, times the bits that as many pages can tell apart,
    is the information that the branch repeats: for texts alike on n pages
    each, log2(n). So the tree says nothing about a single page, and what it
    says depends on how often texts repeat and not on the size of the host. A
    variety of layouts speaks for a branch: articles differ in their build.
    """
    seen = F.greatest("importance", "content")
    bits = F.log2(F.greatest(F.col("pages"), F.lit(1)).cast("double"))
    return bits * F.least(F.lit(0.0), LAYOUT_WEIGHT * F.col("presentation") + REPEAT_WEIGHT * (1 - seen))


def low_nodes(tree: DataFrame, least: float = -0.25) -> DataFrame:
    """``(host, node, odds)``: the nodes that the tree doubts noticeably."""
    return tree.select("host", "node", tree_odds().alias("odds")).where(F.col("odds") <= least)


def low_branches(tree: DataFrame) -> DataFrame:
    """``(host, low)``: for each host the nodes that go by the tree alone."""
    return low_nodes(tree, CUT).groupBy("host").agg(F.collect_set("node").alias("low"))


def _lists(nodes: DataFrame, *key: str) -> DataFrame:
    return nodes.groupBy(*key).agg(F.collect_set(F.struct("node", "odds")).alias("low"))


def _markup_key(html):
    """What finds the low nodes of a page again. Pages of a host that share a
    key share a list; foreign low nodes in it do no harm, as no page has them."""
    return F.xxhash64(html.cast("string"))


def _page_nodes(batches):
    for part in slices(batches, most_rows=256):
        nodes = [list(Page(m or "").styles) for m in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, _LONGS)], names=["host", "key", "nodes"])


def low_by_page(sites: DataFrame, low: DataFrame) -> DataFrame:
    """``(host, key, low)``: for each markup of the hosts in ``low`` those of
    its own nodes that are low, so no list is longer than a page."""
    keyed = sites.select("host", _markup_key(F.col("html")).alias("key"), F.col("html").cast("string"))
    nodes = keyed.mapInArrow(tidy(_page_nodes), "host string, key long, nodes array<long>")
    return _lists(nodes.select("host", "key", F.explode("nodes").alias("node")).join(low, ["host", "node"]), "host", "key")


def extract_text(pages: DataFrame, tree: bool = True) -> DataFrame:
    """Add ``text``, the main text, and ``n_chars``, its code points.

    Reads ``url`` and the whole ``html``, spelt exactly so if another column
    differs only in case. A null or empty page has an empty text; so has one
    that is all menus. A page without a host is read by its own markup alone,
    and on a host of few pages the tree says little. Repeated rows and equal
    markup are read alike, very long pages are read whole, an empty table
    stays empty, input columns called ``text`` or ``n_chars`` are replaced,
    and others pass through. Elements nested more than 512 deep are taken as
    siblings, as browsers do. Without ``tree`` no page is compared with others.

    The pages are read twice, once for the tree and once for the texts, which
    are never shuffled while the table of low branches is small enough for
    Spark to broadcast it by its size; beyond that the pages are joined to it
    by host, and a hot host's partition is split at run time. A host of more
    than ``LIST`` low nodes has no list of its own: its pages are read a third
    time, and each is joined to the few low nodes it has itself.
    """
    names = [c.lower() for c in pages.columns]
    source = pages.toDF(*[f"_{i}" for i in range(len(names))])
    kept = [i for i, c in enumerate(names) if c not in ("text", "n_chars")]
    named = host(F.col(f"_{position(pages, 'url')}"))
    markup = F.col(f"_{position(pages, 'html')}")
    joined = source.withColumn("host", F.coalesce(named, F.lit("")))
    if tree:
        sites = pick(pages, "url", "html").select(host(F.col("url")).alias("host"), "html")
        held: list[DataFrame] = []
        low = stage(low_nodes(style_tree(sites, held)))
        unstage(*held)
        counts = low.groupBy("host").agg(F.count("*").alias("n"))
        many = stage(counts.where(F.col("n") > LIST).select("host"))
        lists = stage(_lists(low.join(many, "host", "left_anti"), "host"))
        joined = joined.join(lists, "host", "left")
        if not many.isEmpty():
            pages_low = stage(low_by_page(sites.join(many, "host", "left_semi"), low.join(many, "host", "left_semi")))
            pages_low = pages_low.withColumnRenamed("low", "own")
            joined = joined.withColumn("key", _markup_key(markup)).join(pages_low, ["host", "key"], "left")
            joined = joined.withColumn("low", F.coalesce("low", "own"))
        unstage(low, many)
    else:
        joined = joined.withColumn("low", F.lit(None).cast("array<struct<node:long,odds:double>>"))
    nodes, odds = F.col("low.node").alias("nodes"), F.col("low.odds").alias("odds")
    rows = joined.select(*[f"_{i}" for i in kept], markup.cast("string").alias("markup"), nodes, odds)
    fields = [StructField(pages.columns[i], pages.schema.fields[i].dataType) for i in kept]
    inner = StructType(
        [StructField(f"_{i}", f.dataType) for i, f in zip(kept, fields, strict=True)]
        + [StructField("text", StringType()), StructField("n_chars", LongType())]
    )
    arrow = to_arrow_schema(inner)

    def work(batches):
        k = len(kept)
        for part in slices(batches, most_rows=256):
            columns = [part.column(i).to_pylist() for i in (k, k + 1, k + 2)]
            texts = [Page(m or "").text(dict(zip(n or (), o or (), strict=True))) for m, n, o in zip(*columns, strict=True)]
            same = [part.column(i).cast(arrow.field(i).type) for i in range(k)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(same + made, schema=arrow)

    return rows.mapInArrow(tidy(work), inner).toDF(*[pages.columns[i] for i in kept], "text", "n_chars")
