"""Language identification by a bit-sliced Bloom filter of character n-grams.

Every position of the filter holds one bit for each language. The AND of an
n-gram's positions is the set of all languages that contain it, so one lookup
serves every language. For each document the bits are counted by language; the
share that false positives would give is taken off; the largest share decides.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from twinfold.llm.frames import add_columns, pick, power_of_two, same_columns, slices, stage, tidy, unstage

#: Lengths of the n-grams, in characters.
ORDERS = (2, 3, 4)
#: Positions of the filter, fewer if there are very many languages, and of an n-gram.
POSITIONS, LEAST_POSITIONS, PROBES = 1 << 19, 1 << 12, 2
#: Bytes of the filter from which on it gets fewer positions.
FILTER_BYTES = 64 << 20
#: Languages whose table is broadcast.
MOST_BROADCAST = 100_000
UNDETERMINED = "und"

_U = np.uint64
_PIECE = 1 << 20
_MULT = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def _pieces(text: str):
    """Cut a very long text: ``(piece, carried, whole)``.

    Cuts fall between words. Where no word ends, the next piece begins with the
    last characters of this one, which ``carried`` counts, and ``whole`` says
    whether the last word of a piece ends there.
    """
    at = carried = 0
    most = max(ORDERS) - 1
    while len(text) - at > _PIECE:
        end = at + _PIECE
        while end > at + _PIECE // 2 and text[end - 1].isalpha():
            end -= 1
        whole = not text[end - 1].isalpha()
        if not whole:
            end = at + _PIECE
            whole = not text[end - 1].isalpha()
        yield text[at - carried : end], carried, whole
        at, carried = end, 0 if whole else most
    yield text[at - carried :], carried, True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _MULT[1]
    return h ^ (h >> _U(32))


def gram_keys(text: str) -> np.ndarray:
    """A 64-bit key for each n-gram of the lower-cased text, order by order.

    A run of characters other than letters counts as one space, and so do both
    ends of the text. No letter, no n-gram. N-grams of a mere space and those
    that span two words are left out.
    """
    found = []
    # in lower case before it is cut, as that can depend on what stands around
    for piece, carried, whole in _pieces(text.lower()):
        piece = f"{'' if carried else ' '}{piece}{' ' if whole else ''}"
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        keep = letter.copy()
        keep[0] = True
        keep[1:] |= letter[:-1]
        c = np.where(letter, code, 32)[keep].astype(_U)
        space = c == 32
        rolled = c.copy()
        inner = np.zeros(max(0, len(c) - 1), bool)
        for n in range(2, max(ORDERS) + 1):
            if len(c) < max(n, 3):
                break
            # h(n) from h(n - 1) and the next character
            rolled = (rolled[: len(c) - n + 1] * _MULT[0]) + c[n - 1 :]
            inner = inner[: len(c) - n + 1]
            if n > 2:
                inner = inner | space[n - 2 : len(c) - 1]
            if n in ORDERS:
                # what ends among the carried characters was in the piece before
                fresh = max(0, carried - n + 1)
                found.append(_mix(rolled[fresh:][~inner[fresh:]] + _U(n)))
    return np.concatenate(found) if found else np.zeros(0, _U)


def _places(keys: np.ndarray, positions: int) -> list[np.ndarray]:
    low, high = keys & _U(0xFFFFFFFF), keys >> _U(32) | _U(1)
    return [((low + _U(i) * high) & _U(positions - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass
class LanguageFilter:
    """The filter: ``masks[word, position]`` has a bit for each language."""

    languages: list[str]
    masks: np.ndarray

    def __post_init__(self):
        self.positions = self.masks.shape[1]
        fill = [
            float(((self.masks[k // 64] >> _U(k % 64)) & _U(1)).mean()) if self.positions else 0.0
            for k in range(len(self.languages))
        ]
        #: Of n-grams that a language lacks, the share its slice has by chance.
        self.chance = np.minimum(np.array(fill) ** PROBES, 0.999)

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages that contain it."""
        out = None
        for at in _places(keys, self.positions):
            got = self.masks[:, at]
            out = got if out is None else out & got
        return out

    def shares(self, keys: np.ndarray) -> np.ndarray:
        """Each language's share of the n-grams, without the chance hits."""
        if not len(keys) or not self.languages:
            return np.zeros(len(self.languages))
        found = self.containing(keys)
        count = np.array(
            [int(((found[k // 64] >> _U(k % 64)) & _U(1)).sum()) for k in range(len(self.languages))]
        )
        return np.clip((count / len(keys) - self.chance) / (1 - self.chance), 0.0, 1.0)

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language and score; ties go to the smaller name."""
        shares = self.shares(gram_keys(text)) if text else np.zeros(0)
        if not len(shares) or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def fraction_of_crc(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(labelled: DataFrame, sample_rows: int = 3000, least_share: float = 0.002, contrast: float = 0.3) -> LanguageFilter:
    """Fit the filter on rows ``(doc_id, text, lang)`` with non-null ``lang``.

    ``sample_rows`` bounds the rows of each language that are read, chosen by
    a hash of the id; their whole texts count. A language contains an n-gram
    if ``least_share`` of its rows (three at least, where it has so many) do,
    and if that share is at least ``contrast`` of the n-gram's share in any
    other language. No rows give a filter of no languages.

    There may be any number of languages; the driver holds their names and two
    counts of each. With very many of them the filter gets fewer positions, so
    that it stays within ``FILTER_BYTES`` while that leaves it 4,096; the share
    of false positives then grows, and is taken off as ever.
    """
    spark = labelled.sparkSession
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    words = max(1, -(-len(languages) // 64))
    positions = max(LEAST_POSITIONS, min(POSITIONS, FILTER_BYTES // 8 // power_of_two(words)))
    if not languages:
        return LanguageFilter([], np.zeros((words, positions), _U))
    number = {name: i for i, name in enumerate(languages)}
    table = spark.createDataFrame(
        [(name, number[name], float(sample_rows) / sizes[name]) for name in languages], "lang string, k int, part double"
    )
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") * F.lit(2.0**-53)
    # a name and two numbers of each language; so many names are no larger than the filter
    small = F.broadcast if len(languages) <= MOST_BROADCAST else (lambda x: x)
    sample = labelled.join(small(table), "lang").where(unit < F.col("part")).select("k", "text")

    def count(batches):
        held: dict[int, list[np.ndarray]] = {}
        rows: dict[int, int] = {}
        size = 0

        def emit():
            for k in sorted(rows):
                keys, n = np.unique(np.concatenate([*held.get(k, []), np.zeros(1, _U)]), return_counts=True)
                # the key 0 carries the number of rows
                n[0] = rows[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)],
                    names=["k", "gram", "n"],
                )

        for part in slices(batches):
            for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                keys = np.unique(gram_keys(text or ""))
                held.setdefault(k, []).append(keys[keys != 0])
                rows[k] = rows.get(k, 0) + 1
                size += len(keys)
                if size > 2_000_000:
                    yield from emit()
                    held, rows, size = {}, {}, 0
        yield from emit()

    counted = stage(sample.mapInArrow(tidy(count), "k int, gram long, n long").groupBy("gram", "k").agg(F.sum("n").alias("n")))
    seen = {r["k"]: r["n"] for r in counted.where("gram = 0").collect()}  # one row for each language
    totals = spark.createDataFrame([(k, n) for k, n in seen.items()] or [(-1, 1)], "k int, total long")
    share = F.col("n") / F.col("total")
    kept = (
        counted.where("gram != 0")
        .join(small(totals), "k")
        .where((F.col("n") >= F.least(F.lit(3), F.col("total"))) & (share >= least_share))
        .groupBy("gram")
        .agg(F.collect_list(F.struct("k", share.alias("share"))).alias("of"))  # at most one for each language
        .select(
            "gram",
            F.explode(
                F.filter(
                    "of",
                    lambda x: x["share"] >= contrast * F.array_max(F.transform("of", lambda y: y["share"])),
                )
            ).alias("x"),
        )
        .select("gram", F.col("x.k").alias("k"))
    )
    low, high = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("long"))
    place = F.explode(
        F.array(*[(low + F.lit(i).cast("long") * high).bitwiseAND(F.lit(positions - 1).cast("long")) for i in range(PROBES)])
    )
    slots = (
        kept.select(place.alias("at"), F.floor(F.col("k") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, k % 64)").alias("bit"))
        .groupBy("word", "at")
        .agg(F.bit_or("bit").alias("bits"))
    )
    # as many rows as the filter has words, whatever the corpus holds
    found = slots.toArrow()
    unstage(counted)
    masks = np.zeros((words, positions), _U)
    masks[found["word"].to_numpy(), found["at"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return LanguageFilter(languages, masks)


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows whose crc32 fraction is not 2: ``doc_id, text, lang``."""
    rows = pick(docs, "doc_id", "text", "lang")
    return rows.where(F.col("lang").isNotNull() & (fraction_of_crc(F.col("doc_id")) != 2))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row, from its text alone.

    A null or empty text, and one without letters, is ``und`` with score 0;
    so is every text if the model has no language. Very long texts are read
    whole, in pieces. Ties between languages go to the smaller name. Clashing
    input columns are replaced, others pass through; repeated rows are judged
    alike; an empty table stays empty. The filter (megabytes, whatever the
    corpus) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks))

    def begin():
        judge = LanguageFilter(*shared.value).decide
        return lambda texts: list(zip(*map(judge, texts.to_pylist()), strict=True))

    return add_columns(docs, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], begin)


def keep_identified(docs: DataFrame, model: LanguageFilter, least: float = 0.2) -> DataFrame:
    """The rows whose language is known, with the columns they came with.

    Rejected are ``und`` texts, so all null and empty ones, and those with a
    score below ``least``: fewer of their n-grams than that belong to any
    learned language. Equal texts are judged alike, repeated rows stay
    repeated, very long texts are read whole, an empty table stays empty, and a
    model without languages rejects all.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks))

    def begin():
        judge = LanguageFilter(*shared.value).decide

        def known(part, at):
            found = map(judge, part.column(at).to_pylist())
            return part.filter(pa.array([name != UNDETERMINED and score >= least for name, score in found], pa.bool_()))

        return known

    return same_columns(docs, begin)
