"""Byte-level BPE by longest matches and backtracking, in linear time.

Token bytes are mapped to Latin-1 so that an Aho-Corasick automaton over
strings finds every token occurrence of a piece in one pass. The encoder takes
the longest token at each place and steps back to a shorter one, or to the
token before, when two adjacent tokens are not what the merges would leave.
Whether two tokens may stand side by side depends on them alone and is
memoised, so the result is the exact merge result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from twinfold.llm.frames import add_columns

#: The white space of the pattern: the Unicode property, not Python's notion.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Letters and numbers that newer Unicode tables have than Unicode 16, by which
#: the tokenizer library splits.
_NEWER_L = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱"
    r"꭬-꭭\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_NEWER_N = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
#: The same classes for texts that Latin-1 can hold.
_LATIN_SPACE, _LATIN_L, _LATIN_N = r"\t-\r\x20\x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"


def split_patterns(pattern: str):
    """Compile a pattern twice: for any text, and a faster form for Latin-1."""

    def filled(space: str, letter: str, number: str, other: str) -> str:
        out = pattern.replace(r"[^\s\p{L}\p{N}]", other)
        return (
            out.replace(r"\s", f"[{space}]")
            .replace(r"\S", f"[^{space}]")
            .replace(r"\p{L}", letter)
            .replace(r"\p{N}", number)
        )

    letter, number = rf"[\p{{L}}--[{_NEWER_L}]]", rf"[\p{{N}}--[{_NEWER_N}]]"
    general = regex.compile(filled(_SPACE, letter, number, f"[^{_SPACE}{letter}{number}]"), regex.V1)
    latin = re.compile(
        filled(_LATIN_SPACE, f"[{_LATIN_L}]", f"[{_LATIN_N}]", f"[^{_LATIN_SPACE}{_LATIN_L}{_LATIN_N}]")
    )
    return general, latin


class BytePairCodec:
    """Encoder and decoder of one vocabulary given as lines ``base64 rank``."""

    #: Pieces up to this many characters are remembered, and this many of them.
    PIECE_CHARS, PIECES, PAIRS = 40, 250_000, 1_000_000
    #: Longer texts are not split into a list of all their pieces first.
    LONG = 1_000_000

    def __init__(self, vocabulary: bytes, pattern: str):
        rows = [line.split() for line in vocabulary.splitlines() if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.any, self.latin = split_patterns(pattern)
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.bytes]
        # the longest token that is a proper prefix, or -1
        self.shorter = [-1] * self.size
        for token, rank in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (found := ranks.get(token[:n], -1)) >= 0:
                    self.shorter[rank] = found
                    break
        self.ranks = ranks
        # the two tokens whose merge gives each token, None for bytes and for
        # what no merge gives; lower ranks first, as parts rank below the whole
        self.parts: list[tuple[int, int] | None] = [None] * self.size
        self.memo: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            left = self.shorter[rank]
            while left >= 0:
                right = ranks.get(token[self.length[left] :], -1)
                if 0 <= right < rank and left < rank and self._apart(left, right, rank):
                    self.parts[rank] = left, right
                    break
                left = self.shorter[left]
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _edge(self, token: int, side: int, limit: int) -> list[tuple[int, int]]:
        """What stands at one edge of a token while it is being merged, in order:
        each part with the rank of the merge that takes it up."""
        out = [(token, limit)]
        while (parts := self.parts[token]) is not None:
            out.append((parts[side], token))
            token = parts[side]
        out.reverse()
        return out

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether the merges of rank below ``limit`` leave ``a`` and ``b`` apart.

        Merges come by rank. As time goes through the ranks, the seam between
        the two has a part of ``a`` on its left and one of ``b`` on its right.
        The seam closes if their own merge comes before the merge that takes
        one of them up; of equal merges the one further left comes first.
        """
        left, right, i, j = self._edge(a, 1, limit), self._edge(b, 0, limit), 0, 0
        text, rank_of = self.bytes, self.ranks.get
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = rank_of(text[x] + text[y])
            if rank is not None and rank < x_ends and rank <= y_ends and rank < limit:
                return False
            if x_ends >= limit and y_ends >= limit:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens that the merges leave of a piece.

        A depth-first search: at each place the longest token is tried first,
        then its shorter prefixes; a token must stay apart from the one before
        it. Tokens that pairwise stay apart are what the merges leave, so the
        way to a place is unique, and a place that no token leads on from is
        dead whatever comes before it.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if not n:
            return []
        length, shorter, memo, never = self.length, self.shorter, self.memo, 1 << 62
        longest = [-1] * n
        # ends come in order, the longest token of each end first, so the last
        # token noted for a start is its longest
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[token] + 1] = token
        path, dead, at, token = [], set(), 0, longest[0]
        while True:
            if token < 0:
                if not path:
                    raise ValueError("the vocabulary lacks single bytes")
                dead.add(at)
                token = path.pop()
                at -= length[token]
                token = shorter[token]
                continue
            end = at + length[token]
            fits = end not in dead
            if fits and path:
                pair = path[-1] << 32 | token
                fits = memo.get(pair)
                if fits is None:
                    if len(memo) >= self.PAIRS:
                        memo.clear()
                    fits = memo[pair] = self._apart(path[-1], token, never)
            if not fits:
                token = shorter[token]
                continue
            path.append(token)
            if end == n:
                return path
            at, token = end, longest[end]

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece not among the recent ones.

        Two generations of recent pieces keep the frequent ones without a
        bound on the vocabulary of the corpus.
        """
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= self.PIECE_CHARS:
            if len(self.pieces) >= self.PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, no special tokens."""
        make, known = self._piece, self.pieces
        try:
            text.encode("latin-1")
            split = self.latin
        except UnicodeEncodeError:
            split = self.any
        if len(text) > self.LONG:
            out = bytearray()
            for m in split.finditer(text):
                out += known.get(m[0]) or make(m[0])
            return bytes(out)
        return b"".join([known.get(p) or make(p) for p in split.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, BytePairCodec] = {}


def codec(vocabulary: bytes, pattern: str) -> BytePairCodec:
    """The codec of a vocabulary, built once in each worker process."""
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = BytePairCodec(vocabulary, pattern)
    return _codecs[key]


def forget() -> None:
    """Drop what the codecs of this worker remember; the vocabularies stay."""
    for c in _codecs.values():
        c.pieces, c.older = {}, {}
        c.memo.clear()


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, decode: bool = False) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (and ``decoded``) to every row.

    Reads ``text``; a null text counts as empty, with no tokens. Every match
    of ``pattern`` in the whole text is encoded separately. Input columns that
    clash with an added one are replaced; all others pass through. Repeated
    rows stay repeated and an empty table stays empty. The vocabulary file (a
    megabyte) is read by the driver and broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    added = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    added += [StructField("decoded", BinaryType())] * decode

    def begin():
        c = codec(vocabulary.value, pattern)

        def columns(texts):
            ids = [c.encode(t) if t else b"" for t in texts.to_pylist()]
            return [[len(x) // 4 for x in ids], ids] + [[c.decode(x) for x in ids]] * decode

        return columns

    return add_columns(docs, added, begin, forget)


def digests(encoded: DataFrame) -> DataFrame:
    """Hexadecimal SHA-256 of the ids and of the decoded bytes."""
    return encoded.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)})
