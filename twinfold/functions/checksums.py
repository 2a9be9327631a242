"""Adler-type checksums: Adler-32, the weak sum of rsync, and rolling by a byte."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from twinfold.functions.bytes import long
from twinfold.functions.lanes import by_value, weighted
from twinfold.operators.lookup import position

_LOW = 0xFFFF
#: Windows in one batch of the result, and bytes summed at once.
PIECE = 1 << 16


def adler32(data: Column) -> Column:
    """Adler-32 as RFC 1950 has it; null for null, 1 for no bytes."""
    return by_value(zlib.adler32, data)


def adler32_rsync(data: Column) -> Column:
    """The weak sum of the rsync report: a plain sum and a weighted one, both
    modulo 2**16, without an offset; 0 for no bytes, null for null."""

    def finish(x):
        import numpy as np

        a = b = 0
        for at in range(0, len(x), 1 << 20):
            part = x[at : at + (1 << 20)].astype(np.int64)
            a += int(part.sum())
            b += int((part * np.arange(len(x) - at, len(x) - at - len(part), -1)).sum()) & 0xFFFF
        return (b & 0xFFFF) * 65536 + (a & 0xFFFF)

    return weighted(data, finish)


def adler32_rolling(checksum: Column, length: Column, leaving: Column, entering: Column) -> Column:
    """The weak sum of a window moved on by one byte.

    ``checksum`` is that of the window so far, of ``length`` bytes, whose first
    byte ``leaving`` goes and behind which ``entering`` comes.
    """
    a = F.pmod(checksum.bitwiseAND(long(_LOW)) - leaving + entering, long(65536))
    b = F.pmod(F.shiftrightunsigned(checksum, 16) - length * leaving + a, long(65536))
    return b * 65536 + a


def rolling_checksums(df: DataFrame, key: str, data: str, length: int) -> DataFrame:
    """Weak sums of all windows of ``length`` bytes: ``(key, at, checksum)``.

    Prefix sums of the bytes and of those sums give every window at once, so no
    window is read twice. All values of a batch are summed together, in pieces
    that bound the memory: the work follows the bytes, however many values they
    make, and a long value is cut within its row. Values shorter than
    ``length`` and null ones have no windows; each row has its own, whether or
    not its key or value is repeated. Other columns are ignored, and the first
    one keeps its name even if that is ``at``.
    """
    if length < 1:
        raise ValueError("windows must have at least one byte")
    k, d = position(df, key), position(df, data)
    rows = df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(
        F.col(f"_{k}").alias("key"), F.col(f"_{d}").cast(BinaryType()).alias("data")
    )
    # only values that have a window go to Python, where they lie end to end
    rows = rows.where(F.octet_length("data") >= length)
    piece = PIECE

    def work(batches):
        import numpy as np

        for batch in batches:
            if not len(batch):
                continue
            values = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            raw = np.frombuffer(values.buffers()[2], np.uint8)
            # stretches of windows of one row: which row, from which window on, and how many
            windows = np.diff(ends) - length + 1
            cuts = -(-windows // piece)
            row = np.repeat(np.arange(len(windows)), cuts)
            at = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * piece
            count = np.minimum(windows[row] - at, piece)
            begin = ends[row] + at
            # as many of them together as have the bytes of a whole piece
            total = np.concatenate(([0], np.cumsum(count + length - 1)))
            i = 0
            while i < len(row):
                j = int(np.searchsorted(total, total[i] + piece + length - 1, "right")) - 1
                part = raw[begin[i] : begin[j - 1] + count[j - 1] + length - 1]
                m = len(part) - length + 1
                # 32 bits may overflow: what is asked for is left modulo 2**16
                sums = np.zeros(len(part) + 1, np.uint32)  # of the bytes before each place
                np.cumsum(part, dtype=np.uint32, out=sums[1:])
                twice = np.cumsum(sums, dtype=np.uint32)
                a = sums[length:] - sums[:m]
                b = twice[length:] - twice[:m] - sums[:m] * np.uint32(length & 0xFFFF)
                # windows across two values are left out
                n = count[i:j]
                before = np.cumsum(n) - n
                step = np.arange(int(n.sum()))
                found = ((b << 16) | (a & 0xFFFF))[np.repeat(begin[i:j] - begin[i] - before, n) + step]
                places = np.repeat(at[i:j] - before, n) + step
                keys = batch.column(0).take(pa.array(np.repeat(row[i:j], n)))
                columns = [keys, pa.array(places.astype(np.int32)), pa.array(found.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "checksum"])
                i = j

    fields = [rows.schema["key"], StructField("at", IntegerType()), StructField("checksum", LongType())]
    return rows.mapInArrow(work, StructType(fields)).toDF(df.columns[k], "at", "checksum")
