"""Byte-level folds over whole Arrow batches, as vectors of 32-bit lanes.

A fold over the bytes of one value is a chain of dependent steps. Batches hold
many values, so a step is taken for all of them at once: byte ``j`` of every
value that is that long. The few values that are longer than the others are
finished one by one, so no step is spent on an empty lane. Folds that are sums
of weighted bytes need no chain at all.

The functions run in Python workers, which need nothing of this package: they
are sent by value, with what they use.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Fewer values than this are worth no vector step.
FEW = 24


def by_value(work: Callable, data: Column) -> Column:
    """``work(bytes) -> int`` of every value; null for null."""

    @arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else work(v) for v in column.to_pylist()], pa.int64())

    return run(data.cast("binary"))


def chained(data: Column, start: Callable, step: Callable, few: int = FEW) -> Column:
    """Fold ``step(h, c, j)`` over the bytes of every value; null for null.

    ``start(lengths)`` gives the first states, for one length as for a vector;
    ``step`` gets them with the bytes at place ``j`` and must leave 32 bits,
    working on vectors of 64 bits as on numbers.
    """

    @arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        import numpy as np

        values = column.cast(pa.large_binary())
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        held = values.buffers()[2]
        raw = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        begin, size = ends[:-1], np.diff(ends)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        h = np.zeros(len(size), np.int64)
        h[:] = start(size)
        # how many values have more than j bytes
        j, alive = 0, len(size)
        while True:
            while alive and size[alive - 1] <= j:
                alive -= 1
            if alive < few:
                break
            h[:alive] = step(h[:alive], raw[begin[:alive] + j].astype(np.int64), j)
            j += 1
        for i in range(alive):
            x = int(h[i])
            for k, c in enumerate(raw[begin[i] + j : begin[i] + size[i]].tobytes(), j):
                x = step(x, c, k)
            h[i] = x
        out = np.empty(len(size), np.int64)
        out[order] = h
        return pa.array(out, mask=np.asarray(column.is_null()))

    return run(data.cast("binary"))


def weighted(data: Column, finish: Callable) -> Column:
    """``finish(bytes as a vector)`` of every value, for folds that are sums."""

    @arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array(
            [None if v is None else int(finish(np.frombuffer(v, np.uint8))) for v in column.to_pylist()], pa.int64()
        )

    return run(data.cast("binary"))
