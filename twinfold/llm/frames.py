"""Frame helpers shared by the training-data operators.

Column picking that survives clashing names and tables staged in the shared
folder of the cluster come from the rest of the package; here is how workers
get the package, and how they read texts in batches of bounded size.
"""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from twinfold.operators.lookup import pick, position
from twinfold.sources.staging import scope, stage, unstage

__all__ = ["add_columns", "pick", "position", "power_of_two", "release", "same_columns", "scope", "ship", "slices", "stage", "tidy", "unstage"]

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_twinfold_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="twinfold-ship-")
    archive = os.path.join(folder, "twinfold_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((_ROOT / "twinfold").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(archive)
    sc._twinfold_shipped = True


def release() -> None:
    """Give memory that this worker process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(work, *forget):
    """Wrap a function of batches so that no task leaves memory behind.

    Worker processes serve one task after another, of this stage and of later
    ones; what a task remembers to be fast is forgotten when it ends.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            for f in forget:
                f()
            release()

    return run


def power_of_two(least: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, least))))


def slices(batches, most_rows: int = 1024, most_bytes: int = 16 << 20):
    """Cut Arrow batches so that one slice stays small whatever its texts hold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(most_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _by_place(docs: DataFrame) -> DataFrame:
    """The same rows with columns named by their place, so that no names clash."""
    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])


def add_columns(
    docs: DataFrame,
    added: list[StructField],
    begin: Callable[[], Callable[[pa.Array], list]],
    *forget: Callable[[], None],
    most_rows: int = 1024,
    most_bytes: int = 16 << 20,
) -> DataFrame:
    """Every row with columns computed from its ``text``.

    ``begin`` is called once in each task and gives the function from some
    texts to the added columns. Input columns named like an added one, in any
    case, are replaced; all others pass through, whatever their names.
    """
    at, taken = position(docs, "text"), {f.name.lower() for f in added}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in taken]
    schema = StructType([StructField(f"_{i}", docs.schema.fields[i].dataType) for i in kept] + added)
    arrow = to_arrow_schema(schema)

    def work(batches):
        columns_of = begin()
        for part in slices(batches, most_rows, most_bytes):
            made = columns_of(part.column(at))
            same = [part.column(i).cast(arrow.field(k).type) for k, i in enumerate(kept)]
            new = [pa.array(c, arrow.field(f.name).type) for f, c in zip(added, made, strict=True)]
            yield pa.RecordBatch.from_arrays(same + new, schema=arrow)

    out = _by_place(docs).mapInArrow(tidy(work, *forget), schema)
    return out.toDF(*[docs.columns[i] for i in kept], *[f.name for f in added])


def same_columns(
    docs: DataFrame,
    begin: Callable[[], Callable[[pa.RecordBatch, int], pa.RecordBatch]],
    *forget: Callable[[], None],
    most_rows: int = 1024,
    most_bytes: int = 16 << 20,
) -> DataFrame:
    """Some or all rows with the columns they came with, whatever their names.

    The function that ``begin`` gives takes a batch and the place of ``text``.
    """
    at = position(docs, "text")
    plain = _by_place(docs)
    arrow = to_arrow_schema(plain.schema)

    def work(batches):
        change = begin()
        for part in slices(batches, most_rows, most_bytes):
            done = change(part, at)
            columns = [c.cast(f.type) for c, f in zip(done.columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return plain.mapInArrow(tidy(work, *forget), plain.schema).toDF(*docs.columns)
