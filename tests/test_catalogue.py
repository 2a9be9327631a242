"""Every registered query of this engine's own against its SQL in DuckDB."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from twinfold.plans.catalogue import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    tidy = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    return sorted([tuple(map(tidy, r)) for r in frame.astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["fingerprint", "canonical", "refs"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_does_not_hide_a_missing_package():
    """Only the absence of the subpackage itself is expected."""
    code = "import sys; sys.modules['ahocorasick'] = None\ntry:\n    import __spark_entry__\nexcept ImportError: sys.exit(0)\nsys.exit(1)"
    if (ROOT / "corpus_pipeline.py").exists():
        subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_without_the_training_data_subpackage():
    """The driver deletes it; everything else must go on."""
    code = (
        "import sys; sys.modules['twinfold.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert 'dedup_exact' in e.queries() and not any(q.startswith('op') for q in e.queries())\n"
        "assert set(e.oracle_sql()) == set(e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
