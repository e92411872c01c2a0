"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import procweave.plans  # noqa: F401  registers the queries
from procweave import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    return connection


def shown(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    return f"{value:.12g}" if isinstance(value, float) else str(value)


def comparable(frame, columns):
    return sorted((tuple(shown(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, duck, small_dir, key):
    got = registry.QUERIES[key](spark, small_dir).toPandas()
    if key not in registry.ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(registry.ORACLES[key]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert comparable(got, columns) == comparable(want, columns)


def test_entry_has_rows_and_names_match(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """A copy without the llm folders and the pipeline still imports and has its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.parquet"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert said.stdout.split()[-2:] == [str(len(registry.QUERIES)), str(len(registry.ORACLES))]
