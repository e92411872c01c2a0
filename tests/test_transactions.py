"""Transactions: all of the steps or none, row counts, handled and unhandled errors."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from procweave.operators import transactions as t

ROWS = [(1, "a", 10.0), (2, "b", None), (3, None, -5.0), (3, None, -5.0)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "k long, name string, amount double")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_steps_see_what_the_ones_before_made(spark):
    steps = [t.update("raise", F.col("amount") < 0, {"amount": F.col("amount") + 20}), t.delete("drop", F.col("amount") >= 15), t.require("sound", F.col("k") > 0, "no key")]
    out = t.transact(table(spark), steps)
    assert got(out.rows) == [(1, "a", 10.0), (2, "b", None)]
    assert out.committed and out.error is None and out.counts == {"raise": 2, "drop": 2}


def test_a_failing_step_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "shared_folder", lambda _, label: str(tmp_path / label))
    steps = [t.delete("drop", F.col("k") == 1), t.require("known", F.col("amount").isNotNull(), "amount is missing")]
    out = t.transact(table(spark), steps)
    assert got(out.rows) == got(table(spark)) and not out.committed
    assert (out.error, out.state, out.counts) == ("amount is missing", "P0001", {})
    assert not list(tmp_path.iterdir())
    # A null condition does not hold.
    assert t.transact(table(spark), [t.require("positive", F.col("amount") > -9, "small")]).error == "small"


def test_other_errors_have_their_own_states(spark):
    divide = t.Step("divide", lambda rows: rows.withColumn("amount", F.col("amount") / (F.col("k") - 1)))
    out = t.transact(table(spark), [divide])
    assert out.state == "22012" and "DIVIDE_BY_ZERO" in out.error
    with pytest.raises(PySparkException, match="DIVIDE_BY_ZERO"):
        t.transact(table(spark), [divide], states=("P0001",))
    with pytest.raises(PySparkException, match="UNRESOLVED_COLUMN"):
        t.transact(table(spark), [t.delete("drop", F.col("nowhere") == 1)])
    with pytest.raises(ValueError, match="differ"):
        t.transact(table(spark), [t.delete("x", F.lit(True)), t.delete("x", F.lit(True))])


def test_empty_tables_commit(spark):
    out = t.transact(table(spark, []), [t.update("raise", F.lit(True), {"amount": F.lit(1.0)}), t.require("never", F.lit(False), "never")])
    assert out.committed and out.counts == {"raise": 0} and out.rows.isEmpty()


def test_conditions_that_are_null_change_nothing(spark):
    out = t.transact(table(spark), [t.update("u", F.col("amount") > 0, {"name": F.lit("x")}), t.delete("d", F.col("name") == "b")])
    assert out.counts == {"u": 1, "d": 1} and got(out.rows) == got(table(spark, [(1, "x", 10.0), (3, None, -5.0), (3, None, -5.0)]))


def test_halves_of_a_cent_go_to_the_even_one(spark, tmp_path):
    """As the cast of the query's SQL does it: 95 times 100000.30 is 9500028.5."""
    import procweave.plans  # noqa: F401  registers the queries
    from procweave import registry

    spark.sql("SELECT 1L AS o_orderkey, 11L AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("SELECT 1L AS l_orderkey, 100000.30D AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert registry.QUERIES["cf_call_output"](spark, str(tmp_path)).first()["total_amount"] == 9500028
