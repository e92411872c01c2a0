"""Named outputs, keyed upserts and generation by level: what a failure and a second run leave."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from procweave.analysis import generate_by_level
from procweave.sources import sinks


def names_in(spark, folder):
    root, files = sinks.hadoop(spark, str(folder))
    return sorted(f.getPath().getName() for f in files.listStatus(root)) if files.exists(root) else []


def test_named_files_stand_under_their_names(spark, tmp_path):
    df = spark.createDataFrame([("A.java", "class A {}\nmore"), ("b c%é.txt", "x"), (None, "none"), ("", "empty"), ("D.java", None)], "n string, t string")
    assert sinks.write_named(df, str(tmp_path), "n", "t") == 3
    assert names_in(spark, tmp_path) == ["A.java", "D.java", "b c%é.txt"]
    assert (tmp_path / "A.java").read_text() == "class A {}\nmore\n"
    sinks.write_named(df.limit(1).withColumn("t", F.lit("new")), str(tmp_path), "n", "t")
    assert (tmp_path / "A.java").read_text() == "new\n" and (tmp_path / "b c%é.txt").exists()


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    df = spark.range(20).select(F.concat(F.lit("f"), "id").alias("n"), F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("t"))
    with pytest.raises(Exception, match="no"):
        sinks.write_named(df, str(tmp_path), "n", "t")
    assert names_in(spark, tmp_path) == []


def shown(df):
    return sorted(((r["k"], r["a"], r["b"]) for r in df.collect()), key=str)


def test_upserts_merge_by_key_and_touch_only_their_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "g"), "k string, a string, b int"
    assert sinks.read_upserted(spark, path, schema).count() == 0
    first = spark.createDataFrame([(f"k{i}", "x", i) for i in range(300)] + [(None, "null", 1)], schema)
    assert sinks.upsert(first, path, ["k"]) == 0
    _, before = sinks.manifest_of(spark, path)
    second = spark.createDataFrame([("k5", "y", None), ("new", None, 7), ("k5", "y", None)], schema)
    assert sinks.upsert(second, path, ["k"]) == 1
    _, after = sinks.manifest_of(spark, path)
    want = [(f"k{i}", "y" if i == 5 else "x", i) for i in range(300)] + [(None, "null", 1), ("new", None, 7)]
    assert shown(sinks.read_upserted(spark, path, first.schema)) == sorted(want, key=str)
    changed = [b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)]
    assert 1 <= len(changed) <= 2


def test_a_failure_leaves_the_version_before(spark, tmp_path):
    path, schema = str(tmp_path / "g"), "k string, a string, b int"
    rows = spark.createDataFrame([("a", "x", 1)], schema)
    sinks.upsert(rows, path, ["k"])
    bad = spark.range(3).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise("q").cast("string").alias("a"), F.lit(1).alias("b"))
    with pytest.raises(Exception, match="broken"):
        sinks.upsert(bad, path, ["k"])
    assert shown(sinks.read_upserted(spark, path, rows.schema)) == [("a", "x", 1)]
    # A second writer that read the same version cannot replace the first one's manifest.
    target, files = sinks.hadoop(spark, f"{path}/_manifest/1.json")
    files.create(target, False).close()
    with pytest.raises(Exception, match="exist|1.json"):
        out = files.create(target, False)
        out.close()


def test_levels_see_what_callees_became_and_are_not_repeated(spark, tmp_path):
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "x"), ("d", "c"), ("r", "s"), ("s", "r")], "src string, dst string")
    planned = spark.createDataFrame([("a", 0, True), ("x", 0, False), ("b", 1, True), ("c", 2, True), ("d", 3, True), ("r", None, True), ("s", None, True)], "name string, level long, defined boolean")
    prompts = spark.createDataFrame([(n, n) for n in "abcdrs"], "procedure_name string, prompt string")

    def write(prompt):
        if prompt.startswith("b"):
            raise ValueError("no b")
        return f"<{prompt}>"

    def never(prompt):
        raise ValueError("again")

    folder = str(tmp_path / "out")
    rows = {r["name"]: r for r in generate_by_level(planned, prompts, calls, write, folder).collect()}
    assert rows["a"]["output"] == "<a>" and rows["x"]["outcome"] == "skipped"
    assert rows["b"]["outcome"] == "failed" and rows["b"]["error"] == "ValueError: no b"
    assert rows["c"]["output"] == "<c\nfailed b\nskipped x>" and rows["d"]["output"] == "<d\nmigrated c>"
    assert rows["r"]["output"] == "<r\nunknown s>" and rows["r"]["level"] is None
    sinks.hadoop(spark, folder)[1].delete(sinks.hadoop(spark, f"{folder}/level=3")[0], True)
    again = {r["name"]: r for r in generate_by_level(planned, prompts, calls, never, folder).collect()}
    assert again["a"]["output"] == "<a>" and again["c"]["output"] == rows["c"]["output"]
    assert again["d"]["outcome"] == "failed" and again["d"]["error"] == "ValueError: again"
    nothing = planned.filter("level > 9")
    assert generate_by_level(nothing, prompts, calls, write, str(tmp_path / "none")).count() == 0
