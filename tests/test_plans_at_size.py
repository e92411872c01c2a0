"""What plans may not do with long tables: make expressions twice, one group or one task for what is many."""

from __future__ import annotations

import contextlib
import io
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from procweave.analysis import analyze_procedures, generate_in_chunks
from procweave.operators import edge_cases, extract, graph, structure

TEXT = "CREATE PROCEDURE p @a INT\nAS\nBEGIN\n  IF @a = 1\n  BEGIN\n    SET @a = 2;\n  END\nEND"


def plan_of(df) -> str:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain("extended")
    return said.getvalue().split("== Optimized Logical Plan ==")[1]


def texts(spark):
    return spark.createDataFrame([(1, TEXT), (2, TEXT)], "k int, raw_sql string")


def test_lines_and_events_are_made_once(spark):
    """No filter on the size of what is exploded: that would make all of it a second time, before rows are dealt."""
    for df in (extract.logical_blocks(texts(spark), "k"), structure.block_tree(texts(spark), "k")):
        filters = [line for line in plan_of(df).splitlines() if "Filter" in line]
        assert not [f for f in filters if "size(" in f]


def test_rows_of_a_text_are_not_shuffled(spark):
    """Windows over lines and tokens find them dealt by the key already: one shuffle, of the texts."""
    for df in (extract.logical_blocks(texts(spark), "k"), structure.statements(texts(spark), "k")):
        assert plan_of(df).split("== Physical Plan ==")[1].count("Exchange hashpartitioning(k") == 1


def test_block_tree_names_the_lines_of_parents(spark):
    got = structure.block_tree(texts(spark), "k").filter("k = 1").orderBy("node").collect()
    assert [(r["start_line"], r["parent_line"]) for r in got] == [(3, None), (4, 3), (5, 4), (6, 5)]


def test_chunks_pass_as_a_stream(spark):
    """Procedures over several batches, out of order, with an error in the middle of one and a null key; no group a procedure."""
    rows = [(k, c, f"{k}-{c}", p) for k in (None, *range(40)) for c, p in ((2, "last"), (0, "first"), (1, "middle"))]
    df = spark.createDataFrame(rows, "k long, chunk long, sql_content string, position string")

    def write(text, position, before):
        if text == "7-1":
            raise ValueError("no")
        return f"{before}{text}/"

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        made = generate_in_chunks(df, write, "k")
        assert "FlatMapGroups" not in plan_of(made)
        got = {r["k"]: (r["output"], r["error"]) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {k: (f"{k}-0/\n{k}-0/{k}-1/\n{k}-0/{k}-1/{k}-2/\n", None) for k in (None, *range(40))}
    assert got == want | {7: (None, "ValueError: no")}


def test_calls_by_variable_send_no_table_through_the_driver(spark):
    calls = plan_of(edge_cases.variable_calls(texts(spark), "k")).split("== Physical Plan ==")[1]
    assert "BroadcastExchange" not in calls and "SortMergeJoin" in calls


def test_tokens_of_a_statement_text_are_no_rows(spark):
    """A text's tokens stay in its row: no window, no sort and no group of them."""
    plan = plan_of(structure.statements(texts(spark), "k")).split("== Physical Plan ==")[1]
    assert "Window" not in plan and "Aggregate" not in plan and "Sort" not in plan


def test_long_statements_keep_their_depths(spark):
    """Several stretches of the fold, within one statement and over a text's statements."""
    items = ", ".join(f"({i}, CASE WHEN (@a) = {i} THEN 1 END)" for i in range(200))
    text = f"CREATE PROCEDURE p @a INT AS BEGIN INSERT INTO t VALUES {items}; " + "SET @a = (1); " * 700 + "EXEC @a END"
    got = structure.statements(spark.createDataFrame([(1, text)], "k int, raw_sql string"), "k").orderBy("at").collect()
    assert [r["word"] for r in got] == ["BEGIN", "INSERT", *["SET"] * 700, "EXEC", "END"]
    toks = got[1]["toks"]
    assert [t["at"] for t in toks] == list(range(toks[0]["at"], toks[0]["at"] + len(toks)))
    assert {(t["paren"], t["cases"]) for t in toks if t["word"] in ("THEN", "END")} == {(1, 1), (1, 0)} and toks[-1]["paren"] == 0


def test_rounds_of_callers_send_no_table_through_the_driver(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c")], "src string, dst string")
    got = graph.callers(edges, spark.createDataFrame([("a",)], "name string")).collect()
    assert sorted((r["caller"], r["distance"]) for r in got) == [("b", 1), ("c", 2), ("d", 3)]
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)


def test_events_are_found_over_whole_batches(spark):
    """Not by a fold whose steps are interpreted token by token."""
    plan = plan_of(structure.statements(texts(spark), "k"))
    assert "aggregate(" not in plan and "ArrowEvalPython" in plan


def own_by_walk(words):
    """The events of a text's words by a plain walk: (at, [(paren, cases) of its tokens])."""
    word = lambda i: words[i] if 0 <= i < len(words) else ";"
    paren, cases, last, out = 0, 0, "", []
    inside = not {"PROC", "PROCEDURE", "FUNCTION", "TRIGGER"} & set(words[:8])
    for i, w in enumerate(words):
        starts = {"WITH": word(i + 1) != "(" and word(i + 2) in ("AS", "("), "UPDATE": word(i + 1) != "(", "FETCH": word(i - 1) not in ("ROW", "ROWS")}.get(w, True) and word(i - 1) not in (*structure.WITHIN, "THEN")
        marks = starts if w in structure.TSQL_STARTS else word(i - 1) not in structure.OBJECTS if w == "IF" else w in (";", "END", "VALUES", "ELSE", "WHILE", "BEGIN")
        mark = marks and inside and paren == 0 and cases == 0
        goes_on = (w in ("SELECT", "EXEC", "EXECUTE") and last == "INSERT") or (w == "SET" and last in ("UPDATE", "MERGE")) or (w in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE") and last == "WITH")
        inside = inside or (w == "AS" and not word(i - 1).startswith("@") and word(i - 1) not in ("EXEC", "EXECUTE") and paren == 0)
        cases = max(cases + (w == "CASE") - (w == "END" and word(i + 1) != "CONVERSATION"), 0)
        if mark:
            last = w
            if w not in (";", "VALUES") and not goes_on:
                out.append((i, []))
        if out:
            out[-1][1].append((paren - (w == ")"), cases))
        paren += (w == "(") - (w == ")")
    return out


def test_events_equal_a_plain_walk(monkeypatch):
    """Random words, empty and null texts, in one run and in runs of few tokens."""
    rng = random.Random(7)
    some = "SELECT SET @a = ( ) , ; CASE END ELSE IF WHILE BEGIN AS WITH x UPDATE INSERT VALUES EXEC FETCH ROWS DELETE MERGE DROP TABLE THEN CONVERSATION PROC RETURN".split()
    all_ = [None, [], *([rng.choice(some) for _ in range(rng.randint(0, 60))] for _ in range(400)), None]
    toks = pa.array([{"line": 1, "raw": w.lower(), "word": w} for t in all_ for w in t or []], pa.struct([("line", pa.int32()), ("raw", pa.string()), ("word", pa.string())]))
    want = [own_by_walk(t or []) for t in all_]
    for run in (structure.RUN, 100):
        monkeypatch.setattr(structure, "RUN", run)
        sizes = np.array([len(t or []) for t in all_])
        at = lambda n: int(sizes[:n].sum())
        made = [e for a, b in structure.runs_of(sizes) for e in structure.own_tokens(toks.slice(at(a), at(b) - at(a)), sizes[a:b]).to_pylist()]
        assert [[(e[0]["at"], [(t["paren"], t["cases"]) for t in e]) for e in events] for events in made] == want
        assert all(t["word"] == all_[n][t["at"]] and t["raw"] == t["word"].lower() for n, events in enumerate(made) for e in events for t in e)


def test_texts_without_four_part_names_are_not_taken_apart(spark):
    """Dots, comments and quoted names in all layouts: as found in the code's lines, and by the first look at the text."""
    rng = random.Random(3)
    some = ["FROM", "EXEC", "srv", "db", "[a.b]", '"c d"', ".", ".", ".", ".", " ", "\n", "\r\n", "/* . */", "-- . .\n", "--x\r", "'. '", "N'a'", "[", '"', "=", ",", "/", "*", "-", "]"]
    made = ["".join(rng.choice(some) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for gap in ("", " ", "/* [ */", " /* ' */ "):
        names = [("s", "d", "o", "t"), ("[s.x]", "d", "", "t"), ('"s s"', "", "", "[t]"), ("sN", "Nd", "N", "Nt")]
        made += ["SELECT 1 -- '\n FROM " + f"{gap}.{gap}".join(n) + " x" for n in names]
    rows = spark.createDataFrame(list(enumerate(made)), "k int, raw_sql string")
    lines = edge_cases.code_lines(rows, "k", "raw_sql").filter(F.rlike("content", F.lit(edge_cases.LINKED)))
    want = {r["k"] for r in lines.select("k").collect()}
    assert len(want) >= 16 and {r["k"] for r in edge_cases.linked_servers(rows, "k").select("k").collect()} == want
    assert edge_cases.linked_servers(texts(spark), "k").count() == 0
    assert "RLIKE(raw_sql" in plan_of(edge_cases.linked_servers(texts(spark), "k"))


def test_queries_run_only_what_their_rows_need(spark, small_dir, monkeypatch):
    """No statements for remote servers or tables alone, and no more texts than a report is of."""
    from procweave.plans import edge_cases as plans
    from procweave.plans import graph as graphs

    asked = []
    monkeypatch.setattr(edge_cases, "kept", lambda df, label: asked.append(df.select("k").distinct().count()) or df)
    graphs.linked_report(spark, small_dir), graphs.ref_tables(spark, small_dir), graphs.unique_nodes(spark, small_dir)
    assert asked == []
    plans.by_procedure(spark, small_dir)
    assert asked == [2]
    monkeypatch.setattr(edge_cases, "linked_servers", lambda *a, **b: 1 / 0)
    graphs.unresolved_report(spark, small_dir), graphs.procedure_nodes(spark, small_dir)
    assert len(asked) == 3


def test_tokens_of_batches_equal_those_of_texts(spark):
    """Literals over lines, doubled and open quotes, empty and null texts: as the tokens that become rows, and no lambda for each token."""
    rng = random.Random(13)
    some = ["SELECT", "N'a''b'", "'x\n\ny'", "'", "xN'1'", "'5'", "\n", "\t", " ", "[n 'q']", '"d"', "--c '\n", "/* ' */", "@a", "é", "ß", "BEGIN", "IN", "N", "-", "''", "."]
    made = [None, "", *["BEGIN " + "".join(rng.choice(some) for _ in range(rng.randint(1, 40))) for _ in range(500)]]
    rows = spark.createDataFrame(list(enumerate(made)), "k int, raw_sql string")
    want = sorted((r["k"], r["line"], r["at"], r["raw"], r["word"]) for r in structure.tokens(rows, "k").collect())
    got = structure.statements(rows, "k").select("k", F.inline("toks")).collect()
    assert sorted((r["k"], r["line"], r["at"], r["raw"], r["word"]) for r in got) == want and len(want) > 3000
    assert "upper(" not in plan_of(structure.statements(texts(spark), "k"))


def test_an_analysis_traces_its_calls_once(spark):
    """Edges and nodes read the calls by variable that are written, and do not find them again."""
    result = analyze_procedures(texts(spark).select(F.concat(F.lit("p"), "k").alias("procedure_name"), "raw_sql"))
    for df in (result.edges, result.nodes):
        assert "SortMergeJoin" not in plan_of(df)
    assert {r["name"] for r in result.nodes.collect()} == {"p1", "p2"}


def test_edge_cases_are_those_of_all_procedures(spark, small_dir, monkeypatch):
    """By procedure, and of every procedure: none is left out of the corpus, its statements or the rows."""
    from procweave.plans import edge_cases as plans

    asked, keys = [], [r["p_partkey"] for r in spark.read.parquet(f"{small_dir}/part.parquet").select("p_partkey").collect()]
    monkeypatch.setattr(edge_cases, "kept", lambda df, label: asked.append(df.select("k").distinct().count()) or df)
    got = {r["k"]: r["unresolved_count"] for r in plans.by_procedure(spark, small_dir).collect()}
    some = [k for k in keys if k % 4 or k % 8 == 0 or k % 6 == 5 or k % 9 == 4 or k % 10 in (7, 9)]
    assert asked == [len(keys)] and len(some) > 100
    assert got == {k: (k % 4 == 3) + (k % 4 == 2) + (k % 10 in (7, 9)) for k in some}
