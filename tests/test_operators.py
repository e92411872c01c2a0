"""Features of sources that the derived corpora do not have, odd rows, and plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import procweave.plans  # noqa: F401  registers the queries
from procweave.functions import dialect as d
from procweave.operators import catalog, changes, edge_cases, extract, graph, plsql, quality_rules, ranking
from procweave.sources.config import AnalysisConfig
from procweave.sources.corpus import last_definitions, list_files, read_sources
from procweave.streaming import logs


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def one(spark, value, **columns):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(*[c.alias(n) for n, c in columns.items()]).first().asDict(recursive=True)


SOURCE = """CREATE OR ALTER PROCEDURE [sales].[usp_Close]
    @OrderId INT,
    @Rate DECIMAL(5,2) = 0.5,
    @Total DECIMAL(18,2) OUTPUT
AS
BEGIN
    -- EXEC usp_NotCalled and FROM NotRead
    DECLARE @proc VARCHAR(100);
    DECLARE @sql NVARCHAR(400);
    CREATE TABLE #CloseLog (
        LogId INT NOT NULL,
        Amount DECIMAL(18,2),
        Note VARCHAR(100)
    );
    BEGIN TRY
        EXEC usp_First @OrderId;
        EXECUTE dbo.usp_Second;
        EXEC usp_First @OrderId;
    END TRY
    BEGIN CATCH
        INSERT INTO ErrorLog (Message) VALUES ('x');
    END CATCH
    WHILE @OrderId > 0
    BEGIN
        SET @OrderId = @OrderId - 1;
    END
    MERGE INTO Totals AS t USING #CloseLog AS s ON t.Id = s.LogId WHEN MATCHED THEN UPDATE SET x = 1;
    SELECT a.x
    FROM [dbo].[Orders] a
    JOIN inserted i ON i.x = a.x;
    IF @Rate > 1
        SET @proc = 'usp_A'
    ELSE
        SET @proc = 'usp_B'
    EXEC @proc;
    SELECT @proc = HandlerName
    FROM Handlers WHERE Id = 1;
    EXEC @proc;
    INSERT INTO Srv.Db.dbo.Copies SELECT 1;
    EXEC Srv.Db.dbo.usp_Remote;
    RETURN;
END"""


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame([(1, SOURCE)], "k int, raw_sql string")


def test_header_and_parameters(source):
    name, schema = extract.procedure_name(F.col("raw_sql"))
    assert source.select(name, schema).first()[:] == ("usp_Close", "sales")
    got = [(r["name"], r["sql_type"], r["direction"], r["default_value"]) for r in rows(extract.parameters(source).orderBy("place"))]
    assert got == [("@OrderId", "INT", "IN", None), ("@Rate", "DECIMAL(5,2)", "IN", "0.5"), ("@Total", "DECIMAL(18,2)", "OUT", None)]


def test_calls_and_tables(source):
    r = source.select(extract.called_procedures(F.col("raw_sql")).alias("c"), extract.referenced_tables(F.col("raw_sql")).alias("t")).first()
    assert r["c"] == ["usp_First", "usp_Second"]
    assert r["t"] == ["ErrorLog", "Totals", "Orders", "Handlers"]


def test_coded_mode_drops_sp_callees(spark):
    df = spark.createDataFrame([("EXEC sp_Run; EXEC usp_Go; EXEC sp_executesql N'x'",)], "s string")
    got = df.select(extract.called_procedures(F.col("s")).alias("d"), extract.called_procedures(F.col("s"), "coded").alias("c")).first()
    assert got["d"] == ["sp_Run", "usp_Go"] and got["c"] == ["usp_Go"]


def test_temp_columns_in_both_modes(source):
    temps = extract.temp_tables(source, "k")
    assert [r["staging_name"] for r in rows(temps)] == ["stg_close_log"]
    assert [r["sql_type"] for r in rows(extract.column_defs(temps, ["k"]).orderBy("place"))] == ["INT", "DECIMAL(18,2)", "VARCHAR(100)"]
    coded = extract.column_defs(extract.temp_tables(source, "k", mode="coded"), ["k"], mode="coded")
    assert [r["sql_type"] for r in rows(coded.orderBy("place"))] == ["INT", "DECIMAL(18"]


def test_blocks_cover_the_body_in_order(source):
    got = rows(extract.logical_blocks(source, "k").orderBy("block"))
    kinds = [r["block_type"] for r in got]
    assert kinds[:5] == ["OTHER", "DECLARATION", "TEMP_TABLE_CREATE", "TRY_CATCH", "WHILE_LOOP"]
    assert got[3]["content"].strip().endswith("END CATCH")
    assert all(a["end_line"] < b["start_line"] for a, b in zip(got, got[1:], strict=False))
    assert {"WHILE_LOOP", "DML_OPERATION", "SELECT_QUERY", "IF_ELSE", "RETURN_BLOCK"} <= set(kinds)


def test_variable_calls(source):
    got = rows(edge_cases.variable_calls(source, "k").orderBy("line"))
    assert [(r["certainty"], r["resolved_targets"], r["condition"]) for r in got] == [
        ("conditional", ["usp_A", "usp_B"], None),
        ("dispatch_table", [], "Handlers.HandlerName"),
    ]


def test_remote_objects_and_report(source):
    linked = edge_cases.linked_servers(source, "k")
    assert [(r["remote_object"], r["operation"]) for r in rows(linked.orderBy("line"))] == [("dbo.Copies", "INSERT"), ("dbo.usp_Remote", "EXEC")]
    report = edge_cases.edge_case_report(linked, edge_cases.dynamic_sql(source, "k"), edge_cases.variable_calls(source, "k"), "k").first()
    assert (report["linked_servers"], report["variable_calls"], report["unresolved_count"]) == (2, 2, 3)


def numbered(spark, *lines):
    return spark.createDataFrame([(1, "\n".join(lines))], "k int, raw_sql string")


def test_exec_of_text_anywhere_in_a_line(spark):
    source = numbered(
        spark,
        "SELECT @sql = 'SELECT 1'",
        "EXEC(@sql); -- run",
        "EXEC(@sql) AT Srv1",
        "IF @x = 1 BEGIN EXEC(@sql) END",
        "SET @a = 'it; ELSE'; SET @b = 'B' + f(@a, ';') -- note",
        "EXEC ( @a ); EXEC(@b)",
        "EXEC('SELECT f(1) ' + CONVERT(VARCHAR(10), ISNULL(LEN(@a), 0))); PRINT ')'",
        "EXEC(@c + ' (' + 'it''s',",
        "EXEC(@none",
    )
    got = [(r["line"], r["expression"], r["tier"], r["resolved_sql"]) for r in rows(edge_cases.dynamic_sql(source, "k").orderBy("line", "expression"))]
    assert got == [
        (2, "@sql", "simple", "SELECT 1"),
        (3, "@sql", "simple", "SELECT 1"),
        (4, "@sql", "simple", "SELECT 1"),
        (6, "@a", "simple", "it; ELSE"),
        (6, "@b", "concatenated", "'B' + f(@a, ';')"),
        (7, "'SELECT f(1) ' + CONVERT(VARCHAR(10), ISNULL(LEN(@a), 0))", "concatenated", None),
    ]


def test_all_assignments_of_a_line(spark):
    source = numbered(
        spark,
        "IF @x = 1 SET @p = 'usp_A' ELSE SET @p = 'usp_B';",
        "EXEC @p;",
        "SET @p = 'usp_C'; SET @p = N'usp_D'",
        "EXEC @p;",
        "SELECT @n = CASE WHEN a = 1 THEN 'x' ELSE 'y' END, @m = COUNT(*) FROM t; SELECT @q = Name FROM dbo.Map",
        "EXEC p @n = 1, @m = 2",
        "SELECT @r = Name",
        "FROM Map2 WHERE Id = 1",
    )
    got = [(r["line"], r["variable"], r["value"], r["kind"]) for r in rows(edge_cases.assignments(source, "k").orderBy("line", "place"))]
    assert got == [
        (1, "@p", "'usp_A'", "literal"),
        (1, "@p", "'usp_B'", "literal"),
        (3, "@p", "'usp_C'", "literal"),
        (3, "@p", "N'usp_D'", "literal"),
        (5, "@n", "CASE WHEN a = 1 THEN 'x' ELSE 'y' END", "expression"),
        (5, "@m", "COUNT(*) FROM t", "expression"),
        (5, "@q", "Map.Name", "table_lookup"),
        (7, "@r", "Map2.Name", "table_lookup"),
    ]
    calls = [(r["certainty"], r["resolved_targets"]) for r in rows(edge_cases.variable_calls(source, "k").orderBy("line"))]
    assert calls == [("conditional", ["usp_A", "usp_B"]), ("resolved", ["usp_D"])]


def test_all_database_links_of_a_line(spark):
    source = numbered(spark, "SELECT * FROM a@l1 JOIN own.b@l2 ON 1 = 1", "x := f@l3 + g@l4;", "-- c@l5")
    got = [(r["line"], r["server"], r["remote_object"], r["operation"]) for r in rows(edge_cases.database_links(source, "k").orderBy("line", "server"))]
    assert got == [(1, "l1", "a", "SELECT"), (1, "l2", "own.b", "SELECT"), (2, "l3", "f", "REFERENCE"), (2, "l4", "g", "REFERENCE")]


def test_cycles_of_any_length_are_reported(spark):
    """A ring of 12, one of 3 that a bridge joins to it, and a self call on the way; the listing stops at 6 calls."""
    ring = [(f"a{i:02}", f"a{(i + 1) % 12:02}") for i in range(12)]
    edges = spark.createDataFrame([*ring, ("a03", "m"), ("m", "b1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("b2", "s"), ("s", "s"), ("top", "a00")], "src string, dst string")
    got = {r["name"]: r["component"] for r in rows(graph.components(edges))}
    assert got == {f"a{i:02}": "a00" for i in range(12)} | {"b1": "b1", "b2": "b1", "b3": "b1", "s": "s"}
    with pytest.warns(UserWarning, match="more than 6 calls"):
        found = {(r["cycle"], r["length"]) for r in rows(graph.cycles(edges, longest=6))}
    assert found == {(" -> ".join(f"a{i % 12:02}" for i in range(13)), 12), ("b1 -> b2 -> b3 -> b1", 3), ("s -> s", 1)}


PACKAGE = """CREATE OR REPLACE PACKAGE BODY pkg_orders IS
FUNCTION total(p_id NUMBER, p_kind IN orders.kind%TYPE DEFAULT 'A') RETURN NUMBER IS
  v_sum NUMBER(18,2);
BEGIN
  FOR r IN (SELECT x FROM items) LOOP
    v_sum := v_sum + r.x;
  END LOOP;
  RETURN v_sum;
END total;
PROCEDURE close_all IS
BEGIN
  BEGIN
    UPDATE orders SET s = 1;
  EXCEPTION
    WHEN OTHERS THEN NULL;
  END;
  CALL pkg_log.write_line('x');
END close_all;
END pkg_orders;"""


def test_packages_are_unwrapped(spark):
    df = spark.createDataFrame([(1, PACKAGE), (2, "CREATE PACKAGE p AS\nPROCEDURE x;\nEND;"), (3, None), (4, "")], "k int, raw_sql string")
    got = plsql.units(df.filter("raw_sql is not null"), "k")
    assert [r["unit"] for r in rows(got.filter("k = 1").orderBy("place"))] == ["pkg_orders.total", "pkg_orders.close_all"]
    assert got.filter("k = 2").count() == 0
    params = rows(plsql.parameters(got.filter("k = 1"), ["unit"]).orderBy("place"))
    assert [(p["name"], p["direction"], p["sql_type"], p["default_value"]) for p in params] == [("p_id", "IN", "NUMBER", None), ("p_kind", "IN", "orders.kind%TYPE", "'A'")]
    calls = {r["unit"]: r["c"] for r in rows(got.filter("k = 1").select("unit", plsql.called(F.col("raw_sql")).alias("c")))}
    assert calls["pkg_orders.close_all"] == ["pkg_log.write_line"]


def test_sources_are_read_from_a_folder(spark, tmp_path):
    (tmp_path / "a.sql").write_bytes(b"\xef\xbb\xbfCREATE PROC usp_A AS\nSELECT 1")
    (tmp_path / "b.sql").write_text("CREATE PROC usp_A AS\nSELECT 2")
    (tmp_path / "c.pkb").write_text("CREATE PACKAGE BODY c AS\nEND;")
    (tmp_path / "d.txt").write_text("none")
    tsql = read_sources(spark, str(tmp_path))
    name, _ = extract.procedure_name(F.col("raw_sql"))
    kept = last_definitions(tsql.withColumn("procedure_name", name)).collect()
    assert len(kept) == 1 and kept[0]["raw_sql"].endswith("SELECT 2")
    assert tsql.filter(F.col("raw_sql").startswith("CREATE")).count() == 2
    assert read_sources(spark, str(tmp_path), "oracle").count() == 3
    listed = {r["name"]: (r["size"], r["lines"]) for r in rows(list_files(spark, str(tmp_path)))}
    assert listed["b.sql"] == (29, 2)
    with pytest.raises(ValueError):
        read_sources(spark, str(tmp_path), "none")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_sources(spark, str(tmp_path / "missing")).count()


def test_graph_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "e"), ("f", "e"), ("g", "g"), ("f", "e")], "src string, dst string")
    names = graph.nodes(edges)
    level = {r["name"]: r["level"] for r in rows(graph.levels(edges, names))}
    assert level == {"e": 0, "f": 1, "a": None, "b": None, "c": None, "d": None, "g": None}
    assert {(r["cycle"], r["length"]) for r in rows(graph.cycles(edges))} == {("a -> b -> c -> a", 3), ("g -> g", 1)}
    assert {r["caller"]: r["distance"] for r in rows(graph.callers(edges, names.filter("name = 'e'")))} == {"d": 1, "f": 1}
    degree = {r["name"]: r["out_degree"] for r in rows(graph.out_degree(edges, names))}
    assert degree["f"] == 2 and degree["e"] == 0
    none = edges.limit(0)
    assert rows(graph.levels(none, graph.nodes(none))) == [] and rows(graph.cycles(none)) == []


def test_numbering_without_one_task(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 11 else None) for i in range(500)], "id long, v double")
    got = {r["id"]: r["n"] for r in rows(ranking.global_row_number(df, "v", ["id"], into="n"))}
    order = sorted(range(500), key=lambda i: (i % 11 == 0, -(i % 7) if i % 11 else 0, i))
    assert got == {i: n for n, i in enumerate(order, 1)}
    assert rows(ranking.global_row_number(df.limit(0), "v", ["id"])) == []


def test_changes_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k int, v string")
    assert {r["k"] for r in rows(changes.delete_where(df, F.col("v") == "a"))} == {2, None}
    new = spark.createDataFrame([(1, None)], "k int, v string")
    assert {(r["k"], r["v"]) for r in rows(changes.update_from(df, new, "k", ["v"]))} == {(1, None), (2, None), (None, "c")}


def test_splits_give_the_text_back(spark):
    texts = ["", "x" * 950, "\n".join("line %d" % i for i in range(300)), "a\n" * 700, "y" * 100 + "\n" + "z" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = rows(quality_rules.split_text(df, ["id"], "text", size=400, overlap=50).orderBy("id", "chunk"))
    for i, text in enumerate(texts):
        mine = [r for r in got if r["id"] == i]
        assert "".join(text[r["begin"] : r["end"]] for r in mine) == text
        assert all(len(r["content"]) <= 400 and r["content"] == text[max(0, r["begin"] - 50 * (r["chunk"] > 0)) : r["end"]] for r in mine)


def test_rules(spark):
    df = spark.createDataFrame([(1, None), (2, "package a.b;\n@Service class X { void run() {} } " + " " * 50 + "// TODO"), (3, "package a;\n@Service class X { void go() { } " + "x" * 50)], "id int, code string")
    rules = quality_rules.structural_rules(F.coalesce(F.col("code"), F.lit("")), F.lit("run"))
    got = {r["id"]: ([i["code"] for i in r["issues"]], r["passed"], r["todo_count"]) for r in rows(quality_rules.apply_rules(df, "code", rules))}
    assert got == {1: (["EMPTY_OUTPUT"], False, 0), 2: (["TODO_FOUND"], True, 1), 3: (["UNBALANCED_BRACES", "MISSING_METHOD"], False, 0)}


def test_dialect_functions(spark):
    v = F.col("v")
    assert one(spark, "abcde", a=d.substr(v, -2), b=d.substr(v, 0, 2), c=d.substr(v, -9), e=d.instr(v, "d"), f=d.decode(v, F.lit("x"), F.lit(1))) == {"a": "de", "b": "ab", "c": None, "e": 4, "f": None}
    assert one(spark, None, a=d.concat(v, F.lit("x")), b=d.plus(v, F.lit("x")), c=d.decode(v, F.lit(None), F.lit("n"), F.lit("o")), e=d.isnull(v, F.lit("z"))) == {"a": "x", "b": None, "c": "n", "e": "z"}
    assert one(spark, "usp_get-orderItems", a=d.pascal_case(d.service_stem(v)), b=d.pascal_case(d.service_stem(v), False), c=d.camel_case(v), e=d.to_number(v)) == {"a": "GetOrderItems", "b": "GetOrderitems", "c": "uspGetOrderItems", "e": None}
    assert d.date_pattern("DD.MM.YYYY HH24:MI:SS") == "dd.MM.yyyy HH:mm:ss"


def test_types(spark):
    got = one(spark, "NUMERIC(10, 2)", a=catalog.target_type(F.col("v")), b=catalog.spark_type(F.col("v")))
    assert got == {"a": "BigDecimal", "b": "decimal(10, 2)"}
    assert one(spark, "varchar2(5)", a=catalog.target_type(F.col("v"))) == {"a": "String"}


def test_config():
    assert AnalysisConfig().with_values({"mode": "coded"}).mode == "coded"
    with pytest.raises(ValueError, match="chunk_sise"):
        AnalysisConfig().with_values({"chunk_sise": 1})


def test_stage_states_and_windows_as_streams(spark, tmp_path):
    data = [(1, "parse", "running", "2024-01-01 00:00:00"), (1, "parse", "completed", "2024-01-01 00:10:00"), (1, "parse", "running", "2024-01-01 00:20:00"), (2, "plan", "running", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(data, "run_id long, stage string, status string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = logs.stage_states(stream).writeStream.outputMode("update").format("memory").queryName("stage_states").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["run_id"], r["status"]) for r in spark.table("stage_states").collect()} == {(1, "completed"), (2, "running")}
    counted = logs.windowed_counts(stream.withColumn("event_type", F.col("status")), width="30 minutes")
    query = counted.writeStream.outputMode("update").format("memory").queryName("window_counts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r["n"] for r in spark.table("window_counts").collect()) == 4
    assert rows(logs.classified(spark.createDataFrame([(" ",), ("Skipped x",), ("all failed",), ("ok",)], "message string")).select("level")) == [{"level": "warning"}, {"level": "error"}, {"level": "info"}]


def test_filters_and_columns_reach_the_scan(spark, small_dir):
    from procweave import registry

    plan = registry.QUERIES["prj_display_expr"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey)" in plan and "o_orderpriority" not in plan
    top = registry.QUERIES["so_top_n"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


# Tables and calls that plain patterns miss or make up


TRICKY = r"""CREATE PROC dbo.usp_T @d INT AS
BEGIN
/* select x FROM Ghost; EXEC usp_Ghost
   FROM Ghost2 */
SELECT 'it''s FROM Str -- no comment', N'EXEC usp_Str' FROM A a, [dbo].[B] AS b WITH (NOLOCK), C; -- FROM Line; EXEC usp_Line
WITH x AS (SELECT 1 AS n FROM D), y (n) AS (SELECT n FROM x) INSERT INTO E SELECT n FROM y LEFT JOIN F ON 1 = 1;
DELETE G WHERE n = 1; DELETE FROM H; UPDATE h SET n = 1 FROM Things h JOIN #tmp t ON t.n = h.n;
MERGE INTO I USING J AS j ON I.n = j.n WHEN MATCHED THEN UPDATE SET n = 1;
FETCH NEXT FROM cur INTO @d;
SELECT n FROM Srv.Db.dbo.Remote; SELECT n FROM inserted
EXEC dbo.usp_Real @d; INSERT K VALUES (1)
END"""


def test_tables_and_calls_in_code_only(spark):
    df = spark.createDataFrame([(1, TRICKY)], "k long, raw_sql string")
    (r,) = rows(df.select(extract.referenced_tables(F.col("raw_sql")).alias("tables"), extract.called_procedures(F.col("raw_sql")).alias("calls")))
    # h is an alias of Things, so DELETE FROM H is taken for it too.
    assert r["tables"] == ["A", "B", "C", "D", "E", "F", "G", "Things", "I", "J", "K"]
    assert r["calls"] == ["usp_Real"]


def test_oracle_tables_in_code_only(spark):
    text = """CREATE OR REPLACE PROCEDURE p IS
BEGIN
  /* SELECT x FROM ghost; */
  SELECT a.id INTO v_n FROM first_tab a, app.second_tab b WHERE a.t = 'FROM str';
  DELETE third_tab WHERE id = 1; DELETE FROM fourth_tab;
  WITH w AS (SELECT 1 n FROM fifth_tab) SELECT n INTO v_n FROM w, dual;
  SELECT n INTO v_n FROM remote_tab@link1;
END;"""
    df = spark.createDataFrame([(1, text)], "k long, raw_sql string")
    (r,) = rows(df.select(plsql.tables(F.col("raw_sql")).alias("tables")))
    assert r["tables"] == ["first_tab", "second_tab", "third_tab", "fourth_tab", "fifth_tab"]


def test_numbers_spread_one_value_over_many_ranges(spark):
    df = spark.range(1000).select(F.lit(7).alias("v"), ((F.col("id") * 37) % 1000).alias("id"))
    got = {r["id"]: r["n"] for r in rows(ranking.global_row_number(df, "v", ["id"], into="n"))}
    assert got == {i: i + 1 for i in range(1000)}
