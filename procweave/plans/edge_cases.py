"""Edge-case and PL/SQL queries over corpora derived from parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.operators import edge_cases as ec
from procweave.operators import plsql as px
from procweave.operators import structure
from procweave.operators.names import table_references
from procweave.plans.extraction import WITH, corpus, scoped_corpus, scoped_sql
from procweave.registry import query
from procweave.session import spread, table
from procweave.sources.corpus import BRANCHES, ORACLE_UNITS, TSQL_CORPUS, branchy_corpus, lines_of, oracle_corpus

#: The corpus's lines in DuckDB, from 1.
LINES = f"{WITH}, ls AS (SELECT k, unnest(c) AS s, generate_subscripts(c, 1) AS line FROM (SELECT k, string_split(replace(raw_sql, chr(13), ''), chr(10)) AS c FROM corpus))"


def branchy(spark, sf_dir):
    return branchy_corpus(spread(table(spark, sf_dir, "part").select("p_partkey")))


@query("ec_linked", f"""{LINES} SELECT k, line::BIGINT AS line, regexp_extract(s, '(Srv\\d)', 1) AS server, 'Db' AS database, 'dbo.' || regexp_extract(s, '(Remote\\d+)', 1) AS remote_object,
'SELECT' AS operation FROM ls WHERE contains(s, '.Db.dbo.')""")
def linked(spark, sf_dir):
    return ec.linked_servers(corpus(spark, sf_dir), "k")


@query("ec_operation", f"{LINES} SELECT k, line::BIGINT AS line, 'UNKNOWN' AS operation FROM ls WHERE regexp_matches(s, '^\\s*SELECT \\* FROM Srv')")
def operation_coded(spark, sf_dir):
    """The coded rule looks before the keyword, so it does not know the operation."""
    return ec.linked_servers(corpus(spark, sf_dir), "k", mode="coded").select("k", "line", "operation")


@query("ec_dyn_exec", f"""{LINES} SELECT k, line::BIGINT AS line, '@sql' AS expression, CASE WHEN k % 4 = 1 THEN 'simple' ELSE 'concatenated' END AS tier,
CASE WHEN k % 4 = 1 THEN 'SELECT 1' ELSE '''SELECT * FROM '' + @Mode' END AS resolved_sql FROM ls WHERE regexp_matches(s, 'EXEC ?\\(@sql\\)')""")
def dyn_exec(spark, sf_dir):
    return ec.dynamic_sql(corpus(spark, sf_dir), "k").filter("tier <> 'templated'")


@query("ec_dyn_spexec", f"""{LINES} SELECT k, line::BIGINT AS line, 'N''SELECT @a''' AS expression, 'templated' AS tier, 'SELECT @a' AS resolved_sql FROM ls WHERE contains(s, 'sp_executesql')""")
def dyn_spexec(spark, sf_dir):
    return ec.dynamic_sql(corpus(spark, sf_dir), "k").filter("tier = 'templated'")


@query("ec_trace_last", f"""{LINES}, uses AS (SELECT k, line, regexp_extract(s, 'EXEC ?\\(?(@\\w+)', 1) AS variable FROM ls WHERE regexp_matches(s, 'EXEC ?\\(?@\\w+')),
sets AS (SELECT k, line, regexp_extract(s, 'SET (@\\w+) =', 1) AS variable, rtrim(regexp_extract(s, 'SET @\\w+ = (.*)$', 1), ';') AS value FROM ls WHERE contains(s, 'SET @'))
SELECT u.k, u.line::BIGINT AS line, u.variable, arg_max(value, sets.line) AS traced FROM uses u LEFT JOIN sets ON sets.k = u.k AND sets.variable = u.variable AND sets.line < u.line
GROUP BY u.k, u.line, u.variable""")
def trace_last(spark, sf_dir):
    pattern = r"EXEC ?\(?(@\w+)"
    rows = lines_of(corpus(spark, sf_dir)).filter(F.rlike("content", F.lit(pattern)))
    uses = rows.select("k", "line", F.regexp_extract("content", pattern, 1).alias("variable"))
    sets = ec.assignments(corpus(spark, sf_dir), "k").filter("kind <> 'table_lookup'")
    return ec.trace_last(uses, sets, "k")


@query("ec_trace_all", f"""WITH RECURSIVE {BRANCHES}
SELECT DISTINCT w.k, w.line::BIGINT AS line, '@p' AS variable, f.value FROM walk w JOIN flow f ON f.k = w.k AND f.line = w.def WHERE w.uses AND w.def > 0""")
def trace_all(spark, sf_dir):
    """The assignments that reach the calls by variable of nested code."""
    rows = branchy(spark, sf_dir)
    found = ec.statement_table(rows, "k")
    uses = ec.executions(found, "k").filter("variable is not null").select("k", "line", "at", "variable")
    return ec.trace_all(uses, ec.assignments(rows, "k", found=found), found, "k").filter("a_line is not null").select("k", "line", "variable", "value")


@query("tx_block_tree", f"""WITH RECURSIVE {BRANCHES}
SELECT t.k, t.line::BIGINT AS start_line, t.last::BIGINT AS end_line, t.kind AS block_type, count(o.line)::BIGINT AS depth, max(o.line)::BIGINT AS parent_line
FROM tree t LEFT JOIN tree o ON o.k = t.k AND o.line < t.line AND o.last >= t.line AND o.last > o.line GROUP BY ALL""")
def block_tree(spark, sf_dir):
    """Every statement and construct of nested code, with the line that its parent begins on."""
    return structure.block_tree(branchy(spark, sf_dir), "k").select("k", "start_line", "end_line", "block_type", "depth", "parent_line")


@query("ec_var_call", f"""WITH RECURSIVE {TSQL_CORPUS.strip()}, {BRANCHES}, ls AS (SELECT k, unnest(c) AS s, generate_subscripts(c, 1) AS line FROM (SELECT k, string_split(replace(raw_sql, chr(13), ''), chr(10)) AS c FROM corpus)),
u AS (SELECT k, line, regexp_extract(s, 'EXEC (@\\w+)', 1) AS variable FROM ls WHERE regexp_matches(s, 'EXEC @\\w+')),
reach AS (SELECT DISTINCT w.k, w.line, w.def, f.value FROM walk w LEFT JOIN flow f ON f.k = w.k AND f.line = w.def WHERE w.uses),
folded AS (SELECT k, line, bool_or(def = 0) AS start, count(value) AS n, bool_or(contains(value, 'CASE')) AS other, string_agg(trim(value, ''''), ',' ORDER BY def) AS targets FROM reach GROUP BY k, line)
SELECT k, line::BIGINT AS line, variable, CASE variable WHEN '@proc' THEN 'resolved' WHEN '@step' THEN 'conditional' WHEN '@act' THEN 'dispatch_table' ELSE 'opaque' END AS certainty,
CASE variable WHEN '@proc' THEN 'usp_P' || (k // 3) WHEN '@step' THEN 'usp_P1,usp_P2' ELSE '' END AS targets, CASE variable WHEN '@act' THEN 'ActionMap.ProcName' END AS condition FROM u
UNION ALL SELECT k, line::BIGINT, '@p', CASE WHEN n = 0 OR other THEN 'opaque' WHEN n = 1 AND NOT start THEN 'resolved' ELSE 'conditional' END,
CASE WHEN n = 0 OR other THEN '' ELSE targets END, NULL FROM folded""")
def var_call(spark, sf_dir):
    """What calls by variable may run, in plain and in nested code."""
    calls = ec.variable_calls(corpus(spark, sf_dir), "k").unionByName(ec.variable_calls(branchy(spark, sf_dir), "k"))
    return calls.select("k", "line", "variable", "certainty", F.array_join("resolved_targets", ",").alias("targets"), "condition")


@query("ec_value_class", f"""{LINES} SELECT k, line::BIGINT AS line, CASE WHEN regexp_matches(s, '= ''[^'']*'';$') THEN 'literal' ELSE 'expression' END AS kind FROM ls WHERE regexp_matches(s, 'SET @\\w+ = ')
UNION ALL SELECT k, line, 'table_lookup' FROM ls WHERE contains(s, 'SELECT @act')""")
def value_class(spark, sf_dir):
    return ec.assignments(corpus(spark, sf_dir), "k").select("k", "line", "kind")


REPORT = """SELECT k, (k % 4 = 3)::BIGINT AS linked_servers, ((k % 4 IN (1, 2))::INT + (k % 8 = 0)::INT)::BIGINT AS dynamic_sql,
((k % 6 = 5)::INT + (k % 9 = 4)::INT + (k % 10 IN (7, 9))::INT)::BIGINT AS variable_calls,
((k % 4 = 3)::INT + (k % 4 = 2)::INT + (k % 10 IN (7, 9))::INT)::BIGINT AS unresolved_count FROM corpus"""


def report(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    found = ec.statement_table(rows, "k")
    return ec.edge_case_report(ec.linked_servers(rows, "k"), ec.dynamic_sql(rows, "k", found=found), ec.variable_calls(rows, "k", found=found), "k")


@query("ec_detect", f"{WITH}, r AS ({REPORT}) SELECT * FROM r WHERE linked_servers + dynamic_sql + variable_calls > 0")
def detect(spark, sf_dir):
    return report(spark, sf_dir)


@query("ec_detect_all", f"""{WITH}, r AS ({REPORT}) SELECT sum(linked_servers)::BIGINT AS linked_servers, sum(dynamic_sql)::BIGINT AS dynamic_sql,
sum(variable_calls)::BIGINT AS variable_calls, sum(unresolved_count)::BIGINT AS unresolved_count FROM r""")
def detect_all(spark, sf_dir):
    names = ("linked_servers", "dynamic_sql", "variable_calls", "unresolved_count")
    return report(spark, sf_dir).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


@query("flt_unresolved", f"""{WITH}, r AS ({REPORT}) SELECT k, unresolved_count FROM r WHERE unresolved_count > 0""")
def unresolved(spark, sf_dir):
    return report(spark, sf_dir).filter("unresolved_count > 0").select("k", "unresolved_count")


@query("flt_by_procedure", f"{WITH}, r AS ({REPORT}) SELECT * FROM r WHERE linked_servers + dynamic_sql + variable_calls > 0")
def by_procedure(spark, sf_dir):
    """What was found in each procedure; those without edge cases have no row."""
    return report(spark, sf_dir)


@query("ec_route", f"""{WITH}, {ORACLE_UNITS.strip()} SELECT 'tsql' AS dialect, count(*)::BIGINT AS procedures FROM corpus UNION ALL SELECT 'oracle', count(*)::BIGINT FROM units""")
def route(spark, sf_dir):
    tsql = corpus(spark, sf_dir).agg(F.count("*").alias("procedures")).select(F.lit("tsql").alias("dialect"), "procedures")
    return tsql.unionByName(units(spark, sf_dir).agg(F.count("*").alias("procedures")).select(F.lit("oracle").alias("dialect"), "procedures"))


def units(spark, sf_dir):
    return px.units(oracle_corpus(spread(table(spark, sf_dir, "supplier").select("s_suppkey"))), "k")


UNITS = f"WITH {ORACLE_UNITS.strip()}"
UNIT_LINES = f"{UNITS}, ls AS (SELECT k, unit, unnest(string_split(raw_sql, chr(10))) AS s, generate_subscripts(string_split(raw_sql, chr(10)), 1) AS line FROM units)"


def keyed(spark, sf_dir):
    return units(spark, sf_dir).select("unit", "raw_sql")


@query("px_unwrap", f"{UNITS} SELECT k, unit, md5(raw_sql) AS digest FROM units")
def unwrap(spark, sf_dir):
    return units(spark, sf_dir).select("k", "unit", F.md5("raw_sql").alias("digest"))


@query("px_top_units", f"{UNITS} SELECT k, count(*)::BIGINT AS n_units FROM units GROUP BY k")
def top_units(spark, sf_dir):
    return units(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n_units"))


@query("px_unit_end", f"{UNITS} SELECT unit, len(string_split(raw_sql, chr(10)))::BIGINT AS n_lines FROM units")
def unit_end(spark, sf_dir):
    return keyed(spark, sf_dir).select("unit", F.size(F.split("raw_sql", "\n", -1)).cast("long").alias("n_lines"))


@query("px_name", f"{UNITS} SELECT unit, CASE WHEN contains(unit, '.') THEN split_part(unit, '.', 1) ELSE 'dbo' END AS schema_name FROM units")
def unit_names(spark, sf_dir):
    return keyed(spark, sf_dir).select("unit", F.when(F.contains("unit", F.lit(".")), F.substring_index("unit", ".", 1)).otherwise("dbo").alias("schema_name"))


@query("px_params", f"""{UNITS} SELECT unit, place::BIGINT AS place, name, direction, sql_type, default_value FROM units,
(VALUES (0, 'p_id', 'IN', 'NUMBER', NULL), (1, 'p_note', 'INOUT', 'VARCHAR2', NULL), (2, 'p_day', 'IN', 'DATE', 'SYSDATE')) p(place, name, direction, sql_type, default_value)""")
def unit_params(spark, sf_dir):
    return px.parameters(keyed(spark, sf_dir), ["unit"])


@query("px_declares", f"{UNITS} SELECT unit, 'v_sql' AS variable FROM units")
def declares(spark, sf_dir):
    return keyed(spark, sf_dir).select("unit", F.explode(px.declared(F.col("raw_sql"))).alias("variable"))


@query("px_collections", f"{UNITS} SELECT unit, 't_rows' AS name, 'stg_rows' AS staging_name FROM units")
def collections(spark, sf_dir):
    found = keyed(spark, sf_dir).select("unit", F.explode(px.collections(F.col("raw_sql"))).alias("name"))
    return found.withColumn("staging_name", px.staging_name(F.col("name")))


@query("px_called", f"{UNITS} SELECT unit, regexp_extract(raw_sql, '(pkg_util\\.step\\d)', 1) AS callee FROM units")
def unit_calls(spark, sf_dir):
    return keyed(spark, sf_dir).select("unit", F.explode(px.called(F.col("raw_sql"))).alias("callee"))


@query("flt_oracle_syspkg", f"{UNITS} SELECT unit, unnest(list_distinct(regexp_extract_all(raw_sql, '\\n  (\\w+\\.\\w+)\\(', 1))) AS qualified FROM units")
def syspkg(spark, sf_dir):
    """All qualified calls, the server's packages included, of which px_called keeps the others."""
    names = F.regexp_extract_all("raw_sql", F.lit(r"\n  (\w+\.\w+)\("), F.lit(1))
    return keyed(spark, sf_dir).select("unit", F.explode(F.array_distinct(names)).alias("qualified"))


SCOPED_UNITS = (
    ("INSERT INTO tgt_# SELECT a FROM (WITH f# AS (SELECT 1 FROM base_#) SELECT a FROM f#) q; SELECT a INTO v FROM f#;", ("tgt_#", "base_#", "f#")),
    ("FOR r IN (SELECT x FROM looped_# l FOR UPDATE OF x) LOOP DELETE FROM gone_# WHERE a = r.x; END LOOP;", ("looped_#", "gone_#")),
    ('MERGE INTO m_# USING s_# ON (m.a = s.a) WHEN MATCHED THEN UPDATE SET b = 1; SELECT a INTO v FROM "Quoted #" q;', ("m_#", "s_#", "Quoted #")),
)


@query("px_table_refs", f"""{UNITS}, f AS (SELECT unit, unnest(regexp_extract_all(raw_sql, '(?:FROM|INTO|UPDATE) (\\w+)[^\\w@]', 1)) AS t FROM units)
SELECT DISTINCT unit, t AS table_name FROM f WHERE NOT regexp_matches(t, '^[vlp]_') AND t <> 'old_rows'
UNION ALL SELECT 'scoped_' || k, table_name FROM ({scoped_sql("supplier", "s_suppkey", SCOPED_UNITS)})""")
def unit_tables(spark, sf_dir):
    suppliers = spread(table(spark, sf_dir, "supplier").select("s_suppkey"))
    scoped = scoped_corpus(suppliers, F.col("s_suppkey"), SCOPED_UNITS, "PROCEDURE p IS\nBEGIN\n", "\nEND;").select(F.concat(F.lit("scoped_"), F.col("k").cast("string")).alias("unit"), "raw_sql")
    return table_references(keyed(spark, sf_dir).unionByName(scoped), "unit", syntax=structure.PLSQL).select("unit", "table_name")


UNIT_BLOCKS = f"""{UNIT_LINES}, b AS (SELECT unit, line - (SELECT min(i.line) FROM ls i WHERE i.unit = o.unit AND i.s = 'BEGIN') AS n, trim(s, ' ' || chr(9)) AS t, s FROM ls o),
c AS (SELECT * FROM b WHERE n > 0 AND t NOT IN ('END;')), m AS (SELECT *, CASE WHEN t LIKE 'UPDATE totals%' OR t = 'END IF;' THEN 0 ELSE 1 END AS new FROM c),
d AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY n) - 1 AS block FROM m)"""


@query("px_blocks", f"""{UNIT_BLOCKS} SELECT unit, block::BIGINT AS block, CASE WHEN f LIKE 'IF %' THEN 'IF_ELSE' WHEN f LIKE 'EXECUTE%' THEN 'DYNAMIC_SQL' WHEN f LIKE 'INSERT%' THEN 'DML_OPERATION'
WHEN f LIKE 'SELECT%' THEN 'SELECT_QUERY' WHEN f LIKE '%:=%' THEN 'DECLARATION' ELSE 'OTHER' END AS block_type FROM (SELECT unit, block, arg_min(t, n) AS f FROM d GROUP BY 1, 2)""")
def unit_blocks(spark, sf_dir):
    return px.blocks(keyed(spark, sf_dir), ["unit"]).select("unit", "block", "block_type")


@query("px_block_ends", f"{UNIT_BLOCKS} SELECT unit, block::BIGINT AS block, min(n)::BIGINT AS start_line, max(n)::BIGINT AS end_line FROM d GROUP BY 1, 2")
def unit_block_ends(spark, sf_dir):
    return px.blocks(keyed(spark, sf_dir), ["unit"]).select("unit", "block", "start_line", "end_line")


@query("px_block_vars", f"""{UNIT_BLOCKS}, t AS (SELECT unit, block, string_agg(s, chr(10) ORDER BY n) AS c FROM d GROUP BY 1, 2)
SELECT unit, block::BIGINT AS block, array_to_string(list_sort(list_distinct(regexp_extract_all(c, '\\b[vlp]_\\w+'))), ',') AS inputs,
array_to_string(list_sort(list_distinct(regexp_extract_all(c, '\\b([vl]_\\w+) :=', 1))), ',') AS outputs FROM t""")
def unit_block_vars(spark, sf_dir):
    used, set_ = px.block_variables(F.col("content"))
    shown = lambda c: F.array_join(F.array_sort(c), ",")
    return px.blocks(keyed(spark, sf_dir), ["unit"]).select("unit", "block", shown(used).alias("inputs"), shown(set_).alias("outputs"))


@query("px_body", f"{UNITS} SELECT unit, length(raw_sql[instr(raw_sql, 'BEGIN'):])::BIGINT AS body_chars FROM units")
def unit_body(spark, sf_dir):
    return keyed(spark, sf_dir).select("unit", F.length(px.body(F.col("raw_sql"))).cast("long").alias("body_chars"))


@query("eo_dblink", f"{UNIT_LINES} SELECT unit, line::BIGINT AS line, regexp_extract(s, '@(\\w+)', 1) AS server, 'remote_tab' AS remote_object, 'SELECT' AS operation FROM ls WHERE contains(s, '@link')")
def dblink(spark, sf_dir):
    return ec.database_links(keyed(spark, sf_dir), "unit")


EI = f"""{UNIT_LINES}, u AS (SELECT k, unit, line, s, trim(regexp_extract(s, 'EXECUTE IMMEDIATE (.+?)(?: USING.*|;.*)$', 1)) AS e FROM ls WHERE contains(s, 'EXECUTE IMMEDIATE'))"""


@query("eo_dyn_sql", f"{EI} SELECT unit, line::BIGINT AS line, e AS expression FROM u")
def dyn_immediate(spark, sf_dir):
    return ec.immediate_sql(keyed(spark, sf_dir), "unit").select("unit", "line", "expression")


@query("eo_tier", f"""{EI} SELECT unit, line::BIGINT AS line, CASE WHEN contains(s, 'USING') THEN 'templated' WHEN contains(e, '||') THEN 'concatenated' ELSE 'simple' END AS tier FROM u""")
def tier(spark, sf_dir):
    return ec.immediate_sql(keyed(spark, sf_dir), "unit").select("unit", "line", "tier")


@query("eo_dispatch", f"""{UNIT_LINES} SELECT unit, line::BIGINT AS line, 'v_proc' AS variable, CASE WHEN k % 5 = 2 THEN 'resolved' ELSE 'dispatch_table' END AS certainty,
CASE WHEN k % 5 = 2 THEN 'pkg_util.run' ELSE '' END AS targets, CASE WHEN k % 5 = 3 THEN 'handlers.handler' END AS condition FROM ls WHERE contains(s, '|| v_proc ||')""")
def dispatch(spark, sf_dir):
    calls = ec.dispatches(keyed(spark, sf_dir), "unit")
    return calls.select("unit", "line", "variable", "certainty", F.array_join("resolved_targets", ",").alias("targets"), "condition")


@query("eo_trace", f"""{UNIT_LINES} SELECT unit, line::BIGINT AS line, regexp_extract(s, '(\\w+) :=', 1) AS variable, rtrim(regexp_extract(s, ':= (.*)$', 1), ';') AS value FROM ls WHERE contains(s, ':=')
UNION ALL SELECT unit, line::BIGINT, 'v_proc', 'handlers.handler' FROM ls WHERE contains(s, 'SELECT handler')
UNION ALL SELECT unit, line::BIGINT, 'v_n', 'remote_tab.n' FROM ls WHERE contains(s, 'SELECT n INTO')""")
def oracle_assignments(spark, sf_dir):
    return ec.assignments(keyed(spark, sf_dir), "unit", dialect=ec.PLSQL).select("unit", "line", "variable", "value")
