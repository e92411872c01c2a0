"""Chunking, prompt context, validation rules, reports and run tables.

Generated texts are stood in for by the pages' markup, runs and logs by events, projects by users.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from procweave.analysis import generate_by_level, generate_in_chunks
from procweave.operators import catalog as c
from procweave.operators import edge_cases as ec
from procweave.operators import extract as x
from procweave.operators import graph as g
from procweave.operators import quality_rules as q
from procweave.operators.changes import delete_cascade, update_where
from procweave.operators.code import unified
from procweave.operators.splitting import TSQL_SEPARATORS, split_ranked
from procweave.plans.edge_cases import REPORT, report
from procweave.plans.extraction import STATEMENTS, WITH, corpus
from procweave.plans.graph import LEVELS, tree
from procweave.registry import query
from procweave.session import table
from procweave.sources.corpus import TSQL_CORPUS
from procweave.sources.sinks import shared_folder, write_json


@query("ck_blocks", f"""{STATEMENTS}, b AS (SELECT k, block, string_agg(s, chr(10) ORDER BY n) AS content FROM numbered GROUP BY k, block),
g AS (SELECT k, block // 5 AS chunk, string_agg(content, chr(10) || chr(10) ORDER BY block) AS sql_content FROM b GROUP BY ALL)
SELECT k, chunk::BIGINT AS chunk, sql_content, count(*) OVER (PARTITION BY k) AS total, CASE WHEN count(*) OVER (PARTITION BY k) = 1 THEN 'only' WHEN chunk = 0 THEN 'first'
WHEN chunk = count(*) OVER (PARTITION BY k) - 1 THEN 'last' ELSE 'middle' END AS position FROM g""")
def block_chunks(spark, sf_dir):
    return q.group_blocks(x.logical_blocks(corpus(spark, sf_dir), "k"), "k")


def chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return q.split_text(docs, ["doc_id"], "text", size=2000, overlap=100)


def sql_text(text):
    """A text with line feeds as SQL."""
    return " || ".join("chr(10)" if p == "\n" else f"'{p}'" for p in re.findall("\n|[^\n]+", text))


CHUNK, OVERLAP = 300, 80

#: Fragments by a recursion over the ranks, chunks by one over the fragments.
RANKED = f"""WITH RECURSIVE {TSQL_CORPUS}, seps(rank, sep) AS (VALUES {", ".join(f"({i}, {sql_text(t)})" for i, t in enumerate(TSQL_SEPARATORS))}),
f(k, rank, path, text, open, up) AS (
  SELECT k, 0, [0::BIGINT], regexp_replace(replace(raw_sql, chr(13), ''), chr(10) || '[ ' || chr(9) || ']+', chr(10), 'g'), true, '' FROM corpus
  UNION ALL SELECT k, rank + 1, list_append(path, j), piece, CASE WHEN cut THEN length(piece) >= {CHUNK} ELSE open END, CASE WHEN cut THEN rank || ' ' || path::VARCHAR ELSE up END
  FROM (SELECT k, rank, path, open, up, cut, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS j FROM (
    SELECT k, rank, path, open, up, open AND contains(text, sep) AS cut, CASE WHEN open AND contains(text, sep)
      THEN list_filter(list_transform(string_split(text, sep), lambda p, i: CASE WHEN i = 1 THEN p ELSE sep || p END), lambda p: p <> '') ELSE [text] END AS pieces FROM (SELECT f.k, f.rank, path, text, open, up, sep FROM f JOIN seps ON seps.rank = f.rank)))),
leaf AS (SELECT k, row_number() OVER w AS i, length(text) AS n, up, coalesce(sum(length(text)) OVER (PARTITION BY k ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM f WHERE rank = {len(TSQL_SEPARATORS)} WINDOW w AS (PARTITION BY k ORDER BY path)),
m(k, i, starts, up, chunks) AS (
  SELECT DISTINCT k, 0::BIGINT, []::BIGINT[], '', []::STRUCT(b BIGINT, e BIGINT, whole BOOLEAN)[] FROM leaf
  UNION ALL SELECT k, i, CASE WHEN long THEN [] WHEN fits THEN list_append(starts, b) WHEN joins THEN list_append(list_filter(starts, lambda s: b - s <= {OVERLAP} AND b - s + n <= {CHUNK}), b) ELSE [b] END,
    CASE WHEN long THEN '' ELSE up END, chunks || CASE WHEN len(starts) > 0 AND NOT fits THEN [{{'b': starts[1], 'e': b, 'whole': false}}] ELSE [] END || CASE WHEN long THEN [{{'b': b, 'e': b + n, 'whole': true}}] ELSE [] END
  FROM (SELECT *, joins AND b - starts[1] + n <= {CHUNK} AS fits FROM (SELECT m.k, l.i, l.n, l.b, l.up, starts, chunks, l.n >= {CHUNK} AS long, l.n < {CHUNK} AND l.up = m.up AND len(starts) > 0 AS joins FROM m JOIN leaf l ON l.k = m.k AND l.i = m.i + 1))),
ends AS (SELECT m.k, chunks || CASE WHEN len(starts) > 0 THEN [{{'b': starts[1], 'e': l.b + l.n, 'whole': false}}] ELSE [] END AS c FROM m JOIN leaf l ON l.k = m.k AND l.i = m.i WHERE m.i = (SELECT max(i) FROM leaf x WHERE x.k = m.k)),
cut AS (SELECT k, unnest(c) AS c, generate_subscripts(c, 1) AS j FROM ends),
shown AS (SELECT cut.k, j, trim(substr(t.text, (c.b + 1)::BIGINT, (c.e - c.b)::BIGINT), ' ' || chr(10) || chr(9)) AS content FROM cut JOIN f t ON t.k = cut.k AND t.rank = 0)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY j) - 1 AS chunk, count(*) OVER (PARTITION BY k) AS total, content FROM shown WHERE content <> ''"""


@query("ck_split", RANKED)
def ranked_splits(spark, sf_dir):
    """Sources without indentation, split by the ranked separators of their dialect."""
    text = F.regexp_replace(unified(F.col("raw_sql")), r"\n[ \t]+", "\n")
    return split_ranked(corpus(spark, sf_dir).select("k", text.alias("raw_sql")), ["k"], "raw_sql", CHUNK, OVERLAP, TSQL_SEPARATORS).select("k", "chunk", "total", "content")


@query("ck_split_lines", "SELECT doc_id, length(text)::BIGINT AS covered, true AS within FROM documents WHERE length(text) > 0")
def splits(spark, sf_dir):
    """What the chunks without their overlaps cover, and whether each is within the size."""
    rows = chunks(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("covered"), F.bool_and(F.length("content") <= 2000).alias("within"))


@query("ck_fold", f"""{STATEMENTS}, b AS (SELECT k, block, string_agg(s, chr(10) ORDER BY n) AS content FROM numbered GROUP BY k, block),
g AS (SELECT k, block // 5 AS chunk, string_agg(content, chr(10) || chr(10) ORDER BY block) AS sql_content FROM b GROUP BY ALL),
f AS (SELECT k, chunk, sum(length(sql_content)) OVER (PARTITION BY k ORDER BY chunk) AS o, row_number() OVER (PARTITION BY k ORDER BY chunk) = 1 AS first FROM g)
SELECT k, string_agg(CASE WHEN first THEN 'first ' ELSE 'then ' END || o, chr(10) ORDER BY chunk) || chr(10) AS output, NULL::VARCHAR AS error FROM f GROUP BY k""")
def folds(spark, sf_dir):
    """Chunked generation: every chunk gets the output of the one before; the generator adds its chunk's length to that."""

    def write(text, position, before):
        return f"{'first' if position in ('first', 'only') else 'then'} {len(text) + int(before.split()[-1] if before else 0)}"

    return generate_in_chunks(q.group_blocks(x.logical_blocks(corpus(spark, sf_dir), "k"), "k"), write, "k")


@query("ck_context", f"""{WITH} SELECT k, 'procedure usp_P' || k || '; temp #WorkSet' || (k % 5) || ' -> stg_work_set' || (k % 5) || CASE WHEN k % 2 = 0 THEN ', ##SharedRows -> stg_shared_rows' ELSE '' END AS context FROM corpus""")
def context(spark, sf_dir):
    """The context that goes with a procedure's chunks: its temporary tables and their staging tables."""
    rows = corpus(spark, sf_dir)
    pairs = F.array_sort(F.collect_list(F.struct("made_by", F.concat_ws(" -> ", "name", "staging_name").alias("pair"))))
    temps = x.temp_tables(rows, "k").groupBy("k").agg(F.array_join(F.transform(pairs, lambda p: p["pair"]), ", ").alias("t"))
    return temps.select("k", F.concat(F.lit("procedure usp_P"), F.col("k").cast("string"), F.lit("; temp "), "t").alias("context"))


@query("mg_names", "SELECT p_partkey, 'P' || p_partkey || 'Service' AS service_name, 'p' || p_partkey AS method_name FROM part")
def names(spark, sf_dir):
    service, method = c.service_names(F.concat(F.lit("usp_P"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", service.alias("service_name"), method.alias("method_name"))


@query("mg_deps", f"""{WITH}, calls AS (SELECT k, 'usp_P' || (k // 2) AS callee, k // 2 AS c FROM corpus WHERE k > 0)
SELECT k, 'P' || c || 'Service.p' || c || '()' AS dependency FROM calls WHERE c IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def dependencies(spark, sf_dir):
    """Calls to procedures that are migrated already (here: those of larger parts), as service calls."""
    calls = corpus(spark, sf_dir).select("k", F.explode(x.called_procedures(F.col("raw_sql"))).alias("callee"))
    service, method = c.service_names(F.col("procedure"))
    migrated = table(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("usp_P"), F.col("p_partkey").cast("string")).alias("procedure"))
    return calls.join(migrated, F.col("callee") == F.col("procedure")).select("k", F.concat(service, F.lit("."), method, F.lit("()")).alias("dependency"))


@query("mg_prompt", f"{WITH} SELECT k, ('usp_P' || k || chr(10) || 'parameters: @Id, @Mode, @Total' || chr(10) || raw_sql) AS prompt FROM corpus")
def prompts(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    name, _ = x.procedure_name(F.col("raw_sql"))
    params = x.parameters(rows).groupBy(F.col("k").alias("pk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda p: p["name"]), ", ").alias("p"))
    return rows.join(params, F.col("k") == F.col("pk")).select("k", F.concat_ws("\n", name, F.concat(F.lit("parameters: "), "p"), "raw_sql").alias("prompt"))


@query("mg_edge_ctx", f"""{WITH}, ls AS (SELECT k, unnest(string_split(raw_sql, chr(10))) AS s, generate_subscripts(string_split(raw_sql, chr(10)), 1) AS line FROM corpus)
SELECT k, 'line ' || line || ': ' || regexp_extract(s, '(Srv\\d)', 1) || ' dbo.' || regexp_extract(s, '(Remote\\d+)', 1) || ' (SELECT)' AS context FROM ls WHERE contains(s, '.Db.dbo.')""")
def edge_context(spark, sf_dir):
    """The text about a procedure's remote objects, in order of line."""
    linked = ec.linked_servers(corpus(spark, sf_dir), "k")
    line = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), "server", F.lit(" "), "remote_object", F.lit(" ("), "operation", F.lit(")"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("text")))), lambda e: e["text"])
    return linked.groupBy("k").agg(F.array_join(listed, "\n").alias("context"))


@query("mg_loop", """WITH RECURSIVE made(k, level, outcome, output) AS (
SELECT 0::BIGINT, 0::BIGINT, 'migrated', 'USP_P0' UNION ALL
SELECT p_partkey, level + 1, CASE WHEN p_partkey % 11 = 5 THEN 'skipped' WHEN p_partkey % 7 = 3 THEN 'failed' ELSE 'migrated' END,
CASE WHEN p_partkey % 11 <> 5 AND p_partkey % 7 <> 3 THEN 'USP_P' || p_partkey || chr(10) || 'USP_P' || k || ' ' || CASE outcome WHEN 'migrated' THEN 'HAS ' || length(output) WHEN 'failed' THEN 'FAILED' ELSE 'IS EXTERNAL' END END
FROM made JOIN part ON p_partkey > 0 AND p_partkey // 2 = k)
SELECT 'usp_P' || k AS name, level, outcome, output, CASE WHEN outcome = 'failed' THEN 'ValueError: usp_P' || k END AS error FROM made""")
def loop(spark, sf_dir):
    """Generation from the leaves on: each prompt tells what the callees became. One in eleven is external, one in seven fails."""
    edges = tree(spark, sf_dir)
    defined = corpus(spark, sf_dir).filter(F.col("k") % 11 != 5).select(F.concat(F.lit("usp_P"), F.col("k").cast("string")).alias("name"))
    nodes = g.nodes(edges, defined)

    def write(prompt):
        name = prompt.split("\n")[0]
        if int(name.removeprefix("usp_P")) % 7 == 3:
            raise ValueError(name)
        return prompt.upper()

    told = lambda name, outcome, output: F.concat(name, F.lit(" "), F.when(outcome == "migrated", F.concat(F.lit("has "), F.length(output).cast("string"))).when(outcome == "failed", "failed").otherwise("is external"))
    planned = g.levels(edges, nodes.select("name")).join(nodes, "name")
    prompts = nodes.filter("defined").select(F.col("name").alias("procedure_name"), F.col("name").alias("prompt"))
    return generate_by_level(planned, prompts, edges, write, shared_folder(spark, "generated"), told)


def services(spark, sf_dir):
    """Generated services, one for each part, with the defects that k gives them: k and code."""
    k = F.col("p_partkey")
    n = k.cast("string")
    code = F.concat(
        F.when(k % 7 == 1, F.lit("")).otherwise(F.concat(F.lit("package com.example.p"), n, F.lit(";\n"))),
        F.when(k % 5 == 2, F.lit("")).otherwise(F.lit("@Service\n")),
        F.when(k % 6 == 3, F.lit("interface ")).otherwise(F.lit("public class ")),
        F.concat(F.lit("P"), n, F.lit("Service {\n")),
        F.when(k % 9 == 4, F.lit("    void other() {}\n")).otherwise(F.concat(F.lit("    void p"), n, F.lit("() {}\n"))),
        F.repeat(F.lit("    // TODO finish\n"), (k % 3).cast("int")),
        F.when(k % 8 == 5, F.lit("")).otherwise(F.lit("}\n")),
    )
    return table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 10 == 9, F.lit("class X {}")).otherwise(code).alias("code"))


SERVICES = """services AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 9 THEN 'class X {}' ELSE
CASE WHEN p_partkey % 7 = 1 THEN '' ELSE 'package com.example.p' || p_partkey || ';' || chr(10) END || CASE WHEN p_partkey % 5 = 2 THEN '' ELSE '@Service' || chr(10) END ||
CASE WHEN p_partkey % 6 = 3 THEN 'interface ' ELSE 'public class ' END || 'P' || p_partkey || 'Service {' || chr(10) ||
CASE WHEN p_partkey % 9 = 4 THEN '    void other() {}' || chr(10) ELSE '    void p' || p_partkey || '() {}' || chr(10) END ||
repeat('    // TODO finish' || chr(10), (p_partkey % 3)::INT) || CASE WHEN p_partkey % 8 = 5 THEN '' ELSE '}' || chr(10) END END AS code FROM part),
marks AS (SELECT k, code, length(trim(code, ' ')) < 50 AS empty FROM services),
issues AS (SELECT k, 'EMPTY_OUTPUT' AS code, 'error' AS severity FROM marks WHERE empty
UNION ALL SELECT k, 'MISSING_PACKAGE', 'error' FROM marks WHERE NOT empty AND NOT starts_with(code, 'package ')
UNION ALL SELECT k, 'MISSING_SERVICE_ANNOTATION', 'error' FROM marks WHERE NOT empty AND NOT contains(code, '@Service')
UNION ALL SELECT k, 'MISSING_CLASS_DECLARATION', 'error' FROM marks WHERE NOT empty AND NOT regexp_matches(code, '\\bclass\\s+\\w+')
UNION ALL SELECT k, 'UNBALANCED_BRACES', 'error' FROM marks WHERE NOT empty AND length(replace(code, '{', '')) <> length(replace(code, '}', ''))
UNION ALL SELECT k, 'MISSING_METHOD', 'warning' FROM marks WHERE NOT empty AND NOT contains(code, 'p' || k || '()')
UNION ALL SELECT k, 'TODO_FOUND', 'warning' FROM marks WHERE NOT empty AND contains(code, '// TODO'))"""


def judged(spark, sf_dir):
    rules = q.structural_rules(F.col("code"), F.concat(F.lit("p"), F.col("k").cast("string"), F.lit("()")))
    return q.apply_rules(services(spark, sf_dir), "code", rules)


@query("vl_structural", f"WITH {SERVICES} SELECT k, code, severity FROM issues")
def structural(spark, sf_dir):
    return judged(spark, sf_dir).select("k", F.explode("issues").alias("i")).select("k", "i.code", "i.severity")


@query("vl_todo", f"WITH {SERVICES} SELECT k, len(regexp_extract_all(code, '// TODO'))::BIGINT AS todo_count FROM services")
def todos(spark, sf_dir):
    return judged(spark, sf_dir).select("k", "todo_count")


@query("vl_passed", f"WITH {SERVICES} SELECT k, k NOT IN (SELECT k FROM issues WHERE severity = 'error') AS passed FROM services")
def passed(spark, sf_dir):
    return judged(spark, sf_dir).select("k", "passed")


def validated(spark, sf_dir):
    """Pages judged as if they were generated services: markers of their own stand in for package, service and class."""
    text = F.coalesce(F.col("html"), F.lit(""))
    rules = [
        q.Rule("EMPTY_OUTPUT", "error", "too short", F.length(F.trim(text)) < 1200),
        q.Rule("MISSING_PACKAGE", "error", "no doctype", ~F.contains(text, F.lit("<!DOCTYPE html>"))),
        q.Rule("MISSING_SERVICE_ANNOTATION", "error", "no nav", ~F.contains(text, F.lit("<nav>"))),
        q.Rule("UNBALANCED_BRACES", "error", "braces differ", q.count_of(text, "{") != q.count_of(text, "}")),
        q.Rule("MISSING_METHOD", "warning", "no table", ~F.contains(text, F.lit("<table"))),
    ]
    return q.apply_rules(table(spark, sf_dir, "pages").select("page_id", "html"), "html", rules)


def broken(code):
    return {
        "EMPTY_OUTPUT": "length(trim(html, ' ')) < 1200",
        "MISSING_PACKAGE": "NOT contains(html, '<!DOCTYPE html>')",
        "MISSING_SERVICE_ANNOTATION": "NOT contains(html, '<nav>')",
        "UNBALANCED_BRACES": "length(html) - length(replace(html, '{', '')) <> length(html) - length(replace(html, '}', ''))",
        "MISSING_METHOD": "NOT contains(html, '<table')",
    }[code]


CODES = ("EMPTY_OUTPUT", "MISSING_PACKAGE", "MISSING_SERVICE_ANNOTATION", "UNBALANCED_BRACES", "MISSING_METHOD")
ISSUES = "issues AS (" + " UNION ALL ".join(
    f"SELECT page_id, '{code}' AS code, '{'warning' if code == 'MISSING_METHOD' else 'error'}' AS severity FROM pages WHERE {broken(code)}" + ("" if code == "EMPTY_OUTPUT" else f" AND NOT ({broken('EMPTY_OUTPUT')})")
    for code in CODES
) + ")"


@query("vl_pages", f"WITH {ISSUES} SELECT page_id, code, severity FROM issues")
def page_issues(spark, sf_dir):
    return validated(spark, sf_dir).select("page_id", F.explode("issues").alias("i")).select("page_id", "i.code", "i.severity")


@query("vl_page_marks", "SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS todo_count FROM pages")
def page_marks(spark, sf_dir):
    """Occurrences of a mark in each text."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<li>")).cast("long").alias("todo_count"))


@query("vl_pages_passed", f"WITH {ISSUES} SELECT page_id, page_id NOT IN (SELECT page_id FROM issues WHERE severity = 'error') AS passed FROM pages")
def pages_passed(spark, sf_dir):
    return validated(spark, sf_dir).select("page_id", "passed")


@query("ag_severity", f"WITH {ISSUES} SELECT page_id, count(*) FILTER (severity = 'error')::BIGINT AS errors, count(*) FILTER (severity = 'warning')::BIGINT AS warnings FROM issues GROUP BY page_id")
def severities(spark, sf_dir):
    return page_issues(spark, sf_dir).groupBy("page_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


@query("ag_pass_ratio", f"WITH {ISSUES} SELECT count(*)::BIGINT AS total, (count(*) - (SELECT count(DISTINCT page_id) FROM issues WHERE severity = 'error'))::BIGINT AS passed FROM pages")
def pass_ratio(spark, sf_dir):
    return validated(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))


@query("ag_report", f"""{WITH}, r AS ({REPORT}) SELECT (SELECT count(*) FROM corpus)::BIGINT AS procedures, (SELECT sum(unresolved_count) FROM r)::BIGINT AS unresolved,
(SELECT count(DISTINCT 'stg_work_set' || (k % 5)) + 1 FROM corpus)::BIGINT AS staging_tables, (SELECT sum(linked_servers + dynamic_sql + variable_calls) FROM r)::BIGINT AS edge_cases""")
def summary(spark, sf_dir):
    """One row of counts; each part is one row already when they meet."""
    rows = corpus(spark, sf_dir)
    cases = report(spark, sf_dir).agg(F.sum("unresolved_count").alias("unresolved"), F.sum(F.col("linked_servers") + F.col("dynamic_sql") + F.col("variable_calls")).alias("edge_cases"))
    staging = x.temp_tables(rows, "k").agg(F.count_distinct("staging_name").alias("staging_tables"))
    parts = [rows.agg(F.count("*").alias("procedures")), cases, staging]
    one = parts[0].withColumn("_j", F.lit(1))
    for part in parts[1:]:
        one = one.join(part.withColumn("_j", F.lit(1)), "_j")
    return one.select("procedures", "unresolved", "staging_tables", "edge_cases")


@query("sink_json_report", f"""{WITH}, r AS ({REPORT}) SELECT k, linked_servers AS linked, unresolved_count AS unresolved FROM r WHERE unresolved_count > 0""")
def json_report(spark, sf_dir):
    """The report of unresolved cases written as JSON, and read back into columns."""
    rows = report(spark, sf_dir).filter("unresolved_count > 0")
    path = f"{shared_folder(spark, 'report')}/unresolved"
    write_json(rows.select("k", F.col("linked_servers").alias("linked"), F.col("unresolved_count").alias("unresolved")), path)
    return spark.read.schema("k long, linked long, unresolved long").json(path)


RUNS = "runs AS (SELECT user_id AS project_id, event_id AS run_id, ts AS started_at, event_type AS status FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"


def runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "purchase", "error"))
    return rows.select(F.col("user_id").alias("project_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("status"))


@query("ag_run_number", f"WITH {RUNS}, n AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY started_at, run_id) AS run_number FROM runs), p AS (SELECT DISTINCT user_id AS project_id FROM events) SELECT p.project_id, (coalesce(max(run_number), 0) + 1)::BIGINT AS next_run FROM p LEFT JOIN n USING (project_id) GROUP BY 1")
def run_numbers(spark, sf_dir):
    numbered = runs(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("run_number"))
    projects = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id")).distinct()
    return projects.join(numbered, "project_id", "left").select("project_id", (F.coalesce("run_number", F.lit(0)) + 1).alias("next_run"))


@query("ag_file_count", "SELECT source, count(*)::BIGINT AS files FROM documents GROUP BY source")
def file_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"))


@query("rn_get_run", f"WITH {RUNS} SELECT run_id, project_id, status, started_at FROM runs WHERE project_id = 3 ORDER BY started_at, run_id")
def one_project(spark, sf_dir):
    return runs(spark, sf_dir).filter("project_id = 3").select("run_id", "project_id", "status", "started_at").orderBy("started_at", "run_id")


@query("rn_project_create", "SELECT DISTINCT user_id AS project_id, 'created' AS status FROM events UNION ALL SELECT max(user_id) + 1, 'created' FROM events")
def create_project(spark, sf_dir):
    from procweave.operators.changes import insert_rows

    have = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id")).distinct().withColumn("status", F.lit("created"))
    return insert_rows(have, have.agg((F.max("project_id") + 1).alias("project_id")).withColumn("status", F.lit("created")))


@query("rn_mark_failed", f"WITH {RUNS} SELECT run_id, CASE WHEN status = 'error' THEN 'failed' ELSE status END AS status FROM runs")
def mark_failed(spark, sf_dir):
    return update_where(runs(spark, sf_dir), F.col("status") == "error", {"status": F.lit("failed")}).select("run_id", "status")


@query("dm_cascade_delete", "SELECT 'orders' AS t, count(*)::BIGINT AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'lineitem', count(*)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))")
def cascade(spark, sf_dir):
    """Customers in debt go, and with them their orders and the orders' lines."""
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem")}
    left = delete_cascade(tables, gone, [("orders", "o_orderkey", "o_custkey"), ("lineitem", "l_linenumber", "l_orderkey")])
    count = lambda n: left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n")
    return count("orders").unionByName(count("lineitem"))


@query("flt_logs_stage", "SELECT event_id, ts, event_type FROM events WHERE user_id = 5 AND event_type = 'click' ORDER BY event_id")
def stage_logs(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("user_id = 5 and event_type = 'click'").select("event_id", "ts", "event_type").orderBy("event_id")


@query("flt_logs_view", "SELECT event_id, event_type FROM events WHERE user_id = 5 AND (event_type = 'click' OR event_type = 'error')")
def viewed_logs(spark, sf_dir):
    return table(spark, sf_dir, "events").filter((F.col("user_id") == 5) & ((F.col("event_type") == "click") | (F.col("event_type") == "error"))).select("event_id", "event_type")


MESSAGE = "event_type || CASE WHEN event_type = 'error' THEN ' FAILED' WHEN value > 80 THEN ' skipped' ELSE '' END"


@query("lg_classify", f"""SELECT event_id, CASE WHEN regexp_matches(upper({MESSAGE}), 'ERROR|FAILED') THEN 'error' WHEN regexp_matches(upper({MESSAGE}), 'WARNING|SKIP') THEN 'warning' ELSE 'info' END AS level FROM events""")
def classify(spark, sf_dir):
    from procweave.streaming.logs import classified

    text = F.concat("event_type", F.when(F.col("event_type") == "error", " FAILED").when(F.col("value") > 80, " skipped").otherwise(""))
    return classified(table(spark, sf_dir, "events").withColumn("message", text)).select("event_id", "level")
