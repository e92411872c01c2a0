"""Graph queries: over the corpus's relationships, and over a call graph that the part keys make.

In the call graph part k calls part k div 2; a few keys of suppliers add calls back, so that there are cycles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.operators import edge_cases as ec
from procweave.operators import extract as x
from procweave.operators import graph as g
from procweave.operators.names import table_references
from procweave.plans.extraction import WITH, corpus
from procweave.registry import query
from procweave.session import table


def tree(spark, sf_dir):
    """usp_P<k> calls usp_P<k div 2>."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("usp_P"), c.cast("string"))
    return table(spark, sf_dir, "part").filter(k > 0).select(name(k).alias("src"), name(F.floor(k / 2)).alias("dst"))


def with_cycles(spark, sf_dir):
    """The tree, and calls from small keys of suppliers down again: s calls 2s for s from 1 to 5, 7 calls itself."""
    s = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("usp_P"), c.cast("string"))
    back = table(spark, sf_dir, "supplier").filter(s.between(1, 5)).select(name(s).alias("src"), name(s * 2).alias("dst"))
    own = table(spark, sf_dir, "supplier").filter(s == 7).select(name(s).alias("src"), name(s).alias("dst"))
    return tree(spark, sf_dir).unionByName(back).unionByName(own)


TREE = "e AS (SELECT 'usp_P' || p_partkey AS src, 'usp_P' || (p_partkey // 2) AS dst FROM part WHERE p_partkey > 0)"
CYCLIC = """e AS (SELECT 'usp_P' || p_partkey AS src, 'usp_P' || (p_partkey // 2) AS dst FROM part WHERE p_partkey > 0
UNION SELECT 'usp_P' || s_suppkey, 'usp_P' || (s_suppkey * 2) FROM supplier WHERE s_suppkey BETWEEN 1 AND 5 UNION SELECT 'usp_P7', 'usp_P7' FROM supplier WHERE s_suppkey = 7)"""
NAMES = "n AS (SELECT src AS name FROM e UNION SELECT dst FROM e)"
LEVELS = "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0), l(k, level) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT src, level + 1 FROM e JOIN l ON dst = k)"


@query("g_leaf", f"WITH {TREE}, {NAMES} SELECT name FROM n WHERE name NOT IN (SELECT src FROM e)")
def leaf(spark, sf_dir):
    e = tree(spark, sf_dir)
    return g.leaves(e, g.nodes(e)).select("name")


@query("g_out_degree", f"WITH {TREE}, {NAMES} SELECT name, count(src)::BIGINT AS out_degree FROM n LEFT JOIN e ON src = name GROUP BY name")
def degree(spark, sf_dir):
    e = tree(spark, sf_dir)
    return g.out_degree(e, g.nodes(e)).select("name", "out_degree")


@query("g_topo_order", f"{LEVELS} SELECT 'usp_P' || k AS name, max(level)::BIGINT AS level FROM l GROUP BY k")
def topo_order(spark, sf_dir):
    e = tree(spark, sf_dir)
    return g.levels(e, g.nodes(e))


@query("g_plan", f"""{LEVELS}, o AS (SELECT 'usp_P' || k AS name, max(level)::BIGINT AS level, k NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) AS external, false AS cyclic FROM l GROUP BY k
UNION ALL SELECT 'ring_' || s_suppkey || '_' || i, NULL, false, true FROM supplier, range(3) t(i))
SELECT name, level, external, cyclic, row_number() OVER (ORDER BY level NULLS LAST, name) AS place FROM o""")
def plan(spark, sf_dir):
    """The order of work: by level, then name; what the corpus does not define is marked, and what stands on a cycle."""
    from procweave.operators.ranking import global_row_number

    member = lambda i: F.concat(F.lit("ring_"), F.col("s_suppkey").cast("string"), F.lit("_"), i.cast("string"))
    rings = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    e = tree(spark, sf_dir).unionByName(rings.select(member(F.col("i")).alias("src"), member((F.col("i") + 1) % 3).alias("dst")))
    own = table(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("usp_P"), F.col("p_partkey").cast("string")).alias("name"))
    return global_row_number(g.plan(e, own.unionByName(rings.select(member(F.col("i")).alias("name")))), "level", ["name"], descending=False, into="place")


CYCLES = """('usp_P1 -> usp_P2 -> usp_P1', 2), ('usp_P2 -> usp_P4 -> usp_P2', 2), ('usp_P3 -> usp_P6 -> usp_P3', 2), ('usp_P4 -> usp_P8 -> usp_P4', 2), ('usp_P10 -> usp_P5 -> usp_P10', 2), ('usp_P7 -> usp_P7', 1)"""


@query("g_cycles", f"SELECT c.* FROM (VALUES {CYCLES}) c(cycle, length) WHERE (SELECT count(*) FROM part) > 10 ORDER BY cycle LIMIT 20")
def cycles(spark, sf_dir):
    return g.cycles(with_cycles(spark, sf_dir), longest=6, most=20).withColumn("length", F.col("length").cast("int"))


@query("g_cycles_dfs", f"SELECT replace(cycle, ' -> ' || split_part(cycle, ' -> ', 1), '') AS cycle FROM (VALUES {CYCLES}) c(cycle, length) WHERE (SELECT count(*) FROM part) > 10 AND length > 1 UNION ALL SELECT 'usp_P7' FROM supplier WHERE s_suppkey = 7")
def cycles_open(spark, sf_dir):
    """The same cycles without the return to their start."""
    found = g.cycles(with_cycles(spark, sf_dir), longest=6, most=20)
    return found.select(F.regexp_replace("cycle", " -> [^ ]+$", "").alias("cycle"))


@query("g_external", f"WITH {TREE}, {NAMES} SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM part WHERE 'usp_P' || p_partkey = name AND p_size > 10)")
def external(spark, sf_dir):
    """Callees that a corpus of the larger parts does not define."""
    e = tree(spark, sf_dir)
    defined = table(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("usp_P"), F.col("p_partkey").cast("string")).alias("name"))
    return g.external(g.nodes(e, defined))


@query("g_impact", f"""WITH RECURSIVE {TREE}, r(target, caller, distance) AS (SELECT dst, src, 1::BIGINT FROM e WHERE dst IN ('usp_P3', 'usp_P10')
UNION SELECT r.target, e.src, r.distance + 1 FROM r JOIN e ON e.dst = r.caller) SELECT * FROM r""")
def impact(spark, sf_dir):
    """Everything that reaches two procedures by calls."""
    e = tree(spark, sf_dir)
    return g.callers(e, g.nodes(e).filter(F.col("name").isin("usp_P3", "usp_P10")))


#: What each part of the analysis finds.
CALLS, VARIABLE, DYNAMIC = ("CALLS",), ("CALLS", "DYNAMIC_DISPATCH", "UNRESOLVED_CALL"), ("USES_DYNAMIC_SQL",)
REMOTE, TABLES, TEMPS = ("CALLS_REMOTE",), ("USES_TABLE",), ("USES_TEMP_TABLE",)


def relations(spark, sf_dir, *only):
    """All relationships, or only those of some kinds: what finds none of them is not run, since statements are written as soon as they are asked for."""
    rows = corpus(spark, sf_dir)
    asked = lambda kinds: not only or bool(set(only) & set(kinds))
    traced = asked(DYNAMIC) or asked(VARIABLE)
    found = ec.statement_table(rows, "k", with_tables=asked(TABLES)) if traced else None
    named = lambda: table_references(rows, "k") if found is None else found.select("k", F.explode("tables").alias("t")).select("k", F.col("t.name").alias("table_name")).distinct()
    edges = g.typed_edges(
        rows.select("k", F.explode(x.called_procedures(F.col("raw_sql"))).alias("callee")) if asked(CALLS) else None,
        ec.linked_servers(rows, "k") if asked(REMOTE) else None,
        ec.dynamic_sql(rows, "k", found=found) if asked(DYNAMIC) else None,
        ec.variable_calls(rows, "k", found=found) if asked(VARIABLE) else None,
        named() if asked(TABLES) else None,
        x.temp_tables(rows, "k") if asked(TEMPS) else None,
        "k",
    )
    return edges.filter(F.col("rel").isin(*only)) if only else edges


RELATIONS = f"""{WITH}, rels AS (
SELECT k, 'usp_P' || (k // 2) AS dst, 'CALLS' AS rel, 'resolved' AS certainty FROM corpus WHERE k > 0
UNION ALL SELECT k, 'usp_P' || (k // 3), 'CALLS', 'resolved' FROM corpus WHERE k % 6 = 5
UNION ALL SELECT k, unnest(['usp_P1', 'usp_P2']), 'CALLS', 'conditional' FROM corpus WHERE k % 9 = 4
UNION ALL SELECT k, 'ActionMap.ProcName', 'DYNAMIC_DISPATCH', 'dispatch_table' FROM corpus WHERE k % 10 = 7
UNION ALL SELECT k, '@Mode', 'UNRESOLVED_CALL', 'opaque' FROM corpus WHERE k % 10 = 9
UNION ALL SELECT k, 'Srv' || (k % 3), 'CALLS_REMOTE', NULL FROM corpus WHERE k % 4 = 3
UNION ALL SELECT k, CASE WHEN k % 4 = 1 THEN 'simple' ELSE 'concatenated' END, 'USES_DYNAMIC_SQL', NULL FROM corpus WHERE k % 4 IN (1, 2)
UNION ALL SELECT k, 'templated', 'USES_DYNAMIC_SQL', NULL FROM corpus WHERE k % 8 = 0
UNION ALL SELECT k, '#WorkSet' || (k % 5), 'USES_TEMP_TABLE', NULL FROM corpus
UNION ALL SELECT k, '##SharedRows', 'USES_TEMP_TABLE', NULL FROM corpus WHERE k % 2 = 0
UNION ALL SELECT p_partkey, unnest(['T' || p_size, 'U' || (p_partkey % 7)]), 'USES_TABLE', NULL FROM part
UNION ALL SELECT k, 'OrderTotals', 'USES_TABLE', NULL FROM corpus WHERE k % 5 = 0
UNION ALL SELECT k, unnest(['Alpha', 'Beta']), 'USES_TABLE', NULL FROM corpus WHERE k % 6 = 1
UNION ALL SELECT k, 'Base', 'USES_TABLE', NULL FROM corpus WHERE k % 6 = 4
UNION ALL SELECT k, 'OldRows', 'USES_TABLE', NULL FROM corpus WHERE k % 6 = 0
UNION ALL SELECT k, 'ActionMap', 'USES_TABLE', NULL FROM corpus WHERE k % 10 = 7)"""


@query("g_add_edges", f"{RELATIONS} SELECT k::VARCHAR AS src, dst, rel, certainty FROM rels")
def all_edges(spark, sf_dir):
    return relations(spark, sf_dir)


@query("g_add_proc", f"{RELATIONS}, n AS (SELECT 'usp_P' || k AS name, true AS d FROM corpus UNION ALL SELECT dst, false FROM rels WHERE rel = 'CALLS') SELECT name, bool_or(d) AS defined FROM n GROUP BY name")
def procedure_nodes(spark, sf_dir):
    calls = relations(spark, sf_dir, "CALLS").select(F.concat(F.lit("usp_P"), "src").alias("src"), "dst")
    defined = corpus(spark, sf_dir).select(F.concat(F.lit("usp_P"), F.col("k").cast("string")).alias("name"))
    return g.nodes(calls, defined)


@query("g_constraints", f"{RELATIONS} SELECT rel, dst, count(*)::BIGINT AS uses FROM rels WHERE rel IN ('USES_TABLE', 'USES_TEMP_TABLE') GROUP BY ALL")
def unique_nodes(spark, sf_dir):
    """Nodes that are unique by name, with their uses."""
    kept = relations(spark, sf_dir, "USES_TABLE", "USES_TEMP_TABLE")
    return kept.groupBy("rel", "dst").agg(F.count("*").alias("uses"))


@query("g_linked_report", f"{RELATIONS} SELECT k AS procedure, dst AS server FROM rels WHERE rel = 'CALLS_REMOTE'")
def linked_report(spark, sf_dir):
    return relations(spark, sf_dir, "CALLS_REMOTE").select(F.col("src").cast("long").alias("procedure"), F.col("dst").alias("server")).orderBy("procedure", "server")


@query("g_unresolved_report", f"{RELATIONS} SELECT k AS procedure, rel, dst AS target FROM rels WHERE rel IN ('DYNAMIC_DISPATCH', 'UNRESOLVED_CALL') OR (rel = 'USES_DYNAMIC_SQL' AND dst = 'concatenated')")
def unresolved_report(spark, sf_dir):
    kept = (F.col("rel").isin("DYNAMIC_DISPATCH", "UNRESOLVED_CALL")) | ((F.col("rel") == "USES_DYNAMIC_SQL") & (F.col("dst") == "concatenated"))
    return relations(spark, sf_dir, "DYNAMIC_DISPATCH", "UNRESOLVED_CALL", "USES_DYNAMIC_SQL").filter(kept).select(F.col("src").cast("long").alias("procedure"), "rel", F.col("dst").alias("target"))


@query("g_ref_tables", f"{RELATIONS} SELECT DISTINCT dst AS table_name FROM rels WHERE rel = 'USES_TABLE' ORDER BY 1")
def ref_tables(spark, sf_dir):
    return relations(spark, sf_dir, "USES_TABLE").select(F.col("dst").alias("table_name")).distinct().orderBy("table_name")


@query("g_schema", f"{RELATIONS} SELECT rel, count(*)::BIGINT AS edges, count(DISTINCT k)::BIGINT AS sources, count(certainty)::BIGINT AS with_certainty FROM rels GROUP BY rel")
def relation_kinds(spark, sf_dir):
    rels = relations(spark, sf_dir)
    return rels.groupBy("rel").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count("certainty").alias("with_certainty"))
