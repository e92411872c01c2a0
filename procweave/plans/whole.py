"""The analysis as a whole, and the hooks for a user's generator and reviewer."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.analysis import analyze_procedures, generate
from procweave.operators import extract as x
from procweave.plans.extraction import corpus
from procweave.plans.graph import RELATIONS
from procweave.plans.reports import prompts
from procweave.registry import query
from procweave.session import table
from procweave.sources import sinks


@query("g_pipeline", f"""{RELATIONS} SELECT 'procedures' AS what, count(*)::BIGINT AS n FROM corpus UNION ALL SELECT 'edges', count(*)::BIGINT FROM rels
UNION ALL SELECT 'nodes', count(DISTINCT name)::BIGINT FROM (SELECT 'usp_P' || k AS name FROM corpus UNION ALL SELECT dst FROM rels WHERE rel = 'CALLS')""")
def pipeline(spark, sf_dir):
    """Parse, trace and link all procedures; how many rows each result has."""
    name, _ = x.procedure_name(F.col("raw_sql"))
    result = analyze_procedures(corpus(spark, sf_dir).withColumn("procedure_name", name))
    count = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count("procedures", result.procedures).unionByName(count("edges", result.edges)).unionByName(count("nodes", result.nodes))


@query("mg_llm", "SELECT p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE 'usp_P' || p_partkey END AS output, CASE WHEN p_partkey % 50 = 49 THEN 'ValueError: no answer' END AS error FROM part")
def generator(spark, sf_dir):
    """A generator of the user's: here it answers with the prompt's first line and fails on some."""

    def first_line(prompt: str) -> str:
        line = prompt.split("\n", 1)[0]
        if int(line.removeprefix("usp_P")) % 50 == 49:
            raise ValueError("no answer")
        return line

    asked = prompts(spark, sf_dir).select(F.col("k").cast("string").alias("procedure_name"), "prompt")
    return generate(asked, first_line)


@query("vl_llm_review", "SELECT page_id::VARCHAR AS name, CASE WHEN contains(html, '<table') THEN 'has a table' ELSE 'fine' END AS output, NULL::VARCHAR AS error FROM pages")
def reviewer(spark, sf_dir):
    """A reviewer of the user's over generated texts."""
    texts = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("procedure_name"), F.coalesce("html", F.lit("")).alias("prompt"))
    return generate(texts, lambda text: "has a table" if "<table" in text else "fine")


@query("sink_graph_clear_embedded", "SELECT 'USES_TABLE' AS rel, count(*)::BIGINT AS n FROM nation")
def clear_by_relation(spark, sf_dir):
    """A store with one folder a relation is cleared relation by relation; those not named stay."""
    path = sinks.shared_folder(spark, "graph")
    edges = table(spark, sf_dir, "nation").select(F.col("n_name").alias("src"), F.col("n_regionkey").cast("string").alias("dst"))
    for rel in ("CALLS", "CALLS_REMOTE", "USES_TABLE"):
        sinks.write_graph(edges, path, rel)
    for rel in ("CALLS", "CALLS_REMOTE"):
        sinks.clear_graph(spark, path, rel)
    return spark.read.parquet(path).groupBy(F.col("label").alias("rel")).agg(F.count("*").alias("n"))


@query("src_config", "SELECT p_partkey, p_size > 25 AS large FROM part")
def configured(spark, sf_dir):
    """A setting in force: the threshold from which a procedure counts as large."""
    from procweave.sources.config import AnalysisConfig

    config = AnalysisConfig().with_values({"large_procedure_threshold": 25})
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > config.large_procedure_threshold).alias("large"))
