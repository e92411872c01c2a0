"""The whole analysis as one call: sources in, lazy tables out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.operators import edge_cases, extract, graph, plsql
from procweave.sources.config import AnalysisConfig
from procweave.sources.corpus import last_definitions, read_sources
from procweave.sources.sinks import kept


@dataclass(frozen=True)
class Analysis:
    """Tables of one analysis; each is planned when it is asked for an action and not before, but for the statements and the calls by variable,
    which several of them take and which are written once."""

    procedures: DataFrame
    calls: DataFrame
    tables: DataFrame
    linked: DataFrame
    dynamic: DataFrame
    variable_calls: DataFrame
    edges: DataFrame
    nodes: DataFrame

    def order(self) -> DataFrame:
        """name and level: what a procedure calls comes before it."""
        calls = self.edges.filter("rel = 'CALLS'").select("src", "dst")
        return graph.levels(calls, self.nodes)


def analyze_procedures(procedures: DataFrame, config: AnalysisConfig | None = None) -> Analysis:
    """Analyse procedures (procedure_name, raw_sql)."""
    config = config or AnalysisConfig()
    key, text = "procedure_name", F.col("raw_sql")
    rows = procedures.select(key, "raw_sql")
    if config.dialect == "oracle":
        calls = rows.select(key, F.explode(plsql.called(text)).alias("callee"))
        tables = rows.select(key, F.explode(plsql.tables(text)).alias("table_name"))
        found = edge_cases.statement_table(rows, key, dialect=edge_cases.PLSQL)
        linked = edge_cases.database_links(rows, key)
        dynamic, variable = edge_cases.immediate_sql(rows, key, found=found), edge_cases.dispatches(rows, key, found=found)
        temps = rows.select(key, F.explode(plsql.collections(text)).alias("name"))
    else:
        calls = rows.select(key, F.explode(extract.called_procedures(text, config.mode)).alias("callee"))
        found = edge_cases.statement_table(rows, key, with_tables=True)
        tables = found.select(key, F.explode("tables").alias("t")).select(key, F.col("t.name").alias("table_name")).distinct()
        linked = edge_cases.linked_servers(rows, key, mode=config.mode)
        dynamic, variable = edge_cases.dynamic_sql(rows, key, found=found), edge_cases.variable_calls(rows, key, found=found)
        temps = extract.temp_tables(rows, key, mode=config.mode)
    # Edges and nodes both take them.
    variable = kept(variable, "variable-calls")
    edges = graph.typed_edges(calls, linked, dynamic, variable, tables, temps, key)
    by_call = edges.filter("rel = 'CALLS'").select("src", "dst")
    nodes = graph.nodes(by_call, rows.select(F.col(key).alias("name")))
    return Analysis(rows, calls, tables, linked, dynamic, variable, edges, nodes)


def analyze(spark: SparkSession, folder: str, config: AnalysisConfig | None = None) -> Analysis:
    """Read a folder of sources and analyse them; the last definition of a name counts."""
    config = config or AnalysisConfig()
    sources = read_sources(spark, folder, config.dialect)
    if config.dialect == "oracle":
        units = plsql.units(sources.withColumn("k", F.col("source_file")), "k").select(F.col("unit").alias("procedure_name"), "raw_sql", F.lit(0).alias("file_rank"), F.col("k").alias("source_file"))
    else:
        name, _ = extract.procedure_name(F.col("raw_sql"))
        units = sources.withColumn("procedure_name", name)
    return analyze_procedures(last_definitions(units), config)


def generate(prompts: DataFrame, write: Callable[[str], str], name: str = "procedure_name", prompt: str = "prompt") -> DataFrame:
    """Call the user's generator on each prompt: name, output, error. One failure does not stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch[name], batch[prompt], strict=True):
                try:
                    out.append((key, write(text), None))
                except Exception as problem:  # noqa: BLE001  whatever the user's generator raises is its item's error
                    out.append((key, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(out, columns=["name", "output", "error"])

    return prompts.select(name, prompt).mapInPandas(run, "name string, output string, error string")


def generate_in_order(planned: DataFrame, prompts: DataFrame, write: Callable[[str], str]) -> DataFrame:
    """Generate what a plan (name, level, defined) orders: name, level, outcome, output, error.

    Names that the corpus does not define are skipped, failures are kept beside what succeeded. Levels are independent
    of each other but for their order, so all of them run in one pass.
    """
    made = generate(prompts, write).withColumnRenamed("name", "made")
    joined = planned.join(made, F.col("defined") & (F.col("name") == F.col("made")), "left")
    outcome = F.when(~F.col("defined"), "skipped").when(F.col("error").isNotNull(), "failed").when(F.col("made").isNotNull(), "migrated").otherwise("no prompt")
    return joined.select("name", "level", outcome.alias("outcome"), "output", "error")


def generate_by_level(planned: DataFrame, prompts: DataFrame, calls: DataFrame, write: Callable[[str], str], folder: str, context: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Generate level by level, so that each prompt knows what its callees became: name, level, outcome, output, error.

    planned is (name, level, defined), calls (src, dst), prompts (procedure_name, prompt). A prompt is followed by one line
    for each callee, in order of name, which context makes of the callee's name, outcome and output. Every level is written
    to its own folder and counts once its _SUCCESS is there; a run that is started again goes on after the last such level.
    Names that the corpus does not define are skipped, names without a level (those on and above cycles) come last.
    """
    spark = planned.sparkSession
    context = context or (lambda name, outcome, output: F.concat_ws(" ", outcome, name))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    level_path = lambda level: f"{folder}/level={level}"
    is_done = lambda level: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{level_path(level)}/_SUCCESS"))
    schema = "name string, outcome string, output string, error string"
    last = planned.agg(F.max("level")).first()[0]
    # Names without a level follow all others; -1 stands for none.
    for level in [*range(0 if last is None else last + 1), -1]:
        if is_done(level):
            continue
        own = planned.filter(F.coalesce("level", F.lit(-1)) == level)
        earlier = [level_path(n) for n in range(0 if last is None else last + 1) if (n < level or level < 0) and is_done(n)]
        made = spark.read.schema(schema).parquet(*earlier) if earlier else spark.createDataFrame([], schema)
        line = context(F.col("callee"), F.coalesce("outcome", F.lit("unknown")), F.col("output"))
        of_callees = calls.select("src", F.col("dst").alias("callee")).distinct().join(own.select(F.col("name").alias("src")), "src", "left_semi").join(made.withColumnRenamed("name", "callee"), "callee", "left")
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("callee", line.alias("line")))), lambda x: x["line"]), "\n")
        told = of_callees.groupBy(F.col("src").alias("told_name")).agg(listed.alias("told"))
        whole = prompts.join(own.filter("defined").select("name"), F.col("procedure_name") == F.col("name"), "left_semi").join(told, F.col("procedure_name") == F.col("told_name"), "left")
        whole = whole.select("procedure_name", F.concat_ws("\n", "prompt", "told").alias("prompt"))
        generated = generate_in_order(own, whole, write).select("name", "outcome", "output", "error")
        generated.write.mode("overwrite").parquet(level_path(level))
    rows = spark.read.schema(schema + ", level long").option("basePath", folder).parquet(*[level_path(n) for n in [*range(0 if last is None else last + 1), -1]])
    return rows.select("name", F.nullif("level", F.lit(-1)).alias("level"), "outcome", "output", "error")


def generate_in_chunks(chunks: DataFrame, write: Callable[[str, str, str], str], key: str = "procedure_name", content: str = "sql_content") -> DataFrame:
    """Generate a large procedure chunk by chunk (key, chunk, position, content): key, output, error.

    write gets a chunk, its position (first, middle, last, only) and its own output for the chunk before; the outputs are
    joined. The chunks of one procedure, which one call after the other must see in order, stand together in a sorted
    partition and pass as a stream: what is held is one procedure's output, and no procedure is a group of its own.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, made, before, error = False, [], "", None
        for batch in batches:
            done = []
            for name, text, position in zip(*(batch.column(c).to_pylist() for c in (key, content, "position")), strict=True):
                if not open_ or name != current:
                    if open_:
                        done.append((current, None if error else "".join(made), error))
                    open_, current, made, before, error = True, name, [], "", None
                if error is None:
                    try:
                        before = write(text, position, before)
                        made.append(before + "\n")
                    except Exception as problem:  # noqa: BLE001  as above
                        error = f"{type(problem).__name__}: {problem}"
            yield answers(done, batch.schema.field(key).type)
            last = batch.schema.field(key).type
        if open_:
            yield answers([(current, None if error else "".join(made), error)], last)

    def answers(done: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
        names, outputs, errors = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(names, type_), pa.array(outputs, pa.string()), pa.array(errors, pa.string())], [key, "output", "error"])

    ordered = chunks.select(key, "chunk", "position", content).repartition(key).sortWithinPartitions(key, "chunk")
    return ordered.mapInArrow(fold, f"{key} {kind}, output string, error string")
