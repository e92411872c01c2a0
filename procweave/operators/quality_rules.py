"""Rules over generated text, chunking of procedures, prompt context and run reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule that a text breaks where ``broken`` holds."""

    code: str
    severity: str
    message: str
    broken: Column


def count_of(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def structural_rules(text: Column, method: Column) -> list[Rule]:
    """The checks on a generated service; the first stops the others."""
    return [
        Rule("EMPTY_OUTPUT", "error", "output has fewer than 50 characters", F.length(F.trim(text)) < 50),
        Rule("MISSING_PACKAGE", "error", "no package declaration", ~F.rlike(text, F.lit(r"(?m)^\s*package\s+[\w.]+\s*;"))),
        Rule("MISSING_SERVICE_ANNOTATION", "error", "no @Service annotation", ~F.contains(text, F.lit("@Service"))),
        Rule("MISSING_CLASS_DECLARATION", "error", "no class declaration", ~F.rlike(text, F.lit(r"\bclass\s+\w+"))),
        Rule("UNBALANCED_BRACES", "error", "opening and closing braces differ in number", count_of(text, "{") != count_of(text, "}")),
        Rule("MISSING_METHOD", "warning", "expected method is not there", ~F.contains(text, method)),
    ]


def apply_rules(df: DataFrame, text: str, rules: list[Rule], stop_first: bool = True) -> DataFrame:
    """Add issues (code, severity, message), todo_count and passed. A null text counts as empty."""
    safe = F.coalesce(F.col(text), F.lit(""))
    issue = lambda r: F.when(r.broken, F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message")))
    todo = F.regexp_count(safe, F.lit("// TODO")).cast("long")
    noted = F.when(todo > 0, F.struct(F.lit("TODO_FOUND").alias("code"), F.lit("warning").alias("severity"), F.lit("open tasks in the text").alias("message")))
    every = F.array_compact(F.array(*[issue(r) for r in rules], noted))
    issues = F.when(rules[0].broken, F.array(issue(rules[0]))).otherwise(every) if stop_first else every
    return df.withColumns({"issues": issues, "todo_count": todo}).withColumn("passed", ~F.exists("issues", lambda i: i["severity"] == "error"))


def group_blocks(blocks: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Chunks of at most ``most`` consecutive blocks, joined by blank lines, with index, total and position."""
    grouped = blocks.groupBy(key, F.floor(F.col("block") / most).cast("long").alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "content"))), lambda b: b["content"]), "\n\n").alias("sql_content")
    )
    total = F.count("*").over(Window.partitionBy(key))
    return grouped.withColumn("total", total).withColumn("position", position(F.col("chunk"), F.col("total")))


def position(index: Column, total: Column) -> Column:
    return F.when(total == 1, "only").when(index == 0, "first").when(index == total - 1, "last").otherwise("middle")


def split_text(df: DataFrame, keys: list[str], text: str, size: int, overlap: int, separator: str = "\n") -> DataFrame:
    """Chunks of at most ``size`` characters that end at separators where one is near, and begin ``overlap`` before the end of the last.

    Pieces between separators are packed greedily by a fold over the text's pieces; a piece longer than a chunk is
    cut. Chunk boundaries are offsets into the text, so the chunks without their overlaps give the text back.
    """
    cut = F.concat(F.lit("(?s)[^"), F.lit(separator), F.lit("]*"), F.lit(separator), F.lit("|[^"), F.lit(separator), F.lit("]+$"))
    lengths = F.flatten(
        F.transform(
            F.regexp_extract_all(text, cut, F.lit(0)),
            lambda p: F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(p) - 1) / (size - overlap)).cast("int"))),
                lambda i: F.least(F.lit(size - overlap), F.length(p) - i * (size - overlap)).cast("long"),
            ),
        )
    )
    start = F.struct(F.array(F.lit(0).cast("long")).alias("starts"), F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("at"))

    def step(a, n):
        full = (a["held"] > 0) & (a["held"] + n > size - overlap)
        return F.struct(
            F.when(full, F.array_append(a["starts"], a["at"])).otherwise(a["starts"]).alias("starts"),
            F.when(full, n).otherwise(a["held"] + n).alias("held"),
            (a["at"] + n).alias("at"),
        )

    starts = F.aggregate(lengths, start, step, lambda a: a["starts"])
    rows = df.filter(F.length(text) > 0).select(*keys, text, starts.alias("_s"))
    rows = rows.select(*keys, text, "_s", F.posexplode("_s").alias("index", "begin"))
    end = F.coalesce(F.get("_s", F.col("index") + 1), F.length(text).cast("long"))
    begin = F.greatest(F.lit(0).cast("long"), F.when(F.col("index") > 0, F.col("begin") - overlap).otherwise(F.col("begin")))
    return rows.select(
        *keys,
        F.col("index").cast("long").alias("chunk"),
        F.size("_s").cast("long").alias("total"),
        F.col("begin").alias("begin"),
        end.alias("end"),
        position(F.col("index"), F.size("_s")).alias("position"),
        F.substring(F.col(text), (begin + 1).cast("int"), (end - begin).cast("int")).alias("content"),
    )


def latest_status(events: DataFrame, keys: list[str], order: list[str], status: str) -> DataFrame:
    """The last status of each key."""
    return events.groupBy(*keys).agg(F.max_by(status, F.struct(*order)).alias(status))
