"""Splitting long sources by a ranked list of separators.

A text is split at the first separator of the list that it holds; a fragment that is still too long falls to the separators
after that one, and one that holds none of them stays whole. Fragments begin with their separator. Neighbours that come from
the same split are then packed greedily, and a chunk begins with as many whole fragments of the one before as the overlap
allows. All of it is a fold over the fragments of one row: no shuffle, and only lengths are kept of what is short enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.operators.code import let, stripped

#: Separators by rank, those of T-SQL and those of PL/SQL.
TSQL_SEPARATORS = [
    *("\n" + word for word in ("BEGIN TRY", "BEGIN CATCH", "END TRY", "END CATCH", "BEGIN TRANSACTION", "COMMIT", "ROLLBACK", "DECLARE ", "CREATE TABLE #", "WHILE ", "IF ", "ELSE")),
    *("\n" + word for word in ("INSERT ", "UPDATE ", "DELETE ", "MERGE ", "EXEC ", "SELECT ", "SET ")),
    ";\n",
    "\nEND",
    "\n\n",
    "\n",
]
PLSQL_SEPARATORS = [
    *("\n" + word for word in ("EXCEPTION", "WHEN ", "EXECUTE IMMEDIATE", "BEGIN", "END;", "END LOOP;", "END IF;", "END CASE;", "FOR ", "WHILE ", "LOOP", "IF ", "ELSIF ", "ELSE")),
    *("\n" + word for word in ("INSERT ", "UPDATE ", "DELETE ", "MERGE ", "SELECT ", "OPEN ", "FETCH ", "CLOSE ", "RETURN ")),
    ";\n",
    "\n\n",
    "\n",
]
SEPARATORS = {"tsql": TSQL_SEPARATORS, "oracle": PLSQL_SEPARATORS}

FRAGMENTS = "array<struct<text: string, len: int, up: bigint>>"
CHUNKS = "array<struct<begin: int, end: int, whole: boolean>>"


def fragments(text: Column, size: int, separators: list[str]) -> Column:
    """The fragments of a text, in order: their length, the split that they come from (up), and their text where it is still too long."""
    ranks = F.array(*[F.struct(F.lit(rank << 40).cast("long").alias("rank"), F.lit(s).alias("text")) for rank, s in enumerate(separators)])

    def at_rank(found: Column, separator: Column) -> Column:
        def cut(f: Column, i: Column) -> Column:
            parts = F.split(f["text"], F.concat(F.lit(r"\Q"), separator["text"], F.lit(r"\E")), -1)
            headed = F.transform(parts, lambda p, j: F.when(j == 0, p).otherwise(F.concat(separator["text"], p)))
            made = F.transform(F.filter(headed, lambda p: p != ""), lambda p: F.struct(F.when(F.length(p) >= size, p).alias("text"), F.length(p).alias("len"), (separator["rank"] + i).alias("up")))
            return F.when(F.coalesce(F.contains(f["text"], separator["text"]), F.lit(False)), made.cast(FRAGMENTS)).otherwise(F.array(f).cast(FRAGMENTS))

        return F.flatten(F.transform(found, cut)).cast(FRAGMENTS)

    whole = F.array(F.struct(text.alias("text"), F.length(text).alias("len"), F.lit(-1).cast("long").alias("up"))).cast(FRAGMENTS)
    return F.aggregate(ranks, whole, at_rank)


def packed(found: Column, size: int, overlap: int) -> Column:
    """The chunks of a text's fragments: begin, end, and whether a chunk is one fragment that is too long."""

    def step(acc: Column, x: Column) -> Column:
        """State: begin and end of the chunk so far (end = at), the starts of its fragments, and the split that they come from."""
        n, at = x["len"], acc["at"]
        long = n >= size
        joins = ~long & (x["up"] == acc["up"]) & (F.size(acc["starts"]) > 0)
        fits = joins & (at - F.get(acc["starts"], 0) + n <= size)
        flush = (F.size(acc["starts"]) > 0) & ~fits
        held = F.struct(F.get(acc["starts"], 0).alias("begin"), at.alias("end"), F.lit(False).alias("whole"))
        # Fragments leave from the front until what stays is an overlap and leaves room.
        stays = F.filter(acc["starts"], lambda s: (at - s <= overlap) & (at - s + n <= size))
        starts = F.when(long, F.array().cast("array<int>")).when(fits, F.concat(acc["starts"], F.array(at))).when(joins, F.concat(stays, F.array(at))).otherwise(F.array(at))
        alone = F.struct(at.alias("begin"), (at + n).alias("end"), F.lit(True).alias("whole"))
        chunks = F.when(flush, F.concat(acc["chunks"], F.array(held))).otherwise(acc["chunks"])
        return F.struct((at + n).alias("at"), starts.alias("starts"), F.when(long, -2).otherwise(x["up"]).cast("long").alias("up"), F.when(long, F.concat(chunks, F.array(alone))).otherwise(chunks).cast(CHUNKS).alias("chunks"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"), F.lit(-2).cast("long").alias("up"), F.array().cast(CHUNKS).alias("chunks"))
    last = lambda acc: F.when(F.size(acc["starts"]) > 0, F.concat(acc["chunks"], F.array(F.struct(F.get(acc["starts"], 0).alias("begin"), acc["at"].alias("end"), F.lit(False).alias("whole"))))).otherwise(acc["chunks"])
    return let(F.aggregate(found, start, step), last)


def split_ranked(rows: DataFrame, keys: list[str], text: str, size: int, overlap: int, separators: list[str]) -> DataFrame:
    """One row a chunk: keys, chunk (from 0), total, begin, end, position, and content without white space at its ends.

    Chunks that are white space alone are left out. A chunk is longer than size only if it is one fragment without any separator.
    """
    chunks = packed(fragments(F.col(text), size, separators), size, overlap)
    cut = rows.filter(F.length(text) > 0).select(*keys, text, F.explode(F.array(chunks)).alias("c"))
    content = lambda c: F.substring(F.col(text), c["begin"] + 1, c["end"] - c["begin"])
    shown = F.transform("c", lambda c: F.struct(c["begin"].alias("begin"), c["end"].alias("end"), F.when(c["whole"], content(c)).otherwise(stripped(content(c))).alias("content")))
    kept = cut.select(*keys, F.explode(F.array(F.filter(shown, lambda c: c["content"] != ""))).alias("c"))
    made = kept.select(*keys, F.size("c").cast("long").alias("total"), F.posexplode("c").alias("chunk", "x"))
    index, total = F.col("chunk").cast("long"), F.col("total")
    position = F.when(total == 1, "only").when(index == 0, "first").when(index == total - 1, "last").otherwise("middle")
    return made.select(*keys, index.alias("chunk"), "total", F.col("x.begin").cast("long").alias("begin"), F.col("x.end").cast("long").alias("end"), position.alias("position"), F.col("x.content").alias("content"))
