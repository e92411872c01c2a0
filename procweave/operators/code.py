"""Source texts as code: one normalising step, after which patterns cannot be misled by layout, comments or literals.

``coded`` gives the code of a text: line ends are line feeds, comments are blanks, and each literal is ``'n'``, n being its
place among the text's pieces; line feeds of both are kept, so lines keep their numbers. ``restored`` puts the literals back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, quoted names and literals, whichever begins first, whole even where they never end; and what lies between.
PIECE = r"""(?s)/\*.*?(?:\*/|\z)|--[^\n]*|\[[^\]\n]*\]|"[^"\n]*"|(?:(?<!\w)N)?'(?:[^']|'')*+(?:'|\z)|(?:[^/\-'N\["]++|N(?!'))++|."""

LITERAL = r"'\d+'\n*"


def let(value: Column, use) -> Column:
    """use(value), with the value made once however often it is used there."""
    return F.transform(F.array(value), use)[0]


def unified(text: Column) -> Column:
    """Line feeds as the only line ends."""
    return F.regexp_replace(text, "\r\n?", "\n")


def coded(text: Column) -> Column:
    """A struct: code, and pieces, of which the literals in the code are places."""

    def plain(piece: Column, place: Column) -> Column:
        feeds = F.regexp_replace(piece, "[^\n]+", "")
        literal = F.concat(F.lit("'"), place.cast("string"), F.lit("'"), feeds)
        return F.when(piece.startswith("/*") | piece.startswith("--"), F.concat(F.lit(" "), feeds)).when(quotes(piece), literal).otherwise(piece)

    def quotes(piece: Column) -> Column:
        return piece.startswith("'") | piece.startswith("N'")

    pieces = F.regexp_extract_all(unified(text), F.lit(PIECE), F.lit(0))
    # Only literals are looked up again.
    kept = lambda all_: F.transform(all_, lambda p: F.when(quotes(p), p))
    return let(pieces, lambda all_: F.struct(F.array_join(F.transform(all_, plain), "").alias("code"), kept(all_).alias("pieces")))


def restored(part: Column, pieces: Column) -> Column:
    """A part of the code with its literals as they stand in the source."""
    place = lambda p: F.regexp_extract(p, r"\d+", 0).cast("int")
    parts = F.regexp_extract_all(part, F.lit(f"{LITERAL}|[^']+|'"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^'\d")), F.get(pieces, place(p))).otherwise(p)), "")


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def up_to_close(text: Column) -> Column:
    """What stands before the bracket that closes one opened just before the text; all of it if none does."""
    parts = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), F.lit(0))
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(acc["depth"] == 0, 0).when(part == "(", 1).when(part == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(depth > 0, F.concat(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step)["out"]


def items_of(text: Column) -> Column:
    """The parts of a list: split at the commas that stand outside of all brackets."""
    parts = F.regexp_extract_all(text, F.lit(r"[(),]|[^(),]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("item"), F.array().cast("array<string>").alias("items"))

    def step(acc: Column, part: Column) -> Column:
        depth = F.greatest(acc["depth"] + F.when(part == "(", 1).when(part == ")", -1).otherwise(0), F.lit(0))
        splits = (part == ",") & (acc["depth"] == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(splits, "").otherwise(F.concat(acc["item"], part)).alias("item"),
            F.when(splits, F.concat(acc["items"], F.array(acc["item"]))).otherwise(acc["items"]).alias("items"),
        )

    return let(F.aggregate(parts, start, step), lambda acc: F.concat(acc["items"], F.array(acc["item"])))
