"""What T-SQL procedures declare and use, by column expressions and joins over their texts and lines.

``mode="documented"`` follows what the analysis is meant to find; ``mode="coded"`` keeps quirks of the analysis that it
replaces where a caller may depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.functions.dialect import snake_case
from procweave.operators.code import let, stripped, unified
from procweave.session import dealt

#: Fixed value: the header of a procedure: optional schema, then name, brackets optional.
HEADER = r"(?i)CREATE\s+(?:OR\s+ALTER\s+)?PROC(?:EDURE)?\s+(?:\[?(\w+)\]?\.)?\[?(\w+)\]?"
PARAMETER = r"(?i)@(\w+)\s+(\w+(?:\([^)]*\))?)(?:\s*=\s*([^,\s]+))?(?:\s+(OUTPUT|OUT)\b)?"
CALL = r"(?i)\bEXEC(?:UTE)?[ \t]+(?:\[?(\w+)\]?\.)?(?:\[?(\w+)\]?\.)?\[?(\w+)\]?(?![\w\]]|[ \t]*\.|\()"
TABLE_WORD = r"(?i)\b(?:FROM|JOIN|INTO|UPDATE|MERGE(?:[ \t]+INTO)?)[ \t]+(?!SET\b|INTO\b)((?:\[?#{0,2}\w+\]?\.){0,3}\[?#{0,2}\w+\]?)"

#: Procedures of the server itself.
SYSTEM_CALL = r"(?i)^(xp_\w+|sp_executesql|sp_rename|sp_help\w*|sp_who\d?|sp_addlinkedserver|sp_getapplock|sp_releaseapplock)$"
CODED_SYSTEM_CALL = r"^(sp_|xp_)"
PSEUDO_TABLES = ("inserted", "deleted")


def found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: Whichever of a block comment, a line comment and a literal begins first hides the others.
HIDDEN = r"(?s)/\*.*?\*/|--[^\n]*|\bN?'[^']*+(?:''[^']*+)*+'|'[^']*+(?:''[^']*+)*+'"


def bare(text: Column) -> Column:
    """A text whose comments and literals are blanks, so that only code is left."""
    return F.regexp_replace(text, HIDDEN, " ")


def procedure_name(text: Column) -> tuple[Column, Column]:
    """Name and schema; ``UnknownProcedure`` and ``dbo`` if there are none."""
    name, schema = F.regexp_extract(text, HEADER, 2), F.regexp_extract(text, HEADER, 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("UnknownProcedure")), F.coalesce(F.nullif(schema, F.lit("")), F.lit("dbo"))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1)).cast("long")


def parameters(procedures: DataFrame, text: str = "raw_sql") -> DataFrame:
    """One row a parameter: its place, name, type, direction and default."""
    header = F.regexp_extract(F.col(text), HEADER + r"([\s\S]*?)\bAS\b", 3)
    groups = F.arrays_zip(*[found(header, PARAMETER, g).alias(n) for g, n in ((1, "name"), (2, "sql_type"), (3, "default_value"), (4, "out_word"))])
    keep = [c for c in procedures.columns if c != text]
    rows = procedures.select(*keep, F.posexplode(groups).alias("place", "p"))
    return rows.select(
        *keep,
        F.col("place").cast("long"),
        F.concat(F.lit("@"), "p.name").alias("name"),
        F.col("p.sql_type"),
        F.when(F.col("p.out_word") != "", "OUT").otherwise("IN").alias("direction"),
        F.nullif("p.default_value", F.lit("")).alias("default_value"),
    )


def staging_name(temp: Column) -> Column:
    """#OrderRows becomes stg_order_rows."""
    return F.concat(F.lit("stg_"), snake_case(F.regexp_replace(temp, "^#+", "")))


CREATE_TEMP = r"(?i)CREATE\s+TABLE\s+(#{1,2}\w+)\s*\(((?:[^()]|\([^()]*\))*)\)"
#: Fixed value: the coded rule ends at the first closing bracket.
CODED_CREATE_TEMP = r"(?i)CREATE\s+TABLE\s+(#{1,2}\w+)\s*\(([^)]+)\)"
INTO_TEMP = r"(?i)\bSELECT\b[^;]*?\bINTO\s+(#{1,2}\w+)"


def temp_tables(procedures: DataFrame, key: str, text: str = "raw_sql", mode: str = "documented") -> DataFrame:
    """One row a temporary table: name, staging name, whether global, column text, and how it is made; the first wins."""
    pattern = CREATE_TEMP if mode == "documented" else CODED_CREATE_TEMP
    created = procedures.select(key, F.posexplode(F.arrays_zip(found(F.col(text), pattern, 1).alias("name"), found(F.col(text), pattern, 2).alias("columns"))).alias("place", "t"))
    created = created.select(key, F.lit(0).alias("kind"), "place", F.col("t.name").alias("name"), F.col("t.columns").alias("columns"))
    selected = procedures.select(key, F.posexplode(found(F.col(text), INTO_TEMP, 1)).alias("place", "name"))
    selected = selected.select(key, F.lit(1).alias("kind"), "place", "name", F.lit(None).cast("string").alias("columns"))
    first = Window.partitionBy(key, "name").orderBy("kind", "place")
    rows = created.unionByName(selected).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return rows.select(
        key,
        "name",
        staging_name(F.col("name")).alias("staging_name"),
        F.col("name").startswith("##").alias("is_global"),
        F.when(F.col("kind") == 0, "CREATE").otherwise("SELECT INTO").alias("made_by"),
        "columns",
    )


def column_defs(temps: DataFrame, keys: list[str], columns: str = "columns", mode: str = "documented") -> DataFrame:
    """One row a column: place, name, type and whether it may be null. Commas inside brackets do not split."""
    # Commas inside parentheses are hidden while the text is split.
    hidden = F.regexp_replace(columns, r"\(\s*(\w+)\s*,\s*(\w+)\s*\)", "($1\u0001$2)") if mode == "documented" else F.col(columns)
    rows = temps.select(*keys, F.posexplode(F.split(hidden, ",")).alias("place", "item"))
    item = F.trim(F.regexp_replace(F.replace("item", F.lit("\u0001"), F.lit(",")), r"\s+", " "))
    words = F.split(F.regexp_replace(item, r"[\[\]]", ""), " ")
    return rows.filter(F.size(words) >= 2).select(
        *keys,
        F.col("place").cast("long"),
        F.get(words, F.lit(0)).alias("name"),
        F.get(words, F.lit(1)).alias("sql_type"),
        (~F.upper(item).contains("NOT NULL")).alias("nullable"),
    )


def called_procedures(text: Column, mode: str = "documented") -> Column:
    """Procedures called by name, each once, in order; calls by variable and to other servers are none of them."""
    names = F.array_distinct(found(bare(text) if mode == "documented" else text, CALL, 3))
    system = SYSTEM_CALL if mode == "documented" else CODED_SYSTEM_CALL
    return F.filter(names, lambda n: ~F.rlike(n, F.lit(system)))


#: Words that end a table's place and so are never its alias, nor a table.
CLAUSE = (
    r"(?:ON|WHERE|INNER|LEFT|RIGHT|FULL|CROSS|OUTER|JOIN|GROUP|ORDER|HAVING|SET|SELECT|VALUES|UNION|EXCEPT|INTERSECT|MINUS|WHEN|USING|WITH|OUTPUT|FROM|EXEC|EXECUTE|OPTION"
    r"|FOR|INTO|UPDATE|DELETE|INSERT|MERGE|DECLARE|IF|ELSE|BEGIN|END|RETURN|WHILE|PRINT|DEFAULT|GO|TOP|OPEN|FETCH|CLOSE|COMMIT|ROLLBACK|CONNECT|START|RETURNING|LOOP|BULK|STATISTICS)\b"
)
TABLE_NAME = r"(?:\[?#{0,2}\w+\]?\.){0,3}\[?#{0,2}\w+\]?"
TABLE_ITEM = rf"(?!{CLAUSE}){TABLE_NAME}(?:(?:\s+AS)?\s+(?!{CLAUSE}|AS\b)\[?\w+\]?)?(?:\s*WITH\s*\([^)]*\))?"
TABLE_LIST = rf"(?i)\b(?:FROM|JOIN|USING|INTO|UPDATE|(?:INSERT|MERGE|DELETE)(?:\s+(?:INTO|FROM))?)\s+({TABLE_ITEM}(?:\s*,\s*{TABLE_ITEM})*+)"
COMMON_TABLE = r"(?i)(?:\bWITH|,)\s+(\w+)(?:\s*\([^)]*\))?\s+AS\s*\("
CURSOR_READ = r"(?i)\bFETCH\s+(?:(?:NEXT|PRIOR|FIRST|LAST)\s+)?FROM\s+\w+"


def listed(lists: Column) -> Column:
    """The tables of comma lists, in order: structs (name, alias in lower case or null)."""
    items = F.flatten(F.transform(lists, lambda x: F.split(F.regexp_replace(x, r"(?i)\s*WITH\s*\([^)]*\)", ""), r"\s*,\s*")))

    def parts(item):
        words = F.split(F.trim(F.regexp_replace(item, r"[\[\]]", "")), r"\s+(?:(?i:AS)\s+)?")
        return F.struct(F.get(words, F.lit(0)).alias("name"), F.lower(F.get(words, F.lit(1))).alias("alias"))

    return F.transform(items, parts)


def referenced_tables(text: Column) -> Column:
    """Tables after FROM (lists too), JOIN, USING, INTO, INSERT, UPDATE, DELETE and MERGE, each once, in order of appearance.

    Temporary and pseudo tables are none, and neither are objects of other servers (four-part names), names of common
    table expressions, cursors, aliases that an UPDATE or DELETE names, or what stands in comments and literals.
    """

    def named(code):
        tables = listed(found(code, TABLE_LIST, 1)).alias("tables")
        return let(F.struct(tables, F.transform(found(code, COMMON_TABLE, 1), lambda n: F.lower(n)).alias("common")), local)

    def local(s):
        # A bare name that is another table's alias stands for that table.
        own = lambda t: t["alias"].isNotNull() | ~F.exists(s["tables"], lambda o: F.coalesce(o["alias"] == F.lower(t["name"]), F.lit(False)))
        here = F.filter(s["tables"], lambda t: (F.size(F.split(t["name"], "[.]")) < 4) & own(t))
        names = F.array_distinct(F.transform(here, lambda t: F.element_at(F.split(t["name"], "[.]"), -1)))
        return F.filter(names, lambda n: ~n.startswith("#") & ~F.lower(n).isin(*PSEUDO_TABLES) & ~F.array_contains(s["common"], F.lower(n)))

    return let(F.regexp_replace(bare(text), CURSOR_READ, " "), named)


#: First words of a line and the block that they open, in the order of the tests.
BLOCK_KINDS = (
    ("DECLARATION", r"^DECLARE\b"),
    ("TEMP_TABLE_CREATE", r"^CREATE TABLE #"),
    ("TRY_CATCH", r"^BEGIN TRY"),
    ("TRANSACTION", r"^BEGIN TRAN"),
    ("WHILE_LOOP", r"^WHILE\b"),
    ("IF_ELSE", r"^IF\b"),
    ("PROCEDURE_CALL", r"^EXEC"),
    ("DML_OPERATION", r"^(INSERT|UPDATE|DELETE|MERGE)"),
    ("SELECT_QUERY", r"^SELECT"),
    ("RETURN_BLOCK", r"^RETURN"),
)


def body_lines(procedures: DataFrame, key: str, text: str = "raw_sql") -> DataFrame:
    """One row a line after the header, which ends at the first line that begins with AS: line (from 0), content, kind.

    What stands after AS on its line is the body's as well.
    """

    def numbered(lines):
        start = F.array_position(F.transform(lines, lambda s: F.rlike(s, F.lit(r"(?i)^\s*AS\b"))), F.lit(True)).cast("int")
        return F.struct(lines.alias("lines"), start.alias("start"), F.regexp_replace(F.get(lines, start - 1), r"(?i)^\s*AS\b\s*", "").alias("rest"))

    # Each is made once for a text, not once for a line.
    parts = let(F.split(unified(F.col(text)), "\n", -1), numbered)

    def kind(up):
        out = F.lit("OTHER")
        for name, pattern in reversed(BLOCK_KINDS):
            out = F.when(F.rlike(up, F.lit(pattern)), name).otherwise(out)
        return F.when(F.rlike(up, F.lit(r"^(BEGIN|GO|BEGIN CATCH|END( TRY| CATCH)?;?)?$")), F.lit(None)).otherwise(out)

    def body(t):
        more = (t["start"] > 0) & (t["rest"] != "")
        first = F.when(more, t["start"] - 1).otherwise(t["start"])
        rest = F.slice(t["lines"], t["start"] + 1, F.size(t["lines"]))
        whole = F.when(more, F.concat(F.array(t["rest"]), rest)).otherwise(rest)
        return F.transform(whole, lambda s, i: F.struct((i + first).cast("long").alias("line"), s.alias("content"), let(F.upper(stripped(s)), kind).alias("kind")))

    # Not by way of a column: a filter on that column's size would make all of it once more, and in the scan's few tasks.
    return dealt(procedures.select(key, text), key).select(key, F.inline(let(parts, body)))


def logical_blocks(procedures: DataFrame, key: str, text: str = "raw_sql") -> DataFrame:
    """Split bodies into blocks: runs of declarations, statements up to their end, nested constructs to their END.

    A line's block depends only on its own first words and, inside a construct, on the depth of BEGIN and END before it,
    so running sums over the lines find the blocks: a line opens a block unless a construct or a statement is open.
    """
    rows = body_lines(procedures, key, text).withColumn("up", F.upper(stripped(F.col("content"))))
    up = F.col("up")
    whole = Window.partitionBy(key).orderBy("line")
    so_far = whole.rowsBetween(Window.unboundedPreceding, 0)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.rlike(up, F.lit(r"^BEGIN\b")) & (F.min("line").over(Window.partitionBy(key)) < F.col("line"))
    opens = F.coalesce(opens, F.lit(False)) | F.rlike(up, F.lit(r"^BEGIN TRY"))
    # TRY and CATCH are one construct, and a transaction has no END.
    inside = F.rlike(up, F.lit(r"^(BEGIN CATCH|END TRY|BEGIN TRAN)"))
    step = F.when(inside, 0).when(opens, 1).when(F.rlike(up, F.lit(r"^END\b")), -1).otherwise(0)
    rows = rows.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    # A statement is open from its first word to a line that ends it; lines of no kind are blocks of their own.
    ends = F.rlike("content", F.lit(r";\s*$")) | F.col("kind").isNull()
    last = lambda condition: F.max(F.when(condition, F.col("line"))).over(before)
    begun, closed = last(F.col("kind") != "OTHER"), last(ends)
    rows = rows.withColumn("ended", F.coalesce(begun <= closed, begun.isNull()))
    same_run = (F.col("kind") == "DECLARATION") & (F.lag("kind").over(whole) == "DECLARATION")
    new = F.col("kind").isNotNull() & (F.col("depth") <= 0) & F.col("ended") & ~F.coalesce(same_run, F.lit(False))
    rows = rows.withColumn("block", F.sum(new.cast("int")).over(so_far)).filter("block > 0 and (kind is not null or depth > 0)")
    return rows.groupBy(key, "block").agg(
        F.min_by("kind", "line").alias("block_type"),
        F.min("line").alias("start_line"),
        F.max("line").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("content"),
    ).withColumn("block", (F.col("block") - 1).cast("long"))


def block_variables(content: Column) -> tuple[Column, Column]:
    """Variables that a block reads or names, and those that it sets, each once, in order."""
    used = F.array_distinct(found(content, r"(@\w+)", 1))
    set_ = F.array_distinct(F.concat(found(content, r"(?i)\bSET\s+(@\w+)\s*=", 1), found(content, r"(?i)\bSELECT\s+(@\w+)\s*=", 1)))
    return used, set_
