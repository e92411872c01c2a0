"""What PL/SQL units declare and use. Packages are unwrapped by running sums over their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.functions.dialect import snake_case
from procweave.operators.code import coded, let, stripped, unified, up_to_close
from procweave.operators.extract import CLAUSE, COMMON_TABLE, bare, found, listed
from procweave.sources.corpus import lines_of

UNIT = r"(?i)^\s*(?:PROCEDURE|FUNCTION)\s+(?:(\w+)\.)?(\w+)"

#: Packages of the server itself.
SYSTEM_PACKAGES = ("DBMS_OUTPUT", "DBMS_SQL", "UTL_FILE", "UTL_HTTP", "SYS", "STANDARD", "DUAL")


#: Prefixes of temporary names, and of variables and parameters.
TEMP_PREFIXES = ("t_", "gtt_", "tmp_", "temp_")
VARIABLE_PREFIXES, PARAMETER_PREFIXES = ("v_", "l_"), ("p_",)


def any_of(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(words)})"


def code_words(text: Column) -> Column:
    """The words of a piece of code; brackets stand alone."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(bare(text), r"([()])", " $1 "), r"\s+", " ")), " ")


def after_word(words: Column, word: str, rule) -> Column:
    """rule(following), for the word after the first occurrence of a word and on; null if there is none."""

    def found_at(w):
        at = F.array_position(F.transform(w, F.upper), F.lit(word)).cast("int")
        return F.when(at > 0, rule(lambda n: F.get(w, at + n)))

    return let(words, found_at)


def package_of(text: Column) -> Column:
    """body and name of the package that a source opens with: words of its head, read one after the other; null if none."""
    head = F.slice(code_words(F.substring(text, 1, 4000)), 1, 8)
    is_body = lambda nth: F.upper(nth(0)) == "BODY"
    name = lambda nth: F.element_at(F.split(F.when(is_body(nth), nth(1)).otherwise(nth(0)), "[.]"), -1)
    return after_word(head, "PACKAGE", lambda nth: F.struct(is_body(nth).alias("body"), name(nth).alias("name")))


def units(sources: DataFrame, key: str, text: str = "raw_sql") -> DataFrame:
    """One row a unit: key, unit (package.name within packages), place, and its own text with line feeds alone. Specifications give none.

    A package's units begin at the headers that stand outside of BEGIN and END; the depth is a running sum over lines.
    """
    sources = sources.withColumn(text, unified(F.col(text)))
    opened_by = package_of(F.col(text))
    bodies = sources.filter(F.coalesce(opened_by["body"], F.lit(True)))
    package = opened_by["name"]
    alone = bodies.filter(package.isNull()).select(
        key, F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(?:PROCEDURE|FUNCTION)\s+(?:\w+\.)?(\w+)", 1), F.lit("")), F.lit("UnknownProcedure")).alias("unit"), F.lit(0).cast("long").alias("place"), F.col(text)
    )
    rows = lines_of(bodies.filter(package.isNotNull()).select(key, package.alias("package"), text), text)
    up = F.upper("content")
    opened = F.size(found(up, r"\b(BEGIN)\b", 1))
    closed = F.size(found(up, r"\b(END)\b(?!\s+(?:IF|LOOP|CASE|WHILE)\b)", 1))
    before = Window.partitionBy(key).orderBy("line")
    depth = F.coalesce(F.sum(opened - closed).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("depth", depth).withColumn("head", F.rlike("content", F.lit(UNIT)) & (F.col("depth") <= 0))
    # The package's own END comes last: the depth falls below zero there.
    rows = rows.withColumn("after", F.col("depth") + opened - closed)
    rows = rows.withColumn("place", F.sum(F.col("head").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    inside = rows.filter("place >= 0 and after >= 0")
    packed = inside.groupBy(key, "package", "place").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("l"))
    own_text = F.array_join(F.transform("l", lambda x: x["content"]), "\n")
    name = F.regexp_extract(F.get("l", F.lit(0))["content"], UNIT, 2)
    return alone.unionByName(packed.select(key, F.concat_ws(".", "package", name).alias("unit"), F.col("place").cast("long"), own_text.alias(text)))


def body(text: Column) -> Column:
    """From the first BEGIN on; the whole text if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)\bBEGIN\b[\s\S]*", 0), F.lit("")), text)


def parameters(rows: DataFrame, keys: list[str], text: str = "raw_sql") -> DataFrame:
    """One row a parameter: place, name, direction (IN, OUT, INOUT), type and default."""
    signature = F.regexp_extract(text, r"(?i)(?:PROCEDURE|FUNCTION)\s+[\w.]+\s*\(((?:[^()]|\([^()]*\))*)\)", 1)
    hidden = F.regexp_replace(signature, r"\(\s*(\w+)\s*,\s*(\w+)\s*\)", "($1\u0001$2)")
    items = rows.filter(F.trim(signature) != "").select(*keys, F.posexplode(F.split(hidden, ",")).alias("place", "item"))
    item = F.trim(F.replace("item", F.lit("\u0001"), F.lit(",")))
    pattern = r"(?i)^(\w+)\s+(?:(IN\s+OUT|IN|OUT)\s+)?([\w%.]+(?:\([\w,\s]+\))?)(?:\s+DEFAULT\s+(.+))?$"
    way = F.upper(F.regexp_replace(F.regexp_extract(item, pattern, 2), r"\s+", ""))
    return items.filter(F.rlike(item, F.lit(pattern))).select(
        *keys,
        F.col("place").cast("long"),
        F.regexp_extract(item, pattern, 1).alias("name"),
        F.when(way == "", "IN").otherwise(way).alias("direction"),
        F.regexp_extract(item, pattern, 3).alias("sql_type"),
        F.nullif(F.regexp_extract(item, pattern, 4), F.lit("")).alias("default_value"),
    )


def declared(text: Column) -> Column:
    """Names declared between IS or AS and BEGIN."""
    section = F.regexp_extract(text, r"(?i)\b(?:IS|AS)\b([\s\S]*?)\bBEGIN\b", 1)
    names = found(section, r"(?im)^\s*(?!(?:TYPE|SUBTYPE|CURSOR|PRAGMA|PROCEDURE|FUNCTION)\b)(\w+)\s+\w+", 1)
    return names


def collections(text: Column) -> Column:
    """Types that are tables of something."""
    is_table = lambda nth: F.upper(F.concat_ws(" ", nth(1), nth(2), nth(3))) == "IS TABLE OF"
    names = F.transform(F.split(text, ";"), lambda s: after_word(code_words(s), "TYPE", lambda nth: F.when(is_table(nth), nth(0))))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull()))


#: Fixed value: how a global temporary table is made.
GLOBAL_TEMP = r"(?i)\bCREATE\s+GLOBAL\s+TEMPORARY\s+TABLE\s+(\w+)\s*\("


def global_temps(rows: DataFrame, keys: list[str], text: str = "raw_sql") -> DataFrame:
    """Global temporary tables with the text of their columns, up to the bracket that closes it."""
    begun = rows.select(*keys, F.posexplode(F.split(coded(F.col(text))["code"], GLOBAL_TEMP)).alias("place", "rest"), found(coded(F.col(text))["code"], GLOBAL_TEMP, 1).alias("names"))
    first = Window.partitionBy(*keys, "name").orderBy("place")
    made = begun.filter("place > 0").select(*keys, "place", F.get("names", F.col("place") - 1).alias("name"), up_to_close(F.col("rest")).alias("columns"))
    return made.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*keys, "name", "columns")


def staging_name(name: Column) -> Column:
    return F.concat(F.lit("stg_"), snake_case(F.regexp_replace(name, f"(?i)^{any_of(TEMP_PREFIXES)}", "")))


def called(text: Column) -> Column:
    """CALL p(...) and pkg.proc(...) at the start of a statement, each once; the server's packages are left out."""
    own = bare(body(text))
    by_call = F.transform(found(own, r"(?i)\bCALL\s+((?:\w+\.){0,2}\w+)\s*\(", 1), lambda n: n)
    qualified = found(own, r"(?im)(?:^|;)\s*(\w+\.\w+)\s*\(", 1)
    return F.array_distinct(F.concat(by_call, F.filter(qualified, lambda n: ~F.upper(F.substring_index(n, ".", 1)).isin(*SYSTEM_PACKAGES))))


PL_ITEM = rf"(?!{CLAUSE})(?:\w+\.)?\w+\b(?!\s*[(@.])(?:\s+(?!{CLAUSE}|AS\b)\w+\b(?!\s*[(.:]))?"
PL_LIST = rf"(?i)\b(?:FROM|JOIN|INTO|UPDATE|DELETE(?:\s+FROM)?|MERGE\s+INTO)\s+({PL_ITEM}(?:\s*,\s*{PL_ITEM})*+)"


def tables(text: Column) -> Column:
    """Tables after FROM (lists too), JOIN, INTO, UPDATE, DELETE and MERGE INTO, each once.

    Links, calls, DUAL, variables, own types, common table expressions and what stands in comments and literals are none.
    """

    def named(own):
        names = F.transform(listed(found(own, PL_LIST, 1)), lambda t: F.element_at(F.split(t["name"], "[.]"), -1))
        other = F.concat(F.transform(collections(text), lambda t: F.upper(t)), F.transform(found(own, COMMON_TABLE, 1), lambda n: F.upper(n)), F.array(F.lit("DUAL")))
        return let(F.struct(names.alias("names"), other.alias("other")), kept)

    def kept(s):
        return F.array_distinct(F.filter(s["names"], lambda n: ~F.rlike(n, F.lit(f"^{any_of(VARIABLE_PREFIXES + PARAMETER_PREFIXES)}")) & ~F.array_contains(s["other"], F.upper(n))))

    return let(bare(body(text)), named)


#: First words of a line and the block that they open, in the order of the tests.
BLOCK_KINDS = (
    ("EXCEPTION_BLOCK", r"^EXCEPTION\b"),
    ("CURSOR_LOOP", r"^FOR\b.*\bLOOP\b"),
    ("WHILE_LOOP", r"^WHILE\b.*\bLOOP\b"),
    ("LOOP", r"^LOOP\b"),
    ("IF_ELSE", r"^IF\b"),
    ("DYNAMIC_SQL", r"^EXECUTE IMMEDIATE\b"),
    ("DML_OPERATION", r"^(INSERT|UPDATE|DELETE|MERGE)\b"),
    ("SELECT_QUERY", r"^SELECT\b"),
    ("CURSOR_OP", r"^(OPEN|FETCH|CLOSE)\b"),
    ("RETURN_BLOCK", r"^RETURN\b"),
    ("DECLARATION", r"^\w+\s*:="),
)


def blocks(rows: DataFrame, keys: list[str], text: str = "raw_sql") -> DataFrame:
    """The statements and constructs of a body, each to its end; nested ones belong to the outer one."""
    lines = lines_of(rows.select(*keys, unified(body(F.col(text))).alias(text)), text, first=0)
    up = F.upper(stripped(F.col("content")))
    kind = F.lit("OTHER")
    for name, pattern in reversed(BLOCK_KINDS):
        kind = F.when(F.rlike(up, F.lit(pattern)), name).otherwise(kind)
    skip = (up == "") | up.startswith("--") | F.rlike(up, F.lit(r"^(BEGIN|END\b(?!\s+(IF|LOOP|CASE))).*"))
    step = F.when(F.rlike(up, F.lit(r"^(IF\b|(FOR|WHILE)\b.*\bLOOP|LOOP\b)")), 1).when(F.rlike(up, F.lit(r"^END\s+(IF|LOOP)\b")), -1).otherwise(0)
    whole = Window.partitionBy(*keys).orderBy("line")
    lines = lines.withColumns({"kind": F.when(~skip, kind), "step": step, "skip": skip})
    lines = lines.withColumn("depth", F.coalesce(F.sum("step").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ended = F.coalesce(F.lag(F.rlike("content", F.lit(r";\s*$")) | F.col("skip")).over(whole), F.lit(True))
    lines = lines.withColumn("new", F.col("kind").isNotNull() & (F.col("depth") <= 0) & ended)
    lines = lines.withColumn("block", F.sum(F.col("new").cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    inside = lines.filter("block >= 0 and (not skip or depth > 0)")
    return inside.groupBy(*keys, F.col("block").cast("long")).agg(
        F.min_by("kind", "line").alias("block_type"),
        F.min("line").alias("start_line"),
        F.max("line").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("content"),
    )


def block_variables(content: Column) -> tuple[Column, Column]:
    """Variables and parameters that a block names, and variables that it sets, each once, in order."""
    named = found(content, rf"\b({any_of(VARIABLE_PREFIXES + PARAMETER_PREFIXES)}\w+)", 1)
    return F.array_distinct(named), F.array_distinct(found(content, rf"\b({any_of(VARIABLE_PREFIXES)}\w+)\s*:=", 1))
