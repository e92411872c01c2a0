"""Schemas: tables, columns, keys and references out of definitions, type mapping, naming, and staging tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.functions.dialect import camel_case, pascal_case, service_stem
from procweave.operators.code import coded, items_of, up_to_close
from procweave.operators.extract import found

#: SQL Server type names, the target types of generated code and the Spark types.
TYPES = {
    "int": ("Integer", "int"),
    "bigint": ("Long", "bigint"),
    "smallint": ("Short", "smallint"),
    "tinyint": ("Short", "smallint"),
    "bit": ("Boolean", "boolean"),
    "decimal": ("BigDecimal", "decimal"),
    "numeric": ("BigDecimal", "decimal"),
    "money": ("BigDecimal", "decimal(19,4)"),
    "smallmoney": ("BigDecimal", "decimal(10,4)"),
    "float": ("Double", "double"),
    "real": ("Float", "float"),
    "date": ("LocalDate", "date"),
    "datetime": ("LocalDateTime", "timestamp_ntz"),
    "datetime2": ("LocalDateTime", "timestamp_ntz"),
    "smalldatetime": ("LocalDateTime", "timestamp_ntz"),
    "time": ("LocalTime", "string"),
    "datetimeoffset": ("OffsetDateTime", "timestamp"),
    "char": ("String", "string"),
    "varchar": ("String", "string"),
    "nchar": ("String", "string"),
    "nvarchar": ("String", "string"),
    "text": ("String", "string"),
    "ntext": ("String", "string"),
    "uniqueidentifier": ("UUID", "string"),
    "binary": ("byte[]", "binary"),
    "varbinary": ("byte[]", "binary"),
    "image": ("byte[]", "binary"),
    "xml": ("String", "string"),
}


def target_type(sql_type: Column) -> Column:
    """The target type by the part before a bracket, whatever the case; String if unknown."""
    base = F.lower(F.trim(F.substring_index(sql_type, "(", 1)))
    pairs = F.create_map(*[F.lit(v) for name, (target, _) in TYPES.items() for v in (name, target)])
    return F.coalesce(F.try_element_at(pairs, base), F.lit("String"))


def spark_type(sql_type: Column) -> Column:
    """The Spark type; a decimal keeps its precision and scale."""
    base = F.lower(F.trim(F.substring_index(sql_type, "(", 1)))
    pairs = F.create_map(*[F.lit(v) for name, (_, spark) in TYPES.items() for v in (name, spark)])
    plain = F.coalesce(F.try_element_at(pairs, base), F.lit("string"))
    return F.when(plain == "decimal", F.concat(plain, F.coalesce(F.nullif(F.regexp_extract(sql_type, r"\(\s*\d+\s*(?:,\s*\d+\s*)?\)", 0), F.lit("")), F.lit("(18,0)")))).otherwise(plain)


#: A name, quoted or not, and what begins a table's definition.
NAME = r'\[[^\]]+\]|"[^"]+"|\w+'
TABLE_HEAD = rf"(?i)\bCREATE\s+TABLE\s+(?:({NAME})\s*\.\s*)?({NAME})\s*\("


def unquoted(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r'^[\["]|[\]"]$', "")


def tables(scripts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row a CREATE TABLE: schema (dbo if none), table, and the code between its brackets. Temporary tables are none.

    Comments are blanks and literals are places, so neither hides a table nor splits a column.
    """
    code = scripts.select(*keys, F.explode(F.array(coded(F.col(text))["code"])).alias("code"))
    rows = code.select(*keys, found(F.col("code"), TABLE_HEAD, 1).alias("schemas"), found(F.col("code"), TABLE_HEAD, 2).alias("names"), F.posexplode(F.split("code", TABLE_HEAD, -1)).alias("part", "rest")).filter("part > 0")
    schema, name = F.get("schemas", F.col("part") - 1), F.get("names", F.col("part") - 1)
    return rows.select(*keys, (F.col("part") - 1).cast("long").alias("place"), unquoted(F.coalesce(F.nullif(schema, F.lit("")), F.lit("dbo"))).alias("schema_name"), unquoted(name).alias("table_name"), up_to_close(F.col("rest")).alias("body"))


def items(defined: DataFrame, keys: list[str]) -> DataFrame:
    """The comma-separated items of each table's body; commas inside brackets, however deep, do not split."""
    rows = defined.select(*keys, F.posexplode(items_of(F.col("body"))).alias("at", "item"))
    return rows.select(*keys, F.col("at").cast("long").alias("at"), F.trim(F.regexp_replace("item", r"\s+", " ")).alias("item"))


def names_listed(item: Column, word: str) -> Column:
    """The names in the brackets after a word of an item, in order."""
    rest = F.regexp_extract(item, rf"(?i)\b{word}\b[^(]*\((.*)$", 1)
    return F.transform(items_of(up_to_close(rest)), lambda n: unquoted(F.regexp_extract(n, rf"^\s*({NAME})", 1)))


def key_items(defined: DataFrame, keys: list[str], word: str) -> DataFrame:
    """The items that are keys of a table, with or without a name of their own."""
    return items(defined, keys).filter(F.rlike("item", F.lit(rf"(?i)^(CONSTRAINT ({NAME}) )?{word} KEY\b")))


def columns(defined: DataFrame, keys: list[str]) -> DataFrame:
    """One row a column: place, name, type, nullability, identity, inline primary key, longest length, target type."""
    rows = items(defined, keys).filter(~F.rlike("item", F.lit(r"(?i)^(CONSTRAINT|PRIMARY KEY|FOREIGN KEY|UNIQUE|CHECK)\b")) & (F.col("item") != ""))
    item = F.col("item")
    sql_type = F.regexp_extract(item, rf"^(?:{NAME})\s+\[?(\w+\]?(?:\s*\([^)]*\))?)", 1)
    sql_type = F.replace(sql_type, F.lit("]"), F.lit(""))
    own_key = F.rlike(item, F.lit(r"(?i)\bPRIMARY KEY\b"))
    identity = F.rlike(item, F.lit(r"(?i)\bIDENTITY\b"))
    return rows.select(
        *keys,
        F.col("at").alias("place"),
        unquoted(F.regexp_extract(item, rf"^({NAME})", 1)).alias("column_name"),
        sql_type.alias("sql_type"),
        (~F.rlike(item, F.lit(r"(?i)\bNOT NULL\b")) & ~own_key & ~identity).alias("nullable"),
        identity.alias("is_identity"),
        own_key.alias("is_primary_key"),
        F.regexp_extract(sql_type, r"(?i)char\s*\(\s*(\d+)\s*\)", 1).try_cast("int").alias("max_length"),
        target_type(sql_type).alias("target_type"),
    )


def primary_keys(defined: DataFrame, keys: list[str], scope: str = "table", script: str | None = None) -> DataFrame:
    """Columns of named primary keys; ``scope="script"`` is the coded rule, by which every table gets all keys of its script.

    script is the column that tells scripts apart; without one, all tables come from one script.
    """
    listed = key_items(defined, keys, "PRIMARY").select(*keys, F.posexplode(names_listed(F.col("item"), "KEY")).alias("at", "column_name"))
    if scope == "table":
        own = listed.select(*keys, F.col("at").cast("long").alias("key_place"), "column_name")
        inline = columns(defined, keys).filter("is_primary_key").select(*keys, F.lit(0).cast("long").alias("key_place"), "column_name")
        return own.unionByName(inline)
    scripts = defined.select(*keys, (F.col(script) if script else F.lit(1)).alias("_script"))
    all_keys = listed.join(scripts, keys).select("_script", "column_name").distinct()
    return scripts.join(all_keys, "_script").select("column_name", *keys)


def foreign_keys(defined: DataFrame, keys: list[str]) -> DataFrame:
    """Column, referenced table and referenced column of foreign keys, one row for each column."""
    item = F.col("item")
    target = F.regexp_extract(item, rf"(?i)\bREFERENCES\s+(?:(?:{NAME})\s*\.\s*)?({NAME})\s*\(", 1)
    pairs = F.arrays_zip(names_listed(item, "FOREIGN KEY").alias("column_name"), names_listed(item, "REFERENCES").alias("referenced_column"))
    rows = key_items(defined, keys, "FOREIGN").filter(target != "").select(*keys, unquoted(target).alias("referenced_table"), F.explode(pairs).alias("f"))
    return rows.select(*keys, "f.column_name", "referenced_table", "f.referenced_column")


def stub_entities(referenced: DataFrame, known: DataFrame) -> DataFrame:
    """Referenced tables that nothing defines."""
    return referenced.select("table_name").distinct().join(known.select("table_name").distinct(), "table_name", "left_anti")


def with_source(referenced: DataFrame, live: DataFrame, scripts: DataFrame) -> DataFrame:
    """Where each referenced table's schema comes from: the live database, else scripts, else none."""
    mark = lambda df, name: df.select("table_name").distinct().withColumn(name, F.lit(True))
    joined = referenced.select("table_name").distinct().join(mark(live, "_live"), "table_name", "left").join(mark(scripts, "_script"), "table_name", "left")
    return joined.select("table_name", F.when(F.col("_live"), "live_db").when(F.col("_script"), "ddl_scripts").otherwise("none").alias("source"))


def signature(columns_of: DataFrame, most: int = 8) -> DataFrame:
    """table_name and its first columns as ``name:type``, with a note of how many more there are."""
    listed = F.array_sort(F.collect_list(F.struct("place", "column_name", "target_type")))
    grouped = columns_of.groupBy("table_name").agg(listed.alias("c"))
    shown = F.array_join(F.transform(F.slice("c", 1, most), lambda x: F.concat(x["column_name"], F.lit(":"), x["target_type"])), ", ")
    more = F.size("c") - most
    return grouped.select("table_name", F.when(more > 0, F.concat(shown, F.lit(", ... (+"), more.cast("string"), F.lit(" more)"))).otherwise(shown).alias("signature"))


def key_type(columns_of: DataFrame) -> DataFrame:
    """table_name and the target type of its first key column, Long if it has none."""
    first = F.min_by(F.when(F.col("is_primary_key"), F.col("target_type")), F.when(F.col("is_primary_key"), F.col("place")))
    return columns_of.groupBy("table_name").agg(F.coalesce(first, F.lit("Long")).alias("key_type"))


def service_names(name: Column, keep_tail: bool = True) -> tuple[Column, Column]:
    """Service class and method of a procedure."""
    stem = service_stem(name)
    return F.concat(pascal_case(stem, keep_tail), F.lit("Service")), camel_case(stem, keep_tail)


def staging_ddl(temps: DataFrame, columns_of: DataFrame, prefix: str = "stg_") -> DataFrame:
    """CREATE TABLE text of each staging table: its columns, the batch it belongs to, when, and an index by batch."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "sql_type"))), lambda c: F.concat(F.lit("    "), c["name"], F.lit(" "), c["sql_type"], F.lit(","))), "\n")
    defined = columns_of.groupBy("staging_name").agg(lines.alias("lines"))
    joined = temps.select("staging_name").distinct().join(defined, "staging_name", "left")
    name = F.regexp_replace("staging_name", "^stg_", prefix)
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("CREATE TABLE "), name, F.lit(" (")),
        F.col("lines"),
        F.lit("    batch_id VARCHAR(36) NOT NULL,"),
        F.lit("    created_at DATETIME NOT NULL"),
        F.lit(");"),
        F.concat(F.lit("CREATE INDEX ix_"), name, F.lit("_batch ON "), name, F.lit(" (batch_id);")),
    )
    return joined.select("staging_name", text.alias("ddl"))
