"""Schemas of live databases: the information schema over JDBC, and what it says about columns, keys and references."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.operators.catalog import target_type, with_source

#: Views of the information schema and the columns that are read.
VIEWS = {
    "COLUMNS": ("TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION", "DATA_TYPE", "IS_NULLABLE", "CHARACTER_MAXIMUM_LENGTH"),
    "TABLE_CONSTRAINTS": ("CONSTRAINT_SCHEMA", "CONSTRAINT_NAME", "TABLE_NAME", "CONSTRAINT_TYPE"),
    "KEY_COLUMN_USAGE": ("CONSTRAINT_SCHEMA", "CONSTRAINT_NAME", "TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION"),
    "REFERENTIAL_CONSTRAINTS": ("CONSTRAINT_SCHEMA", "CONSTRAINT_NAME", "UNIQUE_CONSTRAINT_SCHEMA", "UNIQUE_CONSTRAINT_NAME"),
}

#: How a server tells identity columns.
IDENTITY = {
    "tsql": "COLUMNPROPERTY(OBJECT_ID(TABLE_SCHEMA + '.' + TABLE_NAME), COLUMN_NAME, 'IsIdentity')",
    "standard": "CASE WHEN IS_IDENTITY = 'YES' THEN 1 ELSE 0 END",
}

#: Where the tables' names are cut for parallel reads; the server's own order decides, so every name is in one part.
CUTS = ("D", "H", "M", "P", "T")


@dataclass(frozen=True)
class Schema:
    """Columns (one row each) and references (one row for each column of a foreign key)."""

    columns: DataFrame
    references: DataFrame


def information_schema(spark: SparkSession, url: str, dialect: str = "tsql", properties: Mapping[str, str] | None = None, cuts: tuple[str, ...] = CUTS) -> dict[str, DataFrame]:
    """The views of a database, read by as many tasks as there are parts; only the columns that are used are asked for.

    References have no table name and are read in one part: one row for each foreign key. User, password and driver go into
    ``properties``. The database is reached when the views are loaded: a ``Py4JJavaError`` tells that it is not.
    """
    if dialect not in IDENTITY:
        raise ValueError(f"no such dialect: {dialect}")
    bounds = [None, *cuts, None]
    parts = [" AND ".join(s for s in (f"TABLE_NAME >= '{a}'" if a else "", f"TABLE_NAME < '{b}'" if b else "") if s) or "1 = 1" for a, b in zip(bounds, bounds[1:])]
    read = {}
    for view, names in VIEWS.items():
        asked = [*names, f"{IDENTITY[dialect]} AS IS_IDENTITY_COLUMN"] if view == "COLUMNS" else names
        source = f"(SELECT {', '.join(asked)} FROM INFORMATION_SCHEMA.{view}) v"
        own = dict(properties or {})
        read[view] = spark.read.jdbc(url, source, predicates=parts, properties=own) if "TABLE_NAME" in names else spark.read.jdbc(url, source, properties=own)
    return read


def schema_of(views: Mapping[str, DataFrame], names: DataFrame) -> Schema:
    """What the views say about the tables of the given names (column table_name, any case, repeats and nulls allowed).

    Constraints are met by schema and name, the columns of composite keys by position. A name that several schemas have gives
    the tables of all of them; one that none has gives nothing. A table without keys has ``is_primary_key`` false throughout.
    """
    wanted = names.select(F.lower("table_name").alias("wanted")).filter("wanted IS NOT NULL").distinct()
    only = lambda view: view.join(wanted, F.lower("TABLE_NAME") == F.col("wanted"), "left_semi")
    schema, name = "CONSTRAINT_SCHEMA", "CONSTRAINT_NAME"
    usage, constraints = views["KEY_COLUMN_USAGE"], views["TABLE_CONSTRAINTS"]

    primary = constraints.filter("CONSTRAINT_TYPE = 'PRIMARY KEY'").select(schema, name)
    keys = only(usage).join(primary, [schema, name], "left_semi").select(F.col(schema).alias("table_schema"), F.col("TABLE_NAME").alias("table_name"), F.col("COLUMN_NAME").alias("column_name"), F.lit(True).alias("is_key"))
    columns = only(views["COLUMNS"]).select(
        F.col("TABLE_SCHEMA").alias("table_schema"), F.col("TABLE_NAME").alias("table_name"), F.col("ORDINAL_POSITION").cast("long").alias("ordinal_position"), F.col("COLUMN_NAME").alias("column_name"),
        F.col("DATA_TYPE").alias("sql_type"), target_type(F.col("DATA_TYPE")).alias("target"), (F.col("IS_NULLABLE") == "YES").alias("nullable"),
        F.col("CHARACTER_MAXIMUM_LENGTH").cast("long").alias("max_length"), F.coalesce(F.col("IS_IDENTITY_COLUMN") == 1, F.lit(False)).alias("is_identity"),
    )
    columns = columns.join(keys, ["table_schema", "table_name", "column_name"], "left").withColumn("is_primary_key", F.coalesce("is_key", F.lit(False))).drop("is_key")

    target = usage.select(
        F.col(schema).alias("UNIQUE_CONSTRAINT_SCHEMA"), F.col(name).alias("UNIQUE_CONSTRAINT_NAME"), F.col("ORDINAL_POSITION").alias("place"),
        F.col("TABLE_NAME").alias("referenced_table"), F.col("COLUMN_NAME").alias("referenced_column"),
    )
    references = only(usage).withColumn("place", F.col("ORDINAL_POSITION")).join(views["REFERENTIAL_CONSTRAINTS"], [schema, name])
    references = references.join(target, ["UNIQUE_CONSTRAINT_SCHEMA", "UNIQUE_CONSTRAINT_NAME", "place"])
    return Schema(columns, references.select(F.col("TABLE_NAME").alias("table_name"), F.col("COLUMN_NAME").alias("column_name"), "referenced_table", "referenced_column"))


def live_tables(spark: SparkSession, url: str, names: DataFrame, **options) -> DataFrame | None:
    """Those of the named tables that the database has, spelled as in ``names``; None if the database cannot be reached.

    Only errors of the connection count as unreachable. A missing driver or a wrong dialect is an error of the caller.
    """
    try:
        views = information_schema(spark, url, **options)
    except Py4JJavaError as error:
        # SQLSTATE classes 08 (connection) and XJ (the embedded server's own for a database that is not there).
        cause = error.java_exception
        while cause is not None and not hasattr(cause, "getSQLState"):
            cause = cause.getCause()
        # A URL that no driver takes has the class of a lost connection as well.
        if cause is None or not str(cause.getSQLState() or "").startswith(("08", "XJ")) or "No suitable driver" in str(cause.getMessage()):
            raise
        return None
    have = views["COLUMNS"].select(F.lower("TABLE_NAME").alias("have")).distinct()
    return names.select("table_name").join(have, F.lower("table_name") == F.col("have"), "left_semi").distinct()


def described_by(spark: SparkSession, url: str | None, names: DataFrame, scripts: DataFrame, **options) -> DataFrame:
    """Where each named table's description comes from: the database, else the scripts, else nowhere. Without a URL or a connection, scripts only."""
    found = live_tables(spark, url, names, **options) if url else None
    return with_source(names, names.limit(0) if found is None else found, scripts)
