"""Inserts, updates and deletes as projections: a new table is made, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.operators.ranking import global_row_number


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT ... VALUES or INSERT ... SELECT; columns that rows lack become null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def update_from(table: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """UPDATE ... FROM: rows whose key is in source take its columns (nulls included); source is unique by key."""
    other = source.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_found"))
    joined = table.join(other, F.col(key) == F.col("_key"), "left")
    new = {c: F.when(F.col("_found"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).select(*table.columns)


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... WHERE; a condition that is null leaves the row as it is."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """DELETE ... WHERE; a condition that is null keeps the row."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, chain: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Delete rows and all that refers to them.

    chain lists (table, its id, its reference to the table before); gone holds the ids to delete of the first table.
    """
    out, ids = {}, gone
    for name, own, parent in chain:
        hit = tables[name].join(ids.select(F.col(ids.columns[0]).alias("_gone")).distinct(), F.col(parent) == F.col("_gone"), "left_semi")
        out[name] = tables[name].join(ids.select(F.col(ids.columns[0]).alias("_gone")).distinct(), F.col(parent) == F.col("_gone"), "left_anti")
        ids = hit.select(own).distinct()
    return out


def with_identity(rows: DataFrame, order: str, ties: list[str], start: int = 1, into: str = "id") -> DataFrame:
    """IDENTITY(start, 1): consecutive numbers in a stated order."""
    numbered = global_row_number(rows, order, ties, descending=False, into=into)
    return numbered.withColumn(into, F.col(into) + (start - 1))
