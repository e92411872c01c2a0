"""The schema of a database that the test makes: read over JDBC, with keys, references and the way back to scripts."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from procweave.operators.catalog import with_source
from procweave.sources import live_schema as live

TABLES = """
CREATE TABLE APP.BRANCH (REGION INT NOT NULL, BRANCHNO INT NOT NULL, CITY VARCHAR(40), CONSTRAINT PK_BRANCH PRIMARY KEY (REGION, BRANCHNO));
CREATE TABLE APP.ACCOUNT (ACCOUNTID INT NOT NULL GENERATED ALWAYS AS IDENTITY, REGION INT, BRANCHNO INT, NOTE VARCHAR(99), AMOUNT DECIMAL(18,2), CONSTRAINT PK_ACCOUNT PRIMARY KEY (ACCOUNTID), CONSTRAINT FK_ACCOUNT FOREIGN KEY (REGION, BRANCHNO) REFERENCES APP.BRANCH (REGION, BRANCHNO));
CREATE TABLE APP.ZONE (CODE CHAR(2));
CREATE SCHEMA OTHER;
CREATE TABLE OTHER.ZONE (NAME VARCHAR(5) NOT NULL, CONSTRAINT PK_BRANCH PRIMARY KEY (NAME));
CREATE SCHEMA INFORMATION_SCHEMA;
CREATE TABLE INFORMATION_SCHEMA.COLUMNS (TABLE_SCHEMA VARCHAR(50), TABLE_NAME VARCHAR(50), COLUMN_NAME VARCHAR(50), ORDINAL_POSITION INT, DATA_TYPE VARCHAR(50), IS_NULLABLE VARCHAR(3), CHARACTER_MAXIMUM_LENGTH INT, IS_IDENTITY VARCHAR(3));
CREATE TABLE INFORMATION_SCHEMA.TABLE_CONSTRAINTS (CONSTRAINT_SCHEMA VARCHAR(50), CONSTRAINT_NAME VARCHAR(50), TABLE_NAME VARCHAR(50), CONSTRAINT_TYPE VARCHAR(50));
CREATE TABLE INFORMATION_SCHEMA.KEY_COLUMN_USAGE (CONSTRAINT_SCHEMA VARCHAR(50), CONSTRAINT_NAME VARCHAR(50), TABLE_NAME VARCHAR(50), COLUMN_NAME VARCHAR(50), ORDINAL_POSITION INT);
CREATE TABLE INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS (CONSTRAINT_SCHEMA VARCHAR(50), CONSTRAINT_NAME VARCHAR(50), UNIQUE_CONSTRAINT_SCHEMA VARCHAR(50), UNIQUE_CONSTRAINT_NAME VARCHAR(50))
"""

KEYS = {"APP.PK_BRANCH": ("BRANCH", "PRIMARY KEY", "REGION,BRANCHNO"), "APP.PK_ACCOUNT": ("ACCOUNT", "PRIMARY KEY", "ACCOUNTID"), "APP.FK_ACCOUNT": ("ACCOUNT", "FOREIGN KEY", "REGION,BRANCHNO"), "OTHER.PK_BRANCH": ("ZONE", "PRIMARY KEY", "NAME")}


@pytest.fixture(scope="module")
def url(spark):
    """A database in memory. This server has system tables instead of the standard views, so they are filled from those."""
    at = f"jdbc:derby:memory:{uuid.uuid4().hex}"
    manager = spark.sparkContext._jvm.java.sql.DriverManager
    connection = manager.getConnection(f"{at};create=true")
    run = connection.createStatement().execute
    for statement in TABLES.strip().split(";\n"):
        run(statement)
    run("""INSERT INTO INFORMATION_SCHEMA.COLUMNS SELECT s.SCHEMANAME, t.TABLENAME, c.COLUMNNAME, c.COLUMNNUMBER,
        CASE WHEN CAST(c.COLUMNDATATYPE AS VARCHAR(50)) LIKE 'INTEGER%' THEN 'int' WHEN CAST(c.COLUMNDATATYPE AS VARCHAR(50)) LIKE 'DECIMAL%' THEN 'decimal' WHEN CAST(c.COLUMNDATATYPE AS VARCHAR(50)) LIKE 'VARCHAR%' THEN 'varchar' ELSE 'char' END,
        CASE WHEN CAST(c.COLUMNDATATYPE AS VARCHAR(50)) LIKE '%NOT NULL' THEN 'NO' ELSE 'YES' END,
        CASE WHEN CAST(c.COLUMNDATATYPE AS VARCHAR(50)) LIKE 'VARCHAR(40)%' THEN 40 END, CASE WHEN c.AUTOINCREMENTSTART IS NOT NULL THEN 'YES' ELSE 'NO' END
        FROM SYS.SYSTABLES t JOIN SYS.SYSCOLUMNS c ON c.REFERENCEID = t.TABLEID JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID WHERE s.SCHEMANAME IN ('APP', 'OTHER')""")
    for full, (table, kind, columns) in KEYS.items():
        schema, name = full.split(".")
        run(f"INSERT INTO INFORMATION_SCHEMA.TABLE_CONSTRAINTS VALUES ('{schema}', '{name}', '{table}', '{kind}')")
        for place, column in enumerate(columns.split(","), 1):
            run(f"INSERT INTO INFORMATION_SCHEMA.KEY_COLUMN_USAGE VALUES ('{schema}', '{name}', '{table}', '{column}', {place})")
    run("INSERT INTO INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS VALUES ('APP', 'FK_ACCOUNT', 'APP', 'PK_BRANCH')")
    connection.close()
    return at


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def test_columns_keys_and_references_come_back(spark, url):
    schema = live.schema_of(live.information_schema(spark, url, "standard"), named(spark, "Account", "branch", None, "branch", "Missing"))
    got = {(r["table_name"], r["ordinal_position"]): r for r in schema.columns.collect()}
    assert sorted(got) == [("ACCOUNT", 1), ("ACCOUNT", 2), ("ACCOUNT", 3), ("ACCOUNT", 4), ("ACCOUNT", 5), ("BRANCH", 1), ("BRANCH", 2), ("BRANCH", 3)]
    account = got["ACCOUNT", 1]
    assert (account["column_name"], account["target"], account["nullable"], account["is_identity"], account["is_primary_key"]) == ("ACCOUNTID", "Integer", False, True, True)
    assert [got["BRANCH", n]["is_primary_key"] for n in (1, 2, 3)] == [True, True, False]
    assert (got["BRANCH", 3]["max_length"], got["BRANCH", 3]["nullable"], got["ACCOUNT", 5]["target"]) == (40, True, "BigDecimal")
    # A composite key meets position by position, not each column with each.
    assert sorted(tuple(r) for r in schema.references.collect()) == [("ACCOUNT", "BRANCHNO", "BRANCH", "BRANCHNO"), ("ACCOUNT", "REGION", "BRANCH", "REGION")]


def test_one_name_in_two_schemas(spark, url):
    schema = live.schema_of(live.information_schema(spark, url, "standard"), named(spark, "zone"))
    got = sorted((r["table_schema"], r["column_name"], r["is_primary_key"]) for r in schema.columns.collect())
    assert got == [("APP", "CODE", False), ("OTHER", "NAME", True)] and schema.references.isEmpty()


def test_no_names_give_no_rows(spark, url):
    schema = live.schema_of(live.information_schema(spark, url, "standard"), named(spark))
    assert schema.columns.isEmpty() and schema.references.isEmpty()


def test_parts_are_ranges_that_the_server_filters(spark, url):
    columns = live.information_schema(spark, url, "standard")["COLUMNS"]
    assert columns.rdd.getNumPartitions() == len(live.CUTS) + 1 and columns.count() == 10
    assert live.information_schema(spark, url, "standard", cuts=())["COLUMNS"].count() == 10


def test_unreachable_databases_fall_back_to_scripts(spark, url):
    wanted, scripts = named(spark, "Account", "Lost", "Nowhere"), named(spark, "Account", "Lost")
    assert [r["table_name"] for r in live.live_tables(spark, url, wanted, dialect="standard").collect()] == ["Account"]
    assert live.live_tables(spark, "jdbc:derby:memory:not-there", wanted, dialect="standard") is None
    expected = {"Account": "ddl_scripts", "Lost": "ddl_scripts", "Nowhere": "none"}
    for where, account in ((url, "live_db"), ("jdbc:derby:memory:not-there", "ddl_scripts"), (None, "ddl_scripts")):
        got = {r["table_name"]: r["source"] for r in live.described_by(spark, where, wanted, scripts, dialect="standard").collect()}
        assert got == expected | {"Account": account}
    with pytest.raises(Exception, match="No suitable driver"):
        live.live_tables(spark, "jdbc:unknown:x", wanted, dialect="standard")
    with pytest.raises(ValueError, match="no such dialect"):
        live.information_schema(spark, url, "db3")
