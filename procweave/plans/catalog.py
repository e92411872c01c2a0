"""Catalog, lineage and staging queries. Table scripts are derived from the nations: one script with two tables each."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.operators import catalog as c
from procweave.operators import extract as x
from procweave.plans.extraction import PLAIN_TABLES, WITH, corpus
from procweave.registry import query
from procweave.session import table


def scripts(spark, sf_dir):
    """One script a nation: a parent table with a key, and a child that refers to it."""
    k = F.col("n_nationkey").cast("string")
    parent = F.concat(
        F.lit("CREATE TABLE [dbo].[Parent"), k,
        F.lit("] (\n  ParentId INT IDENTITY(1,1) NOT NULL,\n  Title VARCHAR(200) NOT NULL,\n  Price DECIMAL(18,2),\n  Made DATETIME DEFAULT GETDATE(),\n  CONSTRAINT PK_Parent"), k,
        F.lit(" PRIMARY KEY CLUSTERED (ParentId)\n);\n"),
    )
    child = F.concat(
        F.lit("CREATE TABLE Child"), k, F.lit(" (\n  ChildId BIGINT PRIMARY KEY,\n  ParentId INT NOT NULL,\n  Notes NVARCHAR(MAX),\n  Flag BIT,\n  FOREIGN KEY (ParentId) REFERENCES dbo.Parent"), k, F.lit("(ParentId)\n);\n"),
    )
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(parent, child).alias("ddl"))


def defined(spark, sf_dir):
    return c.tables(scripts(spark, sf_dir), ["k"], "ddl")


DDL_COLUMNS = """cols(kind, place, column_name, sql_type, nullable, is_identity, is_primary_key, max_length, target_type) AS (VALUES
('Parent', 0, 'ParentId', 'INT', false, true, false, NULL, 'Integer'), ('Parent', 1, 'Title', 'VARCHAR(200)', false, false, false, 200, 'String'),
('Parent', 2, 'Price', 'DECIMAL(18,2)', true, false, false, NULL, 'BigDecimal'), ('Parent', 3, 'Made', 'DATETIME', true, false, false, NULL, 'LocalDateTime'),
('Child', 0, 'ChildId', 'BIGINT', false, false, true, NULL, 'Long'), ('Child', 1, 'ParentId', 'INT', false, false, false, NULL, 'Integer'),
('Child', 2, 'Notes', 'NVARCHAR(MAX)', true, false, false, NULL, 'String'), ('Child', 3, 'Flag', 'BIT', true, false, false, NULL, 'Boolean'))"""


@query("src_ddl_dir", "SELECT n_nationkey AS k, place::BIGINT AS place, 'dbo' AS schema_name, t || n_nationkey AS table_name FROM nation, (VALUES (0, 'Parent'), (1, 'Child')) v(place, t)")
def ddl_tables(spark, sf_dir):
    return defined(spark, sf_dir).drop("body")


@query("sc_create_table", f"""WITH {DDL_COLUMNS} SELECT kind || n_nationkey AS table_name, place::BIGINT AS place, column_name, sql_type, nullable, is_identity, is_primary_key, max_length::INT AS max_length, target_type
FROM nation, cols""")
def ddl_columns(spark, sf_dir):
    return c.columns(defined(spark, sf_dir), ["table_name"])


@query("sc_pk", "SELECT 'Parent' || n_nationkey AS table_name, 0::BIGINT AS key_place, 'ParentId' AS column_name FROM nation UNION ALL SELECT 'Child' || n_nationkey, 0, 'ChildId' FROM nation")
def ddl_keys(spark, sf_dir):
    return c.primary_keys(defined(spark, sf_dir), ["table_name"])


@query("sc_fk", "SELECT 'Child' || n_nationkey AS table_name, 'ParentId' AS column_name, 'Parent' || n_nationkey AS referenced_table, 'ParentId' AS referenced_column FROM nation")
def ddl_references(spark, sf_dir):
    return c.foreign_keys(defined(spark, sf_dir), ["table_name"])


@query("sc_type_map", """SELECT k, t AS sql_type, CASE WHEN t LIKE 'varchar%' THEN 'String' WHEN t LIKE 'decimal%' THEN 'BigDecimal' WHEN t = 'tinyint' THEN 'Short' WHEN t = 'uniqueidentifier' THEN 'UUID' ELSE 'String' END AS target,
CASE WHEN t LIKE 'decimal%' THEN t WHEN t = 'tinyint' THEN 'smallint' ELSE 'string' END AS spark FROM (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'varchar(' || p_size || ')' WHEN 1 THEN 'decimal(18,2)'
WHEN 2 THEN 'tinyint' WHEN 3 THEN 'uniqueidentifier' ELSE 'sql_variant' END AS t FROM part)""")
def type_map(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.when(k % 5 == 0, F.concat(F.lit("varchar("), F.col("p_size").cast("string"), F.lit(")"))).when(k % 5 == 1, "decimal(18,2)").when(k % 5 == 2, "tinyint").when(k % 5 == 3, "uniqueidentifier").otherwise("sql_variant")
    return table(spark, sf_dir, "part").select(k.alias("k"), t.alias("sql_type"), c.target_type(t).alias("target"), c.spark_type(t).alias("spark"))


INFO = f"info AS (SELECT kind || n_nationkey AS table_name, place + 1 AS ordinal_position, column_name, sql_type, is_identity FROM nation, cols)"


@query("sc_info_columns", f"WITH {DDL_COLUMNS}, {INFO} SELECT table_name, ordinal_position::BIGINT AS ordinal_position, column_name, sql_type, is_identity FROM info WHERE table_name IN ('Parent3', 'Child4')")
def info_columns(spark, sf_dir):
    """INFORMATION_SCHEMA.COLUMNS of some tables, in order."""
    rows = c.columns(defined(spark, sf_dir), ["table_name"]).filter(F.col("table_name").isin("Parent3", "Child4"))
    return rows.select("table_name", (F.col("place") + 1).alias("ordinal_position"), "column_name", "sql_type", "is_identity").orderBy("table_name", "ordinal_position")


@query("sc_info_pk", "SELECT 'Parent' || n_nationkey AS table_name, 'ParentId' AS column_name FROM nation UNION ALL SELECT 'Child' || n_nationkey, 'ChildId' FROM nation")
def info_keys(spark, sf_dir):
    """TABLE_CONSTRAINTS joined to KEY_COLUMN_USAGE, primary keys only."""
    rows = defined(spark, sf_dir)
    usage = c.primary_keys(rows, ["table_name"]).select("table_name", "column_name", F.concat(F.lit("PK_"), "table_name").alias("constraint_name"))
    constraints = rows.select(F.concat(F.lit("PK_"), "table_name").alias("constraint_name"), F.lit("PRIMARY KEY").alias("constraint_type"))
    return usage.join(constraints.filter("constraint_type = 'PRIMARY KEY'"), "constraint_name").select("table_name", "column_name")


@query("sc_info_fk", "SELECT 'Child' || n_nationkey AS table_name, 'ParentId' AS column_name, 'Parent' || n_nationkey AS referenced_table, 'ParentId' AS referenced_column FROM nation")
def info_references(spark, sf_dir):
    """REFERENTIAL_CONSTRAINTS joined to KEY_COLUMN_USAGE twice, through the unique constraint."""
    rows = defined(spark, sf_dir)
    usage = c.primary_keys(rows, ["table_name"]).select(F.concat(F.lit("PK_"), "table_name").alias("unique_name"), F.col("table_name").alias("referenced_table"), F.col("column_name").alias("referenced_column"))
    refs = c.foreign_keys(rows, ["table_name"]).select("table_name", "column_name", F.concat(F.lit("PK_"), "referenced_table").alias("unique_name"))
    return refs.join(usage, "unique_name").select("table_name", "column_name", "referenced_table", "referenced_column")


REFERENCED = f"{PLAIN_TABLES}, refd AS (SELECT DISTINCT t AS table_name FROM true_tables)"


def referenced(spark, sf_dir):
    return corpus(spark, sf_dir).select(F.explode(x.referenced_tables(F.col("raw_sql"))).alias("table_name")).distinct()


def sized(spark, sf_dir, least):
    """A catalog that knows the tables T<size> of parts above a size."""
    return table(spark, sf_dir, "part").filter(F.col("p_size") > least).select(F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("table_name")).distinct()


@query("sc_ref_union", f"{REFERENCED} SELECT table_name FROM refd")
def referenced_union(spark, sf_dir):
    return referenced(spark, sf_dir)


@query("sc_stub", f"{REFERENCED} SELECT table_name FROM refd WHERE table_name NOT IN (SELECT 'T' || p_size FROM part WHERE p_size > 20)")
def stubs(spark, sf_dir):
    return c.stub_entities(referenced(spark, sf_dir), sized(spark, sf_dir, 20))


@query("sc_strategy", f"{REFERENCED} SELECT table_name, CASE WHEN table_name IN (SELECT 'T' || p_size FROM part WHERE p_size > 40) THEN 'live_db' WHEN table_name IN (SELECT 'T' || p_size FROM part WHERE p_size > 20) THEN 'ddl_scripts' ELSE 'none' END AS source FROM refd")
def strategy(spark, sf_dir):
    return c.with_source(referenced(spark, sf_dir), sized(spark, sf_dir, 40), sized(spark, sf_dir, 20))


@query("flt_referenced_entities", f"{REFERENCED} SELECT DISTINCT 'T' || p_size AS table_name FROM part WHERE p_size > 20 AND 'T' || p_size IN (SELECT table_name FROM refd)")
def referenced_entities(spark, sf_dir):
    return sized(spark, sf_dir, 20).join(referenced(spark, sf_dir), "table_name", "left_semi")


@query("sc_signature", "SELECT 'Parent' || n_nationkey AS table_name, 'ParentId:Integer, Title:String, Price:BigDecimal, ... (+1 more)' AS signature FROM nation UNION ALL SELECT 'Child' || n_nationkey, 'ChildId:Long, ParentId:Integer, Notes:String, ... (+1 more)' FROM nation")
def signatures(spark, sf_dir):
    return c.signature(c.columns(defined(spark, sf_dir), ["table_name"]), most=3)


@query("sc_pk_type", "SELECT 'Parent' || n_nationkey AS table_name, 'Long' AS key_type FROM nation UNION ALL SELECT 'Child' || n_nationkey, 'Long' FROM nation")
def key_types(spark, sf_dir):
    return c.key_type(c.columns(defined(spark, sf_dir), ["table_name"]))


@query("sc_pascal", "SELECT p_partkey, 'P' || p_partkey || 'Service' AS service, 'p' || p_partkey AS method FROM part")
def services(spark, sf_dir):
    name = F.concat(F.lit("usp_P"), F.col("p_partkey").cast("string"))
    service, method = c.service_names(name)
    return table(spark, sf_dir, "part").select("p_partkey", service.alias("service"), method.alias("method"))


@query("sc_entity", """SELECT 'Parent' || n_nationkey AS table_name, 'Parent' || n_nationkey || '{Integer ParentId; String Title; BigDecimal Price; LocalDateTime Made}' AS entity FROM nation
UNION ALL SELECT 'Child' || n_nationkey, 'Child' || n_nationkey || '{Long ChildId; Integer ParentId; String Notes; Boolean Flag}' FROM nation""")
def entities(spark, sf_dir):
    """A compact rendering of each table's entity, as aggregated text."""
    columns = c.columns(defined(spark, sf_dir), ["table_name"])
    fields = F.transform(F.array_sort(F.collect_list(F.struct("place", "target_type", "column_name"))), lambda f: F.concat_ws(" ", f["target_type"], f["column_name"]))
    return columns.groupBy("table_name").agg(F.array_join(fields, "; ").alias("f")).select("table_name", F.concat("table_name", F.lit("{"), "f", F.lit("}")).alias("entity"))


def temps(spark, sf_dir):
    return x.temp_tables(corpus(spark, sf_dir), "k")


@query("st_mapping", f"""{WITH}, t AS (SELECT DISTINCT unnest(regexp_extract_all(raw_sql, '(?:CREATE TABLE|INTO) (#+\\w+)', 1)) AS name FROM corpus)
SELECT name, 'stg_' || lower(regexp_replace(ltrim(name, '#'), '([a-z])([A-Z])', '\\1_\\2', 'g')) AS staging_name FROM t""")
def mapping(spark, sf_dir):
    return temps(spark, sf_dir).groupBy("name").agg(F.min("staging_name").alias("staging_name"))


@query("st_ddl", f"""{WITH}, n AS (SELECT DISTINCT 'stg_work_set' || (k % 5) AS s FROM corpus)
SELECT s AS staging_name, concat_ws(chr(10), 'CREATE TABLE ' || s || ' (', '    RowId INT,', '    Amount DECIMAL(18,2),', '    Note VARCHAR(50),', '    batch_id VARCHAR(36) NOT NULL,', '    created_at DATETIME NOT NULL', ');',
'CREATE INDEX ix_' || s || '_batch ON ' || s || ' (batch_id);') AS ddl FROM n""")
def staging_ddl(spark, sf_dir):
    made = temps(spark, sf_dir).filter("columns is not null").dropDuplicates(["staging_name"])
    return c.staging_ddl(made, x.column_defs(made, ["staging_name"]))


@query("st_cleanup_batch", "SELECT event_id, user_id FROM events WHERE user_id <> 7")
def cleanup_batch(spark, sf_dir):
    """All staging rows but those of one batch."""
    from procweave.operators.changes import delete_where

    return delete_where(table(spark, sf_dir, "events"), F.col("user_id") == 7).select("event_id", "user_id")


@query("st_cleanup_stale", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def cleanup_stale(spark, sf_dir):
    """Rows of the last 24 hours before the newest one."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    newest = rows.agg(F.max("ts").alias("newest"))
    # One row beside all others: the newest time.
    return rows.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("INTERVAL 24 HOURS")).select("event_id", "ts")


@query("st_batch_id", "SELECT user_id, true AS one_batch FROM events GROUP BY user_id")
def batch_ids(spark, sf_dir):
    """A batch id is drawn once on the driver and is the same for all rows of a run."""
    import uuid

    staged = table(spark, sf_dir, "events").withColumn("batch_id", F.lit(str(uuid.uuid4())))
    return staged.groupBy("user_id").agg((F.count_distinct("batch_id") == 1).alias("one_batch"))
