"""Extraction queries over a corpus with one procedure for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.operators import extract as x
from procweave.operators.names import table_references
from procweave.registry import query
from procweave.session import spread, table
from procweave.sources.corpus import TSQL_CORPUS, accepted_uploads, lines_of, tsql_corpus


def corpus(spark, sf_dir):
    return tsql_corpus(spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")))


WITH = f"WITH {TSQL_CORPUS}"


@query("src_tsql_file", f"{WITH} SELECT k, length(raw_sql)::BIGINT AS chars, md5(raw_sql) AS digest FROM corpus")
def texts(spark, sf_dir):
    return corpus(spark, sf_dir).select("k", F.length("raw_sql").cast("long").alias("chars"), F.md5("raw_sql").alias("digest"))


@query("tx_proc_name", f"""{WITH} SELECT k, 'usp_P' || k AS procedure_name, CASE WHEN k % 3 = 0 THEN 'sales' ELSE 'dbo' END AS schema_name FROM corpus
WHERE regexp_matches(raw_sql, '^CREATE (OR ALTER )?PROC')""")
def names(spark, sf_dir):
    name, schema = x.procedure_name(F.col("raw_sql"))
    return corpus(spark, sf_dir).select("k", name.alias("procedure_name"), schema.alias("schema_name"))


@query("tx_line_count", f"{WITH} SELECT k, len(string_split(raw_sql, chr(10)))::BIGINT AS total_line_count FROM corpus")
def line_counts(spark, sf_dir):
    return corpus(spark, sf_dir).select("k", x.line_count(F.col("raw_sql")).alias("total_line_count"))


@query("tx_params", f"""{WITH}, head AS (SELECT k, split_part(replace(raw_sql, chr(13), ''), chr(10) || 'AS', 1) AS h FROM corpus),
found AS (SELECT k, unnest(regexp_extract_all(h, '@\\w+ [^\\n]+')) AS p, generate_subscripts(regexp_extract_all(h, '@\\w+ [^\\n]+'), 1) - 1 AS place FROM head)
SELECT k, place::BIGINT AS place, split_part(p, ' ', 1) AS name, rtrim(split_part(p, ' ', 2), ',') AS sql_type,
CASE WHEN contains(p, 'OUTPUT') THEN 'OUT' ELSE 'IN' END AS direction, nullif(regexp_extract(p, '= ([^,]+)', 1), '') AS default_value FROM found""")
def params(spark, sf_dir):
    return x.parameters(corpus(spark, sf_dir))


@query("tx_temp_create", f"""{WITH} SELECT k, regexp_extract(raw_sql, 'CREATE TABLE (#\\w+)', 1) AS name, 'stg_work_set' || (k % 5) AS staging_name, false AS is_global,
'CREATE' AS made_by, 'RowId INT NOT NULL, Amount DECIMAL(18,2), Note VARCHAR(50)' AS columns FROM corpus""")
def temps_created(spark, sf_dir):
    return x.temp_tables(corpus(spark, sf_dir), "k").filter("made_by = 'CREATE'")


@query("tx_temp_into", f"""{WITH} SELECT k, '##SharedRows' AS name, 'stg_shared_rows' AS staging_name, true AS is_global, 'SELECT INTO' AS made_by
FROM corpus WHERE contains(raw_sql, 'INTO ##SharedRows')""")
def temps_selected(spark, sf_dir):
    return x.temp_tables(corpus(spark, sf_dir), "k").filter("made_by = 'SELECT INTO'").drop("columns")


COLS = "(VALUES (0, 'RowId', 'INT', false), (1, 'Amount', 'DECIMAL(18,2)', true), (2, 'Note', 'VARCHAR(50)', true)) c(place, name, sql_type, nullable)"


@query("tx_coldefs", f"{WITH} SELECT k, place::BIGINT AS place, name, sql_type, nullable FROM corpus, {COLS}")
def coldefs(spark, sf_dir):
    return x.column_defs(x.temp_tables(corpus(spark, sf_dir), "k").filter("columns is not null"), ["k"])


@query("tx_staging_name", f"""{WITH} SELECT DISTINCT t AS name, 'stg_' || lower(regexp_replace(ltrim(t, '#'), '([a-z])([A-Z])', '\\1_\\2', 'g')) AS staging_name
FROM (SELECT unnest(regexp_extract_all(raw_sql, '#+\\w+')) AS t FROM corpus)""")
def staging(spark, sf_dir):
    temps = corpus(spark, sf_dir).select(F.explode(x.found(F.col("raw_sql"), r"(#+\w+)", 1)).alias("name")).distinct()
    return temps.select("name", x.staging_name(F.col("name")).alias("staging_name"))


@query("tx_called", f"""{WITH} SELECT k, place::BIGINT AS place, callee FROM (SELECT k, unnest(c) AS callee, generate_subscripts(c, 1) - 1 AS place
FROM (SELECT k, list_filter(regexp_extract_all(raw_sql, 'EXEC (?:dbo\\.)(\\w+)', 1), lambda x: x <> 'usp_Ghost') AS c FROM corpus))""")
def called(spark, sf_dir):
    calls = corpus(spark, sf_dir).select("k", F.posexplode(x.called_procedures(F.col("raw_sql"))).alias("place", "callee"))
    return calls.select("k", F.col("place").cast("long"), "callee")


@query("flt_system_proc", f"""{WITH} SELECT k, c AS callee FROM (SELECT k, unnest(regexp_extract_all(raw_sql, 'EXEC (?:dbo\\.)?(\\w+)', 1)) AS c FROM corpus)
WHERE regexp_matches(c, '^(sp_executesql|xp_)')""")
def system_calls(spark, sf_dir):
    names = corpus(spark, sf_dir).select("k", F.explode(F.array_distinct(x.found(F.col("raw_sql"), x.CALL, 3))).alias("callee"))
    return names.filter(F.rlike("callee", F.lit(x.SYSTEM_CALL)))


#: What a plain pattern finds but for the lines that mislead it, whose tables are given here.
PLAIN_TABLES = f"""{WITH}, found AS (SELECT k, unnest(regexp_extract_all(raw_sql, '(?:FROM|JOIN|INTO|UPDATE) ([#\\w.]+)', 1)) AS t FROM corpus
UNION ALL SELECT k, 'Beta' FROM corpus WHERE k % 6 = 1 UNION ALL SELECT k, 'OldRows' FROM corpus WHERE k % 6 = 0),
true_tables AS (SELECT DISTINCT k, t FROM found WHERE NOT starts_with(t, '#') AND NOT contains(t, '.') AND t NOT IN ('Ghost', 'Recent'))"""
TABLES = f"{PLAIN_TABLES} SELECT k, t AS table_name FROM true_tables"


#: Statements whose names have to be resolved in their scopes, one for each row of part, and the tables that they name.
SCOPED = (
    ("WITH F# AS (SELECT a FROM Base#) SELECT a FROM F#; SELECT a FROM dbo.F#", ("Base#", "F#")),
    ("SELECT a FROM [My Table #] m, (SELECT b FROM Deep# d) q JOIN Joined# ON 1 = 1", ("My Table #", "Deep#", "Joined#")),
    ("UPDATE t SET a = 1 FROM Orders# t WHERE EXISTS (SELECT 1 FROM Lines# l WHERE l.x = t.x)", ("Orders#", "Lines#")),
    ("DELETE o FROM Past# AS o WHERE o.x IN (SELECT x FROM #t)", ("Past#",)),
    ("MERGE INTO Goal# AS t USING (SELECT a FROM Given#) s ON t.a = s.a WHEN MATCHED THEN UPDATE SET b = 1;", ("Goal#", "Given#")),
)


def scoped_corpus(rows, k, cases, head="", tail=""):
    """k and raw_sql: each row has one of the cases, its number in the place of #."""
    text = F.get(F.array(*[F.lit(head + c + tail) for c, _ in cases]), (k % len(cases)).cast("int"))
    return rows.select(k.alias("k"), F.replace(F.replace(F.replace(text, F.lit("#t"), F.lit("\u0001")), F.lit("#"), k.cast("string")), F.lit("\u0001"), F.lit("#t")).alias("raw_sql"))


def scoped_sql(table_name, key, cases):
    lists = ", ".join("[" + ", ".join(f"'{t}'" for t in tables) + "]" for _, tables in cases)
    return f"SELECT {key} AS k, replace(t, '#', {key}::VARCHAR) AS table_name FROM (SELECT {key}, unnest([{lists}][{key} % {len(cases)} + 1]) AS t FROM {table_name})"


@query("tx_table_refs", f"{TABLES} UNION ALL {scoped_sql('part', 'p_partkey', SCOPED)}")
def table_refs(spark, sf_dir):
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"))
    found = table_references(corpus(spark, sf_dir), "k").unionByName(table_references(scoped_corpus(parts, F.col("p_partkey"), SCOPED), "k"))
    return found.select("k", "table_name")


@query("tx_table_refs_rx", f"""{WITH}, found AS (SELECT k, unnest(regexp_extract_all(raw_sql, '(?i)(?:FROM|JOIN|INTO|UPDATE) (\\w+)', 1)) AS t FROM corpus)
SELECT DISTINCT k, t AS table_name FROM found""")
def table_refs_by_word(spark, sf_dir):
    """The plain fallback: the word after the keyword, whatever follows it."""
    names = x.found(F.col("raw_sql"), r"(?i)(?:FROM|JOIN|INTO|UPDATE|DELETE\s+FROM|MERGE(?:\s+INTO)?)\s+\[?(\w+)\]?", 1)
    return corpus(spark, sf_dir).select("k", F.explode(F.array_distinct(names)).alias("table_name"))


@query("flt_pseudo_tables", f"""{WITH}, found AS (SELECT k, unnest(regexp_extract_all(raw_sql, '(?:FROM|JOIN|INTO|UPDATE) ([#\\w.]+)', 1)) AS t FROM corpus)
SELECT DISTINCT k, t AS temp_table FROM found WHERE starts_with(t, '#')""")
def pseudo_tables(spark, sf_dir):
    names = F.array_distinct(x.found(F.col("raw_sql"), x.TABLE_WORD, 1))
    return corpus(spark, sf_dir).select("k", F.explode(names).alias("temp_table")).filter(F.col("temp_table").startswith("#"))


@query("flt_needs_chunking", f"{WITH} SELECT k, len(string_split(raw_sql, chr(10)))::BIGINT AS total_line_count FROM corpus WHERE len(string_split(raw_sql, chr(10))) > 16")
def needs_chunking(spark, sf_dir):
    return line_counts(spark, sf_dir).filter("total_line_count > 16")


STATEMENTS = f"""{WITH}, ls AS (SELECT k, unnest(c) AS s, generate_subscripts(c, 1) - 1 AS n FROM (SELECT k, string_split(replace(raw_sql, chr(13), ''), chr(10)) AS c FROM corpus)),
typed AS (SELECT k, n, trim(s, ' ' || chr(9)) AS t, s FROM ls WHERE n > 4 AND trim(s) NOT IN ('BEGIN', 'END')),
kinds AS (SELECT k, n, s, CASE WHEN t LIKE 'DECLARE%' THEN 'DECLARATION' WHEN t LIKE 'CREATE TABLE #%' THEN 'TEMP_TABLE_CREATE' WHEN t LIKE 'IF %' THEN 'IF_ELSE'
  WHEN t LIKE 'EXEC%' THEN 'PROCEDURE_CALL' WHEN t LIKE 'UPDATE%' OR t LIKE 'DELETE%' THEN 'DML_OPERATION' WHEN t LIKE 'SELECT%' THEN 'SELECT_QUERY' WHEN t LIKE 'RETURN%' THEN 'RETURN_BLOCK' ELSE 'OTHER' END AS kind FROM typed),
runs AS (SELECT *, CASE WHEN kind = 'DECLARATION' AND lag(kind) OVER (PARTITION BY k ORDER BY n) = 'DECLARATION' THEN 0 ELSE 1 END AS new FROM kinds),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY n) - 1 AS block FROM runs)"""


@query("tx_blocks", f"""{STATEMENTS} SELECT k, block::BIGINT AS block, min(kind) AS block_type, string_agg(s, chr(10) ORDER BY n) AS content FROM numbered GROUP BY k, block""")
def blocks(spark, sf_dir):
    return x.logical_blocks(corpus(spark, sf_dir), "k").select("k", "block", "block_type", "content")


@query("tx_block_ends", f"{STATEMENTS} SELECT k, block::BIGINT AS block, min(n)::BIGINT AS start_line, max(n)::BIGINT AS end_line FROM numbered GROUP BY k, block")
def block_ends(spark, sf_dir):
    return x.logical_blocks(corpus(spark, sf_dir), "k").select("k", "block", "start_line", "end_line")


@query("tx_block_vars", f"""{STATEMENTS}, texts AS (SELECT k, block, string_agg(s, chr(10) ORDER BY n) AS c FROM numbered GROUP BY k, block)
SELECT k, block::BIGINT AS block, array_to_string(list_sort(list_distinct(regexp_extract_all(c, '@\\w+'))), ',') AS inputs,
array_to_string(list_sort(list_distinct(regexp_extract_all(c, '(?:SET|SELECT) (@\\w+) =', 1))), ',') AS outputs FROM texts""")
def block_vars(spark, sf_dir):
    used, set_ = x.block_variables(F.col("content"))
    shown = lambda c: F.array_join(F.array_sort(c), ",")
    return x.logical_blocks(corpus(spark, sf_dir), "k").select("k", "block", shown(used).alias("inputs"), shown(set_).alias("outputs"))


@query("src_upload_files", "SELECT doc_id, n_chars AS size, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents")
def uploaded(spark, sf_dir):
    """Size and line count of every text, as a listing of uploads shows them."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


@query("src_upload_filter", """SELECT page_id, regexp_extract(url, '([^/]*)[.]html$', 1, 'i') AS name FROM pages WHERE lower(url) LIKE '%.html'""")
def accepted(spark, sf_dir):
    """Uploads by extension, under their base name: pages stand in for files, with the extension that uploads need."""
    pages = table(spark, sf_dir, "pages").withColumn("path", F.regexp_replace("url", r"(?i)\.html$", ".SQL"))
    return accepted_uploads(pages).select("page_id", F.regexp_replace("name", r"\.SQL$", "").alias("name"))


@query("src_tsql_lines", f"""{WITH} SELECT k, unnest(string_split(raw_sql, chr(10))) AS content, generate_subscripts(string_split(raw_sql, chr(10)), 1)::BIGINT AS line FROM corpus""")
def lines(spark, sf_dir):
    return lines_of(corpus(spark, sf_dir)).select("k", "content", "line")
