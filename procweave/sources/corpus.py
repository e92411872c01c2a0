"""Reading a corpus of procedure sources, and a corpus derived from the part table.

Sources are read whole with Spark's text reader; a byte-order mark is dropped; of several files that define the same
procedure the last in the order of file kind and path wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File kinds by dialect, in the order in which later ones win.
KINDS = {"tsql": ("*.sql",), "oracle": ("*.sql", "*.pkb", "*.prc")}


def read_sources(spark: SparkSession, folder: str, dialect: str = "tsql", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """source_file, file_rank and raw_sql of every source in a folder; an error if the folder does not exist.

    kinds are the patterns of file names, those of the dialect if none are given; later ones win.
    """
    if dialect not in KINDS:
        raise ValueError(f"dialect {dialect!r} is none of {', '.join(KINDS)}")
    parts = []
    for rank, pattern in enumerate(kinds or KINDS[dialect]):
        read = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
        parts.append(read.select(F.col("_metadata.file_path").alias("source_file"), F.lit(rank).alias("file_rank"), F.regexp_replace("value", "^﻿", "").alias("raw_sql")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def last_definitions(procedures: DataFrame, name: str = "procedure_name") -> DataFrame:
    """Of the rows of one name, the one that was read last."""
    latest = Window.partitionBy(name).orderBy(F.desc("file_rank"), F.desc("source_file"))
    return procedures.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and number of lines (line feeds + 1) of the files in a folder."""
    files = spark.read.format("binaryFile").load(folder)
    content = F.decode("content", "UTF-8")
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"),
    )


def accepted_uploads(files: DataFrame, path: str = "path") -> DataFrame:
    """Uploads that end in .sql, whatever the case, under their base name."""
    base = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return files.withColumn("name", base).filter(F.lower("name").endswith(".sql"))


def lines_of(procedures: DataFrame, text: str = "raw_sql", first: int = 1) -> DataFrame:
    """One row a line: the procedure's columns but its text, line (from ``first``) and content."""
    keep = [c for c in procedures.columns if c != text]
    rows = procedures.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("_at", "content"))
    return rows.withColumn("line", (F.col("_at") + first).cast("long")).drop("_at")


def lines(*parts: Column) -> Column:
    """Join lines by line feeds; null lines are left out."""
    return F.concat_ws("\n", *parts)


def laid_out(text: Column, k: Column, indent: str) -> Column:
    """A text as several editors write it: with tabs, with carriage returns, and with BEGIN on the line of AS."""
    return (
        F.when(k % 4 == 1, F.replace(text, F.lit(indent), F.lit("\t")))
        .when(k % 4 == 2, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .when(k % 4 == 3, F.replace(text, F.lit("\nAS\nBEGIN\n"), F.lit("\nAS BEGIN\n")))
        .otherwise(text)
    )


#: The same in DuckDB, around a text.
LAID_OUT = """CASE {k} % 4 WHEN 1 THEN replace(t, '{indent}', chr(9)) WHEN 2 THEN replace(t, chr(10), chr(13) || chr(10))
  WHEN 3 THEN replace(t, chr(10) || 'AS' || chr(10) || 'BEGIN' || chr(10), chr(10) || 'AS BEGIN' || chr(10)) ELSE t END"""


def tsql_corpus(parts: DataFrame) -> DataFrame:
    """One T-SQL procedure for each row of part: k and raw_sql. Its features and its layout depend on k."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    at = lambda n, rest, text: F.when(k % n == rest, text)
    head = F.when(k % 3 == 0, F.concat(F.lit("CREATE OR ALTER PROC sales.usp_P"), s(k))).otherwise(F.concat(F.lit("CREATE PROCEDURE [dbo].[usp_P"), s(k), F.lit("]")))
    text = lines(
        head,
        F.lit("    @Id INT,"),
        F.lit("    @Mode VARCHAR(20) = 'A',"),
        F.lit("    @Total DECIMAL(18,2) OUTPUT"),
        F.lit("AS"),
        F.lit("BEGIN"),
        F.lit("    DECLARE @n INT;"),
        F.lit("    DECLARE @sql VARCHAR(400);"),
        F.concat(F.lit("    CREATE TABLE #WorkSet"), s(k % 5), F.lit(" (RowId INT NOT NULL, Amount DECIMAL(18,2), Note VARCHAR(50));")),
        at(2, 0, F.lit("    SELECT RowId INTO ##SharedRows FROM #WorkSet;")),
        F.when(k > 0, F.concat(F.lit("    EXEC dbo.usp_P"), s(F.floor(k / 2)), F.lit(" @Id;"))),
        at(7, 3, F.lit("    EXEC xp_logevent 60000, 'done';")),
        F.concat(F.lit("    SELECT a.x FROM T"), s(F.col("p_size")), F.lit(" a JOIN U"), s(k % 7), F.lit(" b ON a.x = b.x;")),
        at(5, 0, F.lit("    UPDATE OrderTotals SET x = 1 WHERE Id = @Id;")),
        at(6, 0, F.lit("    DELETE OldRows;")),
        at(6, 1, F.lit("    SELECT a.x FROM Alpha a, dbo.Beta AS b, #WorkSet0 c WHERE a.x = b.x;")),
        at(6, 2, F.lit("    /* SELECT x FROM Ghost; EXEC dbo.usp_Ghost; */")),
        at(6, 3, F.lit("    SET @note = 'select y from Str';")),
        at(6, 4, F.lit("    WITH Recent AS (SELECT x FROM Base) SELECT x FROM Recent;")),
        at(4, 1, F.lit("    SET @sql = 'SELECT 1';")),
        at(4, 1, F.lit("    EXEC(@sql);")),
        at(4, 2, F.lit("    SET @sql = 'SELECT * FROM ' + @Mode;")),
        at(4, 2, F.lit("    EXEC (@sql);")),
        at(8, 0, F.lit("    EXEC sp_executesql N'SELECT @a', N'@a INT', @a = @Id;")),
        at(4, 3, F.concat(F.lit("    SELECT * FROM Srv"), s(k % 3), F.lit(".Db.dbo.Remote"), s(F.col("p_size")), F.lit(";"))),
        at(6, 5, F.concat(F.lit("    SET @proc = 'usp_P"), s(F.floor(k / 3)), F.lit("';"))),
        at(6, 5, F.lit("    EXEC @proc;")),
        at(9, 4, F.lit("    IF @Id = 1 SET @step = 'usp_P1';")),
        at(9, 4, F.lit("    ELSE SET @step = 'usp_P2';")),
        at(9, 4, F.lit("    EXEC @step;")),
        at(10, 7, F.lit("    SELECT @act = ProcName FROM ActionMap WHERE Id = @Id;")),
        at(10, 7, F.lit("    EXEC @act;")),
        at(10, 9, F.lit("    EXEC @Mode;")),
        F.lit("    RETURN;"),
        F.lit("END"),
    )
    return parts.select(k.alias("k"), laid_out(text, k, "    ").alias("raw_sql"))


#: The same corpus in DuckDB.
TSQL_CORPUS = f"""
corpus AS (SELECT k, {LAID_OUT.format(k="k", indent="    ")} AS raw_sql FROM (SELECT p_partkey AS k, p_size, concat_ws(chr(10),
  CASE WHEN p_partkey % 3 = 0 THEN 'CREATE OR ALTER PROC sales.usp_P' || p_partkey ELSE 'CREATE PROCEDURE [dbo].[usp_P' || p_partkey || ']' END,
  '    @Id INT,', '    @Mode VARCHAR(20) = ''A'',', '    @Total DECIMAL(18,2) OUTPUT', 'AS', 'BEGIN', '    DECLARE @n INT;', '    DECLARE @sql VARCHAR(400);',
  '    CREATE TABLE #WorkSet' || (p_partkey % 5) || ' (RowId INT NOT NULL, Amount DECIMAL(18,2), Note VARCHAR(50));',
  CASE WHEN p_partkey % 2 = 0 THEN '    SELECT RowId INTO ##SharedRows FROM #WorkSet;' END,
  CASE WHEN p_partkey > 0 THEN '    EXEC dbo.usp_P' || (p_partkey // 2) || ' @Id;' END,
  CASE WHEN p_partkey % 7 = 3 THEN '    EXEC xp_logevent 60000, ''done'';' END,
  '    SELECT a.x FROM T' || p_size || ' a JOIN U' || (p_partkey % 7) || ' b ON a.x = b.x;',
  CASE WHEN p_partkey % 5 = 0 THEN '    UPDATE OrderTotals SET x = 1 WHERE Id = @Id;' END,
  CASE WHEN p_partkey % 6 = 0 THEN '    DELETE OldRows;' END,
  CASE WHEN p_partkey % 6 = 1 THEN '    SELECT a.x FROM Alpha a, dbo.Beta AS b, #WorkSet0 c WHERE a.x = b.x;' END,
  CASE WHEN p_partkey % 6 = 2 THEN '    /* SELECT x FROM Ghost; EXEC dbo.usp_Ghost; */' END,
  CASE WHEN p_partkey % 6 = 3 THEN '    SET @note = ''select y from Str'';' END,
  CASE WHEN p_partkey % 6 = 4 THEN '    WITH Recent AS (SELECT x FROM Base) SELECT x FROM Recent;' END,
  CASE WHEN p_partkey % 4 = 1 THEN '    SET @sql = ''SELECT 1'';' END,
  CASE WHEN p_partkey % 4 = 1 THEN '    EXEC(@sql);' END,
  CASE WHEN p_partkey % 4 = 2 THEN '    SET @sql = ''SELECT * FROM '' + @Mode;' END,
  CASE WHEN p_partkey % 4 = 2 THEN '    EXEC (@sql);' END,
  CASE WHEN p_partkey % 8 = 0 THEN '    EXEC sp_executesql N''SELECT @a'', N''@a INT'', @a = @Id;' END,
  CASE WHEN p_partkey % 4 = 3 THEN '    SELECT * FROM Srv' || (p_partkey % 3) || '.Db.dbo.Remote' || p_size || ';' END,
  CASE WHEN p_partkey % 6 = 5 THEN '    SET @proc = ''usp_P' || (p_partkey // 3) || ''';' END,
  CASE WHEN p_partkey % 6 = 5 THEN '    EXEC @proc;' END,
  CASE WHEN p_partkey % 9 = 4 THEN '    IF @Id = 1 SET @step = ''usp_P1'';' END,
  CASE WHEN p_partkey % 9 = 4 THEN '    ELSE SET @step = ''usp_P2'';' END,
  CASE WHEN p_partkey % 9 = 4 THEN '    EXEC @step;' END,
  CASE WHEN p_partkey % 10 = 7 THEN '    SELECT @act = ProcName FROM ActionMap WHERE Id = @Id;' END,
  CASE WHEN p_partkey % 10 = 7 THEN '    EXEC @act;' END,
  CASE WHEN p_partkey % 10 = 9 THEN '    EXEC @Mode;' END,
  '    RETURN;', 'END') AS t FROM part))"""


def branchy_corpus(parts: DataFrame) -> DataFrame:
    """One T-SQL procedure of nested branches, loops and misleading comments for each row of part: k and raw_sql."""
    k = F.col("p_partkey")
    on = lambda condition, *found: [F.when(condition, F.lit(line)) for line in found]
    text = lines(
        F.concat(F.lit("CREATE PROCEDURE dbo.usp_N"), k.cast("string"), F.lit(" @Id INT")),
        F.lit("AS"),
        F.lit("BEGIN"),
        F.lit("    DECLARE @p VARCHAR(50)"),
        *on(k % 2 == 0, "    SET @p = 'a'"),
        F.lit("    IF @Id = 1 -- ELSE SET @p = 'ghost'"),
        F.lit("    BEGIN"),
        F.lit("        SET @p = 'b'"),
        *on(k % 3 == 0, "        IF @Id > 2", "        BEGIN", "            SET @p = 'c'"),
        *on((k % 3 == 0) & (k % 7 == 0), "            RETURN"),
        *on(k % 3 == 0, "        END"),
        *on((k % 3 == 0) & (k % 4 < 2), "        ELSE", "        BEGIN", "            SET @p = 'd'", "        END"),
        F.lit("    END"),
        *on(k % 5 < 3, "    ELSE", "    BEGIN"),
        *on((k % 5 < 3) & (k % 2 == 0), "        SET @p = 'e'"),
        *on(k % 5 < 3, "        PRINT 'x; END ELSE BEGIN'", "    END"),
        F.lit("    EXEC @p"),
        *on(k % 4 != 3, "    WHILE @Id < 9", "    BEGIN", "        EXEC @p"),
        *on((k % 4 != 3) & (k % 3 != 1), "        SET @p = 'f'"),
        *on((k % 4 != 3) & (k % 5 == 4), "        IF @Id = 5", "        BEGIN", "            BREAK", "        END", "        SET @p = 'g'"),
        *on(k % 4 != 3, "    END"),
        F.lit("    EXEC @p"),
        *on(k % 6 == 0, "    SET @p = CASE WHEN @Id = 1 THEN 'h' ELSE 'i' END"),
        F.lit("    EXEC @p /* IF @Id = 3 SET @p = 'ghost' */"),
        F.lit("END"),
    )
    return parts.select(k.alias("k"), laid_out(text, k, "    ").alias("raw_sql"))


def when_sql(condition: str, *found: str) -> str:
    return ", ".join(f"CASE WHEN {condition} THEN '{line}' END" for line in (f.replace("'", "''") for f in found))


#: The same nested code in DuckDB, as lines whose successors a walk follows: flow (k, line, what, value), tree (k, line, last,
#: kind), and walk (k, def, line, uses), the lines that are reached from an assignment (0: the start) without another one between.
BRANCHES = f"""nested AS (SELECT k, {LAID_OUT.format(k="k", indent="    ")} AS raw_sql FROM (SELECT p_partkey AS k, concat_ws(chr(10), 'CREATE PROCEDURE dbo.usp_N' || p_partkey || ' @Id INT', 'AS', 'BEGIN', '    DECLARE @p VARCHAR(50)',
  {when_sql("p_partkey % 2 = 0", "    SET @p = 'a'")}, '    IF @Id = 1 -- ELSE SET @p = ''ghost''', '    BEGIN', '        SET @p = ''b''',
  {when_sql("p_partkey % 3 = 0", "        IF @Id > 2", "        BEGIN", "            SET @p = 'c'")}, {when_sql("p_partkey % 3 = 0 AND p_partkey % 7 = 0", "            RETURN")},
  {when_sql("p_partkey % 3 = 0", "        END")}, {when_sql("p_partkey % 3 = 0 AND p_partkey % 4 < 2", "        ELSE", "        BEGIN", "            SET @p = 'd'", "        END")}, '    END',
  {when_sql("p_partkey % 5 < 3", "    ELSE", "    BEGIN")}, {when_sql("p_partkey % 5 < 3 AND p_partkey % 2 = 0", "        SET @p = 'e'")}, {when_sql("p_partkey % 5 < 3", "        PRINT 'x; END ELSE BEGIN'", "    END")}, '    EXEC @p',
  {when_sql("p_partkey % 4 <> 3", "    WHILE @Id < 9", "    BEGIN", "        EXEC @p")}, {when_sql("p_partkey % 4 <> 3 AND p_partkey % 3 <> 1", "        SET @p = 'f'")},
  {when_sql("p_partkey % 4 <> 3 AND p_partkey % 5 = 4", "        IF @Id = 5", "        BEGIN", "            BREAK", "        END", "        SET @p = 'g'")}, {when_sql("p_partkey % 4 <> 3", "    END")}, '    EXEC @p',
  {when_sql("p_partkey % 6 = 0", "    SET @p = CASE WHEN @Id = 1 THEN 'h' ELSE 'i' END")}, '    EXEC @p /* IF @Id = 3 SET @p = ''ghost'' */', 'END') AS t FROM part)),
split AS (SELECT k, string_split(replace(replace(raw_sql, chr(13), ''), chr(9), ' '), chr(10)) AS c FROM nested),
flow AS (SELECT k, line, s, regexp_extract(s, '^(AS BEGIN|BEGIN|END|ELSE|IF|WHILE|SET|EXEC|RETURN|BREAK|PRINT|DECLARE|AS|CREATE)', 1) AS what, regexp_extract(s, '^SET @p = (.*)$', 1) AS value
  FROM (SELECT k, trim(regexp_replace(unnest(c), ' (--|/[*]).*$', '')) AS s, generate_subscripts(c, 1) AS line FROM split)),
deep AS (SELECT *, sum(CASE WHEN what IN ('BEGIN', 'AS BEGIN') THEN 1 WHEN what = 'END' THEN -1 ELSE 0 END) OVER (PARTITION BY k ORDER BY line) AS depth FROM flow),
blocks AS (SELECT b.k, b.line AS first, min(e.line) AS last FROM deep b JOIN deep e ON e.k = b.k AND e.line > b.line AND e.what = 'END' AND e.depth = b.depth - 1 WHERE b.what IN ('BEGIN', 'AS BEGIN') GROUP BY b.k, b.line),
heads AS (SELECT h.k, h.line, h.what, b.last, coalesce(o.last, b.last) AS whole, n.what = 'ELSE' AS has_else FROM flow h JOIN blocks b ON b.k = h.k AND b.first = h.line + 1
  LEFT JOIN flow n ON n.k = h.k AND n.line = b.last + 1 LEFT JOIN blocks o ON o.k = h.k AND n.what = 'ELSE' AND o.first = n.line + 1 WHERE h.what IN ('IF', 'WHILE')),
tree AS (SELECT f.k, f.line, coalesce(h.whole, b.last, f.line) AS last, CASE f.what WHEN 'IF' THEN 'IF_ELSE' WHEN 'WHILE' THEN 'WHILE_LOOP' WHEN 'EXEC' THEN 'PROCEDURE_CALL' WHEN 'RETURN' THEN 'RETURN_BLOCK'
  WHEN 'DECLARE' THEN 'DECLARATION' WHEN 'BEGIN' THEN 'BEGIN_END' WHEN 'AS BEGIN' THEN 'BEGIN_END' ELSE 'OTHER' END AS kind
  FROM flow f LEFT JOIN heads h ON h.k = f.k AND h.line = f.line LEFT JOIN blocks b ON b.k = f.k AND b.first = f.line WHERE f.what NOT IN ('AS', 'CREATE', 'ELSE', 'END')),
steps AS (
  SELECT f.k, f.line, f.line + 1 AS next FROM flow f
    WHERE f.what NOT IN ('RETURN', 'BREAK') AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.k = f.k AND h.last = f.line AND (h.has_else OR h.what = 'WHILE'))
  UNION ALL SELECT k, line, last + 1 FROM heads
  UNION ALL SELECT k, last, whole + 1 FROM heads WHERE what = 'IF' AND has_else
  UNION ALL SELECT k, last, line FROM heads WHERE what = 'WHILE'
  UNION ALL SELECT f.k, f.line, (SELECT min(h.last) + 1 FROM heads h WHERE h.k = f.k AND h.what = 'WHILE' AND h.line < f.line AND h.last > f.line) FROM flow f WHERE f.what = 'BREAK'),
walk_lines AS (
  SELECT s.k, s.line AS def, s.next AS line FROM steps s JOIN flow f ON f.k = s.k AND f.line = s.line AND f.value <> ''
  UNION SELECT k, 0, 1 FROM split
  UNION SELECT w.k, w.def, s.next FROM walk_lines w JOIN steps s ON s.k = w.k AND s.line = w.line JOIN flow f ON f.k = w.k AND f.line = w.line AND f.value = ''),
walk AS (SELECT w.k, w.def, w.line, f.what = 'EXEC' AS uses FROM walk_lines w JOIN flow f ON f.k = w.k AND f.line = w.line)"""


def oracle_corpus(suppliers: DataFrame) -> DataFrame:
    """One PL/SQL source for each row of supplier: k and raw_sql; every third is a package body of two units."""
    k = F.col("s_suppkey")
    s = lambda c: c.cast("string")
    at = lambda n, rest, text: F.when(k % n == rest, text)

    def body(name: Column) -> list[Column]:
        return [
            F.concat(F.lit("PROCEDURE "), name, F.lit(" (p_id IN NUMBER, p_note IN OUT VARCHAR2, p_day DATE DEFAULT SYSDATE) IS")),
            F.lit("  v_sql VARCHAR2(400);"),
            F.lit("  TYPE t_rows IS TABLE OF audit_rows%ROWTYPE;"),
            F.lit("BEGIN"),
            F.concat(F.lit("  pkg_util.step"), s(k % 4), F.lit("(p_id);")),
            F.lit("  DBMS_OUTPUT.PUT_LINE('x');"),
            F.concat(F.lit("  INSERT INTO audit_rows SELECT id FROM src_"), s(k % 5), F.lit(" WHERE id = p_id;")),
            at(2, 0, F.concat(F.lit("  SELECT n INTO v_n FROM remote_tab@link"), s(k % 3), F.lit(";"))),
            at(4, 1, F.lit("  v_sql := 'DELETE FROM old_rows';")),
            at(4, 1, F.lit("  EXECUTE IMMEDIATE v_sql;")),
            at(4, 2, F.lit("  EXECUTE IMMEDIATE 'TRUNCATE TABLE ' || p_note;")),
            at(4, 3, F.lit("  EXECUTE IMMEDIATE v_sql USING p_id;")),
            at(5, 2, F.lit("  v_proc := 'pkg_util.run';")),
            at(5, 2, F.lit("  EXECUTE IMMEDIATE 'BEGIN ' || v_proc || '(); END;';")),
            at(5, 3, F.lit("  SELECT handler INTO v_proc FROM handlers WHERE id = p_id;")),
            at(5, 3, F.lit("  EXECUTE IMMEDIATE 'BEGIN ' || v_proc || '(); END;';")),
            F.lit("  IF p_id > 0 THEN"),
            F.lit("    UPDATE totals SET n = n + 1;"),
            F.lit("  END IF;"),
            F.lit("END;"),
        ]

    one = F.concat(F.lit("unit_"), s(k))
    alone = lines(F.lit("CREATE OR REPLACE"), *body(one))
    packed = lines(F.concat(F.lit("CREATE OR REPLACE PACKAGE BODY pack_"), s(k), F.lit(" AS")), *body(F.lit("first_unit")), *body(F.lit("second_unit")), F.concat(F.lit("END pack_"), s(k), F.lit(";")))
    return suppliers.select(k.alias("k"), laid_out(F.when(k % 3 == 0, packed).otherwise(alone), k, "  ").alias("raw_sql"))


ORACLE_BODY = """concat_ws(chr(10), 'PROCEDURE ' || {name} || ' (p_id IN NUMBER, p_note IN OUT VARCHAR2, p_day DATE DEFAULT SYSDATE) IS', '  v_sql VARCHAR2(400);',
  '  TYPE t_rows IS TABLE OF audit_rows%ROWTYPE;', 'BEGIN', '  pkg_util.step' || (s_suppkey % 4) || '(p_id);', '  DBMS_OUTPUT.PUT_LINE(''x'');',
  '  INSERT INTO audit_rows SELECT id FROM src_' || (s_suppkey % 5) || ' WHERE id = p_id;',
  CASE WHEN s_suppkey % 2 = 0 THEN '  SELECT n INTO v_n FROM remote_tab@link' || (s_suppkey % 3) || ';' END,
  CASE WHEN s_suppkey % 4 = 1 THEN '  v_sql := ''DELETE FROM old_rows'';' END, CASE WHEN s_suppkey % 4 = 1 THEN '  EXECUTE IMMEDIATE v_sql;' END,
  CASE WHEN s_suppkey % 4 = 2 THEN '  EXECUTE IMMEDIATE ''TRUNCATE TABLE '' || p_note;' END, CASE WHEN s_suppkey % 4 = 3 THEN '  EXECUTE IMMEDIATE v_sql USING p_id;' END,
  CASE WHEN s_suppkey % 5 = 2 THEN '  v_proc := ''pkg_util.run'';' END, CASE WHEN s_suppkey % 5 = 2 THEN '  EXECUTE IMMEDIATE ''BEGIN '' || v_proc || ''(); END;'';' END,
  CASE WHEN s_suppkey % 5 = 3 THEN '  SELECT handler INTO v_proc FROM handlers WHERE id = p_id;' END, CASE WHEN s_suppkey % 5 = 3 THEN '  EXECUTE IMMEDIATE ''BEGIN '' || v_proc || ''(); END;'';' END,
  '  IF p_id > 0 THEN', '    UPDATE totals SET n = n + 1;', '  END IF;', 'END;')"""

#: The units of the same corpus in DuckDB: k, unit and body text, already taken out of their packages, with line feeds alone.
ORACLE_UNITS = f"""
units AS (
  SELECT k, unit, replace({LAID_OUT.format(k="k", indent="  ")}, chr(13), '') AS raw_sql FROM (
  SELECT s_suppkey AS k, 'unit_' || s_suppkey AS unit, 'CREATE OR REPLACE' || chr(10) || {ORACLE_BODY.format(name="'unit_' || s_suppkey")} AS t FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT s_suppkey, 'pack_' || s_suppkey || '.first_unit', {ORACLE_BODY.format(name="'first_unit'")} FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT s_suppkey, 'pack_' || s_suppkey || '.second_unit', {ORACLE_BODY.format(name="'second_unit'")} FROM supplier WHERE s_suppkey % 3 = 0))"""
