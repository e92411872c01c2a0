"""Sources and sinks: queries that write what they derive to the shared folder and read it back, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.operators import catalog as c
from procweave.operators import edge_cases as ec
from procweave.operators import extract as x
from procweave.operators import plsql as px
from procweave.plans.edge_cases import UNIT_LINES, UNITS, keyed, units
from procweave.plans.extraction import corpus
from procweave.plans.graph import RELATIONS, relations
from procweave.registry import query
from procweave.session import table
from procweave.sources import sinks
from procweave.sources.corpus import last_definitions, list_files, oracle_corpus, read_sources, tsql_corpus
from procweave.sources.live_schema import schema_of
from procweave.streaming import captured, logs, subscriptions

@query("src_tsql_dir", "SELECT 'usp_P' || s_suppkey AS procedure_name, CASE WHEN s_suppkey % 3 = 0 THEN 'sales' ELSE 'dbo' END AS schema_name FROM supplier")
def tsql_dir(spark, sf_dir):
    """Procedures written as one file each, read back as a folder of sources; the last definition of a name wins."""
    folder = sinks.shared_folder(spark, "sql")
    made = tsql_corpus(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_nationkey").alias("p_size")))
    # Every second file begins with a byte-order mark, which the reader drops. The text sink names files .txt.
    marked = made.withColumn("raw_sql", F.concat(F.when(F.col("k") % 2 == 0, "\ufeff").otherwise(""), "raw_sql"))
    sinks.write_files(marked, folder, "sql", "raw_sql")
    read = read_sources(spark, f"{folder}/kind=sql", kinds=("*.txt",))
    name, schema = x.procedure_name(F.col("raw_sql"))
    return last_definitions(read.withColumns({"procedure_name": name, "schema_name": schema})).select("procedure_name", "schema_name")


@query("src_plsql_dir", f"{UNITS} SELECT DISTINCT unit FROM units")
def plsql_dir(spark, sf_dir):
    folder = sinks.shared_folder(spark, "plsql")
    made = oracle_corpus(table(spark, sf_dir, "supplier"))
    for n, kind in enumerate(("sql", "pkb", "prc")):
        sinks.write_files(made.filter(F.col("k") % 3 == n), folder, kind, "raw_sql")
    read = read_sources(spark, folder, "oracle", kinds=("*.txt",)).select(F.col("source_file").alias("k"), F.rtrim("raw_sql", F.lit("\n")).alias("raw_sql"))
    return px.units(read, "k").select("unit").distinct()


@query("src_dialect_route", "SELECT 'oracle' AS dialect, count(*)::BIGINT AS files FROM supplier")
def dialect_route(spark, sf_dir):
    """The reader of a dialect's own file kinds; files of other kinds are not read."""
    folder = sinks.shared_folder(spark, "route")
    sinks.write_files(oracle_corpus(table(spark, sf_dir, "supplier")), folder, "prc", "raw_sql")
    listed = list_files(spark, f"{folder}/kind=prc").filter(F.col("name").startswith("part-"))
    return listed.agg(F.count("*").alias("files")).select(F.lit("oracle").alias("dialect"), "files")


@query("src_live_schema", """SELECT 'Account' || s_suppkey AS table_name, p AS ordinal_position, c AS column_name, t AS target, n AS nullable, p = 1 AS is_primary_key, p = 1 AS is_identity, CASE p WHEN 2 THEN 'Branch' || s_nationkey END AS referenced_table
FROM supplier, (VALUES (1::BIGINT, 'AccountId', 'Integer', false), (2, 'BranchId', 'Integer', true), (3, 'Note', 'String', true)) v(p, c, t, n) WHERE s_suppkey % 2 = 0""")
def live_schema(spark, sf_dir):
    """Tables of a database by its information schema: its views, here made of the suppliers, are read from the shared folder as over JDBC."""
    suppliers = table(spark, sf_dir, "supplier")
    account, branch = F.concat(F.lit("Account"), F.col("s_suppkey").cast("string")), F.concat(F.lit("Branch"), F.col("s_nationkey").cast("string"))
    made = suppliers.select(account.alias("t"), branch.alias("b"))
    branches = made.select("b").distinct()
    cut = lambda values, names: F.inline(F.expr(f"array({values})")).alias(*names)
    columns = made.select(F.lit("dbo").alias("TABLE_SCHEMA"), F.col("t").alias("TABLE_NAME"), cut("struct('AccountId', 1, 'int', 'NO', null, 1), struct('BranchId', 2, 'int', 'YES', null, 0), struct('Note', 3, 'varchar', 'YES', 40, 0)", ("COLUMN_NAME", "ORDINAL_POSITION", "DATA_TYPE", "IS_NULLABLE", "CHARACTER_MAXIMUM_LENGTH", "IS_IDENTITY_COLUMN")))
    others = branches.select(F.lit("dbo").alias("TABLE_SCHEMA"), F.col("b").alias("TABLE_NAME"), F.lit("BranchId").alias("COLUMN_NAME"), F.lit(1).alias("ORDINAL_POSITION"), F.lit("int").alias("DATA_TYPE"), F.lit("NO").alias("IS_NULLABLE"), F.lit(None).cast("int").alias("CHARACTER_MAXIMUM_LENGTH"), F.lit(0).alias("IS_IDENTITY_COLUMN"))
    key = lambda rows, t, kind, column: rows.select(F.lit("dbo").alias("CONSTRAINT_SCHEMA"), F.concat(F.lit(f"{kind[0]}K_"), t).alias("CONSTRAINT_NAME"), F.col(t).alias("TABLE_NAME"), F.lit(kind).alias("CONSTRAINT_TYPE"), F.lit(column).alias("COLUMN_NAME"), F.lit(1).alias("ORDINAL_POSITION"))
    keys = key(made, "t", "PRIMARY KEY", "AccountId").unionByName(key(branches, "b", "PRIMARY KEY", "BranchId")).unionByName(key(made, "t", "FOREIGN KEY", "BranchId"))
    links = made.select(F.lit("dbo").alias("CONSTRAINT_SCHEMA"), F.concat(F.lit("FK_"), "t").alias("CONSTRAINT_NAME"), F.lit("dbo").alias("UNIQUE_CONSTRAINT_SCHEMA"), F.concat(F.lit("PK_"), "b").alias("UNIQUE_CONSTRAINT_NAME"))
    views = {"COLUMNS": columns.unionByName(others), "TABLE_CONSTRAINTS": keys.drop("COLUMN_NAME", "ORDINAL_POSITION"), "KEY_COLUMN_USAGE": keys.drop("CONSTRAINT_TYPE"), "REFERENTIAL_CONSTRAINTS": links}
    wanted = suppliers.filter("s_suppkey % 2 = 0").select(F.upper(account).alias("table_name"))
    schema = schema_of({name: sinks.kept(view, name.lower()) for name, view in views.items()}, wanted)
    found = schema.columns.join(schema.references.drop("referenced_column"), ["table_name", "column_name"], "left")
    return found.select("table_name", "ordinal_position", "column_name", "target", "nullable", "is_primary_key", "is_identity", "referenced_table")


@query("src_plsql_file", f"{UNITS} SELECT k, count(*)::BIGINT AS records, sum(length(raw_sql))::BIGINT AS chars FROM units GROUP BY k")
def plsql_file(spark, sf_dir):
    return units(spark, sf_dir).groupBy("k").agg(F.count("*").alias("records"), F.sum(F.length("raw_sql")).alias("chars"))


@query("px_route", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'package body' ELSE 'standalone' END AS kind FROM supplier")
def px_route(spark, sf_dir):
    """Specifications give nothing, package bodies are unwrapped, the rest stands alone."""
    body = px.package_of(F.col("raw_sql"))["body"]
    kind = F.when(body, "package body").when(~body, "specification").otherwise("standalone")
    return oracle_corpus(table(spark, sf_dir, "supplier")).select("k", kind.alias("kind"))


@query("px_standalone", f"""{UNITS} SELECT unit, len(string_split(raw_sql, chr(10)))::BIGINT AS total_line_count, 3::BIGINT AS n_params, 1::BIGINT AS n_calls FROM units""")
def standalone(spark, sf_dir):
    """One record a unit: lines, parameters and calls."""
    rows = keyed(spark, sf_dir)
    n_params = px.parameters(rows, ["unit"]).groupBy("unit").agg(F.count("*").alias("n_params"))
    return rows.select("unit", x.line_count(F.col("raw_sql")).alias("total_line_count"), F.size(px.called(F.col("raw_sql"))).cast("long").alias("n_calls")).join(n_params, "unit")


def gtt_scripts(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("CREATE GLOBAL TEMPORARY TABLE gtt_Rows"), k, F.lit(" (RowId NUMBER(10,0) NOT NULL, Note VARCHAR2(40)) ON COMMIT DELETE ROWS;"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), text.alias("raw_sql"))


@query("px_gtt", "SELECT n_nationkey AS k, 'gtt_Rows' || n_nationkey AS name, 'RowId NUMBER(10,0) NOT NULL, Note VARCHAR2(40)' AS columns FROM nation")
def gtt(spark, sf_dir):
    return px.global_temps(gtt_scripts(spark, sf_dir), ["k"])


@query("px_coldefs", "SELECT n_nationkey AS k, place::BIGINT AS place, name, sql_type, nullable FROM nation, (VALUES (0, 'RowId', 'NUMBER(10,0)', false), (1, 'Note', 'VARCHAR2(40)', true)) c(place, name, sql_type, nullable)")
def gtt_columns(spark, sf_dir):
    return x.column_defs(px.global_temps(gtt_scripts(spark, sf_dir), ["k"]), ["k"])


@query("px_staging_name", "SELECT n_nationkey AS k, 'stg_rows' || n_nationkey AS staging_name FROM nation")
def gtt_staging(spark, sf_dir):
    return px.global_temps(gtt_scripts(spark, sf_dir), ["k"]).select("k", px.staging_name(F.col("name")).alias("staging_name"))


@query("eo_operation", f"{UNIT_LINES} SELECT unit, line::BIGINT AS line, 'SELECT' AS operation FROM ls WHERE contains(s, '@link')")
def oracle_operation(spark, sf_dir):
    return ec.database_links(keyed(spark, sf_dir), "unit").select("unit", "line", "operation")


ORACLE_REPORT = """SELECT unit, (k % 2 = 0)::BIGINT AS linked_servers, ((k % 4 > 0)::INT + (k % 5 IN (2, 3))::INT)::BIGINT AS dynamic_sql, (k % 5 IN (2, 3))::BIGINT AS variable_calls,
((k % 2 = 0)::INT + (k % 4 = 2)::INT + (k % 5 IN (2, 3))::INT + (k % 5 = 3)::INT)::BIGINT AS unresolved_count FROM units"""


def oracle_report(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    found = ec.statement_table(rows, "unit", dialect=ec.PLSQL)
    return ec.edge_case_report(ec.database_links(rows, "unit"), ec.immediate_sql(rows, "unit", found=found), ec.dispatches(rows, "unit", found=found), "unit")


@query("eo_detect", f"{UNITS}, r AS ({ORACLE_REPORT}) SELECT * FROM r WHERE linked_servers + dynamic_sql + variable_calls > 0")
def oracle_detect(spark, sf_dir):
    return oracle_report(spark, sf_dir)


@query("eo_detect_all", f"{UNITS}, r AS ({ORACLE_REPORT}) SELECT sum(linked_servers)::BIGINT AS linked_servers, sum(dynamic_sql)::BIGINT AS dynamic_sql, sum(variable_calls)::BIGINT AS variable_calls, sum(unresolved_count)::BIGINT AS unresolved_count FROM r")
def oracle_detect_all(spark, sf_dir):
    return oracle_report(spark, sf_dir).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("linked_servers", "dynamic_sql", "variable_calls", "unresolved_count")])


@query("sc_camel", "SELECT p_partkey, 'p' || p_partkey AS method FROM part")
def camel(spark, sf_dir):
    _, method = c.service_names(F.concat(F.lit("sp_P"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", method.alias("method"))


@query("sc_repository", "SELECT 'Parent' || n_nationkey || 'Repository extends JpaRepository<Parent' || n_nationkey || ', Long>' AS repository FROM nation UNION ALL SELECT 'Child' || n_nationkey || 'Repository extends JpaRepository<Child' || n_nationkey || ', Long>' FROM nation")
def repositories(spark, sf_dir):
    from procweave.plans.catalog import defined

    keys = c.key_type(c.columns(defined(spark, sf_dir), ["table_name"]))
    return keys.select(F.concat("table_name", F.lit("Repository extends JpaRepository<"), "table_name", F.lit(", "), "key_type", F.lit(">")).alias("repository"))


@query("sink_files", "SELECT 'Service' || s_suppkey || '.java' AS name, 'class Service' || s_suppkey || ' {}' AS value FROM supplier")
def files(spark, sf_dir):
    """A file of its own name for every service, read back by name."""
    folder = sinks.shared_folder(spark, "files")
    service = F.concat(F.lit("Service"), F.col("s_suppkey").cast("string"))
    made = table(spark, sf_dir, "supplier").select(F.concat(service, F.lit(".java")).alias("name"), F.concat(F.lit("class "), service, F.lit(" {}")).alias("code"))
    sinks.write_named(made, folder, "name", "code")
    return spark.read.option("pathGlobFilter", "*.java").text(folder).select(F.col("_metadata.file_name").alias("name"), "value")


@query("sink_graph", f"""{RELATIONS}, first AS (SELECT DISTINCT k, dst, rel, certainty FROM rels),
merged AS (SELECT k, dst, rel, CASE WHEN k % 10 = 3 AND rel = 'CALLS' THEN 'confirmed' ELSE max(certainty) END AS certainty FROM first GROUP BY k, dst, rel
UNION ALL SELECT DISTINCT k, 'late_' || k, 'CALLS', 'confirmed' FROM corpus WHERE k % 10 = 3)
SELECT rel, certainty, count(*)::BIGINT AS n FROM merged GROUP BY ALL""")
def graph(spark, sf_dir):
    """A graph written twice stays as it is; a second, smaller write changes its own keys and adds new ones."""
    path = sinks.shared_folder(spark, "graph")
    edges = sinks.kept(relations(spark, sf_dir).select("src", "dst", "rel", "certainty"), "edges")
    keys = ["src", "dst", "rel"]
    for _ in range(2):
        sinks.upsert(edges, path, keys)
    own = edges.filter((F.col("src").cast("long") % 10 == 3) & (F.col("rel") == "CALLS")).select(*keys, F.lit("confirmed").alias("certainty"))
    late = table(spark, sf_dir, "part").filter("p_partkey % 10 = 3").select(F.col("p_partkey").cast("string").alias("src"), F.concat(F.lit("late_"), F.col("p_partkey").cast("string")).alias("dst"), F.lit("CALLS").alias("rel"), F.lit("confirmed").alias("certainty"))
    sinks.upsert(own.unionByName(late), path, keys)
    return sinks.read_upserted(spark, path, edges.schema).groupBy("rel", "certainty").agg(F.count("*").alias("n"))


@query("sink_graph_clear", "SELECT 'Other' AS label, count(*)::BIGINT AS n FROM nation")
def graph_clear(spark, sf_dir):
    """Clearing one label leaves the others."""
    path = sinks.shared_folder(spark, "graph")
    edges = table(spark, sf_dir, "nation").select(F.col("n_name").alias("src"), F.col("n_regionkey").cast("string").alias("dst"))
    for label in ("Mig", "Other"):
        sinks.write_graph(edges, path, label)
    sinks.clear_graph(spark, path, "Mig")
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"))


@query("sink_run_tables", "SELECT user_id AS run_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def run_tables(spark, sf_dir):
    """States are appended, old ones stay; a view shows the last."""
    path = sinks.shared_folder(spark, "runs")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type")
    for part in (0, 1):
        sinks.append_runs(rows.filter(F.col("event_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.max_by("event_type", "event_id").alias("status"))


def log_copy(spark, sf_dir):
    """The events as a log folder that streams read."""
    path = sinks.shared_folder(spark, "log")
    table(spark, sf_dir, "events").select(*[f.split()[0] for f in logs.LOG_SCHEMA.split(", ")]).repartition(4, "event_id").write.parquet(path)
    return path


@query("lg_stream", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level FROM events")
def stream(spark, sf_dir):
    """A log stream, classified and appended to a durable log batch by batch."""
    out, mark = sinks.shared_folder(spark, "durable"), sinks.shared_folder(spark, "mark")
    entries = logs.classified(logs.read_log(spark, log_copy(spark, sf_dir), files_each=2), "event_type").select("event_id", "level")
    logs.append_log(entries, out, mark).awaitTermination()
    return spark.read.parquet(out).select("event_id", "level")


@query("lg_capture", "SELECT user_id AS run_id, count(*)::BIGINT AS entries FROM events GROUP BY 1")
def capture(spark, sf_dir):
    """What a run's log holds after its stream has ended."""
    out, mark = sinks.shared_folder(spark, "durable"), sinks.shared_folder(spark, "mark")
    logs.append_log(logs.read_log(spark, log_copy(spark, sf_dir)).select("user_id", "event_id"), out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("entries"))


@query("lg_websocket", "SELECT event_id, event_type FROM events WHERE user_id = 3")
def websocket(spark, sf_dir):
    """One subscriber's own query over the stream, to the end of what is there."""
    out, mark = sinks.shared_folder(spark, "followed"), sinks.shared_folder(spark, "mark")
    logs.follow(logs.read_log(spark, log_copy(spark, sf_dir)), 3, out, mark).awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type")


@query("lg_stage_fsm", """SELECT user_id AS run_id, coalesce(arg_min(CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'failed' END, ts) FILTER (event_type IN ('purchase', 'error')), 'running') AS status
FROM events GROUP BY 1""")
def stage_status(spark, sf_dir):
    """The state machine of each run's stage over the stream of its entries: the last state that it told."""
    out, mark = sinks.shared_folder(spark, "states"), sinks.shared_folder(spark, "mark")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    entries = logs.read_log(spark, log_copy(spark, sf_dir), files_each=2).select(F.col("user_id").alias("run_id"), F.lit("main").alias("stage"), status.alias("status"), "ts")
    logs.append_log(logs.stage_states(entries), out, mark, mode="update").awaitTermination()
    return spark.read.parquet(out).groupBy("run_id").agg(F.max_by("status", "batch").alias("status"))


@query("lg_rollup", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def rollup(spark, sf_dir):
    """Extension: counts by hour and type in event-time windows with a watermark, over a stream whose log comes in two parts by time."""
    log, out, mark = (sinks.shared_folder(spark, n) for n in ("log", "counts", "mark"))
    rows = table(spark, sf_dir, "events").select(*[f.split()[0] for f in logs.LOG_SCHEMA.split(", ")]).withColumn("ts", F.col("ts").cast("timestamp"))
    middle = rows.agg(F.percentile_approx(F.unix_seconds("ts"), 0.5).alias("m")).first()["m"]
    for part in (F.unix_seconds("ts") <= middle, F.unix_seconds("ts") > middle):
        rows.filter(part).write.mode("append").parquet(log)
        # Each part is one batch; entries of the second are no older than the watermark of the first.
        logs.append_counts(logs.windowed_counts(logs.read_log(spark, log, files_each=1_000_000)), out, mark).awaitTermination()
    return logs.counts_so_far(spark, out).select(F.col("since").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("lg_poll", "SELECT user_id AS run_id, count(*)::BIGINT AS open_entries FROM events WHERE event_type NOT IN ('purchase', 'error') GROUP BY 1")
def poll(spark, sf_dir):
    """What a poller saw as running, batch by batch, until the log said that it was over."""
    log, out, mark = log_copy(spark, sf_dir), sinks.shared_folder(spark, "polled"), sinks.shared_folder(spark, "mark")
    last = spark.range(1).select(F.lit(None).cast("long").alias("event_id"), F.lit("over").alias("event_type"))
    # Written after all others, so it is read after all others.
    last.write.mode("append").parquet(log)
    stream = logs.read_log(spark, log, files_each=2).select("user_id", "event_id", "event_type")
    captured.poll(stream, out, mark, F.col("event_type") == "over", seconds=0.1)
    seen = spark.read.schema(stream.schema).parquet(out).filter(~F.col("event_type").isin("purchase", "error", "over"))
    return seen.groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("open_entries"))


@query("sink_graph_embedded", f"{RELATIONS} SELECT DISTINCT k::VARCHAR AS src, dst, rel FROM rels WHERE rel IN ('CALLS_REMOTE', 'UNRESOLVED_CALL')")
def graph_of_known(spark, sf_dir):
    """Edges whose source the corpus defines, as a store does that matches sources and does not create them."""
    known = corpus(spark, sf_dir).select(F.col("k").cast("string").alias("src"))
    kept = relations(spark, sf_dir).filter(F.col("rel").isin("CALLS_REMOTE", "UNRESOLVED_CALL")).join(known, "src", "left_semi")
    return kept.select("src", "dst", "rel").distinct()


CHANNELS = """message AS (SELECT user_id AS run_id, event_id, event_type, CASE WHEN event_type = 'signup' THEN 'subscribe' WHEN event_type = 'purchase' AND event_id % 8 = 0 THEN 'end' ELSE 'entry' END AS kind FROM events),
ending AS (SELECT run_id, min(event_id) AS ended_by FROM message WHERE kind = 'end' GROUP BY 1),
sub AS (SELECT s.run_id, s.event_id AS subscriber, e.ended_by FROM message s LEFT JOIN ending e USING (run_id) WHERE s.kind = 'subscribe'),
got AS (SELECT s.run_id, s.subscriber, m.event_id AS entry_id, m.event_type AS text FROM sub s JOIN message m ON m.run_id = s.run_id AND m.kind = 'entry' AND m.event_id > s.subscriber AND (s.ended_by IS NULL OR m.event_id < s.ended_by)),
inbox AS (SELECT run_id, subscriber, (row_number() OVER (PARTITION BY run_id, subscriber ORDER BY entry_id) - 1)::BIGINT AS sequence, entry_id, text, false AS last FROM got
UNION ALL SELECT s.run_id, s.subscriber, (SELECT count(*) FROM got g WHERE g.run_id = s.run_id AND g.subscriber = s.subscriber)::BIGINT, NULL, NULL, true FROM sub s WHERE s.ended_by IS NOT NULL)"""


def channels(spark, sf_dir):
    """Every subscriber's inbox of a log that comes in two parts: the stream stops in between and starts again where it was."""
    arrived, out, mark = (sinks.shared_folder(spark, n) for n in ("messages", "inboxes", "mark"))
    kind = F.when(F.col("event_type") == "signup", "subscribe").when((F.col("event_type") == "purchase") & (F.col("event_id") % 8 == 0), "end").otherwise("entry")
    who = F.when(F.col("event_type") == "signup", F.col("event_id")).alias("subscriber")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("message_id"), kind.alias("kind"), who, F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("at"))
    middle = rows.agg(F.percentile_approx("message_id", 0.5).alias("m")).first()["m"]
    for part in (F.col("message_id") <= middle, F.col("message_id") > middle):
        rows.filter(part).write.mode("append").parquet(arrived)
        # Ends are remembered for the whole month that the events cover.
        subscriptions.deliver(spark.readStream.schema(rows.schema).parquet(arrived), out, mark, keep_ms=366 * 86_400_000)
    return subscriptions.inboxes(spark, out)


@query("lg_subscribe", f"WITH {CHANNELS} SELECT * FROM inbox")
def subscribe(spark, sf_dir):
    """What every subscriber of a run's log gets from its joining on, numbered, with the end mark."""
    return channels(spark, sf_dir)


@query("lg_registry", f"WITH {CHANNELS} SELECT run_id, count(DISTINCT subscriber)::BIGINT AS subscribers, count(entry_id)::BIGINT AS delivered, bool_or(last) AS closed FROM inbox GROUP BY 1")
def registry(spark, sf_dir):
    """The channels that anyone listened to: how many did, what they got, whether the channel is closed."""
    return channels(spark, sf_dir).groupBy("run_id").agg(F.count_distinct("subscriber").alias("subscribers"), F.count("entry_id").alias("delivered"), F.bool_or("last").alias("closed"))
