"""Scalar functions of both dialects over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.functions import dialect as d
from procweave.registry import query
from procweave.session import table


def never_ordered(spark, sf_dir):
    """Customers with their last order's date and total, null for most small segments."""
    last = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_date"), F.max("o_totalprice").alias("most"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")


LAST = """customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_date, max(o_totalprice) AS most FROM orders
WHERE o_totalprice > 450000 GROUP BY 1) ON c_custkey = o_custkey"""


@query("fn_isnull", f"SELECT c_custkey, coalesce(most, 0.0) AS most FROM {LAST}")
def isnull(spark, sf_dir):
    return never_ordered(spark, sf_dir).select("c_custkey", d.isnull(F.col("most"), F.lit(0.0)).alias("most"))


@query("fn_nvl2", f"SELECT c_custkey, CASE WHEN most IS NOT NULL THEN 'buyer' ELSE 'prospect' END AS kind FROM {LAST}")
def nvl2(spark, sf_dir):
    return never_ordered(spark, sf_dir).select("c_custkey", d.nvl2(F.col("most"), F.lit("buyer"), F.lit("prospect")).alias("kind"))


@query("fn_decode", f"""SELECT c_custkey, CASE WHEN year(last_date) IS NULL THEN 'none' WHEN year(last_date) = 1995 THEN 'first'
WHEN year(last_date) = 2001 THEN 'last' ELSE 'middle' END AS era FROM {LAST}""")
def decode(spark, sf_dir):
    year = F.year("last_date")
    era = d.decode(year, F.lit(None).cast("int"), F.lit("none"), F.lit(1995), F.lit("first"), F.lit(2001), F.lit("last"), F.lit("middle"))
    return never_ordered(spark, sf_dir).select("c_custkey", era.alias("era"))


@query("fn_coalesce", f"SELECT c_custkey, coalesce(most, nullif(c_acctbal, 0.0), -1.0) AS v FROM {LAST}")
def coalesce(spark, sf_dir):
    return never_ordered(spark, sf_dir).select("c_custkey", F.coalesce("most", F.nullif(F.col("c_acctbal"), F.lit(0.0)), F.lit(-1.0)).alias("v"))


@query("fn_datefromparts", "SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1)::VARCHAR AS first_day FROM orders")
def date_from_parts(spark, sf_dir):
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", d.date_from_parts(F.year(date), F.month(date), F.lit(1)).cast("string").alias("first_day"))


@query("fn_eomonth", "SELECT o_orderkey, last_day(o_orderdate)::VARCHAR AS last_day, last_day(o_orderdate + INTERVAL 2 MONTH)::VARCHAR AS later FROM orders")
def eomonth(spark, sf_dir):
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", d.eomonth(date).cast("string").alias("last_day"), d.eomonth(date, 2).cast("string").alias("later"))


@query("fn_trunc", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('month', ts)::TIMESTAMP AS month FROM events")
def trunc(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", d.trunc_date(F.col("ts")).cast("timestamp_ntz").alias("day"), d.trunc_date(F.col("ts"), "MM").cast("timestamp_ntz").alias("month"))


@query("fn_to_char", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts, '%d/%m/%Y') AS brief FROM events")
def to_char(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", d.to_char(F.col("ts"), "YYYY-MM-DD HH24:MI:SS").alias("shown"), d.to_char(F.col("ts"), "DD/MM/YYYY").alias("brief"))


@query("fn_to_date", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS parsed FROM events")
def to_date(spark, sf_dir):
    shown = d.to_char(F.col("ts"), "YYYY-MM-DD HH24:MI:SS")
    return table(spark, sf_dir, "events").select("event_id", d.to_date(shown, "YYYY-MM-DD HH24:MI:SS").cast("timestamp_ntz").alias("parsed"))


@query("fn_substr", "SELECT p_partkey, nullif(substr(p_name, 2, 4), '') AS middle, CASE WHEN length(p_name) >= 3 THEN substr(p_name, length(p_name) - 2) END AS tail FROM part")
def substr(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", d.substr(name, 2, 4).alias("middle"), d.substr(name, -3).alias("tail"))


@query("fn_instr", "SELECT p_partkey, instr(p_name, 'a')::INT AS at FROM part")
def instr(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", d.instr(F.col("p_name"), "a").alias("at"))


@query("fn_length", "SELECT doc_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes FROM documents")
def length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("fn_trim", "SELECT p_partkey, trim('  ' || p_name || ' ') AS both_sides, rtrim('  ' || p_brand || ' ') AS right_side, ltrim('xx' || p_brand, 'x') AS left_side FROM part")
def trim(spark, sf_dir):
    pad = lambda c: F.concat(F.lit("  "), F.col(c), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(pad("p_name")).alias("both_sides"), F.rtrim(pad("p_brand")).alias("right_side"), F.ltrim(F.concat(F.lit("xx"), "p_brand"), F.lit("x")).alias("left_side"))


@query("fn_upper_lower", "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low FROM customer")
def upper_lower(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper("c_mktsegment").alias("up"), F.lower("c_mktsegment").alias("low"))


@query("fn_pad", "SELECT p_partkey, lpad(p_partkey::VARCHAR, 8, '0') AS l, rpad(p_brand, 12, '.') AS r FROM part")
def pad(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("l"), F.rpad("p_brand", 12, ".").alias("r"))


@query("fn_replace", "SELECT p_partkey, replace(p_type, ' ', '_') AS t FROM part")
def replace(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("_")).alias("t"))


@query("fn_to_number", """SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, try_cast(event_type AS BIGINT) AS none FROM events""")
def to_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", d.to_number(F.regexp_extract("props", "([0-9]+)", 1)).cast("long").alias("k"), d.to_number(F.col("event_type")).cast("long").alias("none")
    )


@query("fn_concat", f"SELECT c_custkey, c_name || ': ' || coalesce(floor(most)::BIGINT::VARCHAR, '') AS oracle, c_name || ': ' || floor(most)::BIGINT::VARCHAR AS tsql FROM {LAST}")
def concat(spark, sf_dir):
    whole = F.floor("most")
    return never_ordered(spark, sf_dir).select("c_custkey", d.concat(F.col("c_name"), F.lit(": "), whole).alias("oracle"), d.plus(F.col("c_name"), F.lit(": "), whole).alias("tsql"))


@query("fn_cast", "SELECT o_orderkey, o_orderkey::VARCHAR AS text, cast(o_totalprice AS DECIMAL(18,1))::VARCHAR AS short FROM orders")
def cast(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("text"), F.col("o_totalprice").cast("decimal(18,1)").cast("string").alias("short"))


@query("fn_arith", """SELECT o_orderkey, (cast(o_totalprice AS DECIMAL(18,2)) * 5 * 100)::BIGINT AS discount_of_10000,
(cast(o_totalprice AS DECIMAL(18,2)) - cast(100 AS DECIMAL(18,2)))::DOUBLE AS less FROM orders""")
def arith(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", (price * 5 * 100).cast("long").alias("discount_of_10000"), (price - F.lit(100).cast("decimal(18,2)")).cast("double").alias("less"))


@query("fn_identity", "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS id, c_custkey FROM customer")
def identity(spark, sf_dir):
    from procweave.operators.changes import with_identity

    return with_identity(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"]).select("id", "c_custkey")


@query("fn_now", "SELECT r_regionkey, true AS now_is_set FROM region")
def now(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", (F.current_timestamp() > F.lit("2020-01-01").cast("timestamp")).alias("now_is_set"))


@query("fn_snake", r"SELECT p_partkey, lower(regexp_replace('Part' || p_brand || 'Name', '([a-z])([A-Z])', '\1_\2', 'g')) AS snake FROM part")
def snake(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", d.snake_case(F.concat(F.lit("Part"), "p_brand", F.lit("Name"))).alias("snake"))


CAPITALS = """array_to_string(list_transform(list_filter(string_split(replace('usp-' || lower(r_name) || '_Items', '-', '_'), '_'), lambda w: w <> ''), lambda w: upper(w[1:1]) || {rest}), '')"""


@query("fn_pascal", f"SELECT r_regionkey, {CAPITALS.format(rest='w[2:]')} AS documented, {CAPITALS.format(rest='lower(w[2:])')} AS coded FROM region")
def pascal(spark, sf_dir):
    name = F.concat(F.lit("usp-"), F.lower("r_name"), F.lit("_Items"))
    return table(spark, sf_dir, "region").select("r_regionkey", d.pascal_case(name).alias("documented"), d.pascal_case(name, False).alias("coded"))


@query("fn_camel", f"SELECT r_regionkey, lower(p[1:1]) || p[2:] AS camel FROM (SELECT r_regionkey, {CAPITALS.format(rest='w[2:]')} AS p FROM region)")
def camel(spark, sf_dir):
    name = F.concat(F.lit("usp-"), F.lower("r_name"), F.lit("_Items"))
    return table(spark, sf_dir, "region").select("r_regionkey", d.camel_case(name).alias("camel"))
