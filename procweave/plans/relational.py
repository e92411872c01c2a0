"""The relational workload of the procedures: joins, aggregates, windows, sorting, set operations and changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from procweave.operators.changes import delete_where, insert_rows, update_from, update_where, with_identity
from procweave.operators.lookup import previous_value, tier_lookup
from procweave.operators.ranking import global_row_number
from procweave.registry import query
from procweave.session import table

money = lambda c: F.col(c).cast("decimal(18,2)")

TIERS = [(0, 0), (100000, 5), (300000, 10)]


def star(spark, sf_dir):
    """Orders with their customer, line items and parts."""
    o = table(spark, sf_dir, "orders")
    return (
        o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )


def orders_of_1996(df):
    return df.filter(F.col("o_orderdate").between("1996-01-01", "1996-12-31"))


STAR = """orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"""
IN_1996 = "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"


@query("jn_inner4", f"""SELECT o_orderkey, c_name, l_linenumber, p_name, cast(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS price
FROM {STAR} WHERE {IN_1996}""")
def inner_star(spark, sf_dir):
    return orders_of_1996(star(spark, sf_dir)).select("o_orderkey", "c_name", "l_linenumber", "p_name", money("l_extendedprice").cast("double").alias("price"))


@query("ag_count_distinct", f"""SELECT p_type AS category, count(DISTINCT o_orderkey)::BIGINT AS order_count,
sum(cast(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS revenue, round(avg(l_extendedprice), 4) AS avg_value
FROM {STAR} WHERE {IN_1996} AND o_orderstatus IN ('O', 'F') GROUP BY p_type""")
def category_summary(spark, sf_dir):
    """Orders, revenue and mean value by category: the flagship."""
    kept = orders_of_1996(star(spark, sf_dir)).filter(F.col("o_orderstatus").isin("O", "F"))
    return kept.groupBy(F.col("p_type").alias("category")).agg(
        F.count_distinct("o_orderkey").alias("order_count"),
        F.sum(money("l_extendedprice")).cast("double").alias("revenue"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_value"),
    )


@query("ag_sum_avg", """SELECT l_returnflag, l_linestatus, sum(cast(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total,
round(avg(l_quantity), 4) AS mean_quantity FROM lineitem GROUP BY ALL""")
def sums_and_means(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_extendedprice")).cast("double").alias("total"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity")
    )


@query("ag_multi_key", """SELECT c_custkey, c_name, count(*)::BIGINT AS orders, sum(cast(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS spent
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def by_two_keys(spark, sf_dir):
    # Orders are summed by key before they meet the customers, so the join moves one row a customer.
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(money("o_totalprice")).cast("double").alias("spent"))
    return sums.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "orders", "spent")


@query("ag_scalar", """SELECT count(*)::BIGINT AS orders, coalesce(sum(cast(o_totalprice AS DECIMAL(18,2))), 0)::DOUBLE AS revenue,
coalesce(max(o_totalprice), 0) AS largest FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'""")
def scalar_aggregate(spark, sf_dir):
    late = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= "2001-01-01")
    return late.agg(
        F.count("*").alias("orders"),
        F.coalesce(F.sum(money("o_totalprice")), F.lit(0)).cast("double").alias("revenue"),
        F.coalesce(F.max("o_totalprice"), F.lit(0.0)).alias("largest"),
    )


@query("ag_expr_sum", """SELECT l_orderkey, sum(cast(l_quantity AS DECIMAL(18,2)) * cast(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS subtotal
FROM lineitem GROUP BY l_orderkey""")
def sum_of_products(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_quantity") * money("l_extendedprice")).cast("double").alias("subtotal"))


@query("jn_left_count", """SELECT c_custkey, count(o_orderkey)::BIGINT AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def left_count(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("jn_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("jn_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("jn_self_chain", """SELECT a.n_name AS first_name, b.n_name AS second_name, r_name FROM nation a JOIN nation b
ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON a.n_regionkey = r_regionkey""")
def self_chain(spark, sf_dir):
    a, b = table(spark, sf_dir, "nation").alias("a"), table(spark, sf_dir, "nation").alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    named = pairs.join(table(spark, sf_dir, "region"), F.col("a.n_regionkey") == F.col("r_regionkey"))
    return named.select(F.col("a.n_name").alias("first_name"), F.col("b.n_name").alias("second_name"), "r_name")


@query("jn_range_asof", """SELECT o_orderkey, (SELECT arg_max(pct, least) FROM (VALUES (0, 0.0), (100000, 5.0), (300000, 10.0)) t(least, pct)
WHERE least <= o_totalprice)::DOUBLE AS discount FROM orders""")
def range_asof(spark, sf_dir):
    return tier_lookup(table(spark, sf_dir, "orders"), F.col("o_totalprice"), TIERS, "discount").select("o_orderkey", "discount")


@query("jn_asof_backward", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_purchase FROM events""")
def asof_backward(spark, sf_dir):
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return previous_value(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], bought, "previous_purchase").select("event_id", "user_id", "previous_purchase")


SPENT = "(SELECT o_custkey, sum(cast(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS spent FROM orders GROUP BY o_custkey)"


def spending(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).cast("double").alias("spent"))


@query("wn_row_number", f"SELECT o_custkey, spent, row_number() OVER (ORDER BY spent DESC, o_custkey) AS ranking FROM {SPENT}")
def row_numbers(spark, sf_dir):
    return global_row_number(spending(spark, sf_dir), "spent", ["o_custkey"], into="ranking")


@query("wn_topn", f"SELECT o_custkey, spent, row_number() OVER (ORDER BY spent DESC, o_custkey) AS ranking FROM {SPENT} QUALIFY ranking <= 10")
def top_by_rank(spark, sf_dir):
    # The ten are taken first, each task sending ten at most, and numbered then.
    best = spending(spark, sf_dir).orderBy(F.desc("spent"), "o_custkey").limit(10)
    return best.withColumn("ranking", F.row_number().over(Window.orderBy(F.desc("spent"), "o_custkey")).cast("long"))


@query("so_order_desc", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey")
def order_desc(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("so_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("so_rownum", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal, c_custkey LIMIT 5")
def first_rows(spark, sf_dir):
    """ROWNUM <= 5 or FETCH FIRST 5 over an ordered input."""
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(5)


@query("so_list_desc", "SELECT event_id AS run_id, user_id AS project_id, ts AS created_at FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC")
def newest_first(spark, sf_dir):
    runs = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return runs.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("project_id"), F.col("ts").alias("created_at")).orderBy(F.desc("created_at"), F.desc("run_id"))


@query("set_union", "SELECT o_orderkey AS id, 'big' AS why FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'P'")
def union_all(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = lambda condition, why: o.filter(condition).select(F.col("o_orderkey").alias("id"), F.lit(why).alias("why"))
    return part("o_totalprice > 450000", "big").unionByName(part("o_orderstatus = 'P'", "open"))


@query("set_distinct", "SELECT DISTINCT c_mktsegment FROM customer")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment").distinct()


@query("set_except", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def except_(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("set_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersect(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(pending)


@query("prj_display_expr", """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 60
AND o_orderstatus IN ('O', 'F') AND o_totalprice <= 250000""")
def predicates(spark, sf_dir):
    """Point, range, list and comparison predicates, all pushed to the scan."""
    o = table(spark, sf_dir, "orders")
    return o.filter(F.col("o_custkey").between(10, 60) & F.col("o_orderstatus").isin("O", "F") & (F.col("o_totalprice") <= 250000)).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("prj_null_test", """SELECT c_custkey, o_orderkey IS NULL AS never FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
ON c_custkey = o_custkey WHERE o_orderkey IS NULL OR c_acctbal < 0""")
def null_test(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    joined = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.filter(F.col("o_orderkey").isNull() | (F.col("c_acctbal") < 0)).select("c_custkey", F.col("o_orderkey").isNull().alias("never"))


@query("dm_insert_values", """SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL
SELECT max(n_nationkey) + 1, 'ATLANTIS', NULL FROM nation""")
def insert_values(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    row = n.agg((F.max("n_nationkey") + 1).cast("int").alias("n_nationkey")).withColumn("n_name", F.lit("ATLANTIS"))
    return insert_rows(n, row)


@query("dm_insert_select", """SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL
SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0""")
def insert_select(spark, sf_dir):
    have = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    more = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return insert_rows(have, more)


@query("dm_update", """SELECT o_orderkey, coalesce(total, cast(o_totalprice AS DECIMAL(18,2))::DOUBLE) AS o_totalprice,
CASE WHEN o_orderstatus = 'P' THEN 'Processed' ELSE o_orderstatus END AS o_orderstatus
FROM orders LEFT JOIN (SELECT l_orderkey, sum(cast(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).cast("double").alias("o_totalprice"))
    return update_where(update_from(orders, totals, "o_orderkey", ["o_totalprice"]), F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("Processed")})


@query("dm_delete", "SELECT event_id, ts FROM events WHERE NOT (ts < TIMESTAMP '2024-01-15' AND event_type = 'error')")
def delete(spark, sf_dir):
    return delete_where(table(spark, sf_dir, "events"), (F.col("ts") < "2024-01-15") & (F.col("event_type") == "error")).select("event_id", "ts")


@query("dm_temp_table", f"""WITH monthly AS (SELECT o_orderkey, o_custkey, cast(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE {IN_1996}),
ranked AS (SELECT o_custkey, count(*)::BIGINT AS orders, sum(amount)::DOUBLE AS spent FROM monthly GROUP BY o_custkey)
SELECT c_name, orders, spent FROM ranked JOIN customer ON o_custkey = c_custkey""")
def temp_tables(spark, sf_dir):
    """A chain of temporary tables as a chain of plans."""
    monthly = orders_of_1996(table(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey", money("o_totalprice").alias("amount"))
    ranked = monthly.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("amount").cast("double").alias("spent"))
    return ranked.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_name", "orders", "spent")


@query("dm_identity", """SELECT 1000 + row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS report_id, o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def identity(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return with_identity(pending, "o_totalprice", ["o_orderkey"], start=1001, into="report_id").select("report_id", "o_orderkey")
