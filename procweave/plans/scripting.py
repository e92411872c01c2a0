"""Control flow of procedures: set-based rewrites, SQL scripts, dynamic SQL with parameters, dispatch by table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.operators.lookup import tier_lookup
from procweave.operators.transactions import delete, require, transact, update
from procweave.plans.relational import TIERS, money
from procweave.registry import query
from procweave.session import table

#: Fixed value: the SQLSTATE of what a statement raises by itself.
RAISED = "P0001"


def order_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """What a procedure computes for one order, for all orders at once: subtotal, tier discount, and the discounted total in cents."""
    subtotal = lines.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("exact"))
    joined = orders.join(subtotal, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joined = joined.withColumn("exact", F.coalesce("exact", F.lit(0).cast("decimal(28,2)"))).withColumn("subtotal", F.col("exact").cast("double"))
    return tier_lookup(joined, F.col("subtotal"), TIERS, "percent").select("o_orderkey", "subtotal", "percent", (F.col("exact") * (F.lit(100) - F.col("percent").cast("int"))).cast("double").alias("total_cents"))


TOTALS = """SELECT o_orderkey, coalesce(subtotal, 0)::DOUBLE AS subtotal, (coalesce(subtotal, 0) * CASE WHEN coalesce(subtotal, 0) >= 300000 THEN 90 WHEN coalesce(subtotal, 0) >= 100000 THEN 95 ELSE 100 END)::DOUBLE AS total_cents, CASE WHEN coalesce(subtotal, 0) >= 300000 THEN 10.0 WHEN coalesce(subtotal, 0) >= 100000 THEN 5.0 ELSE 0.0 END::DOUBLE AS percent
FROM orders LEFT JOIN (SELECT l_orderkey, sum(cast(l_extendedprice AS DECIMAL(18,2)))::DECIMAL(28,2) AS subtotal FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


@query("cf_cursor_loop", f"{TOTALS} WHERE o_orderstatus = 'P'")
def cursor_loop(spark, sf_dir):
    """A cursor over pending orders that calls a procedure for each, as one join and one aggregate."""
    return order_totals(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), table(spark, sf_dir, "lineitem"))


@query("cf_call_output", f"SELECT sum(total_cents::BIGINT)::BIGINT AS total_amount, count(*) FILTER (percent > 0)::BIGINT AS discounts FROM ({TOTALS} WHERE o_custkey = 11)")
def call_output(spark, sf_dir):
    """A procedure with OUTPUT parameters is a function that returns one row; halves of a cent go to the even one, as in its SQL's cast."""
    rows = order_totals(table(spark, sf_dir, "orders").filter("o_custkey = 11"), table(spark, sf_dir, "lineitem"))
    return rows.agg(F.sum(F.rint("total_cents").cast("long")).alias("total_amount"), F.count_if(F.col("percent") > 0).alias("discounts"))


@query("cf_while_if", """SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'large' WHEN p_size >= 20 THEN 'middle' ELSE 'small' END AS size_class,
(SELECT sum(i) FROM range(0, p_size + 1) t(i))::BIGINT AS steps FROM part""")
def while_if(spark, sf_dir):
    """IF chains are CASE; a WHILE that adds up a counter is a fold over a sequence."""
    size = F.col("p_size")
    kind = F.when(size >= 40, "large").when(size >= 20, "middle").otherwise("small")
    steps = F.aggregate(F.sequence(F.lit(0), size), F.lit(0).cast("long"), lambda a, i: a + i)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("size_class"), steps.alias("steps"))


@query("cf_script", "SELECT sum(cast(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS spent, 4::INT AS rounds FROM orders")
def script(spark, sf_dir):
    """DECLARE, SET, WHILE and IF as a SQL script; each round adds up the orders of one quarter of the year."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("pw_orders")
    return spark.sql("""
        BEGIN
          DECLARE spent DECIMAL(28,2) DEFAULT 0;
          DECLARE part DECIMAL(28,2) DEFAULT 0;
          DECLARE rounds INT DEFAULT 0;
          WHILE rounds < 4 DO
            SET part = (SELECT coalesce(sum(cast(o_totalprice AS DECIMAL(18,2))), 0) FROM pw_orders WHERE quarter(o_orderdate) = rounds + 1);
            SET spent = spent + part;
            SET rounds = rounds + 1;
          END WHILE;
          SELECT cast(spent AS DOUBLE) AS spent, rounds;
        END""")


@query("cf_try_tran", """WITH credited AS (SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 10 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier), kept AS (SELECT * FROM credited WHERE NOT s_acctbal < 2000),
failed AS (SELECT min(s_acctbal) < 5000 AS bad FROM kept)
SELECT s_suppkey, s_name, CASE WHEN bad THEN s_acctbal ELSE s_acctbal - 5000 END AS s_acctbal, CASE WHEN bad THEN 'balance below zero' END AS error_message,
(SELECT count(*) FROM supplier WHERE s_nationkey < 10)::BIGINT AS credited, (SELECT count(*) FROM credited WHERE s_acctbal < 2000)::BIGINT AS deleted FROM kept, failed""")
def try_tran(spark, sf_dir):
    """Two transactions: the first counts; the second fails on its last check, is rolled back, and its handler reports the message."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    balance = F.col("s_acctbal")
    first = transact(suppliers, [update("credit", F.col("s_nationkey") < 10, {"s_acctbal": balance + 100}), delete("purge", balance < 2000)])
    second = transact(first.rows, [update("debit", F.lit(True), {"s_acctbal": balance - 5000}), require("covered", balance >= 0, "balance below zero")], states=(RAISED,))
    counts = [F.lit(first.counts[n]).cast("long").alias(into) for n, into in (("credit", "credited"), ("purge", "deleted"))]
    return second.rows.select("s_suppkey", "s_name", "s_acctbal", F.lit(second.error).cast("string").alias("error_message"), *counts)


@query("fn_error", "SELECT event_id, 'value above 400' AS error_message FROM events WHERE value > 400")
def error(spark, sf_dir):
    """RAISERROR in a script whose EXIT HANDLER lists the rows at fault; nothing is listed if none is raised.

    What is raised inside a shuffle has no SQLSTATE when it comes to a handler, so the script raises after it has looked.
    """
    table(spark, sf_dir, "events").createOrReplaceTempView("pw_events")
    return spark.sql(f"""
        BEGIN
          DECLARE largest DOUBLE;
          DECLARE EXIT HANDLER FOR SQLSTATE '{RAISED}' BEGIN
            SELECT event_id, 'value above 400' AS error_message FROM pw_events WHERE value > 400;
          END;
          SET largest = (SELECT max(value) FROM pw_events);
          IF largest > 400 THEN
            SET largest = (SELECT cast(raise_error('value above 400') AS DOUBLE));
          END IF;
          SELECT event_id, 'value above 400' AS error_message FROM pw_events WHERE false;
        END""")


@query("fn_rowcount", "SELECT o_orderstatus, count(*)::BIGINT AS affected, (SELECT count(*) FROM orders WHERE o_totalprice > 400000)::BIGINT AS row_count FROM orders WHERE o_totalprice > 400000 GROUP BY 1")
def rowcount(spark, sf_dir):
    """@@ROWCOUNT of an update, told by the job that made it; SQL%FOUND is a count above zero."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(False).alias("large"))
    out = transact(orders, [update("mark", F.col("o_totalprice") > 400000, {"large": F.lit(True)})])
    return out.rows.filter("large").groupBy("o_orderstatus").agg(F.count("*").alias("affected")).withColumn("row_count", F.lit(out.counts["mark"]).cast("long"))


@query("cf_dynamic", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def dynamic(spark, sf_dir):
    """A statement built at run time, with its values as parameters and its table as an identifier."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("pw_orders")
    statement = "SELECT o_orderkey, o_totalprice FROM IDENTIFIER(:source) WHERE o_orderstatus = :status AND o_totalprice > :least"
    return spark.sql(statement, args={"source": "pw_orders", "status": "F", "least": 300000})


@query("cf_immediate", "SELECT count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
def immediate(spark, sf_dir):
    """EXECUTE IMMEDIATE with USING."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("pw_customer")
    return spark.sql("EXECUTE IMMEDIATE 'SELECT count(*) AS n FROM pw_customer WHERE c_acctbal > ? AND c_mktsegment = ?' USING 1000, 'BUILDING'")


#: Procedures that a dispatch table may name: each maps selected events to an amount.
HANDLERS = {
    "count_views": lambda df: df.select("event_id", F.lit(1.0).alias("amount")),
    "add_value": lambda df: df.select("event_id", F.round("value", 2).alias("amount")),
    "charge_back": lambda df: df.select("event_id", (-F.round("value", 2)).alias("amount")),
}

DISPATCH = [("view", "count_views"), ("click", "count_views"), ("purchase", "add_value"), ("error", "charge_back")]


@query("cf_var_call", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 1.0 WHEN event_type = 'purchase' THEN round(value, 2) ELSE -round(value, 2) END::DOUBLE AS amount FROM events WHERE event_type <> 'signup'")
def var_call(spark, sf_dir):
    """Calls by variable: a dispatch table says which procedure a row goes to; each procedure runs once over its rows."""
    rules = spark.createDataFrame(DISPATCH, "action string, handler string")
    # The dispatch table has as many rows as this module lists.
    routed = table(spark, sf_dir, "events").join(F.broadcast(rules), F.col("event_type") == F.col("action"))
    return reduce(DataFrame.unionByName, [run(routed.filter(F.col("handler") == name)) for name, run in HANDLERS.items()])


@query("cf_linked", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def linked(spark, sf_dir):
    """A remote table is another relation of the plan: here a second set of views; a JDBC source reads the same way."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("remote_nation")
    return table(spark, sf_dir, "supplier").join(spark.table("remote_nation"), F.col("s_nationkey") == F.col("n_nationkey")).filter("n_regionkey = 2").select("s_suppkey", "n_name")


@query("so_limit20", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20")
def limit20(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id").orderBy("event_id").limit(20)
