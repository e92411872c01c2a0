"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget runs down a tree of domain, language and source. At every node the budget is shared among the children by
their weights; no child gets more than its subtree can give (its tokens times the most epochs), and what one child
lacks goes to its siblings by weight. Only what a whole subtree lacks reaches the siblings of its parent. All sums are
whole tokens, so the result is exact and does not depend on the order of rows.

A leaf's budget buys whole epochs and then a prefix of one more epoch, in an order that the seed and the epoch's number
shuffle. No leaf is ever sorted: its tokens are summed by the next two hex digits of the order key, running sums over
those buckets (256 a leaf at most) find the one in which the budget ends, and that bucket's rows alone are looked at
with two digits more, until every such bucket holds one key.

Defined results: null text has no tokens; nulls of a level are a child of their own; a leaf without tokens gives
nothing. Rows that share an order key (equal ids in a leaf) are taken together or not at all. A prefix never exceeds
its budget. Columns of the input pass through, whatever their names, but for one named epoch, which is replaced. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.shared import materialize

LEVELS = ("domain", "lang", "source")

#: Hex digits of an order key by which a bucket is cut further, and the most leaves whose plan is broadcast; more are joined.
DIGITS, BROADCAST_LEAVES = 2, 10_000


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def share_out(children: DataFrame, parents: tuple[str, ...], node: str) -> DataFrame:
    """Add each child's budget, given its parent's (``parent_budget``), its capacity and its weight.

    Children are filled in the order of capacity by weight: those whose capacity is within their share are full, the
    others split the rest by weight.
    """
    family = [F.col(p) for p in parents] or [F.lit(1)]
    ordered = Window.partitionBy(*family).orderBy(F.col("capacity") / F.col("weight"), F.col(node).asc_nulls_first())
    whole = Window.partitionBy(*family)
    before = F.coalesce(F.sum("capacity").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    return (
        children.withColumn("full", F.col("capacity") * weight_left <= F.col("weight") * (F.col("parent_budget") - before))
        .withColumn("given", F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
        .withColumn(
            "budget",
            F.when(F.col("full"), F.col("capacity")).otherwise(
                F.expr("(weight * (parent_budget - given)) div open")
            ),
        )
        .drop("full", "given", "open")
    )


def weight_of(path: tuple[str, ...], weights: Mapping[tuple, int]) -> Column:
    """The weight of a node by its name at its level: weights maps (level, name) to a positive whole number, 1 if absent."""
    level = path[-1]
    found = F.lit(1)
    for (at, name), weight in weights.items():
        if at == level:
            found = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(int(weight))).otherwise(found)
    return found.cast("long")


def leaf_budgets(counted: DataFrame, weights: Mapping[tuple, int], share: tuple[int, int], max_epochs: int, levels=LEVELS) -> DataFrame:
    """One row a leaf: tokens, budget, whole epochs and the rest that a prefix of the next epoch fills."""
    leaves = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    budget = None
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", weight_of(path, weights))
        if budget is None:
            total = leaves.agg((F.expr(f"sum(tokens) * {share[0]} div {share[1]}")).alias("parent_budget"))
            # One row: the whole budget.
            nodes = nodes.crossJoin(F.broadcast(total)).withColumn("parent_budget", F.coalesce("parent_budget", F.lit(0)))
        else:
            up = budget.select(*[F.col(c).alias(f"up_{c}") for c in path[:-1]], F.col("budget").alias("parent_budget"))
            match = reduce(lambda a, b: a & b, [nodes[c].eqNullSafe(up[f"up_{c}"]) for c in path[:-1]])
            nodes = nodes.join(up, match).drop(*[f"up_{c}" for c in path[:-1]])
        budget = share_out(nodes, path[:-1], path[-1]).drop("parent_budget", "weight")
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long"))
    return budget.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0).cast("long")))


def with_plan(rows: DataFrame, plan: DataFrame, leaves: int, levels=LEVELS) -> DataFrame:
    """Join rows that have the levels to their leaf's row of the plan."""
    named = plan.select(*[F.col(c).alias(f"plan_{c}") for c in levels], *[c for c in plan.columns if c not in levels])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"plan_{c}")) for c in levels])
    return rows.join(F.broadcast(named) if leaves <= BROADCAST_LEAVES else named, match).drop(*[f"plan_{c}" for c in levels])


def leaf_cuts(counted: DataFrame, budgets: DataFrame, leaves: int, seed: int, levels=LEVELS) -> DataFrame:
    """One row a leaf: whole epochs, and the order key from which on the next epoch is not bought."""
    rows = with_plan(counted.select("id", *levels, "n_tokens"), budgets.select(*levels, "epochs", "rest"), leaves, levels).filter("rest > 0")
    rows = rows.select(*levels, "rest", "n_tokens", order_key(seed, F.col("epochs") + 1, F.col("id")).alias("key"))
    run = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    digits, cuts = 0, None
    while True:
        digits += DIGITS
        bucket = F.substr("key", F.lit(1), F.lit(digits)).alias("bucket")
        summed = rows.groupBy(*levels, "rest", bucket).agg(F.sum("n_tokens").alias("tokens"), F.min("key").alias("low"), F.max("key").alias("high"))
        # The bucket in which the budget ends, and what is left of it there.
        ends = (
            summed.withColumn("left", F.col("rest") - F.sum("tokens").over(run) + F.col("tokens"))
            .filter("left < tokens")
            .groupBy(*levels)
            .agg(F.min(F.struct("bucket", "left", "low", "high")).alias("end"))
            .select(*levels, "end.*")
        )
        ends = materialize(ends, "mix-ends")
        settled = ends.filter("low = high").select(*levels, F.col("bucket").alias("cut"))
        cuts = settled if cuts is None else cuts.unionByName(settled)
        unsettled = ends.filter("low < high").select(*levels, F.col("bucket").alias("at"), F.col("left").alias("rest"))
        if unsettled.isEmpty():
            break
        # One bucket of 256 of each leaf: the rows that the next digits part.
        inside = with_plan(rows.drop("rest"), unsettled, leaves, levels).filter(F.col("key").startswith(F.col("at")))
        rows = materialize(inside.drop("at"), "mix-bucket")
    cuts = cuts.select(*[F.col(c).alias(f"cut_{c}") for c in levels], "cut")
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"cut_{c}")) for c in levels])
    return budgets.join(cuts, match, "left").select(*levels, "epochs", F.coalesce("cut", F.lit("")).alias("cut"))


def mix(
    docs: DataFrame,
    weights: Mapping[tuple, int],
    share: tuple[int, int] = (1, 1),
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: Column | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Select documents by target weights; one row for each document and epoch that takes it.

    share is the budget as a fraction of all tokens. The result has the columns of docs and epoch, from 1; or, unless
    keep_text, only the id, the levels, n_tokens and epoch.
    """
    domain = domain if domain is not None else F.lit("all")
    leaf = [F.col(id_col).alias("id"), domain.alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source")]
    counted = materialize(docs.select(*leaf, count_words(F.col(text_col)).alias("n_tokens")), "mix-counted")
    budgets = materialize(leaf_budgets(counted, weights, share, max_epochs), "mix-budgets")
    leaves = budgets.count()
    plan = materialize(leaf_cuts(counted, budgets, leaves, seed), "mix-plan")
    # The input travels as one column, so no name of its own can clash with one of the plan.
    own = F.struct(*[F.col(c) for c in docs.columns if c != "epoch"]) if keep_text else F.struct(F.col("id").alias(id_col), *LEVELS, "n_tokens")
    chosen = with_plan(docs.select(own.alias("own"), *leaf) if keep_text else counted.select(own.alias("own"), "id", *LEVELS), plan, leaves)
    partly = order_key(seed, F.col("epochs") + 1, F.col("id")) < F.col("cut")
    copies = (F.col("epochs") + F.when(partly, 1).otherwise(0)).cast("int")
    taken = chosen.select("own", copies.alias("copies")).filter("copies > 0")
    return taken.select("own", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch")).select("own.*", "epoch")


#: Production parameters: parts by level, 4 tokens in 5 of what there is, at most 3 epochs.
WEIGHTS = {("domain", "a"): 3, ("domain", "b"): 1, ("lang", "en"): 4, ("lang", "de"): 2, ("lang", "fr"): 2, ("lang", "es"): 1}
SHARE, MAX_EPOCHS, SEED = (4, 5), 3, 17


def domain_of(source: Column) -> Column:
    """Sources fall into two domains by the first digit of their name's hash."""
    return F.when(F.substr(F.md5(F.coalesce(source, F.lit(""))), F.lit(1), F.lit(1)) < "8", "a").otherwise("b")


def op2_mixing(spark, sf_dir):
    """Mix all documents to the production weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, WEIGHTS, SHARE, MAX_EPOCHS, SEED, domain=domain_of(F.col("source")), keep_text=False)


ORACLE = r"""
WITH counted AS (
  SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'a' ELSE 'b' END AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 3)::BIGINT AS capacity FROM counted GROUP BY ALL),
total AS (SELECT (sum(tokens) * 4 // 5)::BIGINT AS parent_budget FROM leaves),
d0 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, CASE domain WHEN 'a' THEN 3 ELSE 1 END AS weight, any_value(parent_budget) AS pb
       FROM leaves, total GROUP BY domain),
d1 AS (SELECT *, capacity * sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= weight * (pb - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS ful FROM d0),
d2 AS (SELECT domain, CASE WHEN ful THEN capacity ELSE (weight * (pb - coalesce(sum(capacity) FILTER (ful) OVER (), 0))) // (sum(weight) FILTER (NOT ful) OVER ()) END::BIGINT AS budget FROM d1),
l0 AS (SELECT domain, lang, sum(capacity)::BIGINT AS capacity, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, any_value(budget) AS pb
       FROM leaves JOIN d2 USING (domain) GROUP BY domain, lang),
l1 AS (SELECT *, capacity * sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= weight * (pb - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS ful FROM l0),
l2 AS (SELECT domain, lang, CASE WHEN ful THEN capacity ELSE (weight * (pb - coalesce(sum(capacity) FILTER (ful) OVER (PARTITION BY domain), 0))) // (sum(weight) FILTER (NOT ful) OVER (PARTITION BY domain)) END::BIGINT AS budget FROM l1),
s0 AS (SELECT domain, lang, source, tokens, capacity, 1 AS weight, budget AS pb FROM leaves JOIN l2 USING (domain, lang)),
s1 AS (SELECT *, capacity * sum(weight) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= weight * (pb - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS ful FROM s0),
s2 AS (SELECT domain, lang, source, tokens, CASE WHEN ful THEN capacity ELSE (weight * (pb - coalesce(sum(capacity) FILTER (ful) OVER (PARTITION BY domain, lang), 0))) // (sum(weight) FILTER (NOT ful) OVER (PARTITION BY domain, lang)) END::BIGINT AS budget FROM s1),
plan AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM s2 WHERE tokens > 0),
keyed AS (SELECT c.*, p.epochs, p.rest, md5('17:' || (p.epochs + 1)::VARCHAR || ':' || c.doc_id::VARCHAR) AS key
          FROM counted c JOIN plan p USING (domain, lang, source)),
ran AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS run FROM keyed),
copied AS (SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END)::INT AS copies FROM ran)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, copies + 1))::INT AS epoch FROM copied WHERE copies > 0
"""
