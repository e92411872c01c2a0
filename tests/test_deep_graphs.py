"""Levels of graphs: equal to a walk on random ones, in few rounds on deep ones."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from procweave.operators import graph


def by_hand(edges):
    callees = {}
    for src, dst in edges:
        callees.setdefault(src, set()).add(dst)
        callees.setdefault(dst, set())
    level, todo = {}, True
    while todo:
        todo = False
        for name, below in callees.items():
            if name not in level and all(b in level for b in below):
                level[name], todo = 1 + max((level[b] for b in below), default=-1), True
    return {name: level.get(name) for name in callees}


def levels(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string")
    rows = graph.levels(df, graph.nodes(df)).collect()
    assert len(rows) == len({r["name"] for r in rows})
    return {r["name"]: r["level"] for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(f"n{i:03d}", f"n{rng.randrange(i):03d}") for i in range(1, n) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
    if seed % 2:
        # Calls upwards make rings of several lengths, and there are self calls; some edges come twice.
        edges += [(f"n{rng.randrange(20):03d}", f"n{rng.randrange(20, n):03d}") for _ in range(3)] + [("n050", "n050"), ("m1", "m1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("above", "r2")]
    assert levels(spark, edges + edges[:5]) == by_hand(edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    cuts = []
    own = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or own(df))
    n = 3000
    chain = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(n)]
    got = levels(spark, [*chain, ("top", "c00000"), ("top", "other"), ("ring", "ring2"), ("ring2", "ring")])
    assert got["c00000"] == n and got[f"c{n:05d}"] == 0 and got["top"] == n + 1 and got["other"] == 0
    assert got["ring"] is None and got["ring2"] is None
    assert len(cuts) < 2 * math.log2(n) + 15


def test_a_plan_sends_no_names_through_the_driver(spark, monkeypatch):
    """No join is broadcast unless its rows are counted and few, and rings take no more rounds than chains."""
    seen, rounds = [], []
    own, own_kept = graph.cut, getattr(graph, "kept", None)
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(df) or own(df))
    monkeypatch.setattr(graph, "kept", lambda df, label: seen.append(df) or rounds.append(1) or own_kept(df, label), raising=False)
    monkeypatch.setattr(graph, "FEW_NAMES", -1, raising=False)
    tree = [(f"p{k}", f"p{k // 2}") for k in range(1, 30)]
    edges = tree + [(f"ring{s}_{i}", f"ring{s}_{(i + 1) % 3}") for s in range(100) for i in range(3)] + [("p30", "ring0_1"), ("p31", "p30"), ("p32", "p32"), ("p33", "p32"), ("p33", "p1")]
    df = spark.createDataFrame(edges, "src string, dst string")
    rows = graph.plan(df, df.select(F.col("src").alias("name")))
    got = {r["name"]: (r["level"], r["external"], r["cyclic"]) for r in rows.collect()}
    want = by_hand(edges)
    assert got == {n: (want[n], n == "p0", n.startswith("ring") or n == "p32") for n in want}
    plans = [d._jdf.queryExecution() for d in [*seen, rows]]
    assert not [p for p in plans if "BroadcastExchange" in p.executedPlan().toString()]
    # Two tables a round over chains of four calls.
    assert 0 < len(rounds) <= 8


def test_rounds_over_a_long_chain_keep_estimates_small(spark):
    """Joins multiply the estimates of their sides; carried on from round to round, these would have as many digits as the chain has names."""
    n = 300
    found = graph.chains(spark.createDataFrame([(f"c{i:03d}", f"c{i + 1:03d}") for i in range(n)], "src string, dst string"))
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 300
    assert {r["name"]: r["distance"] for r in found.collect()} == {f"c{i:03d}": n - i for i in range(n)}
