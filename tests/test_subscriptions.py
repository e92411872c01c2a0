"""Delivery to subscribers: order, numbers, end marks, late ones and restarts."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from procweave.streaming import subscriptions as s

MESSAGES = "run_id long, message_id long, kind string, subscriber long, text string, at timestamp"


def expected(batches: list[list[tuple]], replay: bool) -> list[tuple]:
    """The same by hand: one message after the other, over all runs. Who joins twice after the end gets two end marks."""
    out, open_, kept, ended = [], {}, {}, set()
    for batch in batches:
        for run, number, kind, who, text, _ in sorted((m for m in batch if m[0] is not None and m[1] is not None), key=lambda m: m[1]):
            here = open_.setdefault(run, {})
            if kind == "subscribe" and who is not None and who not in here:
                old = kept.get(run, []) if replay else []
                out += [(run, who, n, i, t, False) for n, (i, t) in enumerate(old)]
                if run in ended:
                    out.append((run, who, len(old), None, None, True))
                else:
                    here[who] = len(old)
            elif kind == "leave":
                here.pop(who, None)
            elif kind == "entry" and run not in ended:
                kept.setdefault(run, []).append((number, text))
                for w in here:
                    out.append((run, w, here[w], number, text, False))
                    here[w] += 1
            elif kind == "end" and run not in ended:
                out += [(run, w, n, None, None, True) for w, n in here.items()]
                ended.add(run)
                here.clear()
    return out


def streamed(spark, tmp_path, batches, **options):
    """Each batch arrives after the stream before it has ended: the stream starts again from its checkpoint."""
    for batch in batches:
        spark.createDataFrame(batch, MESSAGES.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(str(tmp_path / "in"))
        s.deliver(spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark"), **options)
    return [tuple(r) for r in s.inboxes(spark, str(tmp_path / "out")).collect()]


@pytest.mark.parametrize("replay", [False, True])
def test_every_subscriber_gets_each_entry_once_in_order(spark, tmp_path, replay):
    rng, batches, number = random.Random(7), [], 0
    for b in range(3):
        batch = []
        for _ in range(120):
            number += 1
            kind = rng.choices(["entry", "subscribe", "leave", "end", "noise"], [60, 15, 6, 2, 2])[0]
            who = rng.randrange(5) if kind in ("subscribe", "leave") else None
            batch.append((rng.randrange(4), number, kind, who, rng.choice([None, "", f"line {number}"]), f"2024-01-01 00:{b:02d}:00"))
        batch += [(None, number, "entry", None, "x", None), (1, None, "entry", None, "x", None), (1, number + 1, None, None, "x", None), (2, number + 2, "subscribe", None, None, None)]
        number += 2
        rng.shuffle(batch)
        batches.append(batch)
    got = streamed(spark, tmp_path, batches, replay=replay)
    assert Counter(got) == Counter(expected(batches, replay)) and len(got) > 100


def test_state_goes_after_the_end(spark, tmp_path):
    at = "2024-01-01 00:00:00"
    first = [(1, 1, "subscribe", 5, None, at), (1, 2, "entry", None, "a", at), (1, 3, "end", None, None, at)]
    second = [(1, 4, "subscribe", 6, None, "2024-01-01 00:00:10"), (2, 5, "entry", None, "b", "2024-01-01 02:00:00")]
    third = [(1, 6, "subscribe", 7, None, "2024-01-01 02:00:01"), (1, 7, "entry", None, "c", "2024-01-01 02:00:02")]
    got = streamed(spark, tmp_path, [first, second, third], replay=True, keep_ms=60_000)
    # Subscriber 6 comes while the end is remembered; 7 comes later and finds a new run of that number.
    assert sorted(got, key=str) == sorted([(1, 5, 0, 2, "a", False), (1, 5, 1, None, None, True), (1, 6, 0, 2, "a", False), (1, 6, 1, None, None, True), (1, 7, 0, 7, "c", False)], key=str)


def test_no_messages(spark, tmp_path):
    assert streamed(spark, tmp_path, [[]]) == []
