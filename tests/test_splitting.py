"""Ranked splitting against a plain recursion."""

from __future__ import annotations

import random

import pytest

from procweave.operators import splitting


def merged(pieces, size, overlap):
    out, held, total = [], [], 0
    for p in pieces:
        if total + len(p) > size:
            if held:
                out.append("".join(held).strip())
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    return [c for c in [*out, "".join(held).strip()] if c]


def split_by_hand(text, size, overlap, separators):
    place = next((i for i, s in enumerate(separators) if s in text), len(separators))
    if place < len(separators):
        first, *rest = text.split(separators[place])
        pieces = [p for p in [first, *[separators[place] + r for r in rest]] if p]
    else:
        pieces = [text]
    out, good = [], []
    for p in pieces:
        if len(p) < size:
            good.append(p)
            continue
        out += merged(good, size, overlap) if good else []
        good = []
        out += split_by_hand(p, size, overlap, separators[place + 1 :]) if place + 1 < len(separators) else [p]
    return out + (merged(good, size, overlap) if good else [])


@pytest.mark.parametrize(("dialect", "size", "overlap"), [("tsql", 60, 20), ("tsql", 200, 0), ("oracle", 80, 30), ("oracle", 25, 24)])
def test_splits_agree_with_a_recursion(spark, dialect, size, overlap):
    rng = random.Random(size)
    separators = splitting.SEPARATORS[dialect]
    words = [*separators, "\n", "\n\n\n", "x", "word ", "SELECT 1", "a" * 30, "b" * 90, "  ", "\t", ";", "END"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["", None, "\n\n", "x" * 500, "  short  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = {}
    for r in splitting.split_ranked(df, ["id"], "text", size, overlap, separators).orderBy("id", "chunk").collect():
        got.setdefault(r["id"], []).append(r["content"])
        assert texts[r["id"]][r["begin"] : r["end"]].strip() == r["content"].strip()
    for i, text in enumerate(texts):
        want = split_by_hand(text, size, overlap, separators) if text else []
        assert got.get(i, []) == [c for c in want if c], repr(text)
