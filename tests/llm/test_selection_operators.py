"""Mixing, quality classifier, near duplicates, decontamination, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from procweave.llm import decontam, minhash, mixing, quality

LONG = "one two three four five six seven eight nine ten " * 8000


def sentence(rng, n, words=2000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# Mixing


def share_out(children, budget):
    """Water filling by brute force: name -> (capacity, weight)."""
    given, left = {}, dict(children)
    while left:
        total = sum(w for _, w in left.values())
        full = [n for n, (c, w) in left.items() if c * total <= w * budget]
        if not full:
            given |= {n: w * budget // total for n, (c, w) in left.items()}
            break
        name = min(full, key=lambda n: (left[n][0] / left[n][1], n))
        given[name] = left[name][0]
        budget -= left.pop(name)[0]
    return given


def mixed_by_hand(docs, weights, share, epochs, seed):
    """docs: (id, text, lang, source, domain)."""
    weight = lambda level, name: weights.get((level, name), 1)
    tokens = {}
    for _, text, lang, source, domain in docs:
        tokens[(domain, lang, source)] = tokens.get((domain, lang, source), 0) + len(re.findall(r"[^ \t-\r]+", text or ""))
    budget = sum(tokens.values()) * share[0] // share[1]
    key = lambda x: (x is not None, x)
    budgets = {}
    domains = share_out({key(d): (epochs * sum(t for k, t in tokens.items() if k[0] == d), weight("domain", d)) for d in {k[0] for k in tokens}}, budget)
    for (_, d), b in domains.items():
        langs = share_out({key(x): (epochs * sum(t for k, t in tokens.items() if k[:2] == (d, x)), weight("lang", x)) for x in {k[1] for k in tokens if k[0] == d}}, b)
        for (_, x), c in langs.items():
            leaves = share_out({key(s): (epochs * tokens[(d, x, s)], weight("source", s)) for s in {k[2] for k in tokens if k[:2] == (d, x)}}, c)
            budgets |= {(d, x, s): e for (_, s), e in leaves.items()}
    out = []
    for leaf, b in budgets.items():
        if not tokens[leaf]:
            continue
        whole, rest = divmod(b, tokens[leaf])
        mine = [(i, len(re.findall(r"[^ \t-\r]+", t or ""))) for i, t, x, s, d in docs if (d, x, s) == leaf]
        out += [(i, e) for i, _ in mine for e in range(1, whole + 1)]
        order, run = {}, 0
        for i, n in mine:
            h = hashlib.md5(f"{seed}:{whole + 1}:{'' if i is None else i}".encode()).hexdigest()
            order.setdefault(h, []).append((i, n))
        for h in sorted(order):
            run += sum(n for _, n in order[h])
            if rest == 0 or run > rest:
                break
            out += [(i, whole + 1) for i, _ in order[h]]
    return sorted(out, key=str)


@pytest.mark.parametrize(("share", "epochs"), [((4, 5), 3), ((2, 1), 2), ((1, 100), 1), ((5, 1), 2)])
def test_mixing_agrees_with_brute_force(spark, share, epochs):
    rng = random.Random(4)
    docs = []
    for i in range(300):
        source = rng.choice(["big", "big", "big", "small", None, f"s{rng.randrange(4)}"])
        docs.append((i, sentence(rng, rng.randrange(0, 40)) or None, rng.choice(["en", "en", "de", None]), source, rng.choice("ab")))
    docs += [docs[7], (None, "x y z", "en", "big", "a"), (400, "", "fr", "empty", "a"), (401, None, "fr", "empty", "a")]
    df = spark.createDataFrame([(*d, 9, 8) for d in docs], "doc_id long, text string, lang string, source string, d string, epoch int, cut int")
    from pyspark.sql import functions as F

    weights = {("domain", "a"): 3, ("lang", "en"): 4, ("source", "small"): 5}
    want = mixed_by_hand(docs, weights, share, epochs, 11)
    for keep in (True, False):
        got = mixing.mix(df, weights, share, epochs, 11, domain=F.col("d"), keep_text=keep)
        assert sorted(((r["doc_id"], r["epoch"]) for r in got.collect()), key=str) == want
        if keep:
            assert set(got.columns) == set(df.columns) and {r["cut"] for r in got.collect()} <= {8}


def test_mixing_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(df, {}).collect() == []


# Quality


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.op5_quality_classifier(spark, folder).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) >= 0.97


def test_quality_of_odd_rows(spark):
    good = [(i, f"calm words of text number {i} and more", "x") for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! " * (3 + i % 4), "x") for i in range(60)]
    odd = [(None, None, "x"), (900, "", "x"), (901, LONG, "x"), (1, "another text of one id", "x"), (1, "another text of one id", "x")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(3, None), (3, 1), (None, 1), (77, 5)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score_docs(docs, model).collect()
    assert len(got) == len(good + bad + odd) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["text"].islower()) for r in got if r["text"] and r["doc_id"] is not None and r["doc_id"] < 200)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_quality_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_docs(docs, quality.train(docs, none)).first()["score"] == pytest.approx(0.5)
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score_docs(docs, quality.train(docs, ones)).first()["score"] > 0.9
    assert quality.score_docs(docs.limit(0), quality.train(docs.limit(0), ones)).collect() == []


def bins_by_hand(text):
    """Bins of the distinct byte n-grams and of the patterns of repeated words, one by one."""
    data, out = text.encode(), set()
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            code = (int.from_bytes(data[i : i + n], "big") + (n << 29)) % 2**32
            out.add((code * 2654435761 % 2**32) >> 16)
    words = text.split()
    same = [a == b for a, b in zip(words, words[1:], strict=False)]
    for i in range(len(same) - 3):
        out.add((1 << 16) + sum(same[i + j] << j for j in range(4)))
    return out


def test_model_and_scores_agree_with_brute_force(monkeypatch):
    """Features, ratios, the fitted optimum (by projected gradient on the whole dual problem) and scores, all by hand."""
    monkeypatch.setattr(quality, "PASSES", 5000)
    rng = random.Random(11)
    texts = [sentence(rng, rng.randrange(3, 12), 40) for _ in range(20)] + [" ".join([rng.choice(["buy", "now", "buy buy"])] * rng.randrange(3, 9)) + f" {i}" for i in range(20)]
    labels = np.array([1] * 20 + [0] * 20)
    flip = rng.sample(range(40), 4)
    labels[flip] = 1 - labels[flip]
    rows = [quality.features(t) for t in texts]
    assert [set(r.tolist()) for r in rows] == [bins_by_hand(t) for t in texts]
    counts = [{}, {}]
    for t, y in zip(texts, labels, strict=True):
        for b in bins_by_hand(t):
            counts[y][b] = counts[y].get(b, 0) + 1
    total = [sum(c.values()) + quality.BINS for c in counts]
    ratio = np.array([np.log(((counts[1].get(b, 0) + 1) / total[1]) / ((counts[0].get(b, 0) + 1) / total[0])) for b in range(quality.BINS)])
    assert np.allclose(quality.count_ratios(rows, labels), ratio)
    x = np.zeros((40, quality.BINS + 1))
    for i, t in enumerate(texts):
        own = sorted(bins_by_hand(t))
        x[i, own] = ratio[own] / np.sqrt((ratio[own] ** 2).sum())
        x[i, -1] = 1
    sign = 2 * labels - 1
    gram = (x @ x.T) * np.outer(sign, sign)
    most = quality.COST * 40 / (2 * np.bincount(labels))[labels]
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, most)
    weight = x.T @ (alpha * sign)
    found, bias = quality.descend(rows, ratio, labels)
    model = quality.Model(ratio, found, bias, 1.7, -0.2)
    for i, t in enumerate(texts):
        margin = float(x[i] @ weight)
        assert abs(model.margin(rows[i]) - margin) < 2e-2
        assert abs(model.score(t) - 1 / (1 + np.exp(-(1.7 * margin - 0.2)))) < 1e-2


def test_descent_reaches_the_optimum():
    """The duality gap of the fitted hinge-loss model is small."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(200, 20, replace=False)) for _ in range(80)]
    labels = np.array([int(r[0] < 8) for r in rows])
    ratio = quality.count_ratios(rows, labels)
    passes, quality.PASSES = quality.PASSES, 2000
    try:
        weight, bias = quality.descend(rows, ratio, labels)
    finally:
        quality.PASSES = passes
    cost = quality.COST * len(labels) / (2 * np.bincount(labels))[labels]

    def objective(w, b):
        loss = 0.0
        for r, y, c in zip(rows, labels, cost, strict=True):
            x = ratio[r] / np.linalg.norm(ratio[r])
            loss += c * max(0.0, 1 - (2 * y - 1) * (w[r] @ x + b))
        return 0.5 * (w @ w + b * b) + loss

    best = objective(weight, bias)
    for _ in range(200):
        w, b = weight + rng.normal(size=weight.size) * 0.01 * (weight != 0), bias + rng.normal() * 0.01
        assert objective(w, b) >= best - 1e-2


# Near duplicates


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) or (frozenset([tuple(words)]) if words else frozenset())


def components(docs):
    """doc_id -> (set size, component) by brute force over all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def near(spark, docs):
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, rep int"), size=minhash.OP7_SHINGLE)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str), got


def test_near_duplicates_agree_with_brute_force(spark):
    rng = random.Random(8)
    docs, n = [], 0
    for _ in range(12):
        base = sentence(rng, rng.choice([6, 30, 120])).split()
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = "x"
            docs.append((n, " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
            n += 1
    docs += [(500, None), (501, ""), (502, " \t "), (503, "A b"), (504, "a  B"), (505, "a b c d"), (506, "Ä b"), (507, "ä b"), (508, LONG), (509, LONG + " end"), (510, "a b c")]
    rng.shuffle(docs)
    want = sorted(components(docs), key=str)
    got, df = near(spark, docs)
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in df.collect())


def test_near_duplicates_in_chains(spark, monkeypatch):
    """Texts of which only neighbours are alike, in an order that hides it, make one component."""
    words = [f"w{i}" for i in range(400)]
    docs = [((i * 37) % 101, " ".join(words[i * 2 : i * 2 + 60])) for i in range(101)]
    got, _ = near(spark, docs)
    assert got == sorted(components(docs), key=str)
    assert {c for _, _, c in got} == {0}


def test_many_unlike_texts_that_share_bands(spark, monkeypatch):
    """Copies of one base that are alike to it but hardly to each other: the blocks decide, in several pieces."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = sentence(rng, 120).split()
    docs = []
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(120), 5):
            copy[at] = f"n{i}-{at}"
        docs.append((i, " ".join(copy)))
    for small in (256, 4):
        monkeypatch.setattr(minhash, "SMALL_BAND", small)
        monkeypatch.setattr(minhash, "BLOCKS_AT_ONCE", 2)
        got, _ = near(spark, docs)
        assert got == sorted(components(docs), key=str)


def test_long_texts_in_pieces(monkeypatch):
    """A text in pieces, words cut by them, has the set and the digests that it has at once."""
    rng = random.Random(7)
    texts = [sentence(rng, 900) + " " * 40 + "x" * 300 + "\tÄÖ " + sentence(rng, 40).upper(), "y" * 1000, "z" * 64, "a b", " " * 500, "A" * 31 + " " + "b" * 33]
    for size in (1, 4, 5):
        whole = [minhash.sign_batch([t.encode()], size) for t in texts]
        sets = [minhash.shingle_sets([t], size)[0].tolist() for t in texts]
        monkeypatch.setattr(minhash, "RUN_BYTES", 0)
        monkeypatch.setattr(minhash, "PIECE", 32)
        for t, one, held in zip(texts, whole, sets, strict=True):
            assert minhash.shingle_sets([t], size)[0].tolist() == held
            again = minhash.sign_batch([t.encode()], size)
            assert all(np.array_equal(np.asarray(one[c][0]), np.asarray(again[c][0])) for c in one)
        monkeypatch.undo()


def test_a_very_long_text_takes_little_memory():
    """200 MB of one text (33,333,334 words): the worker's peak stays under 1.5 GB, the text itself included."""
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run(
        [sys.executable, "-c", "import resource, numpy as np\nfrom procweave.llm import minhash\ndata = np.random.default_rng(1).integers(97, 123, 200_000_000, dtype=np.uint8)\ndata[::6] = 32\nmade = minhash.sign_batch([memoryview(data)])\nprint(int(made['n_shingles'][0]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"],
        cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True,
    )
    shingles, peak = map(int, said.stdout.split())
    assert shingles == 33_333_330 and peak < 1500


def test_near_duplicates_with_null_and_repeated_ids(spark):
    docs = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (2, "a b c d e"), (7, "p q r s t"), (7, "p q r s t"), (8, "p q r s t"), (9, None), (9, "p q r s t")]
    got, df = near(spark, docs)
    assert [c for i, _, c in got if i is None] == [None, None]
    assert {(i, c) for i, _, c in got if i is not None} == {(3, 2), (2, 2), (7, 7), (8, 7), (9, 7)} | {(9, 9)}
    kept = minhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["None", "None", "2", "7", "7"])


def test_stage_takes_shingles_of_five_words(spark):
    """Alike by four words (897 of 1,097), not by five (871 of 1,121): op7 links them, the stage keeps both."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(1000)]
    few, many = list(words), list(words)
    few[20::100] = [f"y{i}" for i in range(10)]
    many[20::40] = [f"x{i}" for i in range(25)]
    docs = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate((words, many, few))], "doc_id long, text string")
    by_five = [{tuple(w[i : i + 5]) for i in range(996)} for w in (words, many, few)]
    alike = {(i, j) for i in range(3) for j in range(i) if 100 * len(by_five[i] & by_five[j]) >= 80 * len(by_five[i] | by_five[j])}
    assert alike == {(2, 0)}
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()) == [0, 1]
    assert {r["component_id"] for r in minhash.near_duplicates(docs, size=minhash.OP7_SHINGLE).collect()} == {0}
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(docs).collect()) == [0, 1]


def test_no_near_duplicates_in_nothing(spark):
    assert near(spark, [])[0] == []
    assert near(spark, [(1, "")])[0] == [(1, 0, 1)]


def test_estimates_are_close():
    rng = random.Random(1)
    base = sentence(rng, 3000, 10**6).split()
    other = list(base)
    for at in rng.sample(range(3000), 150):
        other[at] = "x"
    texts = [" ".join(base), " ".join(other)]
    sets, bounds = minhash.shingle_sets(texts, minhash.OP7_SHINGLE)
    least = minhash.minima(sets, bounds[:-1])
    sig = minhash.signatures(least).view(np.uint64)
    words = minhash.HASHES // 64
    differ = (sig[0, :words] ^ sig[1, :words]) | (sig[0, words:] ^ sig[1, words:])
    agree = 1 - np.bitwise_count(differ).sum() / minhash.HASHES
    a, b = (set(sets[s:e].tolist()) for s, e in zip(bounds[:-1], bounds[1:], strict=True))
    assert abs((agree - 0.25) / 0.75 - len(a & b) / len(a | b)) < 0.12
    assert (bounds[1], bounds[2] - bounds[1]) == (len(shingles(texts[0])), len(shingles(texts[1])))


# Decontamination


def leaks_by_hand(docs, items):
    """Items whose question and answer n-grams stand in the text in large part, over the whole text; short items stand whole."""
    out = set()
    for i, text in docs:
        words = decontam.words_of(text or "")
        held = {n: decontam.grams(words, n) for n in range(1, 5)}
        for item, question, answer in items:
            q, a = decontam.words_of(question), decontam.words_of(answer)
            if not q and not a:
                continue
            short = len(q) + len(a) < 5

            def share(part, short=short, held=held):
                n = len(part) if short else min(3, len(part))
                wanted = decontam.grams(part, n) if part else set()
                return len(wanted & held[n]) / len(wanted) if wanted else 1.0

            if share(q) >= 0.5 and share(a) >= 0.5:
                out.add((i, item))
    return out


def test_leaks_agree_with_brute_force(spark):
    rng = random.Random(3)
    items = [(n, sentence(rng, rng.choice([8, 30, 90]), 400), sentence(rng, 6, 400) if n % 2 else "") for n in range(40)]
    docs = []
    for i in range(200):
        words = sentence(rng, rng.randrange(0, 300), 400).split()
        if i % 4 == 0:
            _, q, a = items[rng.randrange(40)]
            at = rng.randrange(len(words) + 1)
            planted = (q + " " + a).split()
            words[at:at] = [w.upper() + "," for w in planted]
        docs.append((i, " ".join(words)))
    docs += [(900, None), (901, ""), (902, LONG), (903, LONG + items[5][1] + " " + items[5][2])]
    df = spark.createDataFrame([(i, t, "old") for i, t in docs], "doc_id long, text string, leaks string")
    got = {(r["doc_id"], x["item_id"]) for r in decontam.mark_leaks(df, items).collect() for x in r["leaks"]}
    assert got == leaks_by_hand(docs, items)
    kept = decontam.drop_leaks(df, items)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_block_bounds_lose_nothing():
    """What the bounds let through is all that scoring everything finds."""
    rng = random.Random(6)
    items = [(n, sentence(rng, 30, 300), "") for n in range(60)]
    index = decontam.BlockMaxIndex(items)
    texts = [sentence(rng, 80, 300) + " " + " ".join(items[n][1].split()[: 10 + n % 20]) for n in range(60)]
    ids = [np.array([index.vocabulary.get(w, -1) for w in decontam.words_of(t)]) for t in texts]
    got = {(t, p, e) for t, p, e, _ in index.retrieve(ids)}
    want = set()
    for t, x in enumerate(ids):
        for p in range(-(-len(x) // decontam.STEP) + 1):
            terms = {int(i) for i in x[p * decontam.STEP : p * decontam.STEP + decontam.PASSAGE] if i >= 0}
            score = np.zeros(len(index.owner))
            for term in terms:
                s, e = index.starts[term], index.starts[term + 1]
                score[index.entry[s:e]] += index.impact[s:e]
            want |= {(t, p, int(e)) for e in np.flatnonzero(score >= decontam.LEAST_SCORE)}
    assert got == want and got


def test_short_items_are_found_where_they_stand_whole(spark):
    items = [(1, "Is it hot?", "Yes."), (2, "zebra", ""), (3, "one two", "three four"), (4, "Is it cold?", "No.")]
    docs = [(1, "they asked: is it hot? yes, said he"), (2, "is it not hot? yes"), (3, "a ZEBRA, seen"), (4, "three four one two"), (5, "is it cold yes"), (6, "zebras"), (7, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], x["item_id"]) for r in decontam.mark_leaks(df, items).collect() for x in r["leaks"]}
    assert got == leaks_by_hand(docs, items) == {(1, 1), (3, 2), (4, 3)}


def test_many_items_in_many_indexes_and_passes(spark, monkeypatch):
    """100,000 items in more indexes than one pass looks up: as from one index, and as by hand."""
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1_500_000)
    monkeypatch.setattr(decontam, "PASS_INDEXES", 2)
    rng = random.Random(12)
    items = [(n, sentence(rng, 7, 30_000), "") for n in range(100_000)]
    assert len(list(decontam.index_parts(items))) > 2
    docs = [(n, sentence(rng, 40, 30_000) + " " + items[n * 4999][1] + " " + sentence(rng, 40, 30_000)) for n in range(20)] + [(99, None)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in docs], "doc_id long, text string, own string")
    got = decontam.mark_leaks(df, items).collect()
    assert {(r["doc_id"], x["item_id"]) for r in got for x in r["leaks"]} == leaks_by_hand(docs, items) and {r["own"] for r in got} == {"kept"}


def test_walk_retrieves_all_at_or_above_the_threshold():
    rng = random.Random(2)
    for _ in range(300):
        post = sorted({(rng.randrange(6), rng.randrange(16)) for _ in range(rng.randrange(1, 40))})
        impacts = [rng.random() / 3 for _ in post]
        score = {}
        for (_, entry), impact in zip(post, impacts, strict=True):
            score[entry] = score.get(entry, 0) + impact
        got = dict(decontam.walk([t for t, _ in post], [e for _, e in post], impacts))
        assert sorted(got) == sorted(e for e, x in score.items() if x >= decontam.LEAST_SCORE)
        assert all(abs(got[e] - score[e]) < 1e-9 for e in got)


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.drop_leaks(docs, decontam.load_items(items)).count() == 2
    some = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "a b c d e f"), (4, "a b c d e f")], "item_id long, text string")
    assert [r["leaks"] and [x["item_id"] for x in r["leaks"]] for r in decontam.mark_leaks(docs, decontam.load_items(some)).orderBy("doc_id").collect()] == [[3, 4, 4], []]
    assert decontam.mark_leaks(docs.limit(0), decontam.load_items(some)).collect() == []


# Pipeline


def pipeline_by_hand(spark, small_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    scored = {r["doc_id"]: r["predicted"] for r in quality.op5_quality_classifier(spark, small_dir).collect()}
    good = [(i, rows[i]["text"]) for i in sorted(rows) if scored[i] == 1]
    firsts = {i for i, _, c in components(good) if i == c}
    items = decontam.load_items(spark.read.parquet(f"{small_dir}/benchmark.parquet"))
    leaked = {i for i, _ in leaks_by_hand([(i, t) for i, t in good if i in firsts], items)}
    left = [rows[i] for i in sorted(firsts - leaked)]
    domain = lambda s: "a" if hashlib.md5((s or "").encode()).hexdigest()[0] < "8" else "b"
    want = mixed_by_hand([(r["doc_id"], r["text"], r["lang"], r["source"], domain(r["source"])) for r in left], mixing.WEIGHTS, mixing.SHARE, mixing.MAX_EPOCHS, mixing.SEED)
    got = corpus_pipeline.run(spark, small_dir)
    assert got.columns == [*docs.columns, "epoch"]
    assert sorted(((r["doc_id"], r["epoch"]) for r in got.collect()), key=str) == want
    assert len(corpus_pipeline.STAGES) == 4


def test_pipeline_agrees_with_its_stages_at_five_words(spark, small_dir, monkeypatch):
    """The whole comparison by hand, with near duplicates by shingles of five words."""

    def by_five(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())

    monkeypatch.setitem(globals(), "shingles", by_five)
    pipeline_by_hand(spark, small_dir)


def test_pipeline_stages_take_odd_rows(spark, small_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-2, LONG, None, "src0", 1), (-2, LONG, None, "src0", 1)], docs.schema)
    for start in (docs.unionByName(odd), docs.limit(0)):
        out = start
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, small_dir)
            assert n == 3 or out.columns == docs.columns
        out.count()
