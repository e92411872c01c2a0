"""Merkle manifest, hard negatives and language identification."""

from __future__ import annotations

import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procweave.llm import hard_negatives, language_id, merkle

ROOT = str(Path(__file__).resolve().parent.parent.parent)
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sql_rows(query, small_dir, *tables):
    connection = duckdb.connect()
    for name in tables:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    return connection.sql(query)


def comparable(frame):
    columns = sorted(frame.columns)
    return sorted(map(tuple, frame[columns].astype(str).values))


# Manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(row):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[1], row[2], row[3], row[4])))


def tree_by_hand(nodes, fan):
    """The peak, and for each node its steps (left, right)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // fan * fan
            steps[i].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + fan])))
        nodes = [sha(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        at = [place // fan for place in at]
    return nodes[0] if nodes else None, steps


def manifest_by_hand(docs, fan=2):
    groups = {}
    for row in docs:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    out, peaks = [], []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(r)))
        peak, steps = tree_by_hand([leaf_by_hand(r) for r in own], fan)
        peaks.append(peak)
        out.append((own, steps))
    root, above = tree_by_hand(peaks, fan)
    rows = []
    for (own, steps), peak, up in zip(out, peaks, above, strict=True):
        for r, s in zip(own, steps, strict=True):
            rows.append((r[0], leaf_by_hand(r), peak, root, s + up, r))
    return rows


def answer_by_hand(docs):
    out = []
    for doc_id, leaf, peak, root, steps, r in manifest_by_hand(docs):
        node = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r[3] is not None:
            node = leaf_by_hand((*r[:3], r[3] + 1, r[4]))
        for left, right in steps:
            node = sha(left, node, right)
        out.append((doc_id, leaf, peak, root, sha(*(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def odd_docs():
    rng = np.random.default_rng(3)
    docs = [(int(i), "s", ["en", "de", None, "é", "EN", "zz"][int(rng.integers(6))] if i % 3 else "en", int(rng.integers(90)) if i % 5 else None, f"tëxt {i} 💡" if i % 4 else None) for i in range(300)]
    docs += [(7, "s", "en", 5, "twice")] * 3 + [(None, None, None, None, None), (None, "a", "en", 1, ""), (9, "b", "alone", 2**63 - 1, "x"), (14, "", "", 0, "empty lang")]
    return docs + [(50, "s", "en", 1, "copy")] * 200


def written(spark, folder, docs):
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(docs, DOCS).withColumns({"node": F.lit(1), "grp": F.lit("x"), "pos": F.lit(None).cast("string"), "tie_row": F.lit(2)}).repartition(3).write.parquet(path)
    return str(folder)


def test_manifest_agrees_with_brute_force(spark, tmp_path):
    got = merkle.op11_merkle_manifest(spark, written(spark, tmp_path, odd_docs())).collect()
    assert sorted((tuple(r) for r in got), key=str) == answer_by_hand(odd_docs())


@pytest.mark.parametrize(("fan", "levels"), [(2, 2), (3, 2), (5, 1)])
def test_manifest_of_any_fan_in_several_stages(spark, fan, levels):
    docs = odd_docs()
    df = spark.createDataFrame(docs, DOCS)
    got = merkle.manifest(df, F.col("lang"), F.col("doc_id"), merkle.document_leaf(), "text", fan=fan, levels=levels).collect()
    want = [(k, leaf, r[4], peak, root, [tuple(s) for s in steps]) for k, leaf, peak, root, steps, r in manifest_by_hand(docs, fan)]
    assert sorted(((r["key"], r["leaf"], r["text"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]]) for r in got), key=str) == sorted(want, key=str)


def test_proofs_fold_to_the_root_and_show_changes(spark):
    df = spark.createDataFrame(odd_docs(), DOCS)
    rows = merkle.manifest(df, F.col("lang"), F.col("doc_id"), merkle.document_leaf())
    same, other = merkle.fold(F.col("leaf"), F.col("steps")), merkle.fold(F.sha2(F.lit("forged"), 256), F.col("steps"))
    assert [tuple(r) for r in rows.select((same == F.col("root")).alias("a"), (other == F.col("root")).alias("b")).distinct().collect()] == [(True, False)]


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    one = merkle.op11_merkle_manifest(spark, written(spark, tmp_path / "one", [(3, "s", "en", 1, "a")])).collect()
    assert [tuple(r) for r in one] == answer_by_hand([(3, "s", "en", 1, "a")])
    assert one[0]["leaf"] == one[0]["root"] and one[0]["proof_sha256"] == sha("")
    assert merkle.op11_merkle_manifest(spark, written(spark, tmp_path / "none", [])).collect() == []


def test_manifest_query_agrees_with_sql(spark, small_dir):
    got = merkle.op11_merkle_manifest(spark, small_dir).toPandas()
    assert comparable(got) == comparable(sql_rows(merkle.ORACLE, small_dir, "documents").df())
    assert not got.verified.all() and got.verified.any()


# Hard negatives


def mined_by_hand(rows, every=5, positives=5, negatives=10):
    """rows: (id, label, components)."""
    usable = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2])]
    dims = sorted({len(r[2]) for r in usable}, key=lambda d: (-sum(len(r[2]) == d for r in usable), d))
    kept = {}
    for r in usable:
        if len(r[2]) == dims[0]:
            kept[r[0]] = min(kept.get(r[0], r), r, key=lambda x: (x[1], x[2]))
    whole = {i: [int(np.floor(256 * float(x))) for x in r[2]] for i, r in kept.items()}
    out = []
    for a in (i for i in kept if i % every == 0):
        score = {i: sum(x * y for x, y in zip(whole[a], whole[i], strict=True)) for i in kept if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if kept[i][1] == kept[a][1]][:positives]:
            fits = [i for i in ranked if kept[i][1] != kept[a][1] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "shard": F.lit(2), "row": F.lit(3), "asks": F.lit(4)})
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **options).collect())


def cloud(n, dim, labels, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), [float(x) for x in rng.normal(size=dim) / 3]) for i in range(n)]


def test_hard_negatives_agree_with_brute_force_over_shards_and_blocks(spark):
    rows = cloud(300, 6, 4)
    rows += [(400 + i, 1, rows[7][2]) for i in range(60)]  # one vector that many rows repeat
    want = mined_by_hand(rows)
    assert len(want) > 500
    assert mined(spark, rows) == want
    assert mined(spark, rows, shard_rows=40, block_rows=20) == want


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(60, 3, 2, seed=4) + [(None, 1, [1.0, 1.0, 1.0]), (100, None, [1.0, 1.0, 1.0]), (101, 1, None), (102, 1, []), (103, 1, [1.0, None, 1.0]), (105, 0, [nan, 1.0, 1.0]), (110, 0, [inf, 1.0, 1.0])]
    rows += [(115, 1, [1.0, 2.0]), (120, 1, [0.0, 0.0, 0.0]), (5, 1, [0.5, 0.5, 0.5]), (5, 0, [0.5, 0.5, 0.25]), (125, 7, [0.1, 0.1, 0.1]), (-5, 1, [-0.2, 0.3, 0.001])]
    assert mined(spark, rows) == mined_by_hand(rows)
    assert mined(spark, [], shard_rows=3) == []


def test_hard_negatives_of_large_components_are_exact(spark):
    rows = [(i, label, [x * 2.0**22 for x in v]) for i, label, v in cloud(60, 3, 2, seed=5)]
    want = mined_by_hand(rows)
    assert max(abs(r[4]) for r in want) > 2**53
    assert mined(spark, rows) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.integers(1, 6))
def test_threshold_search_returns_each_windows_best(seed, dim, k):
    rng = np.random.default_rng(seed)
    points = rng.integers(-4, 5, size=(int(rng.integers(1, 200)), dim)).astype(float)
    ids = rng.permutation(len(points)).astype(np.int64)
    lists = hard_negatives.Lists(ids, np.zeros(len(points), dtype=np.int64), points)
    anchor, allowed = rng.integers(-3, 4, size=dim).astype(float), rng.random(len(points)) < 0.7
    positives = [int(x) for x in rng.integers(-5, 60, size=3)]
    found = lists.best(anchor, allowed, [hard_negatives.window_of(p) for p in positives] + [(hard_negatives.anything, hard_negatives.anything)], k)
    scores = points @ anchor
    for p, (got_ids, got) in zip([*positives, None], found, strict=True):
        fits = [(-s, i) for s, i, a in zip(scores, ids, allowed, strict=True) if a and (p is None or 30 * p <= 100 * s <= 90 * p)]
        assert [(-s, i) for s, i in zip(got, got_ids, strict=True)] == sorted(fits)[:k]


def test_threshold_search_stops_early(monkeypatch):
    """Where one dimension decides, few rows come up before the threshold falls below the k-th best."""
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(5000, 4)) * [1000, 1, 1, 1])
    lists = hard_negatives.Lists(np.arange(5000), np.zeros(5000, dtype=np.int64), points)
    scored = []
    monkeypatch.setattr(lists, "points", points.view(Counted))
    Counted.scored = scored
    lists.best(np.array([9.0, 1.0, -1.0, 0.0]), np.ones(5000, dtype=bool), [(hard_negatives.anything, hard_negatives.anything)], 5)
    assert 0 < sum(scored) < 500


class Counted(np.ndarray):
    """Points that tell how many whole rows were taken."""

    scored: list[int] = []

    def __getitem__(self, key):
        if isinstance(key, np.ndarray):
            self.scored.append(len(key))
        return np.asarray(super().__getitem__(key))


def test_hard_negative_query_agrees_with_sql(spark, small_dir):
    got = hard_negatives.op12_hard_negatives(spark, small_dir).toPandas()
    assert len(got) and comparable(got) == comparable(sql_rows(hard_negatives.ORACLE, small_dir, "embeddings").df())


# Languages


def grams_by_hand(text):
    low = "".join(c.lower() if (c.isascii() or "À" <= c <= "Þ") and c != "×" else c for c in text)
    out = b" "
    for b in "".join(c if not c.isascii() or c.isalpha() else " " for c in low).encode():
        out += bytes([b]) if b != 32 or out[-1] != 32 else b""
    out += b"" if out.endswith(b" ") else b" "
    total = np.zeros(language_id.BINS, dtype=np.int64)
    for n in range(1, language_id.LONGEST + 1):
        for i in range(len(out) - n + 1):
            if i + n - 1 >= 1:  # the first space alone is not counted
                code = int.from_bytes(out[i : i + n], "big") ^ (n * 0x9E3779B)
                total[((code * 2654435761) & 0xFFFFFFFF) >> 17] += 1
    return total


@pytest.mark.parametrize("piece", [1 << 20, 7, 1])
def test_counts_agree_with_brute_force(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    for text in ["", "a", " ", "Hello,   World!! 123 ÉÀé × ÷ Ünï", "  lead and trail  ", "ß", "日本語 text", "x" * 50, "a-b--c\n\n\td", "É" * 9]:
        got = language_id.counts(np.frombuffer(text.encode(), dtype=np.uint8))
        assert (got == grams_by_hand(text)).all(), text


def test_texts_come_straight_from_the_buffers():
    column = pa.array(["x", "ab", None, "", "é"])[1:]
    assert [None if t is None else t.tobytes().decode() for t in language_id.texts_of(column)] == ["ab", None, "", "é"]
    assert [None if t is None else t.tobytes() for t in language_id.texts_of(column.cast(pa.large_string()))] == [b"ab", None, b"", "é".encode()]
    assert list(language_id.texts_of(pa.array([], pa.string()))) == []


def test_descent_reaches_the_dual_optimum():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        bins = np.sort(rng.choice(40, 6, replace=False)) if i % 2 else np.sort(rng.choice(np.arange(10, 50), 6, replace=False))
        rows.append((bins.astype(np.int32), language_id.unit(rng.integers(1, 9, 6).astype(float))))
    sign = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    language_id.PASSES, passes = 2000, language_id.PASSES
    try:
        weight, bias = language_id.descend(rows, sign)
    finally:
        language_id.PASSES = passes
    dense = np.zeros((60, language_id.BINS + 1))
    for i, (bins, values) in enumerate(rows):
        dense[i, bins], dense[i, -1] = values, 1.0
    whole = np.append(weight, bias)
    loss = lambda w: w @ w / 2 + language_id.COST * np.maximum(0, 1 - sign * (dense @ w)).sum()
    least = loss(whole)
    for _ in range(300):
        assert least <= loss(whole + rng.normal(size=len(whole)) * (np.abs(dense).sum(axis=0) > 0) * rng.choice([1e-3, 1e-2, 0.1])) + 1e-2


WORDS = {"en": "the and of with house river", "de": "der und das mit haus fluss über", "nl": "het een van met huis rivier", "fr": "le la et avec maison fleuve été", "es": "el la y con casa río año", "xx": "qoz zuq qaz quz"}


def small_texts(n, seed):
    rng = np.random.default_rng(seed)
    names = sorted(WORDS)
    return [(i, " ".join(rng.choice(WORDS[names[i % 6]].split(), int(rng.integers(3, 30)))) + "! 1", names[i % 6]) for i in range(n)]


def test_families_first_then_pairs(spark):
    docs = spark.createDataFrame(small_texts(600, 1), "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.families == {"germanic": ["de", "en", "nl"], "of its own: xx": ["xx"], "romance": ["es", "fr"]}
    assert sorted(model.pairs) == [("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")]
    got = language_id.identify(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_agrees_with_a_plain_computation(spark):
    texts = small_texts(240, 2)
    model = language_id.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    for _, text, _ in texts[:60]:
        hits = grams_by_hand(text).astype(float)
        likely = {name: sum(h * model.likely[i, b] for b, h in enumerate(hits) if h) for i, name in enumerate(model.names)}
        own = model.families[max(likely, key=likely.get)]
        unit = np.sqrt(hits / hits.sum())
        votes = {x: 0 for x in own}
        for (one, two), pair in model.pairs.items():
            if one in own:
                votes[two if pair.weight @ unit + pair.bias > 0 else one] += 1
        top = {x for x in own if votes[x] == max(votes.values())}
        assert model.predict(grams_by_hand(text))[0] in top


def test_the_model_never_sees_the_held_out_fold(spark):
    """Texts of the held-out fold under other languages change nothing."""
    texts = small_texts(300, 3)
    wrong = [(i, t, "pt" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in texts]
    one, two = (language_id.train(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (texts, wrong))
    assert one.families == two.families and (one.likely == two.likely).all()


def test_language_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, own string, rank int, id int, said string, none int"
    texts = [(i, t, lang, "old", "own", 1, 2, "s", 3) for i, t, lang in small_texts(200, 4)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 !! --", "de"), (None, "the and of", "en"), (1003, "the and of", None), (5, "der und das", "de"), (5, "der und das", "de"), (1004, "日本", "en"), (1005, "the and of with " * 200_000, "en")]
    docs = spark.createDataFrame(texts + [(*x, "old", "own", 1, 2, "s", 3) for x in odd], schema)
    got = language_id.identify(docs, language_id.train(docs))
    assert got.columns == ["doc_id", "text", "lang", "own", "rank", "id", "said", "none", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(texts) + len(odd) and all(r["own"] == "own" and r["none"] == 3 for r in rows)
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert said[1000] == said[1001] == said[1002] == ("und", 0.0)
    assert said[None][0] == said[1003][0] == said[1005][0] == "en"


def test_language_of_nothing_or_from_one_language(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(none, language_id.train(none)).collect() == []
    some = spark.createDataFrame([(i, "le la", "fr") for i in range(9)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(some, language_id.train(some)).collect()} == {("fr", 1.0)}
    assert {r["lang_pred"] for r in language_id.identify(some, language_id.train(none)).collect()} == {"und"}


def test_language_query_on_held_out_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = language_id.op13_language_id(spark, small_dir).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_a_very_long_text_takes_little_memory_to_identify():
    """One text of 200 MB: the kernel reads it in place, piece by piece."""
    code = """
import resource, numpy as np, pyarrow as pa
from procweave.llm import language_id
text = pa.array(["the house and the river " * (200_000_000 // 24)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for data in language_id.texts_of(text):
    assert language_id.counts(data).sum() > 4 * 190_000_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[-1]) < 300_000
