"""Archive conversion and vector search."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import zlib

import numpy as np
import pytest

from procweave.llm import arc_convert as arc
from procweave.llm import shared, vp_search

# Archives


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected_records(pages, least=0):
    groups = {}
    for key, html in pages:
        if key is not None:
            data = (html or "").encode()
            groups.setdefault(data, []).append(key)
    out = []
    for key, html in pages:
        data = (html or "").encode()
        first = min(groups.get(data, []), default=None)
        revisit = len(data) >= least and first is not None and key != first
        out.append((key, len(data), digest(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


PAGES = [
    (5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, "same"), (3, "http://c d/", ""), (1, "", None), (7, "x", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"), (8, "x", "ü\n" * 1000),
    (10, "http://e/", "a 0.0.0.0 20000101000000 text/html 99999\n"), (None, "http://n/", "same"), (None, "http://n/", "alone"), (4, "http://d/", "z" * 3_000_000), (2, "http://b/", "same"),
]


def convert(spark, pages, least=0):
    df = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, url string, html string, payload string")
    path = shared.fresh_path(spark, "test-warc")
    arc.convert(arc.to_arc(df), path, least)
    return path, arc.read_warc(spark, path)


def test_records_come_back_as_expected(spark, monkeypatch):
    _, got = convert(spark, PAGES)
    found = got.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == expected_records([(k, h) for k, _, h in PAGES])
    payloads = {r["key"]: bytes(r["payload"]) for r in got.filter("record_type = 'response' and key is not null").collect()}
    assert payloads[7] == PAGES[5][2].encode() and payloads[8] == PAGES[6][2].encode() and payloads[4] == PAGES[10][2].encode()


def test_small_payloads_stay_responses(spark):
    _, got = convert(spark, PAGES, least=5)
    found = got.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == expected_records([(k, h) for k, _, h in PAGES], 5)


def test_no_pages(spark):
    _, got = convert(spark, [])
    assert got.collect() == []


def members(data):
    """The gzip members of a file, each by itself."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        assert one.eof
        data = one.unused_data
    return out


def test_written_archives_are_well_formed(spark, monkeypatch):
    monkeypatch.setattr(arc, "ARCHIVE_BYTES", 2000)
    path, got = convert(spark, PAGES)
    folder = path.removeprefix("file://").removeprefix("file:")
    records, ids, refers = 0, set(), set()
    for name in os.listdir(folder):
        if name.startswith("part-"):
            with open(os.path.join(folder, name), "rb") as file:
                data = file.read()
            whole = members(data)
            assert b"".join(whole) == gzip.decompress(data)
            first, *others = [m for m in whole if m]
            assert b"WARC-Type: warcinfo" in first
            for one in others:
                ((head, block),) = arc.parse_warc(one)
                records += 1
                assert head.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
                assert arc.head_value(head, b"WARC-Block-Digest").decode() == "sha1:" + digest(block)
                assert arc.head_value(head, b"WARC-Date")[-1:] == b"Z"
                ids.add(arc.head_value(head, b"WARC-Record-ID"))
                refers |= {arc.head_value(head, b"WARC-Refers-To")} - {None}
    assert records == len(ids) == len(PAGES)
    assert refers and refers <= ids
    by_id = {r["record_id"]: r for r in got.collect()}
    assert all(by_id[r["refers_to_id"]]["key"] == r["refers_to"] for r in by_id.values() if r["record_type"] == "revisit")


def legacy(version, *records):
    """An archive of hand-written header lines (ending in the length) and blocks."""
    return arc.arc_head(version, "x.arc") + b"".join(f"{line} {len(block)}\n".encode() + block + b"\n" for line, block in records)


def test_spaces_in_header_fields_lose_nothing():
    one = legacy("1", ("http://a/ 1.2.3.4 20010101000000 text/html", b"one"), ("http://b/x y 1.2.3.4 20010101000000 text/html; charset=utf-8", b"two"), ("http://c/ 1.2.3.4 20010101000000", b"three"), ("dns:d - 20010101000000 text/plain", b""))
    found = list(arc.parse_arc(one))
    assert [(r.fields["url"], r.fields["mime"], r.block) for r in found] == [("http://a/", "text/html", b"one"), ("http://b/x y", "text/html; charset=utf-8", b"two"), ("http://c/", "", b"three"), ("dns:d", "text/plain", b"")]
    two = legacy("2", ("http://a/ 1.2.3.4 20010101000000 text/html; charset=x 200 ABC http://a/ b 17 x.arc", b"one"), ("http://b/ 1.2.3.4 20010101000000 text/html - - - 0 -", b"two"))
    found = list(arc.parse_arc(two))
    assert [(r.fields["mime"], r.fields["status"], r.fields["location"], r.block) for r in found] == [("text/html; charset=x", "200", "http://a/ b", b"one"), ("text/html", "-", "-", b"two")]


@pytest.mark.parametrize("version", ["1", "2"])
def test_reading_goes_on_after_a_broken_record(version):
    rest = "" if version == "1" else " 200 - - 0 -"
    good = [(f"http://{c}/ 1.2.3.4 20010101000000 text/html{rest}", c.encode() * 50) for c in "abc"]
    whole = legacy(version, *good)
    blocks = [b for _, b in good]
    assert [r.block for r in arc.parse_arc(whole)] == blocks
    garbled = whole.replace(b"http://b/ 1.2.3.4 2001", b"http://b/ \xff 2oo1")
    assert [r and r.block for r in arc.parse_arc(garbled)] == [blocks[0], None, blocks[2]]
    too_long = whole.replace(b" 50\nbbb", b" 5000\nbbb")
    assert [r and r.block for r in arc.parse_arc(too_long)] == [blocks[0], None, blocks[2]]
    short = whole.replace(b" 50\nbbb", b" 20\nbbb")
    assert [r and len(r.block) for r in arc.parse_arc(short)] == [50, 20, None, 50]
    headless = whole.split(b"\n", 3)[-1]
    assert [r and r.block for r in arc.parse_arc(headless)][-3:] == blocks


def test_legacy_files_without_our_keys(spark, tmp_path):
    """Files as others wrote them, plain and gzipped: identifiers follow from archive and place, and nothing is lost."""
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nsame body"
    plain = legacy("1", ("http://a/ 1.2.3.4 20010101000000 text/html", block), ("http://a/ 1.2.3.4 20010101000000 text/html", block), ("http://b/ 1.2.3.4 20010101000000 text/plain", b"no head"))
    (tmp_path / "one.arc").write_bytes(plain)
    packed = legacy("2", ("http://c/ 1.2.3.4 20010101000000 text/html 200 - - 0 -", block), ("http://d/ broken", b"lost"), ("http://e/ 1.2.3.4 20010101000000 text/html 200 - - 0 -", b"other"))
    (tmp_path / "two.arc.gz").write_bytes(b"".join(gzip.compress(packed[i : i + 100]) for i in range(0, len(packed), 100)))
    out = shared.fresh_path(spark, "test-warc")
    assert arc.convert(arc.read_arc(spark, str(tmp_path), "*.arc*"), out) == {"records": 5, "broken": 1}
    got = arc.read_warc(spark, out).collect()
    assert sorted((r["url"], r["record_type"], r["payload_bytes"]) for r in got if r["url"] in ("http://b/", "http://e/")) == [("http://b/", "resource", 7), ("http://e/", "resource", 5)]
    same = [r for r in got if r["payload_digest"] == digest(b"same body")]
    assert sorted(r["record_type"] for r in same) == ["response", "revisit", "revisit"]
    assert {r["refers_to_id"] for r in same if r["record_type"] == "revisit"} == {r["record_id"] for r in same if r["record_type"] == "response"}
    assert len({r["record_id"] for r in got}) == 5 and {r["key"] for r in got} == {None}


def test_archive_files_come_back(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = shared.fresh_path(spark, "test-arc")
    arc.write_arc(arc.to_arc(df), path)
    out = shared.fresh_path(spark, "test-warc")
    assert arc.convert(arc.read_arc(spark, path), out) == {"records": len(PAGES), "broken": 0}
    found = arc.read_warc(spark, out).select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == expected_records([(k, h) for k, _, h in PAGES])


@pytest.mark.parametrize("version", ["1", "2"])
def test_both_versions_are_parsed(version):
    block = arc.http_block(3, "text/html", b"x\ny")
    data = arc.arc_head(version, "t.arc") + arc.arc_record(version, "http://a b/", "20010203040506", "text/html", block) + b"\n\n" + arc.arc_record(version, "http://c/", "2001", "text/plain", b"plain")
    first, second = arc.parse_arc(data)
    assert first.fields["url"] == "http://a%20b/" and first.http()[1] == b"x\ny" and arc.key_of(first.http()[0]) == 3
    assert second.http() == (b"", b"plain")
    assert arc.warc_date(second.fields["date"]) == "2001-00-00T00:00:00Z" and arc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"


def test_broken_archives_keep_what_came_before():
    whole = arc.arc_head("1", "t.arc") + arc.arc_record("1", "http://a/", "2001", "text/plain", b"first")
    cut = whole + arc.arc_record("1", "http://b/", "2001", "text/plain", b"second")[:-4]
    found = list(arc.parse_arc(cut))
    assert [r and r.block for r in found] == [b"first", None]
    assert list(arc.parse_arc(b"no header at all\n")) == [None]
    assert list(arc.parse_arc(b"")) == []


# Vectors


def nearest(rows, k=10, every=5):
    """Brute force over usable vectors."""
    dims = [len(v) for _, v in rows if v]
    dim = max(set(dims), key=lambda d: (dims.count(d), -d)) if dims else 0
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and len(v) == dim and all(x is not None for x in v) and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = set()
    for q in {i for i, _ in good if i % every == 0}:
        asked = min(tuple(v) for i, v in good if i == q)
        near = sorted((float(np.sqrt(((v - asked) ** 2).sum())), i) for i, v in good if i != q)
        out |= {(q, r, i, round(d, 9)) for r, (d, i) in enumerate(near[:k], 1)}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = vp_search.search(df, df.filter("vec_id % 5 = 0"), **options)
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()}


def vectors(n, dim, seed=1):
    random = np.random.default_rng(seed)
    return [(i, random.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]


def test_search_is_exact_at_factor_one(spark):
    rows = vectors(900, 8)
    assert found(spark, rows, shard_rows=200, block_rows=50) == nearest(rows)


def test_search_with_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(400)] + [(i, [0.0, float(i % 7 + 1)]) for i in range(400, 500)]
    rows += [(1000, None), (1005, [0.0, 0.0]), (1010, [float("nan"), 1.0]), (1015, [None, 1.0]), (1020, [float("inf"), 1.0]), (1025, [1.0, 2.0, 3.0]), (1030, [])]
    assert found(spark, rows, shard_rows=150) == nearest(rows)


def by_loop(rows, k, every):
    """Brute force, squares added one after the other, nothing rounded."""
    out = set()
    for q, asked in rows:
        if q % every == 0:
            near = []
            for i, v in rows:
                total = 0.0
                for a, b in zip(asked, v, strict=True):
                    total += (a - b) * (a - b)
                if i != q:
                    near.append((float(np.sqrt(total)), i))
            out |= {(q, r, i, d) for r, (d, i) in enumerate(sorted(near)[:k], 1)}
    return out


def test_near_ties_are_decided_by_the_reported_score(spark):
    """Differences that are permutations of one list: distances differ in the last bit only, by the order of summing."""
    random = np.random.default_rng(3)
    for n in range(4):
        parts = random.normal(size=24).astype(np.float32).astype(float)
        rows = [(0, [1.0] * 24)] + [(i, random.permutation(parts).tolist()) for i in range(1, 300)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = vp_search.search(df, df.filter("vec_id % 300 = 0"), shard_rows=(300, 40)[n % 2])
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == by_loop(rows, 10, 300)


def test_far_shards_are_not_visited(spark):
    """Tight clusters far apart: each query's visits stay within its own cluster, and each shard grows one tree."""
    random = np.random.default_rng(5)
    rows = [(i, (random.normal(size=4) + 1000 * (i % 6)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked, sent = vp_search.visit_shards, []

    def counted(visits, trees, *rest):
        sent.append((visits.count(), trees.count(), trees.select("shard").distinct().count()))
        return asked(visits, trees, *rest)

    vp_search.visit_shards = counted
    try:
        got = vp_search.search(df, df.filter("vec_id % 100 = 0"), shard_rows=60)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == by_loop(rows, 10, 100)
    finally:
        vp_search.visit_shards = asked
    (home, trees, shards), (away, _, _) = sent
    assert home == 12 and trees == shards >= 20 and home + away < 12 * trees / 2


def test_search_with_a_vector_that_a_third_of_all_rows_repeat(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(500 + i, v) for i, v in vectors(400, 2, seed=9)]
    assert found(spark, rows, shard_rows=50, block_rows=16) == nearest(rows)


def test_search_leaves_out_null_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (None, [1.0, 0.0]), (2**60 + 1, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = vp_search.search(df, df.filter("vec_id is null or vec_id = 0"))
    assert [(r["query_id"], r["vec_id"]) for r in got.orderBy("rank").collect()] == [(0, 2**60 + 1), (0, 1)]


def test_search_with_few_candidates(spark):
    rows = [(0, [1.0]), (1, [2.0]), (5, [4.0])]
    assert found(spark, rows) == nearest(rows)
    assert found(spark, []) == set()
    assert found(spark, [(0, None)]) == set()


def test_smaller_factors_skip_work_and_keep_most(spark):
    rows = vectors(2000, 6, seed=3)
    exact, loose = nearest(rows), found(spark, rows, factor=0.7)
    recall = len({(q, i) for q, _, i, _ in exact} & {(q, i) for q, _, i, _ in loose}) / len(exact)
    assert 0.9 <= recall <= 1
    tree = vp_search.VpTree(np.random.default_rng(0).normal(size=(3000, 3)))
    sizes = []
    for factor in (1.0, 0.5):
        visited = 0

        def visit(leaf, live, *rest, of=tree):
            nonlocal visited
            visited += len(leaf) * len(live)
            vp_search.VpTree.visit(of, leaf, live, *rest)

        tree.visit = visit
        tree.search(np.zeros((1, 3)), np.array([-1]), np.arange(3000), 5, factor)
        sizes.append(visited)
    assert sizes[1] <= sizes[0] < 3000
