"""URL filters, token counts, license scans, chat formatting."""

from __future__ import annotations

import hashlib
import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from procweave.llm import chat_format, license_scan, token_count, url_filter

LONG = "Wort-" * 40_000


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# URL filters


def judge(url):
    """The base rules by brute force."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for action, name in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        own, _, start = name.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(name) > len(best[1])):
            best = (action, name)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.net?x=/", "http://A.NET/", "https://example.net/en/x", "https://sub.example.net/en/", "https://badexample.net/en/",
    "https://example.net/EN/", "http://example.com/de/1#f", "http://xexample.com/de/1", "http://m.example.org/fr/?a", "http://example.org/en/?utm_source=x", "http://example.com/x?utm_source=x",
    "http://example.com/ads/x", "ftp://user@host.example.com:80/de/a://b", "http://net/", "http://Ünet/", "http://ÜB.net/a\nb", "x" * 100_000 + "://y.net/", "http://example.com/x?utm_source=x",
]


def test_url_rules_agree_with_brute_force(spark):
    df = spark.createDataFrame([(i if i % 5 else None, u, "old", 1) for i, u in enumerate(URLS)], "page_id long, url string, verdict string, n int")
    got = rows(url_filter.judge_urls(df, url_filter.BASE_RULES, url_filter.PATTERN_RULES))
    assert len(got) == len(URLS)
    for r in got:
        host, path, best = judge(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["n"] == 1
        if best:
            assert r["verdict"] == best[0]
        elif r["url"] and "utm_source" in r["url"] and "example.org" not in r["url"]:
            assert (r["verdict"], r["method_rule"]) == ("block", "?utm_source=")
    by_url = {r["url"]: r for r in got}
    assert by_url["http://example.org/en/?utm_source=x"]["verdict"] == "allow"
    assert by_url["http://example.com/ads/x"]["verdict"] == "block"
    assert by_url[None]["verdict"] == "allow"


def test_url_index_uses_the_rarest_token():
    rule = url_filter.host_rule("block", "example.com/de/")
    index = url_filter.build_index([rule], {"example": 9, "com": 5, "de": 2})
    assert list(index) == ["de"]
    assert url_filter.pattern_rule("track*er").tokens == ()
    assert url_filter.host_rule("block", "example.com/de").tokens == ("example", "com")


def test_url_tables_without_rows_and_rules_without_tokens(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert rows(url_filter.judge_urls(empty, url_filter.BASE_RULES, [])) == []
    df = spark.createDataFrame([(1, "http://a.com/tracker"), (2, "http://a.com/x")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in rows(url_filter.judge_urls(df, [], [url_filter.pattern_rule("track*er")]))}
    assert got == {1: "block", 2: "allow"}
    many = url_filter.judge_urls(df, url_filter.BASE_RULES * 2000, [])
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows(many)} == {1: (None, "allow"), 2: (None, "allow")}


def fitting(url, pattern):
    """Whether a pattern fits a URL, without regular expressions."""
    body = pattern.removeprefix("@@")
    anchored, body = body.startswith("||"), body.removeprefix("||").lower()
    url = "".join(c.lower() if c.isascii() else c for c in url or "")
    pieces = body.split("*")

    def follows(at):
        for n, piece in enumerate(pieces):
            at = (at if url.startswith(piece, at) else -1) if n == 0 else url.find(piece, at)
            if at < 0:
                return False
            at += len(piece)
        return True

    if not anchored:
        return any(follows(i) for i in range(len(url) + 1))
    scheme, colon, rest = url.partition(":")
    if not rest.startswith("//"):
        return False
    begin = len(scheme) + 3
    end = url.find("/", begin) if "/" in url[begin:] else len(url)
    return any(follows(i) for i in range(begin, end + 1) if i == begin or url[i - 1] == ".")


def verdict_by_hand(url, patterns):
    best = judge(url)[2]
    found = [p for p in patterns if fitting(url, p)]
    return best[0] if best else "block" if found and not any(p.startswith("@@") for p in found) else "allow"


def test_patterns_agree_with_brute_force(spark):
    import random

    rng = random.Random(4)
    words = ["ads", "track", "login", "cart", "news", "docs", "spam-farm", "en", "x", "getapk", "a.apk", "tag", "download", "v1.zip", "utm_source=1", "?s=", "&q=", "com", "example.org", "_", "%41"]
    urls = ["http://" + "".join(rng.choice(words) + rng.choice("./?&-/") for _ in range(rng.randrange(1, 6))) for _ in range(400)] + [*URLS, "ads./ads/", "x:y://ads.", "HTTP://TRACK.X/ADS/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    patterns = url_filter.PATTERNS.split()
    got = {r["page_id"]: r["verdict"] for r in rows(url_filter.judge_urls(df, url_filter.BASE_RULES, url_filter.PATTERN_RULES))}
    assert got == {i: verdict_by_hand(u, patterns) for i, u in enumerate(urls)}
    assert len(set(got.values())) == 2


def test_fifty_thousand_rules(spark):
    urls = [f"http://h{i % 70_000}.example.com/p{i}/" for i in range(0, 100_000, 97)]
    rules = [url_filter.host_rule(("block", "allow")[i % 2], f"h{i}.example.com/") for i in range(49_990)] + [url_filter.host_rule("block", "com/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows(url_filter.judge_urls(df, rules, []))}
    for i, u in enumerate(urls):
        n = int(u.split(".")[0].removeprefix("http://h"))
        assert got[i] == ((f"h{n}.example.com/", ("block", "allow")[n % 2]) if n < 49_990 else ("com/", "block"))


# Token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return token_count.WordBpe(public_tokenizers.path("word_bpe_49k.json"))


SAMPLES = [
    "", " ", "a", "Hello, world!!!", "it's we'LL 'Re", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ß", "e\u0301 \u212b", "<|endoftext|>", "a<|startoftext|>b<|endoftext|> <|END|>", "<|", "aaaaaaaaaaaaaaaa" * 50,
    "日本語のテキスト", "🙂🙂👨‍👩‍👧 x", "1234 ½ ² Ⅷ", "\x00\x1c\x1d\x85\xa0\u2028a\u200bb", "ﬁ Ǆ", LONG, "word " * 3000, "___--__..", "ab" * 5000,
]


def test_token_counts_agree_with_the_library(bpe, library):
    want = [len(e.ids) for e in library.encode_batch(SAMPLES, add_special_tokens=False)]
    assert bpe.count(SAMPLES) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_token_counts_agree_on_any_text(bpe, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert bpe.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_agree_on_all_assigned_characters(bpe, library):
    import unicodedata

    letters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["x" + c + "y " + c for c in letters]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = bpe.count(texts)
    odd = [c for c, a, b in zip(letters, got, want, strict=True) if a != b]
    # The two libraries know different versions of Unicode; only private or recent letters may differ.
    assert not [c for c in odd if unicodedata.category(c) != "Co"]


def test_token_counts_agree_on_every_code_point(bpe, library):
    """None excepted: letters of any version of Unicode, unassigned and private code points."""
    texts = [f"x{chr(c)}y||{chr(c)}" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    assert bpe.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_documents(spark, small_dir, library):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in rows(token_count.op9_token_counts(spark, small_dir))}
    for r in docs.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert got[r["doc_id"]] == {"doc_id": r["doc_id"], "n_bytes": len(text.encode()), "n_tokens": n, "over_limit": n > 2048}


def test_token_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", None)], "doc_id long, text string, n_tokens string")
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in rows(token_count.count_tokens(df, "word_bpe_49k.json")))
    assert got == [(0, 0), (0, 0), (0, 0), (3, 2)]
    assert rows(token_count.count_tokens(df.limit(0), "word_bpe_49k.json")) == []


# License scans


def license_facts(text):
    """Words and phrase places by brute force."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = []
    for i in range(len(words)):
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            if words[i : i + len(p)] == p:
                places.append((i, label))
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


MIT_TEXT = license_scan.TEMPLATES["mit"]
LICENSES = [
    None, "", "MIT", "mit license", "MIT-LICENSE, Apache\nLicense! the General Public License", "mit license " * 300, "permit license", "Ünlimit license mit ürgent license",
    "before " + MIT_TEXT + " after", MIT_TEXT.replace("free of charge", "entirely free of all charge"), LONG, "mit  __license__ mit.license", "released under the mit license.",
]


def test_license_base_facts_agree_with_brute_force(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    texts = docs + [(100_000 + i, t) for i, t in enumerate(LICENSES)] + [(100_003, LICENSES[3])]
    got = rows(license_scan.scan_licenses(spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, score int")))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((r["doc_id"], *[str(r[n]) for n in names]) for r in got) == sorted((i, *map(str, license_facts(t))) for i, t in texts)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def test_license_spans_are_found_and_verified(spark):
    got = {r["doc_id"]: r for r in rows(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(LICENSES)), "doc_id long, text string")))}
    assert got[8]["labels"] == "mit" and got[8]["base_labels"] == "" and got[8]["score"] == 1.0
    (span,) = got[8]["spans"]
    assert (span["template"], span["first"]) == ("mit", 1)
    assert got[9]["labels"] == "mit" and 0.8 < got[9]["score"] < 1
    assert got[10]["labels"] == "" and got[10]["score"] == 0


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def spans_by_hand(text, templates):
    """Spans (first, last, template, covered, matched) by plain loops over all pairs of places."""
    k, gap = license_scan.K, license_scan.GAP
    words, sound = license_words(text), []
    for name, body in templates.items():
        own = license_words(body)
        diagonals, places = {}, {}
        for t in range(len(own) - k + 1):
            places.setdefault(tuple(own[t : t + k]), []).append(t)
        for d in range(len(words) - k + 1):
            for t in places.get(tuple(words[d : d + k]), []):
                diagonals.setdefault(d - t, []).append(d)
        bands, before = [], None
        for g in sorted(diagonals):
            if before is None or g - before > gap:
                bands.append([])
            bands[-1].append(g)
            before = g
        for band in bands:
            spans, reached = [], None
            for first, g in sorted((min(diagonals[g]), g) for g in band):
                if reached is None or first > reached + k + gap:
                    spans.append([])
                spans[-1].append(g)
                reached = max(diagonals[g]) if reached is None else max(reached, max(diagonals[g]))
            for span in spans:
                ds, ts = {d for g in span for d in diagonals[g]}, {d - g for g in span for d in diagonals[g]}
                covered, matched = (len({p + i for p in places for i in range(k)}) for places in (ds, ts))
                first, last = min(ds), max(ds) + k - 1
                if covered >= license_scan.LEAST_COVER * (last - first + 1) and matched >= min(license_scan.LEAST_WORDS, license_scan.LEAST_SHARE * len(own)):
                    sound.append((first, last, name, covered, matched, len(own)))
    sound.sort(key=lambda x: x[:3])
    islands, reached = [], -1
    for x in sound:
        if not islands or x[0] > reached:
            islands.append([])
        islands[-1].append(x)
        reached = max(reached, x[1])
    kept = []
    for island in islands:
        best = max(island, key=lambda x: (x[3], x[4] / x[5], -x[0], x[2]))
        kept += [x for x in island if x == best or x[0] > best[1] or x[1] < best[0]]
    return kept


@pytest.mark.parametrize("piece", [200_000, 40, 7])
def test_license_labels_scores_and_spans_agree_with_brute_force(spark, monkeypatch, piece):
    import random

    monkeypatch.setattr(license_scan, "PIECE", piece)
    rng = random.Random(9)
    names = ["mit", "boost", "bsd-2-clause", "bsd-3-clause", "isc", "gpl", "lgpl", "cc-by", "cc-by-nc/short", "apache", "mpl"]
    templates = {n: license_scan.TEMPLATES[n] for n in names}
    texts = [None, "", "mit license", "x " * 300 + "the general public license", "ü" * 90 + " mit  license"]
    for n in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [rng.choice(["plain", "words", "of", "the", "software"]) for _ in range(rng.randrange(0, 40))]
            own = templates[rng.choice(names)].split()
            at = rng.randrange(len(own)) if n % 3 else 0
            own = own[at : at + rng.choice([8, 40, 400])]
            for _ in range(rng.randrange(0, 1 + len(own) // 8)):
                i = rng.randrange(len(own))
                own[i : i + rng.randrange(0, 2)] = rng.choice([[], ["changed"], ["two", "words"]])
            words += own
        texts.append(" ".join(words) if n % 2 else "\n".join(words).upper())
    texts.append(texts[10])
    got = rows(license_scan.scan_licenses(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, piece string, words string"), templates=templates))
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        spans = spans_by_hand(text, templates)
        facts = license_facts(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == facts
        assert [(x["first"], x["last"], x["template"], x["covered"], x["matched"]) for x in r["spans"]] == [x[:5] for x in spans]
        labels = {x[2].split("/")[0] for x in spans} | set(filter(None, facts[4].split(",")))
        assert r["labels"] == ",".join(sorted(labels))
        assert r["score"] == (1.0 if facts[1] else max((x[4] / x[5] for x in spans), default=0.0))
    assert {x for r in got for x in r["labels"].split(",")} > {"bsd-2-clause", "bsd-3-clause", "mit"}


def test_whole_licenses_get_their_own_label_only(spark):
    made = [(n, f"Some heading\n{text}\nand a foot") for n, text in license_scan.TEMPLATES.items()]
    got = {r["name"]: r for r in rows(license_scan.scan_licenses(spark.createDataFrame(made, "name string, text string"), id_col="name"))}
    for name in license_scan.TEMPLATES:
        base = set(filter(None, got[name]["base_labels"].split(",")))
        assert set(got[name]["labels"].split(",")) == {name.split("/")[0]} | base
        assert got[name]["score"] == 1.0


def test_license_scan_of_nothing(spark):
    assert rows(license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))) == []


# Chat formatting


@settings(deadline=None)
@given(st.text(alphabet=st.sampled_from(list("#\\</turn> n\nx:")), max_size=40))
def test_escaping_is_exact_and_hides_control_strings(text):
    import pyarrow as pa

    hidden = chat_format.escape(pa.array([text]))[0].as_py()
    assert chat_format.unescape(hidden) == text and chat_format.unescape(hidden.encode()) == text.encode()
    assert "###" not in hidden and "</turn>" not in hidden


def expected_chats(turns):
    by_conv = {}
    for conv, turn, role, text in turns:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, each in by_conv.items():
        each.sort()
        taught = "".join(t for *_, r, t in each if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in each).encode()).hexdigest()
        out[conv] = (len(each), digest, len(taught), hashlib.sha256(taught.encode()).hexdigest())
    return out


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, 1, "assistant", "b"), (2, 0, "user", None), (3, None, None, "x"), (3, 0, "assistant", ""),
    (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (4, 0, "system\n### User:", "ü\\n"), (None, 0, "user", "lost"), (None, 1, "assistant", "too"), (5, 0, "assistant", LONG),
]


def read_back(spark, turns, **conf):
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, part int")
    got = chat_format.format_conversations(df).mapInArrow(chat_format.read_batches, chat_format.READ_BACK)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows(got)}


def test_chats_come_back_whole(spark):
    assert read_back(spark, TURNS) == expected_chats(TURNS)


def test_chats_that_span_batches_come_back_whole(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        turns = [(c, t, ("user", "assistant")[t % 2], f"{c} {t} ## \\") for c in (1, 2) for t in range(20)]
        assert read_back(spark, turns) == expected_chats(turns)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_very_long_turn_takes_little_memory():
    """200 MB in one turn, formatted and read back: under 1.6 GB at the peak, the turn itself included."""
    import subprocess
    from pathlib import Path

    code = """
import hashlib, resource, numpy as np, pyarrow as pa
from procweave.llm import chat_format as c
text = np.random.default_rng(1).integers(97, 123, 200_000_000, dtype=np.uint8); text[::1000] = 35; text[1::1000] = 35
want = hashlib.sha256(text).hexdigest()
body = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, text.size], dtype=np.int32)), pa.py_buffer(text)])
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["assistant"]), body], ["conv_id", "role", "text"])
(got,) = [b for b in c.read_batches(c.format_batches(iter([batch]))) if b.num_rows]
assert got["loss_sha256"][0].as_py() == want and got["loss_chars"][0].as_py() == 200_000_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert int(said.stdout) < 1600


def test_no_chats(spark):
    assert read_back(spark, []) == {}
