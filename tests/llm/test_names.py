"""Columns of the input may have any names, also those that the operators use within."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from procweave.llm import decontam, minhash, mixing, quality, token_count, url_filter

LLM = Path(minhash.__file__).parent
GOOD = [(i, f"calm words of text number {i} and more", "en", "s") for i in range(40)]
BAD = [(100 + i, "BUY!! NOW!! " * (3 + i % 4), "en", "s") for i in range(40)]


def names_within(module):
    """Every word in quotes in a module's code: all names of columns that it makes or uses are among them."""
    code = (LLM / f"{module}.py").read_text().split("ORACLE = ")[0]
    return sorted({n.lower() for n in re.findall(r'"([A-Za-z_]\w*)"', code)} | {"_score", "_leaks", "_dropped", "_epochs", "_cut", "_copies", "_url", "_candidates", "_fits", "plan_lang"})


def stages():
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)]
    return {
        "mixing": lambda s, d: mixing.mix(d, {}, (1, 1), 2, domain=F.lit("a")),
        "quality": lambda s, d: quality.keep_good(d, s.createDataFrame(labels, "doc_id long, quality int")),
        "minhash": lambda s, d: minhash.drop_near_duplicates(d),
        "decontam": lambda s, d: decontam.drop_leaks(d, [(1, "calm words of text number 7 and more", "")]),
        "url_filter": lambda s, d: url_filter.judge_urls(d.withColumn("url", F.lit("http://example.com/ads/x")), url_filter.BASE_RULES, url_filter.PATTERN_RULES),
        "token_count": lambda s, d: token_count.count_tokens(d, "word_bpe_49k.json"),
    }


#: Columns that an operator documents as replaced.
REPLACED = {"mixing": {"epoch"}, "url_filter": {"host", "path", "rule", "verdict", "method_rule"}, "token_count": {"n_bytes", "n_tokens", "over_limit"}}


@pytest.mark.parametrize("module", sorted(stages()))
def test_no_name_of_the_input_clashes(spark, module):
    docs = spark.createDataFrame(GOOD + BAD, "doc_id long, text string, lang string, source string")
    extra = [n for n in names_within(module) if n not in {*docs.columns, "url", *REPLACED.get(module, ())}]
    assert len(extra) > 10
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in extra])
    got = stages()[module](spark, wide).collect()
    assert got
    for r in got:
        assert all(r[n] == f"{n}{r['doc_id']}" for n in extra)
        assert r["text"] == (GOOD + BAD)[r["doc_id"] if r["doc_id"] < 100 else r["doc_id"] - 60][1]
