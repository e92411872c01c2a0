"""Token counts by rank-synchronous merging over ragged numpy arrays.

The vocabulary is a word-end BPE in the JSON format of the ``tokenizers`` library. Text is normalised and cut into
pre-tokens as that library does; the distinct pre-tokens of a batch that are not known yet become one flat array of
symbol ids with row offsets, and every round applies each row's lowest-ranked pair at once. What survives is counted.
Counts of known pre-tokens stay in a bounded table per Python worker.

Defined results: null text counts as empty (0 bytes, 0 tokens). Special strings inside a text count as one token
each. Rows are independent, so ties, repeats, extra columns and empty tables need no care.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from procweave.llm.shared import bound_batches, read_spread, text_runs

#: Pre-tokens whose counts a worker keeps, and pre-tokens merged at once.
KNOWN_LIMIT = 400_000
MERGE_BATCH = 20_000

#: Bytes of texts that are counted at once; a single longer text is counted alone.
RUN_BYTES = 2_000_000

#: The capital sigma, whose lower case does not depend on its place here, and capitals that Python's tables lack.
RECENT_LOWER = str.maketrans({"Σ": "σ", "\ua7cb": "\u0264", "\ua7d2": "\ua7d3", "\ua7d4": "\ua7d5", "\ua7dc": "\u019b"})

#: Fixed value: the pre-token pattern of the vocabulary, white space spelled out, and its letters and digits by name.
PRE_TOKEN = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^\p{White_Space}{L}{N}]+"


@lru_cache(maxsize=1)
def unknown_letters() -> str:
    """What the pattern's own engine takes for letters or digits and the library's, which knows an older Unicode, does not, as ranges of a set.

    Only code points that Python's tables do not have yet can differ; the library is asked about each of them.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    recent = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    asked = Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(" ".join(recent))
    odd = sorted(set(map(ord, recent)) - {ord(c) for c, _ in asked})
    starts = [c for c in odd if c - 1 not in set(odd[max(0, bisect_left(odd, c) - 1) : bisect_left(odd, c)])]
    ends = [c for c in odd if c + 1 not in set(odd[bisect_left(odd, c) + 1 : bisect_left(odd, c) + 2])]
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, ends, strict=True))


def pre_token_pattern() -> str:
    odd = unknown_letters()
    known = {name: rf"[\p{{{name}}}--[{odd}]]" if odd else rf"[\p{{{name}}}]" for name in ("L", "N")}
    return PRE_TOKEN.replace("{L}", known["L"]).replace("{N}", known["N"])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Counts the tokens of pre-tokens by merging many of them at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([a * self.width + b for a, b, _ in pairs], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([m for _, _, m in pairs], dtype=np.int64)
        self.none = len(pairs)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.pattern, self.plain = regex.compile(pre_token_pattern()), regex.compile(PRE_TOKEN.replace("{L}", r"[\p{L}]").replace("{N}", r"[\p{N}]"))
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``none``."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.order[at], self.none)

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each non-empty pre-token."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(b) for b in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.final[data[ends - 1]]
        row = np.repeat(np.arange(len(words)), lengths)
        counts = lengths.copy()
        while ids.size > 1:
            rank = self.ranks(ids[:-1], ids[1:])
            rank[row[:-1] != row[1:]] = self.none
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, self.none], starts)
            position = np.repeat(lowest, np.diff(np.r_[starts, row.size]))
            hit = (rank == position[:-1]) & (rank < self.none)
            if not hit.any():
                break
            # In a run of overlapping hits, every second one applies, from the left.
            where = np.flatnonzero(hit)
            first = np.r_[True, np.diff(where) > 1]
            run = np.maximum.accumulate(np.where(first, np.arange(where.size), 0))
            where = where[(np.arange(where.size) - run) % 2 == 0]
            ids[where] = self.merged[rank[where]]
            keep = np.ones(ids.size, dtype=bool)
            keep[where + 1] = False
            np.subtract.at(counts, row[where], 1)
            # Rows without any pair are done and leave the arrays.
            keep &= position < self.none
            ids, row = ids[keep], row[keep]
        return counts

    def learn(self, words: set[str]) -> None:
        fresh = sorted(words, key=len)
        for start in range(0, len(fresh), MERGE_BATCH):
            part = fresh[start : start + MERGE_BATCH]
            self.known.update(zip(part, self.merge_counts(part).tolist(), strict=True))

    def pre_tokens(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        # Lower-casing goes letter by letter, so a final capital sigma becomes the plain small one.
        return (self.plain if text.isascii() else self.pattern).findall(text.translate(RECENT_LOWER).lower())

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.known) > KNOWN_LIMIT:
            self.known.clear()
        cut, extra = [], []
        for text in texts:
            pieces = self.special.split(text) if "<|" in text else [text]
            cut.append([w for p in pieces for w in self.pre_tokens(p)] if len(pieces) > 1 else self.pre_tokens(text))
            extra.append(len(pieces) - 1)
        self.learn({w for words in cut for w in words if w not in self.known})
        get = self.known.__getitem__
        return [sum(map(get, words)) + n for words, n in zip(cut, extra, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> WordBpe:
    return WordBpe(path)


def token_counter(tokenizer: str):
    """A Spark column function: the number of tokens of a text column, by the named public vocabulary or a path."""

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        import public_tokenizers

        bpe = counter(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        for batch in batches:
            yield pa.array([n for part in text_runs(batch, RUN_BYTES) for n in bpe.count(part)], pa.int64())

    return n_tokens


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text_col: str = "text") -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns(
        {"n_bytes": F.octet_length(text).cast("long"), "n_tokens": token_counter(tokenizer)(text)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir):
    """Tokens of every whole text of documents by the word-end vocabulary."""
    bound_batches(spark)
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs, "word_bpe_49k.json").drop("text")
