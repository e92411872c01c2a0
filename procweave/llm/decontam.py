"""Benchmark decontamination by block-max WAND over a BM25 index of test items.

Test items are cut into entries of bounded length and held in an inverted index with BM25 impacts, each divided by the
score that its entry gives itself, so that 1 is a whole entry and one threshold serves all. The index knows the largest
impact of every term, over all entries and over every block of neighbouring entries. Each text is cut into overlapping
passages, and every passage is a query. The bounds are applied to many passages at once in numpy: passages whose terms'
largest impacts stay under the threshold end there, and so do, of the others, the blocks whose largest impacts do. In
the blocks that are left the walk proper runs: one cursor a term, ordered by entry; the first entry at which the largest
impacts of the cursors up to it reach the threshold is the pivot, cursors before it skip to it, and an entry is scored
only when all cursors stand there. Every entry at or above the threshold is retrieved. A retrieved item counts only if the
word n-grams of its question and of its answer stand, in large part, around the passage.

Items are held in indexes of bounded size (INDEX_BYTES of text each). A pass over the texts looks them up in at most
PASS_INDEXES of them; where there are more, the texts pass again, with what was found so far, for the next ones.

Defined results: null texts and texts without words hold nothing. An item without an answer column is split: its last
sentence is the answer, if it has more than one. Items with fewer than SHORT_WORDS words count only where the whole word
sequences of question and answer stand; items without words, and null ones, take no part. Items that repeat an id are
separate entries of that id. Rows are judged one by one; columns of the input pass through, whatever their names, but
for one with the name of the added column, which is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.llm.shared import bound_batches, materialize, read_spread, text_runs

#: Words of a passage and of the step from one to the next, most words of an index entry, entries of a block.
PASSAGE, STEP, ENTRY_WORDS, BLOCK = 64, 32, 48, 8

#: BM25 parameters, and the share of an entry's own score at which it is retrieved.
K1, B, LEAST_SCORE = 1.2, 0.75, 0.5

#: Words of an n-gram, and the least shares of the question's and the answer's n-grams.
GRAM, LEAST_QUESTION, LEAST_ANSWER = 3, 0.5, 0.5

#: Items with fewer words count only if their whole word sequences stand in the text.
SHORT_WORDS = 5

#: Bytes of item texts in one index, and indexes that one pass over the texts looks up.
INDEX_BYTES, PASS_INDEXES = 8_000_000, 8

WORD = re.compile(r"\w+")
#: Bytes of texts that are looked up at once; a single longer text is looked up alone.
RUN_BYTES = 500_000

LEAKS = "array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double>>"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer, if there are several."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def walk(terms: list[int], entries: list[int], impacts: list[float], least: float | None = None) -> Iterator[tuple[int, float]]:
    """The entries of a block that reach the threshold, and their scores, by a walk of cursors and pivots.

    Postings come as parallel lists, ordered by term and entry.
    """
    least = (LEAST_SCORE if least is None else least) - 1e-9
    cut = [0, *(i for i in range(1, len(terms)) if terms[i] != terms[i - 1]), len(terms)]
    # A cursor: its place, its end, and the term's largest impact in this block.
    cursors = [[a, b, max(impacts[a:b])] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    while cursors:
        cursors.sort(key=lambda c: entries[c[0]])
        bound, pivot = 0.0, None
        for cursor in cursors:
            bound += cursor[2]
            if bound >= least:
                pivot = entries[cursor[0]]
                break
        if pivot is None:
            return
        if entries[cursors[0][0]] == pivot:
            here = [c for c in cursors if entries[c[0]] == pivot]
            score = sum(impacts[c[0]] for c in here)
            if score >= least:
                yield pivot, score
            for cursor in here:
                cursor[0] += 1
        else:
            for cursor in cursors:
                if entries[cursor[0]] >= pivot:
                    break
                cursor[0] = bisect_left(entries, pivot, cursor[0], cursor[1])
        cursors = [c for c in cursors if c[0] < c[1]]


class BlockMaxIndex:
    """An inverted index with impacts, largest impacts of terms, and largest impacts of terms by block."""

    def __init__(self, items: list[tuple[int, str, str]]):
        self.items = [(i, words_of(q), words_of(a)) for i, q, a in items]
        self.items = [x for x in self.items if x[1] or x[2]]
        entries, self.owner = [], []
        for n, (_, question, answer) in enumerate(self.items):
            whole = question + answer
            # Entries are of about the same length, none longer than ENTRY_WORDS.
            count = -(-len(whole) // ENTRY_WORDS)
            size = -(-len(whole) // count)
            for start in range(0, len(whole), size):
                entries.append(whole[start : start + size])
                self.owner.append(n)
        self.vocabulary: dict[str, int] = {}
        post: dict[int, dict[int, int]] = {}
        for e, words in enumerate(entries):
            for w in words:
                held = post.setdefault(self.vocabulary.setdefault(w, len(self.vocabulary)), {})
                held[e] = held.get(e, 0) + 1
        total = len(entries)
        mean = sum(map(len, entries)) / max(1, total)
        terms = np.array([t for t, held in post.items() for _ in held], dtype=np.int64)
        where = np.array([e for held in post.values() for e in held], dtype=np.int64)
        often = np.array([f for held in post.values() for f in held.values()], dtype=np.float64)
        length = np.array([len(w) for w in entries], dtype=np.float64)
        order = np.lexsort((where, terms))
        terms, where, often = terms[order], where[order], often[order]
        held_by = np.bincount(terms, minlength=len(self.vocabulary)) if terms.size else np.zeros(0)
        rarity = np.log1p((total - held_by + 0.5) / (held_by + 0.5))
        impact = rarity[terms] * often * (K1 + 1) / (often + K1 * (1 - B + B * length[where] / mean)) if terms.size else often
        own = np.bincount(where, weights=impact, minlength=total) if terms.size else np.zeros(0)
        self.entry, self.impact = where, impact / own[where] if terms.size else impact
        self.starts = np.r_[0, np.cumsum(held_by)].astype(np.int64)
        self.most = np.maximum.reduceat(self.impact, self.starts[:-1]) if terms.size else np.zeros(0)
        block = where // BLOCK
        new = np.r_[True, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])] if terms.size else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        self.block, self.block_most = block[first], np.maximum.reduceat(self.impact, first) if first.size else np.zeros(0)
        self.block_starts = np.r_[0, np.cumsum(np.bincount(terms[first], minlength=len(self.vocabulary)))].astype(np.int64) if first.size else np.zeros(1, dtype=np.int64)

    @staticmethod
    def expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term its postings' places, and which of the terms each belongs to."""
        counts = starts[terms + 1] - starts[terms]
        source = np.repeat(np.arange(terms.size), counts)
        return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[terms], counts), source

    @staticmethod
    def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, weights=values, minlength=found.size)

    def retrieve(self, ids: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(text, passage, entry, score) of every passage and entry that reach LEAST_SCORE; ids are term numbers or -1."""
        steps = np.array([-(-len(x) // STEP) + 1 for x in ids])
        base = np.r_[0, np.cumsum(steps)]
        flat = np.concatenate(ids)
        size = np.array([len(x) for x in ids])
        step = np.repeat(base[:-1], size) + (np.arange(flat.size) - np.repeat(np.cumsum(size) - size, size)) // STEP
        known = flat >= 0
        terms, step = flat[known], step[known]
        # Largest impacts of all terms: passages that cannot reach the threshold end here.
        bound = np.bincount(step, weights=self.most[terms], minlength=base[-1] + 1)
        live = bound[:-1] + bound[1:] >= LEAST_SCORE
        wanted = live[step] | np.r_[False, live[:-1]][step]
        terms, step = terms[wanted], step[wanted]
        width = len(self.vocabulary)
        # A passage is two steps; its terms count once.
        here, before = live[step], (step > 0) & live[np.maximum(step - 1, 0)]
        pairs = np.unique(np.r_[step[here] * width + terms[here], (step[before] - 1) * width + terms[before]])
        passage, term = pairs // width, pairs % width
        blocks = int(self.entry.max()) // BLOCK + 1
        place, source = self.expand(self.block_starts, term)
        key, most = self.summed(passage[source] * blocks + self.block[place], self.block_most[place])
        alive = key[most >= LEAST_SCORE - 1e-9]
        if not alive.size:
            return
        # The postings of the blocks that are left, by passage and block.
        near = np.isin(passage, np.unique(alive // blocks))
        passage, term = passage[near], term[near]
        place, source = self.expand(self.starts, term)
        group = passage[source] * blocks + self.entry[place] // BLOCK
        kept = np.isin(group, alive)
        group, term, place = group[kept], term[source][kept], place[kept]
        order = np.lexsort((place, term, group))
        group, term, place = group[order], term[order], place[order]
        bounds = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), group.size]
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = int(group[start]) // blocks
            text = int(np.searchsorted(base, at, side="right")) - 1
            own = place[start:stop]
            for entry, score in walk(term[start:stop].tolist(), self.entry[own].tolist(), self.impact[own].tolist()):
                yield text, at - int(base[text]), entry, score

    def overlaps(self, item: int, words: list[str], passage: int) -> tuple[float, float]:
        """Shares of the question's and of the answer's n-grams that stand around a passage; 1 for what is empty."""
        _, question, answer = self.items[item]
        reach = len(question) + len(answer)
        around = words[max(0, passage * STEP - reach) : passage * STEP + PASSAGE + reach]

        size = max(len(question), len(answer)) if reach < SHORT_WORDS else GRAM

        def share(part: list[str]) -> float:
            wanted = grams(part, min(size, len(part))) if part else set()
            return len(wanted & grams(around, min(size, len(part)))) / len(wanted) if wanted else 1.0

        return share(question), share(answer)

    def leaks(self, texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
        """Per text the verified items with their best passage's score and overlaps."""
        out: list[list] = [[] for _ in texts]
        if not self.items or not texts:
            return out
        cut = [words_of(t) for t in texts]
        get = self.vocabulary.get
        ids = [np.fromiter(map(get, w, repeat(-1)), dtype=np.int64, count=len(w)) for w in cut]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for text, passage, entry, score in self.retrieve(ids):
            item = self.owner[entry]
            question, answer = self.overlaps(item, cut[text], passage)
            if question >= LEAST_QUESTION and answer >= LEAST_ANSWER:
                key = (text, item)
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, question, answer))
        for (text, item), (score, question, answer) in sorted(best.items()):
            out[text].append((self.items[item][0], score, question, answer))
        return out


def load_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> list[tuple[int, str, str]]:
    """The items as (id, question, answer), in a fixed order. Test items, unlike texts, have to fit the driver."""
    columns = [F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("q"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a")]
    rows = items.select(*columns).filter("q is not null").orderBy("i", "q", "a").toLocalIterator()
    return [(r["i"], r["q"], r["a"] or "") if answer_col else (r["i"], *split_item(r["q"])) for r in rows]


def index_parts(items: list[tuple[int, str, str]]) -> Iterator[list[tuple[int, str, str]]]:
    """Runs of items of bounded size in bytes, at least one item each."""
    part, held = [], 0
    for item in items:
        size = len(item[1]) + len(item[2])
        if part and held + size > INDEX_BYTES:
            yield part
            part, held = [], 0
        part.append(item)
        held += size
    if part:
        yield part


def finder(spark: SparkSession, items: list[tuple[int, str, str]]):
    """A Spark column function: the verified items of one index in a text. The index is broadcast, a bounded size each."""
    sent = spark.sparkContext.broadcast(BlockMaxIndex(items))
    names = ("item_id", "score", "question_overlap", "answer_overlap")
    kind = pa.list_(pa.struct([(names[0], pa.int64()), *((n, pa.float64()) for n in names[1:])]))

    @F.arrow_udf(LEAKS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = sent.value
        for batch in batches:
            found = [x for part in text_runs(batch, RUN_BYTES) for x in index.leaks(part)]
            yield pa.array([[dict(zip(names, leak, strict=True)) for leak in x] for x in found], kind)

    # Else the planner would find the leaks once more where they are filtered by.
    return find.asNondeterministic()


def with_leaks(docs: DataFrame, items: list[tuple[int, str, str]], text_col: str) -> DataFrame:
    """Rows of ``own`` (all columns of docs) and ``leaks``; the texts pass once for every PASS_INDEXES indexes."""
    none = F.array().cast(LEAKS)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), none.alias("leaks"))
    text = F.coalesce(F.col("own").getField(text_col), F.lit(""))
    for n, part in enumerate(index_parts(items)):
        if n and n % PASS_INDEXES == 0:
            out = materialize(out, "leaks")
        found = finder(docs.sparkSession, part)(text)
        out = out.select("own", (F.concat("leaks", found) if n else found).alias("leaks"))
    return out


def mark_leaks(docs: DataFrame, items: list[tuple[int, str, str]], text_col: str = "text", into: str = "leaks") -> DataFrame:
    """Add a column, ``leaks`` by default, of the verified test items in each text."""
    own = [F.col("own").getField(c).alias(c) for c in docs.columns if c != into]
    return with_leaks(docs, items, text_col).select(*own, F.col("leaks").alias(into))


def drop_leaks(docs: DataFrame, items: list[tuple[int, str, str]], text_col: str = "text") -> DataFrame:
    """Keep the documents without a verified test item."""
    return with_leaks(docs, items, text_col).filter(F.size("leaks") == 0).select("own.*")


def op8_decontamination(spark, sf_dir):
    """Every document and test item whose question and answer stand in it."""
    bound_batches(spark)
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    items = load_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return mark_leaks(docs, items).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
