"""Near-duplicate removal by b-bit MinHash.

1. Every text becomes the set of its distinct word shingles (64-bit hashes), in numpy; from the set come a 128-bit
   fingerprint, HASHES minima, band keys over them, and a signature that keeps the low BITS bits of each minimum,
   packed in bit planes.
2. Texts with equal sets form one class, held by its smallest doc_id; from here on only classes matter, so thousands of
   copies cost one row each.
3. Classes that share a band key are candidates. A band's leader is its smallest class. Each class is first paired with one
   leader, that of most of its bands, so the pairs are no more than the classes. Pairs are estimated from the signatures
   by bit counts, corrected for chance collisions, and those safely under the threshold are dropped; the others are
   confirmed on the full sets, rebuilt from the texts of the classes concerned. Confirmed links make components.
4. Then only bands that still hold several components matter: each of their classes is paired with another component's
   leader in the same way, and at last all pairs across the components that are left in a band are looked at, by blocks
   of bounded size: first on the signatures alone, then, for the classes that have a plausible partner in the other block,
   on the full sets. So no candidate link is lost, a large group of near copies, which is one component by then, is never
   paired within, and no task gets more of a hot band than two blocks.

Texts pass in runs of bounded size, and a single long text in pieces, so beside the text itself a worker holds about 16
bytes for each of its shingles.

A pair at the threshold shares no band with a probability under 3e-6 (42 bands of 6 minima, similarity 0.8). The
estimate is dropped only when it lies six standard deviations under the threshold.

Defined results: texts without words (null, empty) have an empty set, link with nothing and are kept. A text with fewer
words than a shingle is one shingle. Rows with a null doc_id link with nothing, get a null component and are kept. Rows
that share a doc_id get the component of their own text; classes whose smallest doc_id is the same are one component.
``near_duplicates`` does not carry extra columns; ``drop_near_duplicates`` keeps the columns of its input and drops every
row of a doc_id that has a row which is not kept. Columns of the input may have any names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from procweave.llm.shared import bound_batches, materialize, read_spread

#: Words of a shingle, and those that the contract of op7 fixes.
SHINGLE, OP7_SHINGLE = 5, 4

#: The threshold as a share in whole numbers (4 of 5).
SHARE = (80, 100)

#: Minima, rows of a band, bits kept of a minimum. The last minima that fill no band only serve the estimate.
HASHES, BAND_ROWS, BITS = 256, 6, 2

#: Standard deviations by which an estimate may miss before its pair is dropped.
SAFE_SIGMAS = 6.0

#: Rounds in which every class is paired with one leader, before all pairs across components are looked at.
STAR_ROUNDS = 2

#: Classes of a block whose full sets are compared, blocks that are compared at once by signatures, and the most rows of a
#: band in which partners are looked for by a join on the band.
BLOCK, BLOCKS_AT_ONCE, SMALL_BAND = 256, 4, 256

#: Bytes of texts that are hashed at once; a longer text is hashed alone, in pieces of PIECE bytes.
RUN_BYTES, PIECE = 400_000, 1 << 20

#: The most ids that are broadcast to pick out texts (8 bytes each); more are joined.
BROADCAST_IDS = 500_000

SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig array<long>"

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    up, down = np.full(size, BASE | U64(1)), np.full(size, U64(pow(int(BASE | U64(1)), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of the text that each stands in. Only A-Z is lower-cased."""
    raw = [t.lower() for t in texts]
    sizes = np.array([len(b) + 1 for b in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    space = space_table()[data]
    before = np.r_[True, space[:-1]]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    up, down = powers(1 << max(16, int(data.size + 1).bit_length()))
    total = np.zeros(data.size + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: data.size], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64)), np.searchsorted(np.cumsum(sizes), starts, side="right")


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def piece_words(data: np.ndarray) -> Iterator[np.ndarray]:
    """The hashes of a long text's words, piece by piece; a word that a cut parts is put together again."""
    up, down = powers(PIECE)
    value, length = U64(0), 0
    for at in range(0, data.size, PIECE):
        part = lower_table()[data[at : at + PIECE]]
        space = space_table()[part]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        total = np.zeros(part.size + 1, dtype=U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[: part.size], out=total[1:])
        values, sizes = (total[ends] - total[starts]) * down[starts], (ends - starts).astype(U64)
        if length and not (starts.size and starts[0] == 0):
            values, sizes = np.r_[value, values], np.r_[U64(length), sizes]
        elif length:
            values[0] = value + values[0] * U64(pow(int(BASE | U64(1)), length, 1 << 64))
            sizes[0] += U64(length)
        value, length = U64(0), 0
        if not space[-1]:
            value, length = values[-1], int(sizes[-1])
            values, sizes = values[:-1], sizes[:-1]
        yield mix(values + sizes)
    if length:
        yield mix(np.array([value + U64(length)]))


def rolled_up(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for every run of ``size`` words."""
    count = max(0, words.size - size + 1)
    rolled = words[:count].copy()
    for n in range(1, size):
        rolled *= BASE | U64(1)
        rolled += words[n : n + count]
    return mix(rolled)


def short_hash(words: np.ndarray) -> np.uint64:
    """The one hash of a text with fewer words than a shingle."""
    value = np.array([words.size], dtype=U64)
    for w in words:
        value = mix(value * BASE + w)
    return value[0]


def long_set(data: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one long text."""
    parts, tail, n = [], np.zeros(0, dtype=U64), 0
    for words in piece_words(data):
        n += words.size
        held = np.r_[tail, words]
        parts.append(rolled_up(held, size))
        tail = held[max(0, held.size - size + 1) :]
    if n < size:
        return np.array([short_hash(tail)] if n else [], dtype=U64)
    out = np.concatenate(parts)
    del parts
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def shingle_sets(texts: list, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin (one more bound at the end).

    Texts are strings or UTF-8 bytes; a single long one is taken in pieces.
    """
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    if len(raw) == 1 and len(raw[0]) > RUN_BYTES:
        out = long_set(np.frombuffer(raw[0], dtype=np.uint8), size)
        return out, np.array([0, out.size])
    raw = list(map(bytes, raw))
    words, owner = word_hashes(raw)
    counts = np.bincount(owner, minlength=len(raw)) if words.size else np.zeros(len(raw), dtype=np.int64)
    whole = owner[: max(0, words.size - size + 1)] == owner[size - 1 :]
    rolled = rolled_up(words, size)[whole]
    made = np.maximum(counts - size + 1, np.minimum(counts, 1))
    bounds = np.r_[0, np.cumsum(made)]
    out = np.empty(int(bounds[-1]), dtype=U64)
    long_rows = np.ones(out.size, dtype=bool)
    first_word = np.r_[0, np.cumsum(counts)]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        out[bounds[i]] = short_hash(words[first_word[i] : first_word[i + 1]])
        long_rows[bounds[i]] = False
    out[long_rows] = rolled
    for i in np.flatnonzero(made > 1):
        out[bounds[i] : bounds[i + 1]].sort()
    row = np.repeat(np.arange(len(raw)), made)
    fresh = np.ones(out.size, dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[fresh], np.r_[0, np.cumsum(np.bincount(row[fresh], minlength=len(raw)))] if out.size else np.zeros(len(raw) + 1, dtype=np.int64)


@lru_cache(maxsize=1)
def hash_family() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    return (random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)), random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minima(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The HASHES minima of each set; starts are the beginnings of non-empty runs. One row a hash."""
    values = (sets ^ (sets >> U64(32))).astype(np.uint32)
    a, b = hash_family()
    out, scratch = np.empty((HASHES, starts.size), dtype=np.uint32), np.empty_like(values)
    for k in range(HASHES):
        np.multiply(values, a[k], out=scratch)
        np.add(scratch, b[k], out=scratch)
        np.minimum.reduceat(scratch, starts, out=out[k])
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band and set; the band's number is part of it."""
    n = HASHES // BAND_ROWS
    keys = np.repeat(np.arange(1, n + 1, dtype=U64)[:, None], least.shape[1], axis=1)
    for r in range(BAND_ROWS):
        keys = mix(keys * BASE + least[r : n * BAND_ROWS : BAND_ROWS].astype(U64))
    return keys


def signatures(least: np.ndarray) -> np.ndarray:
    """The low bits of the (scrambled) minima as 64-bit words, one bit plane after the other."""
    low = (least * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    planes = [np.packbits((low >> np.uint32(p)).astype(np.uint8) & 1, axis=0) for p in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes).T).view(np.int64)


def set_digests(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of each set's fingerprint and its minima; a long set, which comes alone, is gone through in slices."""
    f1, f2, least = np.zeros(starts.size, dtype=U64), np.zeros(starts.size, dtype=U64), np.full((HASHES, starts.size), 0xFFFFFFFF, dtype=np.uint32)
    step = PIECE if starts.size == 1 else max(1, sets.size)
    for at in range(0, sets.size, step):
        part = sets[at : at + step]
        f1 += np.add.reduceat(mix(part), starts)
        f2 += np.add.reduceat(mix(part ^ U64(0x5851F42D4C957F2D)), starts)
        np.minimum(least, minima(part, starts), out=least)
    return f1, f2, least


def sign_batch(texts: list, size: int = SHINGLE) -> dict[str, list]:
    sets, bounds = shingle_sets(texts, size)
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    f1, f2 = np.zeros(len(texts), dtype=U64), np.zeros(len(texts), dtype=U64)
    bands, sig = [[]] * len(texts), [[]] * len(texts)
    if some.size:
        f1[some], f2[some], least = set_digests(sets, bounds[:-1][some])
        for i, keys, packed in zip(some, band_keys(least).T.astype(np.int64), signatures(least), strict=True):
            bands[i], sig[i] = keys, packed
    return {"n_shingles": sizes, "f1": f1.astype(np.int64), "f2": f2.astype(np.int64), "bands": bands, "sig": sig}


def raw_runs(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, list]]:
    """Runs of texts of bounded size as bytes, at least one text each, and their ids. The bytes are views, not copies."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + RUN_BYTES, side="right")))
        part = texts.slice(start, stop - start)
        yield ids.slice(start, stop - start), [t.as_buffer() if stop - start == 1 else t.as_buffer().to_pybytes() for t in part]
        start = stop


SIGNED_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))


def sign_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Set size, fingerprint, band keys and signature of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in raw_runs(batch.column(0), batch.column(1)):
                made = sign_batch(texts, size)
                columns = [pa.array(c, t) for c, t in zip(made.values(), SIGNED_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *made])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(sign, SIGNED)


def matching(a: str, b: str) -> Column:
    """How many minima's low bits agree in two signatures."""
    words = HASHES // 64
    differ = F.lit(0)
    for w in range(words):
        planes = [F.get(a, F.lit(p * words + w)).bitwiseXOR(F.get(b, F.lit(p * words + w))) for p in range(BITS)]
        either = planes[0]
        for plane in planes[1:]:
            either = either.bitwiseOR(plane)
        differ = differ + F.bit_count(either)
    return F.lit(HASHES) - differ


def estimate(a: str, b: str) -> Column:
    """Similarity estimated from two signatures, corrected for agreement by chance."""
    chance = 2.0**-BITS
    return (matching(a, b) / float(HASHES) - chance) / (1 - chance)


def least_estimate() -> float:
    """The estimate under which a pair cannot reach the threshold but by a miss of SAFE_SIGMAS deviations."""
    wanted, chance = SHARE[0] / SHARE[1], 2.0**-BITS
    agree = chance + (1 - chance) * wanted
    return wanted - SAFE_SIGMAS * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def plausible(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose set sizes and signatures allow the threshold."""
    side = lambda x: signed.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(sizes_allow() & (estimate("sig_a", "sig_b") >= least_estimate())).select("a", "b")


def sizes_allow() -> Column:
    return F.least("n_a", "n_b") * SHARE[1] >= F.greatest("n_a", "n_b") * SHARE[0]


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The shingle sets of the wanted documents (rep), as bytes of sorted hashes."""
    named = docs.select(F.col(id_col).cast("long").alias("rep"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    few = wanted.count() <= BROADCAST_IDS
    texts = named.join(F.broadcast(wanted) if few else wanted, "rep", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, part in raw_runs(batch.column(0), batch.column(1)):
                sets, bounds = shingle_sets(part, size)
                data = [memoryview(sets[s:e]).cast("B") for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(map(bytes, data), pa.binary())], ["rep", "set"])

    return texts.mapInArrow(build, "rep long, set binary").filter(F.octet_length("set") > 0)


@F.pandas_udf(LongType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sets in bytes."""

    def count(x: bytes, y: bytes) -> int:
        x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
        at = np.searchsorted(y, x)
        return int((y[np.minimum(at, y.size - 1)] == x).sum())

    return pd.Series([count(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    sizes = (F.octet_length("set_a") + F.octet_length("set_b")) / 8
    shared = both.select("a", "b", sizes.cast("long").alias("sizes"), common("set_a", "set_b").alias("shared"))
    return shared.filter(F.col("shared") * SHARE[1] >= (F.col("sizes") - F.col("shared")) * SHARE[0]).select("a", "b")


def contract(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (rep, label) after more links: every rep of a link, labelled with the smallest rep it is joined to.

    Each round hooks every label to the smallest one that it has a link with, shortens the chains of hooks, and carries
    the links over to the new labels until none is left between different ones.
    """
    if labels is not None:
        links = relabel(relabel(links, labels, "a"), labels, "b")
    links = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "links"
    )
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("label", F.col("rep"))
    known = ends if labels is None else labels.unionByName(ends.join(labels, "rep", "left_anti"))
    while not links.isEmpty():
        hooks = materialize(links.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("label")), "hooks")
        for _ in range(3):
            hooks = relabel(hooks, hooks, "label")
        hooks = materialize(hooks, "hooks")
        known = relabel(known, hooks, "label")
        links = relabel(relabel(links, hooks, "a"), hooks, "b")
        links = materialize(
            links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "links"
        )
    return materialize(known, "labels")


def relabel(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Replace a column by its label where it has one."""
    to = labels.select(F.col("rep").alias("_from"), F.col("label").alias("_to"))
    names = rows.columns
    joined = rows.join(to, F.col(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).select(*names)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept; shingles of ``size`` words."""
    signed = materialize(sign_docs(docs, id_col, text_col, size), "signed")
    # Band keys and signature follow from the set, so any row's will do.
    classes = (
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("f1", "f2", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    )
    classes = materialize(classes, "classes")
    held = classes.select("rep", F.explode("bands").alias("band"))
    leaders = held.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    shared = materialize(by_band(held, materialize(leaders, "leaders"), "inner"), "bands")
    labels = tried = None
    mixed = shared
    for _ in range(STAR_ROUNDS):
        # One pair for each class: the leader of most of its bands that lies in another component.
        stars = mixed.filter("rep <> lead").groupBy(F.col("lead").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("bands"))
        if tried is not None:
            stars = apart(stars, labels).join(tried, ["a", "b"], "left_anti")
        best = stars.groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a"))
        pairs = materialize(best.select("a", "b"), "pairs")
        labels = contract(labels, confirmed(pairs, classes, docs, id_col, text_col, size))
        tried = pairs if tried is None else tried.unionByName(pairs)
        mixed = materialize(still_mixed(shared, labels), "mixed")

    links = links_across(mixed, classes, docs, id_col, text_col, size)
    if links is not None:
        labels = contract(labels, links)

    reps = classes.select("f1", "f2", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    # Rows of one doc_id with different texts hold classes of the same id and so share a label.
    named = relabel(reps, labels, "component_id") if labels is not None else reps
    rows = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends have different labels."""
    both = relabel(relabel(pairs.withColumns({"_la": F.col("a"), "_lb": F.col("b")}), labels, "_la"), labels, "_lb")
    return both.filter("_la <> _lb").drop("_la", "_lb")


def by_band(rows: DataFrame, bands: DataFrame, how: str) -> DataFrame:
    """Join rows to their bands (band, size). Large bands are few and broadcast, so none of their rows is dealt by band.

    Where even they are more than BROADCAST_IDS, all bands are joined alike and skew is left to the adaptive planner.
    """
    hot, small = bands.filter(F.col("size") > SMALL_BAND), bands.filter(F.col("size") <= SMALL_BAND)
    if hot.count() > BROADCAST_IDS:
        return rows.join(bands, "band", how)
    others = rows.join(F.broadcast(hot.select("band")), "band", "left_anti")
    return rows.join(F.broadcast(hot), "band", how).unionByName(others.join(small, "band", how))


def still_mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the bands that hold more than one label, with their labels."""
    labelled = relabel(shared.withColumn("label", F.col("rep")), labels, "label")
    bands = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("size").alias("size"))
    return by_band(labelled, materialize(bands.filter("low <> high").select("band", "size"), "mixed-bands"), "left_semi")


def links_across(mixed: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame | None:
    """Links (a, b) between the components that are left in mixed bands, at least one for each two that have any.

    In small bands, classes without a plausible partner in another component leave first. What is left is gathered into
    clusters by shared bands, and a cluster is cut into blocks of bounded size. Groups of two runs of blocks compare
    signatures and name the classes that have a plausible partner in a block; only those bring their full sets to the
    group of the two blocks, and only confirmed links leave it.
    """
    # A band's size was counted when its leader was found, so no row of a hot band is dealt by band here.
    rows = mixed.select("band", "rep", "label", "lead", (F.col("size") > SMALL_BAND).alias("hot"))
    small = rows.filter("not hot").join(classes.select("rep", "n", "sig"), "rep").withColumnRenamed("lead", "lead_a")
    left = small.select("band", "lead_a", *[F.col(c).alias(f"{c}_a") for c in ("rep", "label", "n", "sig")])
    right = small.select(F.col("band").alias("band_b"), *[F.col(c).alias(f"{c}_b") for c in ("label", "n", "sig")])
    met = (F.col("band") == F.col("band_b")) & (F.col("label_a") != F.col("label_b")) & sizes_allow() & (estimate("sig_a", "sig_b") >= least_estimate())
    paired = left.join(right, met, "left_semi").select(F.col("lead_a").alias("lead"), F.col("rep_a").alias("rep"), F.col("label_a").alias("label"))
    open_rows = materialize(paired.unionByName(rows.filter("hot").select("lead", "rep", "label")).distinct(), "open")
    if open_rows.isEmpty():
        return None
    # The leader stands for its bands, whether it is among the rows or not.
    clusters = contract(None, open_rows.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    members = relabel(open_rows.select("rep", "label").distinct().withColumn("cluster", F.col("rep")), clusters, "cluster")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = materialize(placed.join(classes.select("rep", "n", "sig"), "rep"), "placed")
    run = F.floor(F.col("own") / BLOCKS_AT_ONCE).cast("int")
    met_by = placed.withColumn("run", run).withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / BLOCKS_AT_ONCE).cast("int"))))
    slim = met_by.select("cluster", F.least("run", "other").alias("lo"), F.greatest("run", "other").alias("hi"), "run", "own", "rep", "label", "n", "sig")
    asked = slim.groupBy("cluster", "lo", "hi").applyInPandas(plausible_blocks, "cluster long, rep long, lo int, hi int")
    asked = materialize(asked.distinct(), "asked")
    if asked.isEmpty():
        return None
    sets = materialize(full_sets(docs, asked.select("rep").distinct(), id_col, text_col, size), "sets")
    own = placed.select(F.col("rep").alias("own_rep"), "own", "label", "sig")
    pairs = asked.join(own, F.col("rep") == F.col("own_rep")).join(sets, "rep").select("cluster", "lo", "hi", "own", "rep", "label", "sig", "set")
    return pairs.groupBy("cluster", "lo", "hi").applyInPandas(compare_blocks, "a long, b long")


def agreeing(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Similarities estimated between many signatures and one."""
    words = HASHES // 64
    differ = np.zeros((len(sig), words), dtype=U64)
    for p in range(BITS):
        differ |= sig[:, p * words : (p + 1) * words] ^ one[p * words : (p + 1) * words]
    chance = 2.0**-BITS
    return (1 - np.bitwise_count(differ).sum(axis=1) / HASHES - chance) / (1 - chance)


def plausible_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """For two runs of blocks (or one and itself): the classes that have a plausible partner in a block, by block pair.

    Both partners are named, so at most as many rows come out as there are classes times blocks of a run.
    """
    rows = rows.sort_values("rep", kind="stable")
    lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
    left, right = rows[rows["run"] == lo], rows[rows["run"] == hi]
    if left.empty or right.empty:
        return pd.DataFrame({"cluster": [], "rep": [], "lo": [], "hi": []}, dtype="int64")
    sig = np.stack(right["sig"].to_numpy()).view(U64)
    label, n, block = (right[c].to_numpy() for c in ("label", "n", "own"))
    # Which blocks of the other run hold a partner of each class.
    left_hit, right_hit = np.zeros((len(left), BLOCKS_AT_ONCE), dtype=bool), np.zeros((len(right), BLOCKS_AT_ONCE), dtype=bool)
    for row, (own, own_label, own_n, own_sig) in enumerate(left[["own", "label", "n", "sig"]].itertuples(index=False)):
        fits = (label != own_label) & (np.minimum(n, own_n) * SHARE[1] >= np.maximum(n, own_n) * SHARE[0])
        if fits.any():
            partners = np.flatnonzero(fits & (agreeing(sig, np.asarray(own_sig).view(U64)) >= least_estimate()))
            left_hit[row, block[partners] % BLOCKS_AT_ONCE] = True
            right_hit[partners, own % BLOCKS_AT_ONCE] = True
    parts = []
    for side, hit, first in ((left, left_hit, hi), (right, right_hit, lo)):
        row, other = np.nonzero(hit)
        own, other = side["own"].to_numpy()[row], other + first * BLOCKS_AT_ONCE
        parts.append(pd.DataFrame({"rep": side["rep"].to_numpy()[row], "lo": np.minimum(own, other), "hi": np.maximum(own, other)}))
    found = pd.concat(parts).drop_duplicates()
    return found.assign(cluster=rows["cluster"].iloc[0])[["cluster", "rep", "lo", "hi"]].astype("int64")


def compare_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links between two blocks (or within one): one for each two components that have any."""
    rows = rows.sort_values("rep", kind="stable")
    left, right = rows[rows["own"] == rows["lo"]], rows[rows["own"] == rows["hi"]]
    none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
    if left.empty or right.empty:
        return none
    sets = [np.frombuffer(x, dtype=U64) for x in right["set"]]
    sizes = np.array([x.size for x in sets])
    hashes, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    holders = np.repeat(np.arange(len(sets)), sizes)[order]
    starts = np.r_[0, np.cumsum(np.bincount(at, minlength=hashes.size))]
    sig = np.stack(right["sig"].to_numpy()).view(U64)
    rep, label = right["rep"].to_numpy(), right["label"].to_numpy()
    a, b, seen = [], [], set()
    for own, own_label, own_sig, data in zip(left["rep"], left["label"], left["sig"], left["set"], strict=True):
        likely = (agreeing(sig, np.asarray(own_sig).view(U64)) >= least_estimate()) & (label != own_label)
        if not likely.any():
            continue
        own_set = np.frombuffer(data, dtype=U64)
        place = np.minimum(np.searchsorted(hashes, own_set), hashes.size - 1)
        place = place[hashes[place] == own_set]
        counts = starts[place + 1] - starts[place]
        posted = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[place], counts)
        shared = np.bincount(holders[posted], minlength=len(sets))
        linked = likely & (shared * SHARE[1] >= (own_set.size + sizes - shared) * SHARE[0])
        for n in np.flatnonzero(linked):
            key = (min(own_label, label[n]), max(own_label, label[n]))
            if key not in seen:
                seen.add(key)
                a.append(own)
                b.append(rep[n])
    return pd.DataFrame({"a": a, "b": b}, dtype="int64") if a else none


def confirmed(pairs: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough; the signatures sort out the others first."""
    likely = materialize(plausible(pairs, signed), "likely")
    sets = full_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), id_col, text_col, size)
    return confirm(likely, materialize(sets, "sets"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Keep one document of each component."""
    found = near_duplicates(docs, id_col, text_col, size).filter("not kept").select(F.col("doc_id").alias("dropped"))
    gone = materialize(found.distinct(), "dropped")
    few = gone.count() <= BROADCAST_IDS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(id_col).cast("long").alias("id"))
    return rows.join(F.broadcast(gone) if few else gone, F.col("id") == F.col("dropped"), "left_anti").select("own.*")


def op7_minhash_dedup(spark, sf_dir):
    """Near duplicates among all documents."""
    bound_batches(spark)
    return near_duplicates(read_spread(spark, sf_dir, "documents", "doc_id", "text"), size=OP7_SHINGLE)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
meets AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM meets JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, p.component_id, d.doc_id = p.component_id AS kept
FROM documents d JOIN parts p USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""
