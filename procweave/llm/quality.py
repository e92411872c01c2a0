"""Quality classifier: naive-Bayes features, linear support vectors, dual coordinate descent.

A text's features are the indicators of its byte n-grams, hashed to a fixed number of bins, and of the n-grams of its
words' repetition (whether a word is the same as the one before it). Each indicator is scaled by
the log ratio of the two classes' smoothed counts, the scaled vector is set to length one, and a linear hinge-loss model
is fitted by dual coordinate descent. A logistic curve, fitted on rows that the model has not seen, turns margins into
scores from 0 to 1.

The model is fitted on a bounded sample of labelled rows (FIT_ROWS, those first in the order of a hash of their id);
scoring reads every whole text in one narrow pass.

Defined results: null text counts as empty; an empty text gets the score of the bias alone. Labels that are null take no
part, a doc_id with several labels counts once (the largest), and several texts of one doc_id are fitted once (the
smallest). With fewer than two classes in the sample every score is the share of the one class (0.5 without any).
Extra columns pass through, except those named as the added ones, which are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.llm.shared import bound_batches, read_spread, text_runs

#: The most labelled rows that the model is fitted on.
FIT_ROWS = 6000

#: Feature bins, n-gram sizes in bytes, the loss's weight, passes over the sample, and smoothing of counts.
BYTE_BINS, SIZES, COST, PASSES, SMOOTH = 1 << 16, (1, 2, 3), 1.0, 12, 1.0

#: Bins after those of the bytes: one for each pattern of REPEATS words that repeat the word before or do not.
REPEATS = 4
BINS = BYTE_BINS + (1 << REPEATS)

#: Bytes of texts that are Python strings at once; a single longer text is alone.
RUN_BYTES = 4_000_000

#: Scores from here on mean label 1.
THRESHOLD = 0.3


def features(text: str) -> np.ndarray:
    """The bins of a text's byte and repetition n-grams, in order and once each."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    hit = np.zeros(BINS, dtype=bool)
    code = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        if n in SIZES:
            mixed = (code + np.uint32(n << 29)) * np.uint32(2654435761)
            hit[mixed >> np.uint32(16)] = True
    words = text.split()
    same = np.fromiter(map(eq, words[1:], words), dtype=np.int64, count=max(0, len(words) - 1))
    if len(same) >= REPEATS:
        pattern = sum(same[n : len(same) - REPEATS + 1 + n] << n for n in range(REPEATS))
        hit[BYTE_BINS:] = np.bincount(pattern, minlength=1 << REPEATS) > 0
    return np.flatnonzero(hit)


class Model:
    """Weights that already hold the count ratios, the bias, and the curve from margin to score."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.ratio, self.weight, self.bias, self.slope, self.shift = ratio, weight, bias, slope, shift
        self.square = ratio**2
        self.product = ratio * weight

    def margin(self, bins: np.ndarray) -> float:
        length = np.sqrt(self.square[bins].sum())
        return self.bias + (self.product[bins].sum() / length if length > 0 else 0.0)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -500, 500))))


def count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of the classes' smoothed and normalised indicator counts."""
    counts = np.full((2, BINS), SMOOTH)
    for bins, label in zip(rows, labels, strict=True):
        counts[label, bins] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def descend(rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with a bias term; classes weigh the same in total."""
    sign = np.where(labels == 1, 1.0, -1.0)
    most = COST * len(labels) / (2 * np.bincount(labels, minlength=2))[labels]
    values = []
    for bins in rows:
        x = ratio[bins]
        length = np.sqrt((x**2).sum())
        values.append((x / length if length > 0 else x).astype(np.float32))
    # The bias is a feature of value 1.
    curve = np.array([(x.astype(np.float64) ** 2).sum() + 1.0 for x in values])
    alpha, weight, bias = np.zeros(len(rows)), np.zeros(BINS), 0.0
    random = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in random.permutation(len(rows)):
            slack = sign[i] * (weight[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slack / curve[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight, bias


def curve_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with targets kept off 0 and 1."""
    up, down = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on four rows of five, set the curve on the fifth."""
    flat = np.zeros(BINS)
    if len(set(labels.tolist())) < 2:
        share = labels.mean() if len(labels) else 0.5
        return Model(flat, flat, 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    aside = np.zeros(len(rows), dtype=bool)
    for label in (0, 1):
        aside[np.flatnonzero(labels == label)[4::5]] = True
    part = lambda mask: [r for r, m in zip(rows, mask, strict=True) if m]
    ratio = count_ratios(part(~aside), labels[~aside])
    weight, bias = descend(part(~aside), ratio, labels[~aside])
    model = Model(ratio, weight, bias, 1.0, 0.0)
    seen = aside if len(set(labels[aside].tolist())) == 2 else np.ones(len(rows), dtype=bool)
    margins = np.array([model.margin(r) for r in part(seen)])
    model.slope, model.shift = curve_fit(margins, labels[seen])
    return model


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit the model on at most fit_rows labelled rows outside the held-out fold."""
    rows = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max(label_col).alias("label"))
        .orderBy(F.md5(F.col("label_id").cast("string")), "label_id")
        .limit(fit_rows)
    )
    # At most fit_rows pairs of numbers are broadcast, so no text is shuffled but the sample's.
    sample = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(rows), "label_id")
    sample = sample.groupBy("label_id", "label").agg(F.min("text").alias("text"))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for text in batch["text"]:
                hit = np.zeros(BINS, dtype=bool)
                hit[features(text)] = True
                packed.append(np.packbits(hit).tobytes())
            yield batch[["label_id", "label"]].assign(bits=packed)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat([pd.DataFrame({"label_id": [], "label": [], "bits": []}), *batches]).sort_values("label_id", kind="stable")
        rows = [np.flatnonzero(np.unpackbits(np.frombuffer(b, dtype=np.uint8))).astype(np.int32) for b in whole["bits"]]
        model = fit(rows, whole["label"].to_numpy(dtype=np.int64))
        yield pd.DataFrame({"ratio": [model.ratio.tobytes()], "weight": [model.weight.tobytes()], "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    marked = sample.mapInPandas(bits, "label_id long, label int, bits binary")
    fitted = marked.coalesce(1).mapInPandas(learn, "ratio binary, weight binary, bias double, slope double, shift double").collect()
    if not fitted:
        return fit([], np.zeros(0, dtype=np.int64))
    row = fitted[0]
    vector = lambda b: np.frombuffer(bytes(b), dtype=np.float64)
    return Model(vector(row["ratio"]), vector(row["weight"]), row["bias"], row["slope"], row["shift"])


def score_column(model: Model):
    """A Spark column function: the score of a text column."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(text) for run in text_runs(batch, RUN_BYTES) for text in run], pa.float64())

    return score


def score_docs(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score and predicted to every row."""
    scored = docs.withColumn("score", score_column(model)(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op5_quality_classifier(spark, sf_dir):
    """Score every document; the model never sees the held-out fold."""
    bound_batches(spark)
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    held = docs.withColumn("held_out", fold(F.col("doc_id")) == 0)
    return score_docs(held, model).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a model fitted on them and their labels does not reject, with their own columns, whatever their names."""
    model = train(docs, labels)
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), score_column(model)(F.coalesce(F.col("text"), F.lit(""))).alias("score"))
    return scored.filter(F.col("score") >= THRESHOLD).select("own.*")
