"""Language identification in two steps: the family first, then one-versus-one support vectors within the family.

A text's features are counts of its byte n-grams, hashed to a fixed number of bins. Letters are lower-cased and runs of
anything that is no letter become one space, so punctuation, digits and markup say nothing. Texts are read piece by piece
straight from Arrow's buffers: only one piece is ever unpacked.

1. The family is the one under which the n-grams are most likely (multinomial naive Bayes over the family's counts).
2. Within the family, each pair of languages has a linear hinge-loss model over square roots of counts at length one,
   fitted by dual coordinate descent; the language with most votes wins, ties go to the larger sum of margins.

The model is fitted on a bounded sample (FIT_ROWS rows at most, as many of each language, drawn by hashes of their ids);
prediction reads every whole text in one narrow pass.

Defined results: texts that are null or hold no letter are `und` with score 0, as is everything where nothing could be
learned. Only rows with text, lang and doc_id that hold a letter are learned from; a doc_id with several rows is fitted once
(the smallest language, then text). A language that FAMILIES does not name is a family of its own. One learned language
alone is predicted for all texts with a letter, with score 1. Extra columns pass through, except those named as the added
ones, which are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.shared import bound_batches, read_spread

#: Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "hi", "mr", "ne", "pa", "ur"),
    "malayic": ("id", "ms"),
}

#: The most rows that the model is fitted on.
FIT_ROWS = 4000

#: Feature bins, the longest n-gram in bytes, bytes of a piece, the loss's weight, passes over the sample, smoothing of counts.
BINS, LONGEST, PIECE, COST, PASSES, SMOOTH = 1 << 15, 4, 1 << 20, 4.0, 20, 0.5

#: The most languages whose cuts are broadcast.
SENT_LANGUAGES = 100_000

UNKNOWN = "und"

LETTER = r"\p{L}"

SPACE = 32


def byte_table() -> np.ndarray:
    """What each byte becomes: A-Z lower case, other ASCII a space, bytes of other characters themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = SPACE
    small = np.arange(ord("a"), ord("z") + 1)
    table[small] = small
    table[small - 32] = small
    return table


BYTES = byte_table()


def plain(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with letters lower-cased and every run of ASCII characters that are no letters as one space.

    Of letters beyond ASCII, those of Latin-1 are lower-cased; the others stay.
    """
    out = BYTES[data]
    high = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
    out[upper] += 0x20
    gap = out == SPACE
    gap[1:] &= out[:-1] == SPACE
    gap[:1] = False
    return out[~gap]


def counts(data: np.ndarray) -> np.ndarray:
    """Counts of a text's hashed n-grams of 1 to LONGEST bytes, with a space before and after."""
    total, tail = np.zeros(BINS, dtype=np.int64), np.array([SPACE], dtype=np.uint8)
    for start in range(0, max(len(data), 1), PIECE):
        # A letter of two bytes may be cut in two: the piece begins with the last byte of the one before.
        piece = data[max(0, start - 1) : start + PIECE]
        clean = plain(piece)[1 if start else 0 :]
        if tail[-1] == SPACE and len(clean) and clean[0] == SPACE:
            clean = clean[1:]
        last = start + PIECE >= len(data)
        total += grams(tail, clean, last)
        tail = np.concatenate([tail, clean])[-(LONGEST - 1) :]
    return total


def grams(before: np.ndarray, clean: np.ndarray, last: bool) -> np.ndarray:
    """Counts of the n-grams that end in clean (and in a closing space, if it is the last piece)."""
    ending = [np.array([SPACE], dtype=np.uint8)] if last and (clean[-1] if len(clean) else before[-1]) != SPACE else []
    whole = np.concatenate([before, clean, *ending]).astype(np.uint32)
    total = np.zeros(BINS, dtype=np.int64)
    code = np.zeros(len(whole), dtype=np.uint32)
    for n in range(1, min(LONGEST, len(whole)) + 1):
        code = (code[: len(whole) - n + 1] << np.uint32(8)) | whole[n - 1 :]
        new = code[max(0, len(before) - n + 1) :]
        mixed = (new ^ np.uint32(n * 0x9E3779B)) * np.uint32(2654435761)
        total += np.bincount(mixed >> np.uint32(17), minlength=BINS)
    return total


def texts_of(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each text's bytes, straight from the column's buffer; None for null."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield whole[at[i] : at[i + 1]] if valid[i] else None


class Pair:
    """A linear model between two languages: a positive margin is for the second."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float = 1.0):
        self.weight, self.bias, self.slope = weight, bias, slope

    def margin(self, bins: np.ndarray, values: np.ndarray) -> float:
        return float(self.weight[bins] @ values + self.bias)


class Model:
    """Log likelihoods of every family's n-grams, and a pair model for every two languages of a family."""

    def __init__(self, families: dict[str, list[str]], likely: np.ndarray, sharpness: float, pairs: dict[tuple[str, str], Pair]):
        self.families, self.names, self.likely, self.sharpness, self.pairs = families, sorted(families), likely, sharpness, pairs

    def predict(self, hits: np.ndarray) -> tuple[str, float]:
        """Language and score of a text with these counts."""
        bins = np.flatnonzero(hits)
        if not self.names or not bins.size:
            return UNKNOWN, 0.0
        place, sure = self.family(bins, hits[bins])
        own = self.families[self.names[place]]
        language, agreed = self.vote(own, bins, unit(hits[bins]))
        return language, sure * agreed

    def family(self, bins: np.ndarray, held: np.ndarray) -> tuple[int, float]:
        """The most likely family, and how sure that is."""
        likely = self.likely[:, bins] @ held / held.sum()
        odds = np.exp(np.clip(self.sharpness * (likely - likely.max()), -500, 0))
        return int(likely.argmax()), float(1 / odds.sum())

    def vote(self, languages: list[str], bins: np.ndarray, values: np.ndarray) -> tuple[str, float]:
        """The language with most votes of its pairs, and the mean of what they give it."""
        votes, margins, given = ({x: 0.0 for x in languages} for _ in range(3))
        for one, two in combinations(languages, 2):
            pair = self.pairs[one, two]
            margin = pair.margin(bins, values)
            share = 1 / (1 + np.exp(-np.clip(pair.slope * margin, -500, 500)))
            for language, sign, part in ((one, -1, 1 - share), (two, 1, share)):
                votes[language] += sign * margin > 0
                margins[language] += sign * margin
                given[language] += part
        best = max(languages, key=lambda x: (votes[x], margins[x]))
        return best, float(given[best] / (len(languages) - 1)) if len(languages) > 1 else 1.0


def unit(held: np.ndarray) -> np.ndarray:
    """Square roots of counts, at length one."""
    return np.sqrt(held / held.sum())


def descend(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, seed: int = 13) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with a bias term; both classes weigh the same in total."""
    share = np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum())
    most = COST * len(sign) / (2 * share)
    alpha, weight, bias = np.zeros(len(rows)), np.zeros(BINS), 0.0
    random = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in random.permutation(len(rows)):
            bins, values = rows[i]
            # Values have length one, the bias is a feature of value 1: the curvature is 2.
            slack = sign[i] * (weight[bins] @ values + bias) - 1
            new = min(max(alpha[i] - slack / 2, 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[bins] += step * values
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight, bias


def slope_of(margins: np.ndarray, sign: np.ndarray) -> float:
    """The slope, out of powers of the square root of two, of the logistic curve that fits the margins best."""
    slopes = 2.0 ** np.arange(-2, 6, 0.5)
    return float(min(slopes, key=lambda slope: np.logaddexp(0, -slope * margins * sign).sum()))


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), f"of its own: {language}")


def fit(rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """Fit on rows of (bins, counts): four of five for the models, the fifth for the curves."""
    families: dict[str, list[str]] = {}
    for language in sorted(set(languages)):
        families.setdefault(family_of(language), []).append(language)
    names = sorted(families)
    seat = {}
    aside = np.zeros(len(rows), dtype=bool)
    for i, language in enumerate(languages):
        seat[language] = seat.get(language, -1) + 1
        aside[i] = seat[language] % 5 == 4
    of_family = np.array([names.index(family_of(x)) for x in languages], dtype=np.int64)
    seen = np.full((len(names), BINS), SMOOTH)
    for (bins, held), family, left_out in zip(rows, of_family, aside, strict=True):
        if not left_out:
            seen[family, bins] += held
    likely = np.log(seen / seen.sum(axis=1, keepdims=True)) if names else seen
    model = Model(families, likely, 1.0, {})
    model.sharpness = sharpness_of(model, [r for r, a in zip(rows, aside, strict=True) if a], of_family[aside])
    for members in families.values():
        for one, two in combinations(members, 2):
            own = [i for i, x in enumerate(languages) if x in (one, two)]
            values = [(rows[i][0], unit(rows[i][1])) for i in own]
            sign = np.array([1.0 if languages[i] == two else -1.0 for i in own])
            left_out = aside[own]
            pick = lambda mask, values=values: [v for v, m in zip(values, mask, strict=True) if m]
            pair = Pair(*descend(pick(~left_out), sign[~left_out]))
            if left_out.any():
                pair.slope = slope_of(np.array([pair.margin(*v) for v in pick(left_out)]), sign[left_out])
            model.pairs[one, two] = pair
    return model


def sharpness_of(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray) -> float:
    """The power of two by which the families' mean log likelihoods become odds, so that rows left aside fit best."""
    if not rows:
        return 1.0
    likely = np.stack([model.likely[:, bins] @ held / held.sum() for bins, held in rows])
    loss = lambda power: (np.log(np.exp(power * (likely - likely.max(axis=1, keepdims=True))).sum(axis=1)) - power * (likely[np.arange(len(rows)), truth] - likely.max(axis=1))).sum()
    return float(min(2.0 ** np.arange(-2, 8), key=loss))


def fold(doc_id: Column) -> Column:
    """The remainder, from 0 to 3, that decides whether a document is held out (2)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4))


HELD_OUT = 2


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit the model on at most fit_rows rows outside the held-out fold, as many of each language as can be."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & (fold(F.col("id")) != HELD_OUT))
    # As many rows of each language as there is room for: about twice as many get a rank, chosen by a hash, so that no task
    # ranks all rows of a frequent language.
    per_lang = known.groupBy("lang").agg(F.count("*").alias("rows"))
    languages = per_lang.count()
    share = max(1, -(-fit_rows // max(1, languages)))
    cuts = per_lang.select(F.col("lang").alias("cut_lang"), (F.lit(2.0 * share + 100) / F.col("rows")).alias("cut"))
    near = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / float(1 << 20) < F.col("cut")
    # A bounded number of languages is sent to all tasks, so that rows are left out before they are dealt by language.
    cuts = F.broadcast(cuts) if languages <= SENT_LANGUAGES else cuts
    some = known.select("id", "lang").join(cuts, (F.col("lang") == F.col("cut_lang")) & near).select("id", "lang")
    hashed = F.md5(F.col("id").cast("string"))
    drawn = some.withColumn("rank", F.dense_rank().over(Window.partitionBy("lang").orderBy(hashed, "id"))).filter(F.col("rank") <= share)
    drawn = drawn.groupBy("id").agg(F.min("lang").alias("drawn_lang"), F.min("rank").alias("rank")).orderBy("rank", F.md5(F.col("id").cast("string")), "id").limit(fit_rows)
    sample = known.join(F.broadcast(drawn.select(F.col("id").alias("drawn_id"), "drawn_lang")), (F.col("id") == F.col("drawn_id")) & (F.col("lang") == F.col("drawn_lang")))
    sample = sample.groupBy("id", "lang").agg(F.min("text").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for text in texts_of(batch.column("text")):
                hits = counts(text)
                bins = np.flatnonzero(hits)
                held.append((bins.astype(np.int32).tobytes(), hits[bins].astype(np.float64).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("lang"), pa.array([b for b, _ in held], pa.binary()), pa.array([h for _, h in held], pa.binary())], names=["id", "lang", "bins", "held"])

    packed = sample.select(F.col("id").cast("string").alias("id"), "lang", "text").mapInArrow(pack, "id string, lang string, bins binary, held binary")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat([pd.DataFrame({"id": [], "lang": [], "bins": [], "held": []}), *batches]).sort_values(["lang", "id"], kind="stable")
        rows = [(np.frombuffer(b, dtype=np.int32), np.frombuffer(h, dtype=np.float64)) for b, h in zip(whole["bins"], whole["held"], strict=True)]
        model = fit(rows, list(whole["lang"]))
        yield pd.DataFrame([{"kind": "family", "name": ",".join(model.families[name]), "other": "", "numbers": model.likely[i].tobytes(), "bias": 0.0, "slope": model.sharpness} for i, name in enumerate(model.names)])
        yield pd.DataFrame([{"kind": "pair", "name": one, "other": two, "numbers": p.weight.tobytes(), "bias": p.bias, "slope": p.slope} for (one, two), p in model.pairs.items()])

    told = packed.coalesce(1).mapInPandas(learn, "kind string, name string, other string, numbers binary, bias double, slope double").collect()
    vector = lambda row: np.frombuffer(bytes(row["numbers"]), dtype=np.float64)
    families = sorted([r for r in told if r["kind"] == "family"], key=lambda r: family_of(r["name"].split(",")[0]))
    by_name = {family_of(r["name"].split(",")[0]): r["name"].split(",") for r in families}
    likely = np.stack([vector(r) for r in families]) if families else np.zeros((0, BINS))
    pairs = {(r["name"], r["other"]): Pair(vector(r), r["bias"], r["slope"]) for r in told if r["kind"] == "pair"}
    return Model(by_name, likely, families[0]["slope"] if families else 1.0, pairs)


def predicted(model: Model):
    """A Spark column function: language and score of a text column."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            said = [model.predict(counts(text)) if text is not None else (UNKNOWN, 0.0) for text in texts_of(batch)]
            yield pa.array([{"lang": language, "score": score} for language, score in said], kind)

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score to every row; texts without a letter are not looked at."""
    text = F.when(F.col(text_col).rlike(LETTER), F.col(text_col))
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), predicted(model)(text).alias("said"))
    kept = [F.col(f"own.`{c}`") for c in docs.columns if c.lower() not in names]
    return judged.select(*kept, F.col("said.lang").alias(names[0]), F.col("said.score").alias(names[1]))


def op13_language_id(spark, sf_dir):
    """The language of every document; the model never sees the held-out fold."""
    bound_batches(spark)
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs)
    said = identify(docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text"), model)
    return said.select("doc_id", "held_out", "lang_pred", "score")
