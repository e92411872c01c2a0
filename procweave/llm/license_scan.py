"""License scan by diagonal voting, with DataFrame functions only.

Every rolling k-gram of a text's words joins the k-gram positions of the license templates on its hash (and, so that
no hash collision votes, on the words themselves). A match at document position d and template position t votes for
the diagonal d - t. Neighbouring diagonals of one template form a band; within a band, diagonals that also touch in the
text merge into a span. A span is verified on its words: the distinct words of the text and of the template that stand
in some matching k-gram must cover enough of the span and of the template. Where spans of different templates overlap,
as licenses share sentences, the one that covers most words stays. Besides, fixed phrases are counted wherever their
words stand consecutively.

One pass over the texts: every text also emits marker rows with its own figures, so the rows that meet in the one
shuffle are the matches and a slim row for each text. Long texts are cut into pieces of bounded size at the ends of words;
each piece takes along the last words before it, so no k-gram and no phrase is lost at a cut, and none counts twice.

Defined results: null text counts as empty, with 0 words, no labels and score 0. Rows are told apart by an id of
their own, so repeated rows and doc_id stay separate. Extra columns are not carried. Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.license_texts import TEXTS as TEMPLATES
from procweave.llm.shared import ascii_lower, read_spread

#: What separates lower-cased words, and what words are made of before.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words in a k-gram; how far apart diagonals may lie to merge; least share of a span's words that match.
K, GAP, LEAST_COVER = 4, 3, 0.6

#: Words of a template that have to match: so many, or of a short template this share.
LEAST_WORDS, LEAST_SHARE = 12, 0.8

#: Characters of a piece of a long text (and the rest of the word that it ends in).
PIECE = 200_000


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    pieces = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS)
    return F.filter(pieces, lambda w: w != "")


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """Structs (at, end, label) for every place where a phrase's words stand consecutively; end is the last word's place."""
    parts = [(phrase.split(), label) for phrase, label in phrases.items()]
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    # Few places hold a phrase's first word; only those are looked at further.
    begun = F.filter(every, lambda i: F.get(words, i).isin(*sorted({p[0] for p, _ in parts})))

    def label_at(i):
        found, end = F.lit(None).cast("string"), F.lit(None).cast("long")
        for phrase, label in parts:
            test = F.get(words, i) == phrase[0]
            for n, word in enumerate(phrase[1:], 1):
                test = test & (F.get(words, i + n) == word)
            found, end = F.when(test, F.lit(label)).otherwise(found), F.when(test, (i + len(phrase) - 1).cast("long")).otherwise(end)
        return F.struct(i.cast("long").alias("at"), end.alias("end"), found.alias("label"))

    return F.filter(F.transform(begun, label_at), lambda p: p["label"].isNotNull())


def grams(words: Column, first: Column, k: int) -> Column:
    """All rolling k-grams from a word on; none if there are fewer than k words."""
    return F.when(
        F.size(words) >= first + k,
        F.transform(F.sequence(first, F.size(words) - k), lambda i: F.concat_ws(" ", *[F.get(words, i + n) for n in range(k)])),
    ).otherwise(F.array().cast("array<string>"))


def pieces_of(text: Column, keep: int) -> Column:
    """A text in pieces: structs (part, offset: words before it, tail: the last ``keep`` of them)."""
    none = F.array().cast("array<string>")
    whole = F.array(F.struct(text.alias("part"), F.lit(0).cast("long").alias("offset"), none.alias("tail")))
    # Every piece ends where a word does: what is left of a word goes to the piece that it began in.
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}{WORD}*+"), F.lit(0))
    last = lambda words: F.slice(words, F.greatest(F.size(words) - keep + 1, F.lit(1)), keep)
    # An array of one value names the words, so they are made once.
    facts = F.transform(cut, lambda c: F.transform(F.array(words_of(c)), lambda w: F.struct(c.alias("part"), F.size(w).cast("long").alias("n"), last(w).alias("last")))[0])
    start = F.struct(F.filter(whole, lambda p: p["offset"] > 0).alias("out"), F.lit(0).cast("long").alias("offset"), none.alias("tail"))

    def add(held, piece):
        out = F.concat(held["out"], F.array(F.struct(piece["part"].alias("part"), held["offset"].alias("offset"), held["tail"].alias("tail"))))
        return F.struct(out.alias("out"), (held["offset"] + piece["n"]).alias("offset"), last(F.concat(held["tail"], piece["last"])).alias("tail"))

    return F.when(F.length(text) <= PIECE, whole).otherwise(F.aggregate(facts, start, add, lambda held: held["out"]))


def template_grams(spark, templates: dict[str, str], k: int) -> DataFrame:
    """The templates' k-grams with their positions: bounded by the templates, so it may be broadcast."""
    rows = []
    for name, text in templates.items():
        words = [w for w in re.split(BETWEEN_WORDS, text.lower()) if w]
        rows += [(name, i, len(words), " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    made = spark.createDataFrame(rows, "template string, t long, t_words long, t_gram string")
    return made.withColumn("t_hash", F.xxhash64("t_gram"))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    k: int = K,
) -> DataFrame:
    """One row per input row: n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    score is 1 where a phrase stands, else the best share of a template that verified spans cover. spans holds the
    verified spans (first word, last word, template, words of the text and of the template that match).
    """
    spark = docs.sparkSession
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    marker = "\u0000"
    index = template_grams(spark, templates, k)
    index = index.unionByName(
        spark.createDataFrame([(None, -1, 0, marker)], "template string, t long, t_words long, t_gram string").withColumn("t_hash", F.xxhash64("t_gram"))
    )
    # The words that a piece takes along: enough for a k-gram or a phrase that ends with its first own word.
    keep = max(k, *(len(p.split()) for p in phrases)) - 1
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("row", "id", F.explode(pieces_of(F.col("text"), keep)).alias("piece"))
    own_words = words_of(F.col("piece.part"))
    pieces = texts.select(
        "row",
        "id",
        F.size("piece.tail").alias("taken"),
        F.col("piece.offset").alias("offset"),
        # Exploded, one row a piece, so that the planner makes the words once and not at each of their uses.
        F.explode(F.array(F.concat("piece.tail", own_words))).alias("words"),
    )
    # What ends among the words taken along was counted before.
    places = F.filter(phrase_places(F.col("words"), phrases), lambda p: p["end"] >= F.col("taken"))
    pieces = pieces.select("row", "id", "taken", "offset", "words", F.explode(F.array(places)).alias("places"))
    # A piece's own figures are made before its k-grams are dealt out, so that no row carries the words along.
    before = F.col("offset") - F.col("taken")
    facts = F.struct(
        "id",
        (F.size("words") - F.col("taken")).cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        (F.array_min("places.at") + before).alias("first_word"),
        (F.array_max("places.at") + before).alias("last_word"),
        F.array_distinct("places.label").alias("base"),
    )
    first = F.greatest(F.col("taken") - (k - 1), F.lit(0))
    # The marker stands before the piece's own k-grams.
    dealt = pieces.select("row", facts.alias("own"), (before + first).alias("start"), F.concat(F.array(F.lit(marker)), grams(F.col("words"), first, k)).alias("grams"))
    rolled = dealt.select("row", "own", "start", F.posexplode("grams").alias("pos", "gram"))
    marked = F.col("pos") == 0
    rolled = rolled.select("row", F.when(marked, F.col("own")).alias("own"), F.when(marked, -1).otherwise(F.col("start") + F.col("pos") - 1).alias("d"), "gram")
    # Broadcast up to a bounded size, as the templates are a parameter.
    few = sum(map(len, templates.values())) <= BROADCAST_CHARS
    votes = rolled.join(F.broadcast(index) if few else index, (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    spans = best_spans(verified_spans(votes.select("row", "own", "template", "d", "t", "t_words").repartition("row"), k))
    per_row = spans.groupBy("row").agg(
        *own_figures(),
        F.collect_set(F.split_part("template", F.lit("/"), F.lit(1))).alias("method"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("matched") / F.greatest(F.col("t_words"), F.lit(1)))), F.lit(0.0)).alias("share"),
        F.array_sort(F.collect_list(F.when(F.col("template").isNotNull(), F.struct("first", "last", "template", "covered", "matched")))).alias("spans"),
    )
    return per_row.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "method")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("share")).alias("score"),
        "spans",
    )


#: Characters of all templates up to which their k-grams are broadcast.
BROADCAST_CHARS = 5_000_000


def own_figures(of: str = "") -> list[Column]:
    """A text's own figures, from those of its marker rows."""
    return [
        F.first(f"{of}id", ignorenulls=True).alias("id"),
        F.sum(f"{of}n_words").alias("n_words"),
        F.sum(f"{of}n_base").alias("n_base"),
        F.min(f"{of}first_word").alias("first_word"),
        F.max(f"{of}last_word").alias("last_word"),
        F.array_distinct(F.flatten(F.collect_list(f"{of}base"))).alias("base"),
    ]


FIGURES = ("id", "n_words", "n_base", "first_word", "last_word", "base")


def covered_words(starts: Column, k: int) -> Column:
    """How many words the k-grams that begin at these distinct places cover."""
    places = F.array_sort(starts)
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(b - a, F.lit(k)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda held, step: held + F.coalesce(step, F.lit(k)))


def verified_spans(votes: DataFrame, k: int) -> DataFrame:
    """Spans whose words cover enough, and one row without a template for each text, with its figures.

    Arrays hold the places of one diagonal or span: no more than a template has k-grams, times its merged neighbours.
    """
    diagonals = votes.groupBy("row", "template", (F.col("d") - F.col("t")).alias("diagonal")).agg(
        *own_figures("own."), F.max("t_words").alias("t_words"), F.min("d").alias("first"), F.max("d").alias("last"), F.collect_set(F.when(F.col("template").isNotNull(), F.col("d"))).alias("ds")
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > GAP, F.lit(True))
    banded = diagonals.withColumn("far", far.cast("int")).withColumn("band", F.sum("far").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    # In a band, those that also touch in the text belong to one span.
    by_place = Window.partitionBy("row", "template", "band").orderBy("first", "diagonal")
    reached = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first") > reached + k + GAP, F.lit(True))
    numbered = banded.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("row", "template", "band", "span").agg(
        *own_figures(),
        F.max("t_words").alias("t_words"),
        F.min("first").alias("first"),
        (F.max("last") + k - 1).alias("last"),
        F.array_distinct(F.flatten(F.collect_list("ds"))).alias("ds"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("ds", lambda d: d - F.col("diagonal"))))).alias("ts"),
    )
    measured = spans.select("row", "template", *FIGURES, "t_words", "first", "last", covered_words(F.col("ds"), k).alias("covered"), covered_words(F.col("ts"), k).alias("matched"))
    sound = (F.col("covered") >= LEAST_COVER * (F.col("last") - F.col("first") + 1)) & (F.col("matched") >= F.least(F.lit(LEAST_WORDS), LEAST_SHARE * F.col("t_words")))
    return measured.filter(F.col("template").isNull() | sound)


def best_spans(spans: DataFrame) -> DataFrame:
    """Drop spans that overlap the one that covers most words among those that they hang together with."""
    marker = F.col("template").isNull()
    by_place = Window.partitionBy("row", marker).orderBy("first", "last", "template")
    reached = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int"))
    island = island.withColumn("island", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct("covered", (F.col("matched") / F.greatest(F.col("t_words"), F.lit(1))).alias("share"), (-F.col("first")).alias("place"), "template", "last")
    best = F.max(rank).over(Window.partitionBy("row", marker, "island"))
    whole = island.withColumn("best", best)
    is_best = (F.col("template") == F.col("best.template")) & (F.col("first") == -F.col("best.place"))
    clear = (F.col("first") > F.col("best.last")) | (F.col("last") < -F.col("best.place"))
    return whole.filter(marker | is_best | clear)


def op6_license_scans(spark, sf_dir):
    """Phrases, license spans and labels of every whole text of documents."""
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    return scan_licenses(docs).drop("spans")
