"""Review text: sentiment, aspects, samples and scorer comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions import text as tx
from tillsight.operators import ranking

# The aspect vocabulary of retail reviews.
RETAIL_ASPECTS = {
    "delivery": ["delivery", "shipping", "arrived", "courier", "postage", "dispatch"],
    "customer_service": ["customer service", "support", "staff", "helpful", "rude", "responded"],
    "product_quality": ["quality", "broke", "faulty", "material", "cheaply made", "well made"],
    "price_value": ["price", "value", "expensive", "cheap", "worth it", "overpriced"],
    "returns_refunds": ["return", "refund", "exchange", "money back"],
}
NEGATION_FACTOR = -0.74
NEGATION_REACH = 3
COMPOUND_ALPHA = 15.0
NEUTRAL_BAND = 0.05
#: Words of a lexicon that is sent to all tasks; the words of texts meet a larger one in a join.
LEXICON_WORDS = 100_000
#: Valences are summed in millionths.
UNITS = 1_000_000

# A scorer takes distinct texts (with their digest) and adds integer `predicted_stars`.
Scorer = Callable[[DataFrame, str], DataFrame]


def score_bucket(score: Column) -> Column:
    return F.when(score <= -NEUTRAL_BAND, "negative").when(score >= NEUTRAL_BAND, "positive").otherwise("neutral")


def star_bucket(stars: Column) -> Column:
    return F.when(stars <= 2, "negative").when(stars >= 4, "positive").otherwise("neutral")


def stars_from_label(label: Column) -> Column:
    """'4 stars' -> 4."""
    return F.substring(label, 1, 1).cast("int")


def stratified_sample(reviews: DataFrame, target: int | None = None, fraction: float | None = None) -> DataFrame:
    """The same share of every star rating, exact per rating and repeatable."""
    if fraction is None:
        total = reviews.count()
        fraction = min(1.0, target / total) if total else 0.0
    return ranking.hashed_sample(reviews, "review_id", fraction, ["stars"])


def lexicon_table(spark: SparkSession, lexicon: dict[str, float]) -> DataFrame:
    rows = [(w, float(v)) for w, v in lexicon.items()]
    return spark.createDataFrame(rows, "word string, valence double")


def lexicon_sentiment(
    df: DataFrame, key: Sequence[str], text: str, lexicon: DataFrame, negators: Sequence[str], name: str = "compound"
) -> DataFrame:
    """key and the compound score in [-1, 1] of every row, from a word-valence table.

    A valence is flipped and damped when one of the three words before it is a
    negator. A small lexicon is sent to all tasks, which look up the words of
    a text where they are; only a text's sum leaves its task. Words meet a
    larger lexicon in a join. One aggregate per key sums up.
    """
    units = _units(lexicon)
    known = _bounded(units)
    if known is not None:
        total = _summed_units(known, negators)(tx.word_pieces(F.col(text)))
        totals = df.select(*key, total.alias("_u")).groupBy(*key).agg((F.sum("_u") / float(UNITS)).alias("_s"))
    else:
        totals = _joined_sums(df.select(*key, tx.words(F.col(text)).alias("_w")), key, units, negators)
    return totals.select(*key, _compound(F.col("_s")).alias(name))


def _compound(s: Column) -> Column:
    return s / F.sqrt(s * s + COMPOUND_ALPHA)


def _units(lexicon: DataFrame) -> DataFrame:
    """word, and its valence alone and after a negator."""
    damped = F.col("valence") * NEGATION_FACTOR
    return lexicon.select("word", *[(x * 1.0).cast("decimal(18,6)").alias(c) for c, x in (("plain", F.col("valence")), ("negated", damped))])


def _bounded(units: DataFrame) -> list | None:
    """The rows of a lexicon of at most LEXICON_WORDS words."""
    known = units.where("word is not null").limit(LEXICON_WORDS + 1).collect()
    return known if len(known) <= LEXICON_WORDS else None


def _summed_units(known, negators: Sequence[str]):
    """A function of lists of `word_pieces`: the sum of the valences of their words, in millionths."""
    found: dict[str, list[int]] = {}
    for r in known:
        sums = found.setdefault(r.word, [0, 0])
        for i, x in enumerate((r.plain, r.negated)):
            sums[i] += 0 if x is None else int(x * UNITS)
    # Text that begins with a separator has an empty piece, which is no word.
    found.pop("", None)
    names, before = list(found), [n for n in negators if n != ""]
    values = np.array([*found.values()], np.int64).reshape(-1, 2)

    @F.arrow_udf("bigint")
    def summed(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        words = lists.flatten()
        place = pc.fill_null(pc.index_in(words, value_set=pa.array(names, words.type)), -1).to_numpy()
        stop = pc.is_in(words, value_set=pa.array(before, words.type)).to_numpy(zero_copy_only=False)
        hits = np.flatnonzero(place >= 0)
        starts = np.concatenate([[0], ends])[np.searchsorted(ends, hits, side="right")]
        negated = np.zeros(len(hits), bool)
        for back in range(1, NEGATION_REACH + 1):
            negated |= (hits - back >= starts) & stop[hits - back]
        running = np.concatenate([[0], np.cumsum(values[place[hits], negated.astype(int)])])
        upto = running[np.searchsorted(hits, ends)]
        return pa.array(np.diff(upto, prepend=0), pa.int64())

    return summed


def _joined_sums(words: DataFrame, key: Sequence[str], units: DataFrame, negators: Sequence[str]) -> DataFrame:
    """Sums of valences by key from a row for each word, for a lexicon of any size."""
    stop = F.array(*[F.lit(n) for n in negators]) if negators else F.array().cast("array<string>")

    def mark(word: Column, i: Column) -> Column:
        before = F.slice(F.col("_w"), F.greatest(F.lit(1), i - (NEGATION_REACH - 1)), F.least(i, F.lit(NEGATION_REACH)))
        return F.struct(word.alias("word"), F.arrays_overlap(before, stop).alias("negated"))

    marked = words.select(*key, F.explode_outer(F.transform("_w", mark)).alias("m"))
    weight = F.when(F.col("m.negated"), F.col("negated")).otherwise(F.col("plain"))
    return (
        marked.join(units, F.col("m.word") == F.col("word"), "left")
        .groupBy(*key)
        .agg(F.coalesce(F.sum(weight).cast("double"), F.lit(0.0)).alias("_s"))
    )


def score_distinct(df: DataFrame, text: str, scorer: Scorer) -> DataFrame:
    """Score every distinct text once and attach the stars to all its rows.

    Texts meet their scores by a 256-bit digest, so long texts are neither
    grouped nor joined on. A scorer with an attribute `stars_of`, an expression
    over the text, scores texts where they are, as that costs less than
    bringing equal texts together.
    """
    stars_of = getattr(scorer, "stars_of", None)
    if stars_of is not None:
        return df.withColumn("predicted_stars", F.when(F.col(text).isNotNull(), stars_of(F.col(text))))
    keyed = df.withColumn("_digest", F.sha2(text, 256))
    # Both as keys: rows are hashed, where picking any text of a digest would sort them.
    distinct = keyed.select("_digest", text).distinct()
    scored = scorer(distinct, text)
    return keyed.join(scored.select("_digest", "predicted_stars"), "_digest", "left").drop("_digest")


def lexicon_star_scorer(lexicon: DataFrame, negators: Sequence[str]) -> Scorer:
    """Stars 1-5 from fifths of the compound range; a small lexicon needs no join, and scores texts where they are."""

    def stars(compound: Column) -> Column:
        return 1 + F.least(F.floor((compound + 1.0) * 2.5), F.lit(4)).cast("int")

    def score(df: DataFrame, text: str) -> DataFrame:
        scored = lexicon_sentiment(df, ["_digest"], text, lexicon, negators, "_compound")
        return scored.withColumn("predicted_stars", stars(F.col("_compound"))).drop("_compound")

    known = _bounded(_units(lexicon))
    if known is not None:
        summed = _summed_units(known, negators)
        score.stars_of = lambda text: stars(_compound(summed(tx.word_pieces(text)) / float(UNITS)))
    return score


def aspect_sentences(df: DataFrame, aspects: dict[str, Sequence[str]], keep: Sequence[str] = ("review_id", "stars")) -> DataFrame:
    """One row per sentence, with the aspects whose vocabulary occurs in it.

    The vocabulary is part of the expression: one flag per aspect, no join.
    """
    lowered = F.col("_lowered")

    def names(aspect: str, keywords: Sequence[str]) -> Column:
        found = F.lit(False)
        for k in keywords:
            found = found | lowered.contains(k)
        return F.when(found, F.lit(aspect))

    pieces = tx.exploded(df, tx.sentences(F.col("full_text")), "sentence", *keep)
    hits = F.array_compact(F.array(*[names(a, k) for a, k in aspects.items()]))
    return pieces.select(*keep, "sentence", F.lower("sentence").alias("_lowered")).select(*keep, "sentence", hits.alias("aspects"))


def by_aspect(sentences: DataFrame) -> DataFrame:
    """Rows of `aspect_sentences`, each once for every aspect of its sentence."""
    others = [c for c in sentences.columns if c != "aspects"]
    return tx.exploded(sentences, F.col("aspects"), "aspect", *others)


def aspect_mentions(df: DataFrame, aspects: dict[str, Sequence[str]], keep: Sequence[str] = ("review_id", "stars")) -> DataFrame:
    """One row per sentence and aspect whose vocabulary the sentence contains."""
    return by_aspect(aspect_sentences(df, aspects, keep)).select(*keep, "aspect", "sentence")


def score_sentences(mentions: DataFrame, scorer: Scorer) -> DataFrame:
    return score_distinct(mentions, "sentence", scorer)


def aspect_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("aspect").agg(
        F.avg("predicted_stars").alias("mean_stars"), F.count("predicted_stars").alias("mentions")
    )


def compare_scorers(df: DataFrame, buckets: dict[str, str], actual: str) -> DataFrame:
    """Share of rows where each scorer's bucket equals the actual one."""
    agree = {k: F.avg((F.col(c) == F.col(actual)).cast("double")) for k, c in buckets.items()}
    row = df.agg(*[v.alias(k) for k, v in agree.items()])
    items = F.array(*[F.struct(F.lit(k).alias("scorer"), F.col(k).alias("accuracy")) for k in buckets])
    return row.select(F.explode(items).alias("i")).select("i.*")


def first_per_company(reviews: DataFrame) -> DataFrame:
    """One row per company: the category and description of its first review."""
    first = F.min(F.struct("review_id", "category", "description")).alias("f")
    return reviews.groupBy("company").agg(first).select("company", "f.category", "f.description")


def company_dimension(reviews: DataFrame) -> DataFrame:
    """Companies with dense surrogate ids, numbered in md5 order of the name."""
    named = first_per_company(reviews).withColumn("_digest", F.md5("company"))
    numbered = ranking.number_rows(ranking.digest_ranges(named, "_digest"), ["_digest", "company"])
    return numbered.select(
        F.col("row_no").cast("bigint").alias("company_id"), "company", "category", "description"
    )


def review_facts(reviews: DataFrame, companies: DataFrame) -> DataFrame:
    ids = companies.select("company", "company_id")
    return reviews.join(ids, "company", "left").select("review_id", "company_id", "title", "review", "stars")


def text_length(df: DataFrame, column: str) -> DataFrame:
    lengths = df.select(F.length(column).cast("double").alias("chars"))
    median = ranking.exact_percentiles(lengths, "chars", {"m": 0.5}).scalar()
    return lengths.agg(
        F.min("chars").cast("bigint").alias("shortest"), F.max("chars").cast("bigint").alias("longest")
    ).select("shortest", median.alias("median"), "longest")


def name_endings(df: DataFrame, column: str, endings: Sequence[str]) -> DataFrame:
    """Distinct names per ending; names with none of them count as 'other'."""
    matched = F.lit("other")
    for e in reversed(endings):
        matched = F.when(F.col(column).endswith(e), e).otherwise(matched)
    return df.select(column).distinct().groupBy(matched.alias("ending")).agg(F.count(F.lit(1)).alias("names"))
