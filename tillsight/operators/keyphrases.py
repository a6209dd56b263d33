"""Keyphrases: one- and two-word candidates chosen by relevance and diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillsight.functions import text as tx
from tillsight.sources.staging import materialize


def stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def pick_phrases(codes: np.ndarray, idf: np.ndarray, names: list[str], top: int, diversity: float) -> list[str]:
    """Greedy maximal marginal relevance over the candidates of one document.

    `codes` are the document's words as places in `names`, which is sorted, and
    in `idf`. The document is its TF-IDF vector; a candidate is the sum of the
    vectors of its words. Cosines between candidates only involve shared words,
    so no candidate matrix is built, and only tied candidates are spelled out.
    """
    if len(codes) == 0:
        return []
    own, code = np.unique(codes, return_inverse=True)
    n, weight = len(own), idf[own]
    doc = np.bincount(code, minlength=n) * weight
    doc_norm = np.sqrt(np.sum(doc * doc))
    pairs = np.unique(code[:-1].astype(np.int64) * n + code[1:])
    first = np.concatenate([np.arange(n), pairs // n])
    second = np.concatenate([np.full(n, -1), pairs % n])
    w1 = weight[first]
    w2 = np.where(second >= 0, weight[second], 0.0)
    same = first == second
    norm = np.where(same, w1 + w2, np.sqrt(w1 * w1 + w2 * w2))
    dot = w1 * doc[first] + np.where(second >= 0, w2 * doc[second], 0.0)
    relevance = np.round(dot / (norm * doc_norm), 9)

    def phrase(i: int) -> str:
        word = names[own[first[i]]]
        return word if second[i] < 0 else f"{word} {names[own[second[i]]]}"

    closest = np.full(len(first), -np.inf)
    chosen: list[int] = []
    free = np.ones(len(first), bool)
    for _ in range(min(top, len(first))):
        score = relevance if not chosen else np.round((1 - diversity) * relevance - diversity * closest, 9)
        best_value = np.max(score[free])
        pick = int(min(np.flatnonzero(free & (score == best_value)), key=phrase))
        chosen.append(pick)
        free[pick] = False
        vector = {first[pick]: w1[pick]}
        if second[pick] >= 0:
            vector[second[pick]] = vector.get(second[pick], 0.0) + w2[pick]
        overlap = np.zeros(len(first))
        for word, v in vector.items():
            overlap += v * (np.where(first == word, w1, 0.0) + np.where(second == word, w2, 0.0))
        closest = np.maximum(closest, overlap / (norm * norm[pick]))
    return [phrase(i) for i in chosen]


#: Words that are sent to all tasks with their weights, the most frequent ones; rarer words meet theirs in a join.
COMMON_WORDS = 500_000


def keyphrases(df: DataFrame, key: str, text: str, top: int = 5, diversity: float = 0.5) -> DataFrame:
    """The `top` phrases of every text, joined by ' | '.

    Words are split once and staged. Spark computes the document frequencies;
    weights of the most frequent words are sent to the tasks, those of other
    words of several texts are joined, a word of one text has the largest
    weight. So texts stay where they are, unless there are more words. Only the
    greedy choice inside one text runs in Python, on Arrow batches of whole rows
    whose words are numbered batch by batch.
    """
    skip = stop_words()
    tokens = materialize(
        df.select(
            key, F.filter(tx.words(F.col(text)), lambda w: (F.length(w) >= 2) & ~w.isin(skip)).alias("_tokens")
        )
    )
    texts = float(tokens.count())
    weight = F.log((F.lit(texts) + 1.0) / (F.col("df") + 1.0)) + 1.0
    frequency = tokens.select(F.explode(F.array_distinct("_tokens")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = materialize(frequency.where("df > 1").select("word", "df", weight.alias("idf")))
    largest = df.sparkSession.range(1, 2).select(F.col("id").alias("df")).select(weight).first()[0]
    # Bounded: at most COMMON_WORDS short rows.
    common = idf.orderBy(F.col("df").desc(), "word").limit(COMMON_WORDS).select("word", "idf").toArrow()
    known, weights = pa.array(common["word"].to_pylist(), pa.string()), common["idf"].to_numpy()
    joined = tokens
    if idf.count() > len(known):
        joined = _with_rare_words(tokens, key, known, idf)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            coded = tokens.flatten().dictionary_encode()
            words = coded.dictionary.take(pc.sort_indices(coded.dictionary))  # by UTF-8 bytes, which is by code point
            codes = pc.index_in(coded.dictionary, value_set=words).to_numpy()[coded.indices.to_numpy()]
            weight = np.full(len(words), largest)
            sides = [(known, weights)]
            if batch.num_columns > 2:
                sides.append((batch.column(2).flatten(), batch.column(3).flatten().to_numpy()))
            for names, values in sides:
                at = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy()
                weight[at >= 0] = values[at[at >= 0]]
            ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
            names = words.to_pylist()
            picked = [
                " | ".join(pick_phrases(c, weight, names, top, diversity)) for c in np.split(codes, ends[:-1])
            ] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked, pa.string())], [key, "keywords"])

    shape = StructType([tokens.schema[key], StructField("keywords", StringType())])
    return joined.mapInArrow(choose, shape)


def _with_rare_words(tokens: DataFrame, key: str, known: pa.StringArray, idf: DataFrame) -> DataFrame:
    """The rows with lists of their words that are not in `known` but in `idf`, and of their weights."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten()
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            other = np.flatnonzero(~pc.is_in(words, value_set=known).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[other])), words.take(pa.array(other))], ["_key", "word"])

    shape = StructType([StructField("_key", tokens.schema[key].dataType), StructField("word", StringType())])
    pairs = tokens.mapInArrow(rare, shape).join(idf.select("word", "idf"), "word")
    found = pairs.groupBy("_key").agg(F.collect_set(F.struct("word", "idf")).alias("_w"))
    none = F.array().cast("array<struct<word: string, idf: double>>")
    # Words hold no blanks; one string of them is shorter than their list where rows are shuffled.
    packed = tokens.select(key, F.array_join("_tokens", " ").alias("_line"))
    listed = packed.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_w", F.coalesce("_w", none))
    words = F.when(F.col("_line") == "", F.array().cast("array<string>")).otherwise(F.split("_line", " "))
    return listed.select(key, words.alias("_tokens"), F.col("_w.word").alias("_words"), F.col("_w.idf").alias("_idf"))
