"""Benchmark items inside training documents: BM25 retrieval, then word-run overlap.

The items form an inverted index. Impacts are BM25 weights divided by the item's
own total, so a passage that holds all of an item's words scores 1 for it. Every
passage of every document is a query; all items that reach `threshold` are
retrieved. Retrieval works with bounds, as block-max WAND does: a passage whose
terms' largest impacts stay below the threshold together is passed over; of the
others, only blocks of items whose block maxima reach it are looked at; in those
the exact scores are summed. A retrieved item counts if enough of its question's
and of its answer's word runs stand in the passage, or enough of the runs of the
whole item and half the words of either part (one word changed in a short answer).

Items are indexed by length class, each with passages of its own length, so what
is found of an item depends neither on other items' lengths nor on shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm import words
from tillsight.sources.staging import discard, materialize

K1, B = 1.2, 0.75
#: Share of an item's BM25 weight that a passage must hold to be looked at.
THRESHOLD = 0.5
#: Word runs compared, and the share of them that must stand in the passage.
RUN_WORDS, OVERLAP = 5, 0.8
#: Items per block of a postings list.
BLOCK = 4
#: Text of one index shard; items beyond it form further shards, searched in turn.
SHARD_BYTES = 32 << 20
#: Items of up to so many words form the first length class; each further class is four times as long. Passages are
#: twice as long as the longest item of the class may be, and overlap by half.
SHORT_ITEM, CLASS_STEP = 32, 4
#: Share of the words of either part that a near-verbatim item must hold.
PART_WORDS = 0.5
#: Bounds are sums in another order than the scores; they may differ by so much.
SLACK = 1e-9

IN_WORD = words.byte_class(rb"[0-9a-z\x80-\xff]")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode()


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last one; both are the text if it has one sentence."""
    parts = [s for s in _SENTENCE.split(text.strip()) if s]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _runs(digests: np.ndarray, most: int = RUN_WORDS) -> tuple[int, np.ndarray]:
    n = min(most, len(digests))
    return n, np.unique(words.window_digests(digests, n)) if n else np.empty(0, np.uint64)


def _share(runs: tuple[int, np.ndarray], passage: np.ndarray) -> float:
    n, own = runs
    return float(np.isin(own, words.window_digests(passage, n)).mean()) if n else 1.0


def length_class(n_words: int) -> int:
    """Largest number of words of the item's length class."""
    most = SHORT_ITEM
    while most < n_words:
        most *= CLASS_STEP
    return most


def indexes(ids: list, texts: list[str], n_items: int, mean_words: float, frequency: dict[int, int]) -> list[Index]:
    """One index per length class of the items."""
    classes: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        n = len(words.word_digests([plain(text)], IN_WORD)[0])
        classes.setdefault(length_class(n), []).append(i)
    return [
        Index([ids[i] for i in at], [texts[i] for i in at], n_items, mean_words, frequency, most)
        for most, at in sorted(classes.items())
    ]


class Index:
    """Items of one shard and length class. `frequency` gives the number of items, over all, that hold a word."""

    def __init__(self, ids: list, texts: list[str], n_items: int, mean_words: float, frequency: dict[int, int], most: int):
        parsed, bounds = words.word_digests([plain(t) for t in texts], IN_WORD)
        own = [parsed[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        order = sorted((i for i in range(len(texts)) if len(own[i])), key=lambda i: (len(own[i]), i))
        self.ids = [ids[i] for i in order]
        self.longest = most
        terms, items, weights = [], [], []
        self.parts = []
        for k, i in enumerate(order):
            t, tf = np.unique(own[i], return_counts=True)
            df = np.array([frequency[int(x)] for x in t], float)
            idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own[i]) / mean_words))
            terms.append(t)
            items.append(np.full(len(t), k))
            weights.append(w / w.sum())
            halves = words.word_digests([plain(p) for p in question_and_answer(texts[i])], IN_WORD)
            parts = [halves[0][halves[1][h] : halves[1][h + 1]] for h in (0, 1)]
            self.parts.append([*map(_runs, parts), _runs(own[i]), *[_runs(part, 1) for part in parts]])
        self.blocks = -(-len(order) // BLOCK)
        if not order:
            self.terms = np.empty(0, np.uint64)
            return
        term, item, weight = np.concatenate(terms), np.concatenate(items), np.concatenate(weights)
        at = np.lexsort((item, term))
        term, self.item, self.weight = term[at], item[at], weight[at]
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        self.top = np.maximum.reduceat(self.weight, first)
        number = np.repeat(np.arange(len(first)), np.diff(self.first))
        block = self.item // BLOCK
        new = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (block[1:] != block[:-1])))
        self.block, self.block_top = block[new], np.maximum.reduceat(self.weight, new)
        self.block_first = np.searchsorted(number[new], np.arange(len(first) + 1))

    def numbers(self, digests: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words no item has."""
        at = np.searchsorted(self.terms, digests)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == digests, at, -1)

    def retrieve(self, terms: np.ndarray, passage: np.ndarray, threshold: float):
        """(passage, item, score) of all pairs at or above the threshold; `terms` are distinct in a passage."""
        bound = np.bincount(passage, self.top[terms])
        keep = bound[passage] >= threshold - SLACK
        terms, passage = terms[keep], passage[keep]
        key, total = _sum_lists(passage, terms, self.block_first, self.block, self.block_top, self.blocks)
        live = key[total >= threshold - SLACK]
        if not len(live):
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        keep = np.isin(passage, live // self.blocks)
        n = self.blocks * BLOCK
        key, total = _sum_lists(passage[keep], terms[keep], self.first, self.item, self.weight, n)
        found = (total >= threshold) & np.isin(key // n * self.blocks + key % n // BLOCK, live)
        return key[found] // n, key[found] % n, total[found]


def _sum_lists(passage, terms, first, target, value, n: int):
    """Sum `value` per passage and target over the lists of the passage's terms; key = passage * n + target."""
    size = first[terms + 1] - first[terms]
    if not size.sum():
        return np.empty(0, int), np.empty(0)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(first[terms], size) + step
    base = passage - passage.min()
    key = np.repeat(base, size) * n + target[at]
    if (base.max() + 1) * n <= 1 << 24:
        total = np.bincount(key, value[at])
        keys = np.flatnonzero(total)
        total = total[keys]
    else:
        keys, where = np.unique(key, return_inverse=True)
        total = np.bincount(where, value[at])
    return keys + passage.min() * n, total


#: Passages per search step, which bounds its arrays.
STEP = 2048


def leaks_of(texts: list[str | None], parts: list[Index], threshold: float, overlap: float) -> list[list[dict]]:
    """For each text the items it holds, each with its best passage."""
    out: list[dict] = [{} for _ in texts]
    for base, group in words.groups(texts, plain):
        digests, bounds = words.word_digests(group, IN_WORD)
        for index in parts:
            if len(index.terms):
                _search(digests, bounds, index, threshold, overlap, out[base : base + len(group)])
    return [[best[k] for k in sorted(best, key=lambda k: (k is None, k))] for best in out]


def _search(digests, bounds, index: Index, threshold: float, overlap: float, out: list[dict]) -> None:
    """Enter into `out`, one dictionary a text, the best passage of each item of the index."""
    numbers = index.numbers(digests)
    stride, size = index.longest, 2 * index.longest
    passages = np.maximum(1, -(-(np.diff(bounds) - size) // stride) + 1)
    doc = np.repeat(np.arange(len(out)), passages)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(passages) - passages, passages)
    start = bounds[doc] + nth * stride
    end = np.minimum(start + size, bounds[doc + 1])
    step = max(1, STEP * SHORT_ITEM // index.longest)
    for p in range(0, len(doc), step):
        lo, hi = start[p : p + step], end[p : p + step]
        width = hi - lo
        rows = np.repeat(np.arange(len(lo)), width)
        at = np.repeat(lo, width) + np.arange(len(rows)) - np.repeat(np.cumsum(width) - width, width)
        known = numbers[at] >= 0
        pairs = np.unique(rows[known] * len(index.terms) + numbers[at][known])
        if not len(pairs):
            continue
        row, term = pairs // len(index.terms), pairs % len(index.terms)
        for r, i, score in zip(*(x.tolist() for x in index.retrieve(term, row, threshold))):
            passage = digests[lo[r] : hi[r]]
            question, answer, whole, *either = index.parts[i]
            shares = _share(question, passage), _share(answer, passage)
            if min(shares) < overlap and (
                _share(whole, passage) < overlap or min(_share(part, passage) for part in either) < PART_WORDS
            ):
                continue
            d, key = doc[p + r], index.ids[i]
            if key not in out[d] or score > out[d][key]["score"]:
                out[d][key] = {
                    "item_id": key,
                    "score": score,
                    "question_overlap": shares[0],
                    "answer_overlap": shares[1],
                    "first_word": int(lo[r] - bounds[d]),
                }


def _word_sets(texts: Column) -> Column:
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            digests, bounds = words.word_digests([plain(t) for t in batch], IN_WORD)
            yield pd.Series([digests[a:b].view(np.int64).tolist() for a, b in zip(bounds, bounds[1:])])

    return F.pandas_udf(split, "array<long>")(texts)


def _searcher(parts: list[Index], threshold: float, overlap: float):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(leaks_of(batch.tolist(), parts, threshold, overlap))
        words.release_memory()

    return search


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """`docs` with `leaks`: the benchmark items each document holds, by item id.

    An item: item_id, score (share of its BM25 weight in the best passage),
    question_overlap and answer_overlap (shares of their runs of RUN_WORDS words,
    or of the whole if shorter), first_word of that passage. Null or empty texts
    and items have no leaks. Items that share an id count as one. Statistics
    cover all items. The driver and the workers hold the index of about
    SHARD_BYTES of item text at a time; more items are searched shard after
    shard, each over the documents staged by the one before. Passages overlap by
    the longest item of a length class, so an item is never cut, and what is
    found does not depend on shards. No shuffle of documents.
    """
    usable = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).where(F.length("t") > 0)
    counted = usable.withColumn("w", _word_sets(F.col("t")))
    total, n_items, mean = counted.agg(
        F.sum(F.octet_length("t")), F.count_if(F.size("w") > 0), F.avg(F.when(F.size("w") > 0, F.size("w")))
    ).first()
    shards = max(1, -(-(total or 0) // SHARD_BYTES))
    frequency = counted.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    id_type = items.schema[item_id].dataType.simpleString()
    kind = (
        f"array<struct<item_id: {id_type}, score: double, question_overlap: double, "
        "answer_overlap: double, first_word: long>>"
    )
    found, before = docs.withColumn("leaks", F.array().cast(kind)), None
    for shard in range(shards):
        mine = counted.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        own_words = mine.select(F.explode(F.array_distinct("w")).alias("w")).distinct()
        known = {r.w & 0xFFFFFFFFFFFFFFFF: r.n for r in own_words.join(frequency, "w").collect()}
        rows = sorted(mine.select("item", "t").collect(), key=lambda r: (r.item is None, r.item, r.t))
        parts = indexes([r.item for r in rows], [r.t for r in rows], n_items, mean, known)
        searched = F.pandas_udf(_searcher(parts, threshold, overlap), kind)(F.col(text_col))
        found = found.withColumn("leaks", F.concat("leaks", searched))
        if shard + 1 < shards:
            found = materialize(found)
            if before is not None:
                discard(before)
            before = found
    return found.withColumn("leaks", F.array_sort("leaks"))
