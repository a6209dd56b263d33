"""The best documents for each of many queries, term at a time with a limited set of accumulators.

One pass over the texts keeps, for each document, its length and its counts of
the queries' terms (postings). A second pass scores postings block by block: a
query's terms are taken rarest first, a document met for the first time gets an
accumulator, and as soon as the largest sums that the remaining terms can still
give stay below the k-th best partial score, no more accumulators are made; the
documents that have one are carried on to their exact scores. The k-th best
score of the blocks a task has finished is such a bound from the start. Tasks
send on at most k rows for each query.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.sources.staging import materialize

#: Bytes of distinct query texts that are sent to all tasks at a time; more take another pass over the documents.
BATCH_BYTES = 4 << 20
#: Postings scored together, bytes of a text that are cut into terms together, tasks whose rows meet first.
BLOCK_POSTINGS, PIECE_BYTES, TASKS_MERGED = 1 << 20, 1 << 20, 64

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms and how often each occurs; A-Z are lower-cased."""
    n, at, counts = 0, 0, Counter()
    while at < len(text):
        gap = _BREAK.search(text, at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else None
        end = gap.start() if gap else len(text)
        terms = _TERM.findall(text[at:end].lower())
        counts.update(terms)
        n += len(terms)
        at = end
    return n, counts


def postings(docs: DataFrame, id_col: str, text_col: str, known: dict[bytes, int]) -> DataFrame:
    """id, n (terms of the text), term and tf (the known terms' numbers and counts)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                n, counts = term_counts(text.as_py() or b"")
                for w in counts.keys() & known.keys():
                    terms.append(known[w])
                    tfs.append(counts[w])
                lengths.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
                ],
                ["id", "n", "term", "tf"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(emit, f"id {id_type}, n long, term array<int>, tf array<long>")


class Scorer:
    """Scores of one set of queries: weights of terms, and each query's terms, rarest first."""

    def __init__(self, queries: list[list[int]], df: dict[int, int], n_docs: int, n_terms: int, k: int):
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        self.weights = np.zeros(max(df, default=-1) + 1, np.int64)
        for t, n in df.items():
            self.weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        self.queries = [np.array(sorted((t for t in q if t in df), key=lambda t: (df[t], t)), np.int64) for q in queries]

    def impacts(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each posting adds to a score."""
        m = np.array([50 + 50 * int(x) * self.n_docs // self.n_terms for x in n], np.int64)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))

    def block(self, n, doc, term, tf, id_rank, floors) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores) of the at most k best of a block, best first.

        `floors[q]` is a score that k documents reach elsewhere: lower ones are
        left out. Equal scores go by `id_rank`.
        """
        added = self.impacts(n, doc, term, tf)
        order = np.argsort(term, kind="stable")
        doc, added = doc[order], added[order]
        cuts = np.searchsorted(term[order], np.arange(len(self.weights) + 1))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        most = np.zeros(len(self.weights), np.int64)
        if len(full):
            most[full] = np.maximum.reduceat(added, cuts[full])
        for q, terms in enumerate(self.queries):
            terms = terms[most[terms] > 0]
            if len(terms):
                docs, scores = self._best(terms, most, cuts, doc, added, len(n), id_rank, floors[q])
                if len(docs):
                    yield q, docs, scores

    def _best(self, terms, most, cuts, doc, added, n_docs, id_rank, floor):
        left = np.cumsum(most[terms][::-1])[::-1]
        sums, live = np.zeros(n_docs, np.int64), None
        kth = floor
        for t, bound in zip(terms, left):
            at, more = doc[cuts[t] : cuts[t + 1]], added[cuts[t] : cuts[t + 1]]
            if live is None:
                if kth <= bound and n_docs >= self.k and bound < sums.max():
                    kth = max(floor, int(np.partition(sums, n_docs - self.k)[n_docs - self.k]))
                if bound < kth:
                    live = sums > 0  # a document without an accumulator can no longer reach the k-th score
            if live is not None:
                own = live[at]
                at, more = at[own], more[own]
            sums[at] += more
        found = np.flatnonzero(sums >= max(floor, 1))
        if len(found) > self.k:
            found = found[sums[found] >= np.partition(sums[found], len(found) - self.k)[len(found) - self.k]]
        found = found[np.lexsort((id_rank[found], -sums[found]))[: self.k]]
        return found, sums[found]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold about BLOCK_POSTINGS postings."""
    ends = np.asarray(batch.column(2).offsets)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK_POSTINGS, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _best_rows(scorer: Scorer):
    """Postings -> query, score, id of the at most k best documents of a task for each query."""

    def order(row):
        return -row[0], row[1] is None, row[1]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in scorer.queries]
        floors = [0] * len(best)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for rows in _blocks(batch):
                ids = rows.column(0).to_pylist()
                by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
                id_rank = np.empty(len(ids), np.int64)
                id_rank[by_id] = np.arange(len(ids))
                sizes = np.diff(np.asarray(rows.column(2).offsets))
                term, tf = (rows.column(c).flatten().to_numpy() for c in (2, 3))
                doc = np.repeat(np.arange(len(ids)), sizes)
                n = rows.column(1).to_numpy()
                for q, docs, scores in scorer.block(n, doc, term, tf, id_rank, floors):
                    own = best[q] + [(int(s), ids[d]) for d, s in zip(docs, scores)]
                    best[q] = sorted(own, key=order)[: scorer.k]
                    if len(best[q]) == scorer.k:
                        floors[q] = best[q][-1][0]
        found = [(q, s, i) for q, rows in enumerate(best) for s, i in rows]
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in found], pa.int32()),
                    pa.array([r[1] for r in found], pa.int64()),
                    pa.array([r[2] for r in found], id_type),
                ],
                ["query", "score", "id"],
            )

    return rank


def _rank_batch(docs: DataFrame, texts: list[str], id_col: str, text_col: str, k: int) -> DataFrame:
    """query, score, id, rank for the query texts of one batch."""
    terms = [sorted(term_counts(t.encode())[1]) for t in texts]
    known = {w: i for i, w in enumerate(sorted({w for ws in terms for w in ws}))}
    kept = materialize(postings(docs, id_col, text_col, known))
    totals = kept.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = {r.t: r.n for r in kept.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    scorer = Scorer([[known[w] for w in ws] for ws in terms], df, totals.n, max(1, totals.l), k)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = kept.mapInArrow(_best_rows(scorer), f"query int, score long, id {id_type}")
    rows = rows.withColumn("part", F.expr(f"spark_partition_id() div {TASKS_MERGED}"))
    for keys in (["query", "part"], ["query"]):
        best_first = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        rows = rows.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return rows.drop("part")


def search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    k: int = 50,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """query id, rank (from 1), document id, score: the k best documents with a score above 0 of each query row.

    Terms are runs of ASCII letters, digits and all other characters beyond
    ASCII, lower-cased in A-Z. Null and empty texts have no terms: such
    documents are in no result and count in no statistic, such queries have no
    rows. Equal scores go by ascending id, nulls last. Rows that repeat a
    document's id are documents of their own; rows that repeat a query are all
    answered. Other columns are not read. Empty tables give empty results.
    Queries are sent to the tasks in batches of about `batch_bytes`, each with
    its own pass over the documents.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias("_item"), F.col(query_text).alias("_asked")).where("_asked is not null")
    distinct = asked.select("_asked").distinct()
    n_bytes = distinct.agg(F.coalesce(F.sum(F.octet_length("_asked")), F.lit(0)).alias("b")).first().b
    batches = max(1, -(-n_bytes // batch_bytes))
    out = None
    for number in range(batches):
        own = distinct.where(F.pmod(F.xxhash64("_asked"), F.lit(batches)) == number)
        texts = sorted(r._asked for r in own.collect())
        numbered = spark.createDataFrame(list(enumerate(texts)), "_query int, _text string")
        found = _rank_batch(docs, texts, id_col, text_col, k)
        found = found.join(numbered, F.col("query") == F.col("_query")).join(asked, F.col("_asked") == F.col("_text"))
        found = found.select("_item", F.col("rank").cast("int").alias("rank"), "id", "score")
        found = found if batches == 1 else materialize(found)
        out = found if out is None else out.unionByName(found)
    return out.toDF(query_id, "rank", id_col, "score")
