"""SimHash near copies by tables of distances to reference fingerprints.

For every distinct fingerprint the Hamming distances to many reference
fingerprints are computed: to zero and the 64 fingerprints of a single bit (the
block references), and to scattered ones. By the triangle inequality two
fingerprints within d of each other differ by at most d in each of these
coordinates. The differences between the distance to zero and those to the
block references serve to deal fingerprints out: a pair within d agrees in all
but d of them, so of d + 3 groups of block references any three groups agree
for some choice, and fingerprints that meet in no choice need not be compared.
Where they meet, pairs whose coordinates differ by more than d anywhere are
discarded, and the Hamming distance of the others is computed.

A very common key is dealt out again over the references left, after which a
key has at most a few thousand distinct fingerprints. Pairs are never written:
each key keeps a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm import words
from tillsight.llm.components import components, forest
from tillsight.sources.staging import materialize

SEED = 42  # of the shingles' digests
#: Scattered references; groups of block references that agree; fingerprints of a key that are dealt out again.
SCATTERED, AGREE, COMMON_KEY = 32, 3, 1 << 16
#: Fingerprints a task compares at once, words of a text hashed at once.
HELD, PIECE_WORDS = 1 << 16, 1 << 16

_U = np.uint64
BLOCK_REFERENCES = np.concatenate([np.zeros(1, _U), _U(1) << np.arange(64, dtype=_U)])
SCATTERED_REFERENCES = words.mix(np.arange(1, SCATTERED + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _runs(text: bytes, run: int) -> Iterator[list[bytes]]:
    """Runs of `run` words, space-joined, piece by piece; shorter texts give one of all words, empty ones none."""
    held = text.split(maxsplit=PIECE_WORDS)
    while len(held) > PIECE_WORDS:
        rest = held.pop()
        yield [b" ".join(r) for r in zip(*(held[k:] for k in range(run)))]
        held = held[len(held) - run + 1 :] + rest.split(maxsplit=PIECE_WORDS)
        if len(held) > PIECE_WORDS + run - 1:
            continue
        break
    if held:
        yield [b" ".join(r) for r in zip(*(held[k:] for k in range(run)))] or [b" ".join(held)]


def fingerprint(text: bytes, run: int = 3) -> int:
    """64 bits: each is set if it is set in over half the digests of the text's runs of words."""
    ones, n = np.zeros(64, np.int64), 0
    for runs in _runs(text.lower(), run):
        digests = np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], "<u8")
        ones += np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
        n += len(runs)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, run: int = 3) -> DataFrame:
    """id, fingerprint (its 64 bits as a long)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or b"", run) for t in batch.column(1)], _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(emit, f"id {id_type}, fingerprint long")


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Table of Hamming distances, a row for each fingerprint and a column for each reference."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def choices(bits: tuple[int, ...], within: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(bits whose block references agree, bits left) of each choice of AGREE groups among within + AGREE."""
    groups = [bits[k :: within + AGREE] for k in range(within + AGREE)]
    out = []
    for chosen in combinations(range(len(groups)), AGREE):
        own = tuple(b for k in chosen for b in groups[k])
        out.append((own, tuple(b for b in bits if b not in own)))
    return out


def keys(prints: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """Numbers that are equal if the distances to zero and to the block references of `bits` differ equally."""
    table = distances(prints, BLOCK_REFERENCES[[0, *(b + 1 for b in bits)]])
    differ = (table[:, :1] - table[:, 1:] + 1) >> 1  # 1 where the reference is nearer than zero, else 0
    return (differ.astype(np.int64) << np.arange(len(bits))).sum(1)


def _deal(prints: np.ndarray, bits: tuple[int, ...], within: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fingerprints): each fingerprint once for each choice, whose number stands in the key's highest bits."""
    own = choices(bits, within)
    dealt = [keys(prints, agree) | (k << 58) for k, (agree, _) in enumerate(own)]
    return np.concatenate(dealt), np.tile(prints, len(own))


def near_pairs(key: np.ndarray, prints: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of fingerprints with the same key (sorted by key), as many as connect them."""
    table = distances(prints, np.concatenate([BLOCK_REFERENCES[:1], SCATTERED_REFERENCES]))
    a = b = np.empty(0, np.int64)
    at, lag = np.arange(len(key)), 0
    while True:
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            return a, b
        left = at
        for c in range(table.shape[1]):
            left = left[np.abs(table[left, c] - table[left + lag, c]) <= within]
        left = left[np.bitwise_count(prints[left] ^ prints[left + lag]) <= within]
        if len(left):
            a, b = np.concatenate([a, left]), np.concatenate([b, left + lag])
            if len(a) > 2 * HELD:
                kept = forest(a, b)
                a, b = a[kept], b[kept]


def _linked(batches: Iterator[pa.RecordBatch], within: int) -> Iterator[pa.RecordBatch]:
    """Sorted key, again, fingerprint -> edges `a, b` that connect the linked fingerprints of each key."""

    def edges(key, prints):
        a, b = near_pairs(key, prints, within)
        a, b = prints[a].view(np.int64), prints[b].view(np.int64)
        kept = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])

    first = second = np.empty(0, np.int64)
    prints = np.empty(0, _U)
    for batch in batches:
        more = [batch.column(k).to_numpy() for k in range(3)]
        first, second = np.concatenate([first, more[0]]), np.concatenate([second, more[1]])
        prints = np.concatenate([prints, more[2].view(_U)])
        last = (first == first[-1]) & (second == second[-1]) if len(first) else np.empty(0, bool)
        cut = len(first) - int(last.sum())
        if cut >= HELD:
            yield edges(_numbered(first[:cut], second[:cut]), prints[:cut])
            first, second, prints = first[cut:], second[cut:], prints[cut:]
    if len(first):
        yield edges(_numbered(first, second), prints)


def _numbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Consecutive numbers of equal neighbouring rows."""
    return np.cumsum(np.append(False, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))


def links(prints: DataFrame, within: int = 2) -> DataFrame:
    """Distinct `fingerprint` longs -> edges `a, b` whose components are those of all pairs within `within` bits."""
    bits = tuple(range(64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, own = _deal(batch.column(0).to_numpy().view(_U), bits, within)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own.view(np.int64))], ["key", "fingerprint"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [left for _, left in choices(bits, within)]
        for batch in batches:
            key, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(_U)
            for k in np.unique(key >> 58):
                chosen = key >> 58 == k
                second, dealt = _deal(own[chosen], rest[k], within)
                columns = np.tile(key[chosen], len(dealt) // chosen.sum()), second, dealt.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "again", "fingerprint"])

    dealt = materialize(prints.select("fingerprint").mapInArrow(deal, "key long, fingerprint long"))
    common = materialize(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > COMMON_KEY).select("key"))
    rows = dealt.select("key", F.lit(0).cast("long").alias("again"), "fingerprint")
    if not common.isEmpty():
        more = dealt.join(common, "key").mapInArrow(again, "key long, again long, fingerprint long")
        rows = rows.join(common, "key", "left_anti").unionByName(more)
    return (
        rows.repartition("key", "again")
        .sortWithinPartitions("key", "again", "fingerprint")
        .mapInArrow(lambda batches: _linked(batches, within), "a long, b long")
    )


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, within: int = 2
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Digests are XXH64 with seed 42 of `run` words, lower-cased in A-Z and
    joined by spaces; a shorter text has one of all its words. Null, empty and
    blank texts have the fingerprint 0 and link like any other. Documents whose
    fingerprints differ in at most `within` bits link. Equal fingerprints are
    one from the start, whatever their number. Null ids name a component only
    if it has no others; repeated ids are passed on. Other columns are not
    read. An empty table gives an empty result.
    """
    described = materialize(fingerprints(docs, id_col, text_col, run))
    prints = described.groupBy("fingerprint").agg(F.min("id").alias("least_id"))
    labels = components(links(prints, within)).withColumnRenamed("node", "fingerprint")
    classes = materialize(
        prints.join(labels, "fingerprint", "left").select("fingerprint", "least_id", F.coalesce("label", "fingerprint").alias("label"))
    )
    smallest = classes.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = classes.join(smallest, "label").select(F.col("fingerprint").alias("_f"), "component_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return described.join(named, F.col("fingerprint") == F.col("_f"), "left").select(
        F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id"
    )
