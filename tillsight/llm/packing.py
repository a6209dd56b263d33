"""Token ids of documents, packed into rows of a fixed length.

Documents are dealt over shards of about SHARD_DOCS documents by a digest of id
and text. A shard is one unit of work: its texts become ids, documents longer
than a row are cut into whole rows and a rest, and the rests are packed best fit
first, longest first: a segment tree over free capacities finds the fullest row
that still takes the next segment. No token is lost or cut off.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.words import release_memory
from tillsight.operators import ranking

ROW_TOKENS = 2048
SHARD_DOCS = 1024
#: Characters of a shard and of a task, if there are more than the documents' and the shuffle partitions' numbers make them.
SHARD_CHARS, TASK_CHARS = 16 << 20, 256 << 20
#: Encoded words a worker remembers, and the longest; results do not depend on them.
REMEMBERED, LONGEST = 120_000, 64
#: A space that does not simply lead the next word.
LOOSE_SPACE = re.compile(r" (?:\s|$)")


class Encoder:
    """Ids of texts under a byte-level vocabulary, word by word.

    The tokenizer's pattern always starts a new piece at a space before a
    non-space, so words can be encoded apart and remembered. A text with other
    spaces is encoded in one go.
    """

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.dtype = np.dtype("<u2") if max(table.values()) < 65535 else np.dtype("<u4")
        encoder = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = encoder.encode_whole(" " + word)
                if len(word) <= LONGEST:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[word] = ids
                return ids

        self.words = Words()

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.codec.encode_ordinary(text), dtype=self.dtype).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if LOOSE_SPACE.search(text):
            return np.frombuffer(self.encode_whole(text), dtype=self.dtype)
        first, *rest = text.split(" ")
        return np.frombuffer(self.encode_whole(first) + b"".join(map(self.words.__getitem__, rest)), dtype=self.dtype)


class Capacities:
    """Open rows by free capacity; a segment tree finds the smallest capacity that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the open row with the smallest capacity of at least `need`."""
        node, count = need + self.leaves, self.count
        while node and not count[node]:
            while node & 1:
                node >>= 1
            node += bool(node)
        if not node:
            return None
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return capacity, row


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of `lengths` by row; longest first, each into the fullest row that takes it."""
    rows: list[list[int]] = []
    free = Capacities(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = free.take(lengths[i])
        if found is None:
            rows.append([i])
            left, row = capacity - lengths[i], len(rows) - 1
        else:
            left, row = found[0] - lengths[i], found[1]
            rows[row].append(i)
        if left:
            free.put(left, row)
    return rows


def pack_shard(shard: int, ids: list, tokens: list[np.ndarray], length: int, pad: int) -> Iterator[dict]:
    """Rows of one shard from the ids and tokens of its documents."""
    segments = []  # (document, start, end)
    for d, t in enumerate(tokens):
        segments += [(d, s, min(s + length, len(t))) for s in range(0, len(t), length)]
    packed = best_fit([end - start for _, start, end in segments], length)
    for r, members in enumerate(packed):
        dtype = tokens[0].dtype
        row, position, ends = np.full(length, pad, dtype), np.zeros(length, "<u4" if length > 65535 else "<u2"), [0]
        for m in members:
            d, start, end = segments[m]
            at, n = ends[-1], end - start
            row[at : at + n] = tokens[d][start:end]
            position[at : at + n] = np.arange(n)
            ends.append(at + n)
        yield {
            "shard": shard,
            "row_no": r,
            "n_tokens": ends[-1],
            "ids": row.tobytes(),
            "cu_seqlens": ends,
            "position_ids": position.tobytes(),
            "doc_ids": [ids[segments[m][0]] for m in members],
            "doc_starts": [segments[m][1] for m in members],
        }


_encoders: dict[tuple[bytes, str], Encoder] = {}


def packed_rows(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    end_of_text: int,
    row_tokens: int = ROW_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per packed row of `row_tokens` ids.

    shard, row_no: its key. n_tokens: ids in use, the rest is `end_of_text`.
    ids: little-endian unsigned integers (16 bits if the vocabulary allows, else
    32). cu_seqlens: 0 and the end of every segment. position_ids: positions
    that restart with every segment, as ids. doc_ids, doc_starts: the document
    of every segment and the segment's first token in it.

    Every document's ids end with `end_of_text`; null and empty texts have no
    ids and appear in no row. Rows with equal id or text are packed one by one.
    `ranks` is the content of a vocabulary file, whose size does not depend on
    the data. A shard holds the ids of about `shard_docs` documents, or SHARD_CHARS
    characters, or one document in memory.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    n_docs, n_chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    shards = max(1, n_docs // shard_docs, n_chars // SHARD_CHARS)
    schema = (
        "shard long, row_no int, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, "
        "doc_ids array<string>, doc_starts array<int>"
    )
    content = F.xxhash64(F.col(text_col))
    dealt = (
        docs.where(F.length(text_col) > 0)
        .select(
            F.pmod(F.xxhash64(F.col(id_col), content), F.lit(shards)).alias("shard"),
            F.col(id_col).cast("string").alias("id"),
            content.alias("digest"),
            F.col(text_col).alias("text"),
        )
        .repartition(max(ranking.bucket_count(docs.sparkSession), n_chars // TASK_CHARS), "shard")
        .sortWithinPartitions("shard")
    )

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoders.get((ranks, pattern))
        if encoder is None:
            encoder = _encoders[(ranks, pattern)] = Encoder(ranks, pattern)
        last = np.array([end_of_text], encoder.dtype)
        shard, held = None, []

        def flush() -> Iterator[pd.DataFrame]:
            held.sort(key=lambda x: (x[0], x[1] is None, x[1]))
            rows = []
            for row in pack_shard(shard, [x[1] for x in held], [x[2] for x in held], row_tokens, end_of_text):
                rows.append(row)
                if len(rows) == 256:
                    yield pd.DataFrame(rows)
                    rows = []
            if rows:
                yield pd.DataFrame(rows)
            held.clear()

        for frame in frames:
            for now, i, digest, text in zip(frame.shard, frame.id, frame.digest, frame.text):
                if now != shard and held:
                    yield from flush()
                shard = int(now)
                held.append((int(digest), None if pd.isna(i) else i, np.concatenate([encoder(text), last])))
        if held:
            yield from flush()
        release_memory()

    return dealt.mapInPandas(pack, schema).withColumn("doc_ids", F.col("doc_ids").cast(f"array<{id_type}>"))
