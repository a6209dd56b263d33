"""Counting unigram tokens without making them.

The tokenizer marks word starts (a space becomes the mark, and a text begins
with one), cuts before every mark, and takes for each cut piece the cheapest
path over its vocabulary. Here an Aho-Corasick automaton lists all vocabulary
matches of a piece, and the path search carries only the best score and the
number of tokens.

Tie rules as the tokenizer has them: candidates for an end are tried from the
earliest start on, a later one replaces an earlier one only if its score is
strictly greater, and scores are added left to right in 64-bit floats. A
character without a match costs the lowest score less 10; runs of them are one
unknown, which is written as one token for each of its bytes if the vocabulary
has byte pieces, else as one token.

The path needs log probabilities as scores. A vocabulary made by merging (BPE)
has ranks instead; `fitted` replaces them by probabilities estimated over the
texts that are counted.
"""

from __future__ import annotations

import math
from collections import Counter as Bag
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_COST = 10.0
#: Counted pieces a worker remembers; results do not depend on it.
REMEMBERED = 400_000
#: Model type of a piece model file whose scores are log probabilities.
UNIGRAM = 1


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a piece model file; kinds: 1 normal, 2 unknown, 3 control, 4 user, 6 byte."""
    import struct

    def varint(buf, at):
        value = shift = 0
        while True:
            byte = buf[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value, at

    def fields(buf):
        at = 0
        while at < len(buf):
            tag, at = varint(buf, at)
            if tag & 7 == 0:
                value, at = varint(buf, at)
            elif tag & 7 == 2:
                n, at = varint(buf, at)
                value, at = buf[at : at + n], at + n
            else:
                n = 4 if tag & 7 == 5 else 8
                value, at = buf[at : at + n], at + n
            yield tag >> 3, value

    out = []
    for number, value in fields(model):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            out.append((piece.get(1, b"").decode(), score, piece.get(3, 1)))
    return out


def cut(text: str) -> list[str]:
    """The text's pieces without their marks: a cut before every mark; the first piece gets a mark if it has none."""
    parts = text.replace(MARK, " ").split(" ")
    return parts[1:] if parts[0] == "" else parts


class Counter:
    """Token counts of texts for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_known: bool):
        self.known = dict(pieces)
        self.lengths = [len(p) for p, _ in pieces]
        self.scores = [s for _, s in pieces]
        self.bytes_known = bytes_known
        self.unknown = min(self.scores) - UNKNOWN_COST
        self.automaton = ahocorasick.Automaton()
        for i, (piece, _) in enumerate(pieces):
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.counted: dict[str, int] = {}

    def piece_tokens(self, piece: str) -> int:
        """Tokens on the best path of one cut piece.

        The automaton lists matches by end, the longest (earliest start) first.
        """
        n = len(piece)
        lengths, scores = self.lengths, self.scores
        best, count, last, single = [0.0] * (n + 1), [0] * (n + 1), -1, 0
        for end, i in self.automaton.iter(piece):
            length = lengths[i]
            start = end + 1 - length
            value = best[start] + scores[i]
            if end != last or value > best[end + 1]:
                last = end
                best[end + 1] = value
                count[end + 1] = count[start] + 1
            if length == 1:
                single += 1
        return count[n] if single == n else self._with_unknown(piece)

    def _with_unknown(self, piece: str) -> int:
        """The same path where some character is no piece by itself."""
        n = len(piece)
        matches: list[list] = [[] for _ in range(n + 1)]
        for end, i in self.automaton.iter(piece):
            matches[end + 1].append((self.lengths[i], self.scores[i]))
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        run = [0] * (n + 1)  # one more than the start of the unknown run that ends here
        for end in range(1, n + 1):
            top, at, unknown = None, 0, False
            for length, score in matches[end]:
                value = best[end - length] + score
                if top is None or value > top:
                    top, at = value, end - length
            if not any(length == 1 for length, _ in matches[end]):
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, at, unknown = value, end - 1, True
            best[end] = top
            if unknown:
                start = run[end - 1] - 1 if run[end - 1] else end - 1
                run[end] = start + 1
                count[end] = count[start] + self.unknown_tokens(piece[start:end])
            else:
                count[end] = count[at] + 1
        return count[n]

    def unknown_tokens(self, run: str) -> int:
        return len(run.encode()) if self.bytes_known and run not in self.known else 1

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        counted, total = self.counted, 0
        for part in cut(text):
            tokens = counted.get(part)
            if tokens is None:
                tokens = self.piece_tokens(MARK + part)
                if len(part) < 64:
                    if len(counted) >= REMEMBERED:
                        counted.clear()
                    counted[part] = tokens
            total += tokens
        return total


def load(model: bytes) -> Counter:
    """Counter over a piece model's pieces and scores; pieces that hold a mark inside never match a cut piece."""
    pieces = read_pieces(model)
    usable = [(p, s) for p, s, kind in pieces if kind in (1, 4)]
    return Counter(usable, bytes_known=sum(kind == 6 for _, _, kind in pieces) == 256)


def piece_counts(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """`piece` (its number in the model), `n`: how often the model's own segmentation of all cut pieces uses it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        total = np.zeros(own.get_piece_size(), np.int64)
        parts: Bag[str] = Bag()

        def add() -> None:
            total[own.piece_to_id(MARK)] += parts.pop("", 0)
            names, times = list(parts), np.array(list(parts.values()), np.int64)
            for a in range(0, len(names), 20_000):
                found = own.encode(names[a : a + 20_000], num_threads=1)
                ids = np.array([i for f in found for i in f], np.int64)
                np.add.at(total, ids, np.repeat(times[a : a + 20_000], [len(f) for f in found]))
            parts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    parts.update(cut(text))
                    if len(parts) >= REMEMBERED:
                        add()
        add()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    counted = docs.select(text_col).mapInArrow(count, "piece long, n long")
    return counted.groupBy("piece").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame, model: bytes, text_col: str = "text") -> bytes:
    """The model file as a unigram model whose scores are log probabilities of the pieces in `docs`.

    A piece's probability is its share of the segmentation that `model` itself
    gives the texts, with half a use added to each piece, so that unused ones
    stay possible. Counts are whole numbers over all texts: the scores do not
    depend on row order or partitions. Only one number per piece of the
    vocabulary reaches the driver.
    """
    from sentencepiece import sentencepiece_model_pb2

    made = sentencepiece_model_pb2.ModelProto()
    made.ParseFromString(model)
    uses = {r.piece: r.n for r in piece_counts(docs, model, text_col).collect()}
    scored = [i for i, p in enumerate(made.pieces) if p.type in (1, 4)]
    total = sum(uses.get(i, 0) for i in scored) + 0.5 * len(scored)
    for i in scored:
        made.pieces[i].score = math.log((uses.get(i, 0) + 0.5) / total)
    made.trainer_spec.model_type = UNIGRAM
    return made.SerializeToString()


_loaded: dict[bytes, Counter] = {}


def token_counts(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """All columns of `docs` that a scan of them needs, plus `n_tokens`.

    `model` is the content of a vocabulary file (some 0.5 MB, its size does not
    depend on the data); tasks get it with their code. Null and empty texts
    have 0 tokens. Work and memory are linear in the text's length, however
    long it is. No shuffle.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _loaded.get(model)
        if counter is None:
            counter = _loaded[model] = load(model)
        for texts in batches:
            yield pd.Series([counter(t) for t in texts], dtype="int64")

    tokens: Column = F.pandas_udf(count, "long")(F.col(text_col))
    return docs.withColumn("n_tokens", tokens)
