"""Byte strings of a fixed length that stand at more than one place, and texts without them.

Doubling over positions: positions get ranks by ever longer strings that start
near them, equal strings share a rank, and a position leaves as soon as its
string is unique or its full length is known to repeat. Two things keep the
number of positions small.

* Not every position starts: of the 64-byte strings inside each window of the
  full length, the one with the smallest digest is the window's anchor. Equal
  windows have equal anchors at equal offsets, so only windows with a repeated
  anchor can repeat; some one position in 70 is an anchor.
* Windows of one anchor are ranked together. All windows with offsets in a range
  share a core (their common bytes) and lie in a hull. If no other place has the
  same core, none of them repeats; if another has the same hull, all do;
  else the range is split, which makes cores longer and hulls shorter, until a
  range is one window and core and hull are the window itself.

Equal texts are one text from the start.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm import words
from tillsight.sources.staging import materialize

LENGTH, GRAM = 200, 64
#: Each round cuts a range of offsets into so many.
FAN_OUT = 4
#: Places of one anchor that a task ranks by itself; more are ranked by all tasks together.
PLACES_IN_TASK = 4096
#: A text is searched in parts of so many bytes.
PART = 1 << 20

_U = np.uint64


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Columns (digest, context, position, most, least) of one text's anchors.

    An anchor at `position` serves the windows that start `least` to `most`
    bytes before it; `context` is a digest of these offsets and windows. Where a
    long text is cut into parts, one anchor may have two rows with other windows.
    """
    width = length - gram + 1
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for start in range(0, max(0, len(data) - length + 1), PART):
        part = data[start : start + PART + length - 1]
        sums = words.prefix_sums(part)
        at = np.arange(len(part) - gram + 1)
        digest = words.run_digest(sums, at, at + gram)
        # Smallest upper half first, leftmost among equals.
        key = (digest >> _U(32) << _U(32)) | at.astype(_U)
        span = 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key)) - 1
        position = (key[first] & _U(0xFFFFFFFF)).astype(np.int64)
        most, least = position - first, position - last
        context = words.run_digest(sums, first, last + length)
        context = words.mix(context + (most * 1024 + least).astype(_U))
        for column, values in zip(out, (digest[position], context, position + start, most, least)):
            column.append(values)
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


def anchor_rows(base: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of all distinct texts; a text may come from several tasks."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2, texts = (batch.column(k) for k in range(3))
            parts, held = [], 0
            for i in range(len(texts)):
                key = k1[i].as_py(), k2[i].as_py()
                if key in seen:
                    continue
                seen.add(key)
                columns = anchors(np.frombuffer(texts[i].as_buffer(), np.uint8), length, gram)
                n = len(columns[0])
                if n:
                    parts.append([np.full(n, key[0]), np.full(n, key[1]), *columns])
                    held += n
                if held > 200_000:
                    yield _batch(parts)
                    parts, held = [], 0
            if parts:
                yield _batch(parts)

    def _batch(parts) -> pa.RecordBatch:
        k1, k2, digest, context, position, most, least = (np.concatenate(c) for c in zip(*parts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(digest.view(np.int64)),
                pa.array(context.view(np.int64)),
                pa.array(k1),
                pa.array(k2),
                pa.array(position),
                pa.array(most.astype(np.int32)),
                pa.array(least.astype(np.int32)),
            ],
            ["anchor", "context", "k1", "k2", "position", "most", "least"],
        )

    return base.select("k1", "k2", "text").mapInArrow(
        find, "anchor long, context long, k1 long, k2 long, position long, most int, least int"
    )


def _pieces(most: int, least: int, size: int, inside=None) -> list[int]:
    """Numbers of the ranges of `size` offsets that hold some of least..most, below one of FAN_OUT times the size."""
    low, high = least // size, most // size
    if inside is not None:
        low, high = max(low, inside * FAN_OUT), min(high, inside * FAN_OUT + FAN_OUT - 1)
    return list(range(low, high + 1))


def first_size(length: int, gram: int) -> int:
    size = 1
    while size * FAN_OUT <= (length - gram + 1) // 2:
        size *= FAN_OUT
    return size


def repeated_ranges(places: list[tuple], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each place of one anchor the offset ranges (first, last) whose windows stand at another place too.

    A place is (most, least, bytes of its windows).
    """
    found: list[list[tuple[int, int]]] = [[] for _ in places]
    size = first_size(length, gram)
    # Ranges known to repeat stay, one for each hull, as long as others share their core.
    live = [(i, piece, False) for i, (most, least, _) in enumerate(places) for piece in _pieces(most, least, size)]
    while live:
        cores: dict[tuple[int, bytes], list[int]] = {}
        hulls: dict[tuple[int, bytes], int] = {}
        keys = []
        for i, piece, _ in live:
            most, least, held = places[i]
            near, far = piece * size, piece * size + size - 1
            core = (piece, held[most - near : most - far + length])
            hull = (piece, held[most - far : most - near + length]) if least <= near and far <= most else None
            keys.append((core, hull))
            cores.setdefault(core, [0, 0])[0] += 1
            if hull is not None:
                hulls[hull] = hulls.get(hull, 0) + 1
        judged = []
        for (i, piece, done), (core, hull) in zip(live, keys):
            repeated = done or (hull is not None and hulls[hull] > 1)
            if repeated and not done:
                found[i].append((piece * size, piece * size + size - 1))
            cores[core][1] += not repeated
            judged.append(repeated)
        following, kept = [], set()
        for (i, piece, _), (core, hull), repeated in zip(live, keys, judged):
            if size == 1 or cores[core][0] < 2 or not cores[core][1] or (repeated and hull in kept):
                continue
            if repeated:
                kept.add(hull)
            most, least, _ = places[i]
            following += [(i, p, repeated) for p in _pieces(most, least, size // FAN_OUT, piece)]
        live, size = following, size // FAN_OUT
    return found


PLACE = "anchor long, k1 long, k2 long, position long, most int, least int, held binary"
SPAN = "k1 long, k2 long, start long, end long"


def _rank_in_tasks(places: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of repeated windows; each anchor's places are in one task."""

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, rows, out = None, {}, []

        def close() -> None:
            keys = list(rows)
            ranges = repeated_ranges([rows[k] for k in keys], length, gram)
            for (k1, k2, position, _), own in zip(keys, ranges):
                out.extend((k1, k2, position - far, position - near + length) for near, far in own)

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["k1", "k2", "start", "end"])

        for batch in frames:
            for now, k1, k2, position, most, least, held in batch.itertuples(index=False, name=None):
                if now != anchor:
                    if rows:
                        close()
                    anchor, rows = now, {}
                rows[k1, k2, position, most] = (most, least, bytes(held))
            if out:
                yield frame()
                out.clear()
        if rows:
            close()
            yield frame()

    return places.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(rank, SPAN)


def _rank_together(places: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """The same for anchors with any number of places: rounds of counting equal cores and hulls."""
    places = materialize(places.dropDuplicates(["anchor", "k1", "k2", "position", "most"]))
    size, spans = first_size(length, gram), []
    low = F.floor(F.col("least") / size).cast("int")
    high = F.floor(F.col("most") / size).cast("int")
    live = places.withColumn("piece", F.explode(F.sequence(low, high))).withColumn("done", F.lit(False))
    place = F.struct("k1", "k2", "position", "most")
    while True:
        near, far = F.col("piece") * size, F.col("piece") * size + size - 1
        whole = (F.col("least") <= near) & (far <= F.col("most"))
        keyed = materialize(
            live.withColumn("core", F.substring("held", F.col("most") - near + 1, F.lit(length) - size + 1)).withColumn(
                "hull", F.when(whole, F.substring("held", F.col("most") - far + 1, F.lit(length) + size - 1))
            )
        )
        hulls = (
            keyed.where("hull is not null")
            .groupBy("anchor", "piece", "hull")
            .agg(F.count("*").alias("n_hull"), F.min(place).alias("witness"))
        )
        repeated = F.col("done") | F.coalesce(F.col("n_hull") > 1, F.lit(False))
        judged = materialize(
            keyed.join(hulls, ["anchor", "piece", "hull"], "left").drop("hull").withColumn("repeated", repeated)
        )
        spans.append(
            judged.where("repeated and not done").select(
                "k1", "k2", (F.col("position") - far).alias("start"), (F.col("position") - near + length).alias("end")
            )
        )
        if size == 1:
            return spans
        shared = (
            judged.groupBy("anchor", "piece", "core")
            .agg(F.count("*").alias("n_core"), F.count_if(~F.col("repeated")).alias("n_open"))
            .where("n_core > 1 and n_open > 0")
        )
        # Ranges known to repeat stay, one for each hull, as long as others share their core.
        kept = (
            judged.where(~F.col("repeated") | F.coalesce(F.col("witness") == place, F.lit(False)))
            .join(shared, ["anchor", "piece", "core"])
            .drop("core", "n_core", "n_open", "n_hull", "witness", "done")
        )
        size //= FAN_OUT
        first = F.greatest(F.floor(F.col("least") / size).cast("int"), F.col("piece") * FAN_OUT)
        last = F.least(F.floor(F.col("most") / size).cast("int"), F.col("piece") * FAN_OUT + FAN_OUT - 1)
        live = kept.withColumnRenamed("repeated", "done").withColumn("piece", F.explode(F.sequence(first, last)))


def without_spans(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside all spans, and the spans joined where they touch."""
    joined: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    kept, at = [], 0
    for start, end in joined:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return b"".join(kept), [(a, b) for a, b in joined]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if it lies in a string of `length` bytes that also starts
    anywhere else, in the same text or another. `spans` are the maximal removed
    runs [start, end). Matches never cross texts. Null and empty texts have no
    bytes; texts shorter than `length` lose nothing; equal texts of at least
    `length` bytes lose everything. Null and repeated ids are passed on.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).alias("k2"), text.alias("text")
    )
    found = anchor_rows(base, length, gram)
    often = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("often"))
    places = materialize(found.join(often, F.col("anchor") == F.col("often")).drop("often"))
    places = places.distinct()

    # Contexts: places with the same windows. Two such places repeat all of them; an anchor with
    # one context needs no more, others are ranked, one place for each context.
    contexts = materialize(
        places.groupBy("anchor", "context").agg(
            F.count("*").alias("n_places"), F.min(F.struct("k1", "k2", "position", "most")).alias("chosen")
        )
    )
    spread = contexts.groupBy("anchor").agg(F.count("*").alias("n_contexts")).where("n_contexts > 1")
    sized = contexts.join(spread, "anchor", "left").where("n_places > 1 or n_contexts > 1").select(
        F.col("anchor").alias("_a"), F.col("context").alias("_c"), "n_places", "n_contexts", "chosen"
    )
    told = places.join(sized, (F.col("anchor") == F.col("_a")) & (F.col("context") == F.col("_c")))
    ranked = F.col("n_contexts").isNotNull() & (F.col("chosen") == F.struct("k1", "k2", "position", "most"))
    by_text = told.groupBy("k1", "k2").agg(
        F.collect_list(
            F.when(
                F.col("n_places") > 1,
                F.struct(
                    (F.col("position") - F.col("most")).alias("start"),
                    (F.col("position") - F.col("least") + length).alias("end"),
                ),
            )
        ).alias("spans"),
        F.collect_list(F.when(ranked, F.struct("anchor", "position", "most", "least", "n_contexts"))).alias("places"),
    )
    copies = base.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("chosen_id"))
    info = (
        copies.join(by_text, ["k1", "k2"], "left")
        .withColumnRenamed("k1", "_k1")
        .withColumnRenamed("k2", "_k2")
    )
    span_list = "array<struct<start: long, end: long>>"
    result = f"id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {span_list}"
    names = [c.split()[0] for c in result.split(", ")[:5]] + ["spans"]

    def settle(i, raw: bytes, spans) -> tuple:
        kept, joined = without_spans(raw, spans)
        runs = [{"start": a, "end": b} for a, b in joined]
        return i, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs

    extra = f"kind string, anchor long, k1 long, k2 long, position long, most int, least int, n_contexts long, held binary"
    extra_names = [c.split()[0] for c in extra.split(", ")]

    def open_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                raw = row.text.encode()
                i = None if pd.isna(row.id) else row.id
                chosen = i == (None if pd.isna(row.chosen_id) else row.chosen_id)
                blank = (None,) * 6
                for p in row.places if chosen and row.places is not None else ():
                    held = raw[p["position"] - p["most"] : p["position"] - p["least"] + length]
                    where = p["anchor"], row.k1, row.k2, p["position"], p["most"], p["least"], p["n_contexts"], held
                    out.append((*blank, "place", *where))
                if row.copies > 1 and len(raw) >= length:
                    out.append((*settle(i, raw, [(0, len(raw))]), "done", *(None,) * 8))
                elif row.spans is None:
                    out.append((*settle(i, raw, ()), "done", *(None,) * 8))
                else:
                    spans = [(s["start"], s["end"]) for s in row.spans]
                    runs = [{"start": a, "end": b} for a, b in without_spans(raw, spans)[1]]
                    rest = None, row.k1, row.k2, None, None, None, None, zlib.compress(raw, 1)
                    out.append((i, len(raw), None, None, None, runs, "open", *rest))
            table = pd.DataFrame(out, columns=names + extra_names)
            whole = ["n_bytes", "n_removed", "n_spans", "anchor", "k1", "k2", "position", "most", "least", "n_contexts"]
            yield table.astype({c: "Int64" for c in whole})

    joined = base.join(info, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).drop("_k1", "_k2")
    opened = materialize(joined.mapInPandas(open_texts, f"{result}, {extra}"))

    ranked_places = opened.where("kind = 'place'")
    columns = ["anchor", "k1", "k2", "position", "most", "least", "held"]
    spans = _rank_in_tasks(ranked_places.where(F.col("n_contexts") <= PLACES_IN_TASK).select(columns), length, gram)
    hot = ranked_places.where(F.col("n_contexts") > PLACES_IN_TASK).select(columns)
    if not hot.isEmpty():
        for more in _rank_together(hot, length, gram):
            spans = spans.unionByName(more)
    more_spans = spans.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(
        F.collect_list(F.struct("start", "end")).alias("more")
    )

    def close_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                spans = [(s["start"], s["end"]) for s in row.spans]
                spans += [(s["start"], s["end"]) for s in (() if row.more is None else row.more)]
                out.append(settle(None if pd.isna(row.id) else row.id, zlib.decompress(row.held), spans))
            yield pd.DataFrame(out, columns=names)

    closed = (
        opened.where("kind = 'open'")
        .join(more_spans, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
        .select("id", "spans", "more", "held")
        .mapInPandas(close_texts, result)
    )
    done = opened.where("kind = 'done'").select(names)
    return done.unionByName(closed).withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)
