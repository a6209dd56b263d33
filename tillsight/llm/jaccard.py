"""Documents whose sets of word runs are alike, and the groups they form.

Sets are ordered globally, by the digest of their members. The order is cut into
segments, so many that any pair that reaches the threshold agrees on one of them
completely (where segments for certainty would hold too few members, with a
probability of one pair in 10**10 that it does not; small sets have single members
in place of segments, so many that one must be shared). Every set stands in a forest of tries, once under each of its
segments as the root edge, and all links lie below common roots. The forest is
spread by sorting root edges; sets with a common root edge get one cluster number.

Within a cluster, sets are stored in tries along the global order and probed
one after the other: a branch's overlap with the probe is counted once for all
sets below it, and a branch goes when the remaining lengths cannot make up for
what is missing. A probe stops at the first link into each group, as more links
change no group. Large clusters are worked on in chunks that are combined
through their most typical sets; sets outside the largest group then meet every
chunk, so no link is missed.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm import words
from tillsight.llm.columns import positional
from tillsight.llm.components import components, fewer_edges, forest
from tillsight.sources.staging import discard, materialize

#: Sets of fewer members always have single members as roots, and members per segment that count as full.
LEAST_SMALL, FULL = 40, 5
#: Ratio of the smallest to the largest set size of a size class.
CLASS_RATIO = 0.85
#: A pair that just reaches the threshold has no common root with at most this probability (over the digests).
MISSED = 1e-10
#: A member of so many small sets is frequent; at most so many members are treated so.
OFTEN, FREQUENT = 6, 250_000
#: Sets and members per chunk of a cluster, and typical sets a chunk sends on (one, or as many as half a chunk's members).
CHUNK_SETS, CHUNK_MEMBERS, TYPICAL = 256, 1 << 20, 8

#: Texts handled together.
SLICE_ROWS = 512

#: Narrow rows (a few numbers each) that are sent to every task rather than shuffling the texts.
LOOKUP_ROWS = 500_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
IN_WORD = words.byte_class(rb"[^\x20\x09-\x0D]")
_U = np.uint64


class Plan:
    """Size classes of sets and the segments each class is cut into, for runs of `run` words and a percentage."""

    def __init__(self, run: int, percent: int):
        self.run, self.percent = run, percent
        self.small = next(n for n in count(LEAST_SMALL) if self._cut(n, int(n / CLASS_RATIO)))
        self.bounds: list[int] = [self.small]
        self.cuts: list[tuple[int, int, int | None]] = []

    def links(self, overlap: int, size_a: int, size_b: int) -> bool:
        return overlap * (100 + self.percent) >= self.percent * (size_a + size_b)

    def is_small(self, size: int) -> bool:
        """Whether a set of this size may link with one of fewer than `small` members."""
        return self.percent * size < 100 * self.small

    def prefix(self, size: int) -> int:
        """Linked sets of which one is of this size share one of its so many first members, and of the other's."""
        return size - -(-self.percent * size // 100) + 1

    def _cut(self, low: int, high: int) -> tuple[int, int, int | None] | None:
        """Segments for sets from `low` to `high` members, members a root needs, segments that may be empty.

        A pair that just reaches the threshold differs in at most `differ`
        members. With more segments than that some agree for certain; that is
        the choice where segments are still full enough. Else members fall on
        segments at random: of the largest number of members a root can have, the
        fewest segments with which such a pair has no common root with a
        probability below MISSED. None if roots would have single members.
        """
        differ = (high + high * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        spare = 1 + differ // 32
        if differ and low >= FULL * (differ + 1 + spare):
            return differ + 1 + spare, 1, spare
        common = low * self.percent // 100
        for least in (6, 5, 4, 3, 2):
            for segments in range(2, 2 * differ + 2):
                whole = (1 - 1 / segments) ** differ
                mean = common / segments
                filled = 1 - math.exp(-mean) * sum(mean**k / math.factorial(k) for k in range(least))
                if segments * math.log1p(-whole * filled) <= math.log(MISSED):
                    return segments, least, None
        return None

    def classes(self, size: int) -> list[int]:
        """Classes of the smaller set of the pairs a set of at least `small` members can be in."""
        while self.bounds[-1] <= size:
            low = self.bounds[-1]
            high = int(low / CLASS_RATIO)
            self.cuts.append(self._cut(low, high))
            self.bounds.append(high + 1)
        c = bisect_right(self.bounds, size) - 1
        out = [c]
        while c and (self.bounds[c] - 1) * 100 >= self.percent * size:
            c -= 1
            out.append(c)
        return out


def run_sets(texts: list[str | None], run: int) -> Iterator[np.ndarray]:
    """Sorted digests of each text's distinct runs of `run` words; shorter texts have one run of all words."""
    for _, group in words.groups(texts, lambda t: t.encode().translate(_LOWER)):
        digests, bounds = words.word_digests(group, IN_WORD)
        for a, b in zip(bounds, bounds[1:]):
            n = min(run, b - a)
            yield np.unique(words.window_digests(digests[a:b], n)) if n else np.empty(0, _U)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in small batches, so that a task holds few texts and sets at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    words.release_memory()


def set_digest(members: np.ndarray) -> int:
    """A number for the set; equal sets have equal numbers."""
    total = words.mix(members * _U(3) + _U(1)).sum(dtype=_U) + _U(len(members))
    return int(words.mix(np.array([total], _U)).view(np.int64)[0])


def root_edges(members: np.ndarray, plan: Plan, frequent: np.ndarray) -> np.ndarray:
    """Digests of the set's root edges.

    For large sets one per segment and size class that holds enough members; and
    one common root for sets with more empty segments than the class allows.
    Sets that may link with a small one also have single members as roots: the
    first ones of an order that puts `frequent` members (sorted) last.
    """
    n = len(members)
    out = []
    if plan.is_small(n):
        common = np.isin(members, frequent, assume_unique=True)
        ordered = np.concatenate([members[~common], members[common]])
        out.append(words.mix(ordered[: plan.prefix(n)] + _U(7)))
    for c in plan.classes(n) if n >= plan.small else ():
        segments, least, spare = plan.cuts[c]
        where = ((members >> _U(32)) * _U(segments)) >> _U(32)
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        total = np.add.reduceat(words.mix(members), first)
        label = (where[first] + _U(1)) * _U(1 << 20) + _U(c)
        enough = np.diff(np.append(first, n)) >= least
        out.append(words.mix(words.mix(label) + total)[enough])
        if spare is not None and segments - len(first) > spare:
            out.append(words.mix(np.array([c], _U) + _U(1 << 60)))
    return np.concatenate(out) if out else np.empty(0, _U)


def frequent_members(docs: DataFrame, text_col: str, plan: Plan) -> np.ndarray:
    """Members that many small sets have, the most frequent FREQUENT of them at most.

    Any choice gives the same links; this one keeps wording that many texts
    share from being a root of all of them.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            small = [s for s in run_sets(batch.column(0).to_pylist(), plan.run) if plan.is_small(len(s))]
            if small:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(small).view(np.int64))], ["member"])

    counted = docs.select(text_col).mapInArrow(emit, "member long").groupBy("member").agg(F.count("*").alias("n"))
    often = counted.where(F.col("n") >= OFTEN).orderBy(F.col("n").desc(), "member").limit(FREQUENT)
    staged = materialize(often.select("member"))  # so that what was counted goes from the disk
    found = np.sort(np.array([r.member for r in staged.collect()], np.int64).view(_U))
    discard(staged)
    return found


def describe(docs: DataFrame, id_col: str, text_col: str, run: int) -> DataFrame:
    """id, content (digest of the text), n_shingles, node (digest of the set)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [(len(s), set_digest(s)) for s in run_sets(batch.column(2).to_pylist(), run)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))],
                ["id", "content", "n_shingles", "node"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sets, f"id {id_type}, content long, n_shingles long, node long")


def common_roots(docs: DataFrame, text_col: str, plan: Plan) -> DataFrame:
    """Edges `a, b` between sets that stand under a common root, as chains along the sorted roots."""
    frequent = frequent_members(docs, text_col, plan)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            roots, nodes = [], []
            for s in run_sets(batch.column(0).to_pylist(), plan.run):
                node = set_digest(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    edges = root_edges(s, plan, frequent)
                    roots.append(edges)
                    nodes.append(np.full(len(edges), node, np.int64))
            if roots:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(roots).view(np.int64)), pa.array(np.concatenate(nodes))], ["root", "node"]
                )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Neighbours with the same root; root null marks an edge, else the ends of this run of rows.
        last = None
        for batch in batches:
            root, node = (batch.column(k).to_numpy() for k in (0, 1))
            if last is None:
                yield _ends(root[:1], node[:1])
            else:
                root, node = np.append(last[0], root), np.append(last[1], node)
            same = np.flatnonzero((root[1:] == root[:-1]) & (node[1:] != node[:-1]))
            kept = same[forest(node[same], node[same + 1])]
            if len(kept):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(kept), pa.int64()), pa.array(node[kept]), pa.array(node[kept + 1])], ["root", "a", "b"]
                )
            last = root[-1:], node[-1:]
        if last is not None:
            yield _ends(*last)

    def _ends(root: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(root), pa.array(node), pa.array(node)], ["root", "a", "b"])

    rows = docs.select(text_col).mapInArrow(emit, "root long, node long")
    chained = materialize(
        rows.repartitionByRange("root", "node")
        .sortWithinPartitions("root", "node")
        .mapInArrow(chain, "root long, a long, b long")
    )
    inner = chained.where("root is null").select("a", "b")
    ends = chained.where("root is not null")
    heads = ends.groupBy("root").agg(F.min("a").alias("head"))
    between = ends.join(heads, "root").select("a", F.col("head").alias("b"))
    edges = materialize(fewer_edges(inner.unionByName(between)))
    discard(chained)
    return edges


class Trie:
    """Sets of one group along the global order; unbranched stretches are one edge.

    A node: [edge, children, shortest set, longest set, most members below the
    edge, name]. Every set ends in an own leaf, as paths end with a mark.
    """

    def __init__(self, plan: Plan):
        self.plan = plan
        self.stored: list[tuple[int, np.ndarray]] = []
        self.roots: dict[int, list] = {}

    def add(self, name: int, path: np.ndarray) -> None:
        self.stored.append((name, path))
        size, at, children = len(path) - 1, 0, self.roots
        while True:
            node = children.get(int(path[at]))
            if node is None:
                children[int(path[at])] = [path[at:], {}, size, size, 0, name]
                return
            edge = node[0]
            n = min(len(edge), len(path) - at)
            differ = np.flatnonzero(edge[:n] != path[at : at + n])
            if len(differ):
                k = int(differ[0])
                rest = [edge[k:], *node[1:]]
                node[0], node[1], node[4], node[5] = edge[:k], {int(edge[k]): rest}, len(edge) - k + node[4], None
            at += len(node[0])
            node[2], node[3], node[4] = min(node[2], size), max(node[3], size), max(node[4], len(path) - at)
            children = node[1]

    def find(self, path: np.ndarray, inside: np.ndarray) -> int | None:
        """Some stored set that links with the probe; `inside` marks the probe's members."""
        size, percent, links = len(path) - 1, self.plan.percent, self.plan.links
        todo = [(node, 0) for node in self.roots.values()]
        while todo:
            (edge, children, shortest, longest, below, name), overlap = todo.pop()
            if longest * 100 < percent * size or size * 100 < percent * shortest:
                continue
            overlap += int(np.count_nonzero(inside[edge]))
            left = max(0, size - int(np.searchsorted(path, edge[-1], "right")))
            if links(overlap + min(left, below), size, shortest):
                if not children:
                    return name
                todo += [(child, overlap) for child in children.values()]
        return None


def link_sets(plan: Plan, names: list[int], sets: list[np.ndarray], groups: list[int], probes=None):
    """Edges that join all linked sets of one chunk, and each set's group afterwards.

    `groups` are groups known before. With `probes` (positions) only pairs with
    one of these sets count; without, all pairs do.
    """
    values = np.unique(np.concatenate(sets))
    paths = [np.append(np.sort(np.searchsorted(values, s)), len(values)) for s in sets]
    inside = np.zeros(len(values) + 1, bool)
    tries: dict[int, Trie] = {}
    joined: dict[int, int] = {}
    edges: list[tuple[int, int]] = []

    def group_of(i: int) -> int:
        g = groups[i]
        while g in joined:
            g = joined[g]
        return g

    def join(g: int, h: int) -> int:
        small, large = sorted((g, h), key=lambda x: len(tries[x].stored) if x in tries else 0)
        for name, path in tries.pop(small).stored if small in tries else ():
            tries[large].add(name, path)
        joined[small] = large
        return large

    def meet(i: int) -> None:
        own = group_of(i)
        inside[paths[i][:-1]] = True
        for g in list(tries):
            if g != own and g in tries:
                hit = tries[g].find(paths[i], inside)
                if hit is not None:
                    edges.append((names[i], hit))
                    own = join(own, g)
        inside[paths[i]] = False

    def store(i: int) -> None:
        tries.setdefault(group_of(i), Trie(plan)).add(names[i], paths[i])

    for i in range(len(names)):
        if probes is None:
            meet(i)
        store(i)
    for i in probes or ():
        meet(i)
    return edges, [group_of(i) for i in range(len(names))]


def _typical(sets: list[np.ndarray], groups: list[int]) -> list[int]:
    """Positions of the sets of the largest group whose members are the most common in it."""
    sizes = pd.Series(groups).value_counts()
    largest = min(sizes.index[sizes == sizes.max()])
    own = [i for i, g in enumerate(groups) if g == largest]
    values, where = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True)
    common = np.bincount(where)
    ends = np.cumsum([len(sets[i]) for i in own])
    score = [common[where[e - len(sets[i]) : e]].mean() for i, e in zip(own, ends)]
    best = [own[k] for k in np.argsort(score)[::-1][:TYPICAL]]
    held = np.cumsum([len(sets[i]) for i in best])
    return best[: max(1, int(np.searchsorted(held, CHUNK_MEMBERS // 2, "right")))]


def _grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list]]:
    """Rows of each key, of frames sorted by it; rows without the key, one per node."""
    key, rows = None, {}
    for frame in frames:
        rest = [c for c in frame.columns if c not in keys]
        for now, row in zip(zip(*(frame[k] for k in keys)), zip(*(frame[c] for c in rest))):
            if now != key:
                if rows:
                    yield key, list(rows.values())
                key, rows = now, {}
            if row[0] not in rows or row[-1]:
                rows[row[0]] = row
    if rows:
        yield key, list(rows.values())


LINKED = "kind string, cluster long, a long, b long, members array<long>, chunk long, chunks long"
LINKED_COLUMNS = ["kind", "cluster", "a", "b", "members", "chunk", "chunks"]
LINKED_KINDS = pa.schema(
    [
        (c, pa.string() if c == "kind" else pa.list_(pa.int64()) if c == "members" else pa.int64())
        for c in LINKED_COLUMNS
    ]
)


def _by_slices(fn, kinds: pa.Schema):
    """A function of pandas frames that gets few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batch.to_pandas() for batch in _slices(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    return run


def _chunks_needed():
    """Chunks for all sets of a cluster, by their number and their members; at most one for each set."""
    members = F.ceil(F.sum(F.size("members")) / CHUNK_MEMBERS)
    return F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.least(members, F.count("*")), F.lit(1))


def _chunked(sets: DataFrame) -> DataFrame:
    """Add `chunks` of the set's cluster and `chunk`."""
    sizes = sets.groupBy("cluster").agg(_chunks_needed().alias("chunks"))
    return sets.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("node", "chunks"), "chunks"))


def _fewer_chunks(typical: DataFrame) -> DataFrame:
    """The next level: neighbouring chunks become one, so that at most half of them (rounded up) remain.

    Levels end after the logarithm of the first one's chunks, whatever the sets'
    sizes. Three chunks at most meet where the half is the bound, with half a
    chunk's members or one set each.
    """
    sizes = typical.groupBy("cluster").agg(F.least(_chunks_needed(), F.ceil(F.max("chunks") / 2)).alias("fewer"))
    return (
        typical.join(sizes, "cluster")
        .withColumn("chunk", F.expr("chunk * fewer div chunks"))
        .withColumn("chunks", F.col("fewer"))
        .drop("fewer")
    )


def _link_chunks(chunked: DataFrame, plan: Plan) -> DataFrame:
    """Edges inside chunks; of clusters with several chunks also each one's typical sets."""

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (cluster, chunk), rows in _grouped(frames, ["cluster", "chunk"]):
            names, groups, sets = ([r[k] for r in rows] for k in range(3))
            edges, after = link_sets(plan, names, sets, groups)
            chunks = rows[0][3]
            out += [("edge", cluster, a, b, None, chunk, chunks) for a, b in edges]
            if chunks > 1:
                out += [
                    ("typical", cluster, names[i], after[i], sets[i], chunk, chunks) for i in _typical(sets, after)
                ]
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=LINKED_COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=LINKED_COLUMNS)

    return (
        chunked.select("cluster", "chunk", "node", "grp", "members", "chunks", F.lit(False).alias("probe"))
        .repartition("cluster", "chunk")
        .sortWithinPartitions("cluster", "chunk")
        .mapInArrow(_by_slices(link, LINKED_KINDS), LINKED)
    )


def _link_rest(chunked: DataFrame, groups: DataFrame, plan: Plan) -> DataFrame:
    """Links between the sets outside each cluster's largest group and all sets of the cluster."""
    known = chunked.join(groups.withColumnRenamed("label", "known"), "node", "left").withColumn(
        "grp", F.coalesce("known", "node")
    )
    known = materialize(known.select("cluster", "chunks", "chunk", "node", "grp", "members"))
    sizes = known.groupBy("cluster", "grp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max_by("grp", F.struct("n", "grp")).alias("main"))
    rest = known.join(largest, "cluster").where("grp <> main").drop("main")
    blocks = rest.groupBy("cluster").agg(F.ceil(F.count("*") / CHUNK_SETS).alias("blocks"))
    rest = rest.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node", "blocks"), "blocks"))
    columns = ["cluster", "chunk", "block", "node", "grp", "members", "probe"]
    stored = known.join(blocks, "cluster").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("probe")
    )
    probing = rest.drop("chunk").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("probe")
    )

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (cluster, _, _), rows in _grouped(frames, ["cluster", "chunk", "block"]):
            names, groups, sets, probe = ([r[k] for r in rows] for k in range(4))
            edges, _ = link_sets(plan, names, sets, groups, [i for i, p in enumerate(probe) if p])
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])

    return (
        stored.select(columns)
        .unionByName(probing.select(columns))
        .repartition("cluster", "chunk", "block")
        .sortWithinPartitions("cluster", "chunk", "block")
        .mapInArrow(_by_slices(link, pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a long, b long")
    )


def lookup(rows: DataFrame) -> DataFrame:
    """Narrow rows to look up in: sent to every task if they are at most LOOKUP_ROWS, else joined by shuffling."""
    return F.broadcast(rows) if rows.count() <= LOOKUP_ROWS else rows


def linked_sets(docs: DataFrame, described: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """Edges `a, b` between sets that reach the threshold; enough of them for the groups."""
    clusters = components(common_roots(docs, text_col, plan)).withColumnRenamed("label", "cluster")
    one = (
        described.join(clusters, "node")
        .groupBy("node", "cluster")
        .agg(F.min(F.struct("content", "id")).alias("r"))
        .select("node", "cluster", F.col("r.content").alias("c"), F.col("r.id").alias("i"))
    )
    one = lookup(materialize(one))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    wanted = texts.join(one, (F.col("content") == F.col("c")) & F.col("id").eqNullSafe(F.col("i"))).select(
        "cluster", "node", "text"
    )
    run = plan.run

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [s.view(np.int64) for s in run_sets(batch.column(2).to_pylist(), run)]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], ["cluster", "node", "members"])

    sets = materialize(wanted.mapInArrow(members, "cluster long, node long, members array<long>"))
    first = level = materialize(_chunked(sets.withColumn("grp", F.col("node"))))
    discard(sets)
    found, used = [], []
    while True:
        linked = materialize(_link_chunks(level, plan))
        used += [linked] if level is first else [linked, level]
        found.append(linked.where("kind = 'edge'").select("a", "b"))
        typical = linked.where("kind = 'typical'").select(
            "cluster", F.col("a").alias("node"), F.col("b").alias("grp"), "members", "chunk", "chunks"
        )
        if typical.isEmpty():
            break
        level = materialize(_fewer_chunks(typical))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    edges = materialize(fewer_edges(edges))
    for table in used:
        discard(table)
    several = first.where("chunks > 1")
    if not several.isEmpty():
        edges = edges.unionByName(_link_rest(several, components(edges), plan))
    return edges


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links).

    A text's set holds its distinct runs of `run` words, lower-cased in A-Z; a
    shorter text has one run. Two documents link when 100 * intersection >=
    percent * union. Null and empty texts have empty sets and link with nothing.
    Null ids never name a component that has others. Equal texts and equal sets
    are one set from the start, whatever their number. Runs are compared as
    64-bit digests. Empty tables give empty results.
    """
    placed = _placed(docs, id_col, text_col, Plan(run, percent))
    smallest = placed.groupBy("label").agg(F.min("id").alias("component_id")).withColumnRenamed("label", "_l")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return placed.join(smallest, F.col("label") == F.col("_l"), "left").select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id")
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """id, content, n_shingles and the label of the row's group (null for texts without words), staged."""
    described = materialize(describe(docs, id_col, text_col, plan.run))
    labels = components(linked_sets(docs, described, id_col, text_col, plan))
    known = labels.withColumnRenamed("node", "_node")
    return materialize(
        described.join(known, F.col("node") == F.col("_node"), "left").select(
            "id", "content", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")).alias("label")
        )
    )


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 5, percent: int = 80
) -> DataFrame:
    """`docs` without near copies: of each group the row with the smallest id stays, all columns unchanged.

    Rows without an id go before rows with one; of rows that repeat id and text
    one stays. Texts without words group with nothing and stay. Columns may have any names.
    """
    names = docs.columns
    docs, at = positional(docs)
    id_col, text_col = at[id_col], at[text_col]
    placed = _placed(docs, id_col, text_col, Plan(run, percent)).where("label is not null")
    row = F.struct(F.isnull("id").alias("no_id"), "id", "content")
    first = placed.groupBy(F.col("label").alias("_l")).agg(F.min(row).alias("_first"))
    judged = placed.join(first, F.col("label") == F.col("_l")).select(
        F.col("id").alias("_id"), F.col("content").alias("_content"), (row == F.col("_first")).alias("_stays")
    )
    counted = judged.groupBy("_id", "_content", "_stays").agg(F.count("*").alias("_n"))
    special = materialize(counted.where("not _stays or _n > 1"))
    gone, repeated = (lookup(special.where(c).select("_id", "_content")) for c in ("not _stays", "_stays"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_content"))
    stay = docs.join(gone, same, "left_anti")
    once = stay.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col])
    return stay.join(repeated, same, "left_anti").unionByName(once).toDF(*names)
