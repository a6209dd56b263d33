import random
import re

import numpy as np
import pytest

from tillsight.llm import jaccard


def plain_groups(rows, run, percent):
    """Component of each row by comparing all pairs of sets."""
    sets = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(run, len(ws))
        sets.append({tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if n else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and top(i) != top(j) and 100 * len(a & b) >= percent * len(a | b):
                parent[top(i)] = top(j)
    out = {}
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.setdefault(rows[i][0], []).append((len(sets[i]), min(ids, default=None)))
    return {k: sorted(v, key=str) for k, v in out.items()}


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, most)):
            k = rng.randrange(len(ws))
            what = rng.randrange(3)
            if what == 0:
                ws[k] = f"new{rng.randrange(10**6)}"
            elif what == 1:
                del ws[k]
            else:
                ws.insert(k, "the")
        out.append(" ".join(ws))
    return out


def corpus(seed, sizes=(1, 2, 3, 6, 9, 14, 25, 60, 150)):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 4 + [f"w{i}" for i in range(80)]
    texts = []
    for size in sizes:
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            texts += near_copies(rng, base, rng.randint(1, 9), max(1, size // 12))
    texts += [None, "", " \t ", texts[5].upper(), texts[-1] + "\n", texts[-1]]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[-2]), (None, "nothing like it at all here"), rows[3]]


@pytest.mark.parametrize("run,percent,chunk", [(3, 90, 256), (5, 80, 256), (3, 90, 6)])
def test_groups_equal_all_pairs(spark, monkeypatch, run, percent, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    monkeypatch.setattr(jaccard, "TYPICAL", 2)
    rows = corpus(run + chunk)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, node string, members int")
    got = {}
    for r in jaccard.similar_groups(docs, run=run, percent=percent).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert {k: sorted(v, key=str) for k, v in got.items()} == plain_groups(rows, run, percent)


@pytest.mark.parametrize("members", [1, 330, 700])
def test_levels_end_for_sets_that_fill_a_chunk(spark, monkeypatch, members):
    """Chunks bounded by members hold few sets of one group, all of them typical."""
    monkeypatch.setattr(jaccard, "CHUNK_MEMBERS", members)
    levels, link_chunks = [], jaccard._link_chunks

    def counted(level, plan):
        levels.append(level)
        assert len(levels) <= 8, "levels do not end"
        return link_chunks(level, plan)

    monkeypatch.setattr(jaccard, "_link_chunks", counted)
    rng = random.Random(members)
    base = [f"w{i}" for i in range(150)]
    texts = near_copies(rng, base, 10, 3) + near_copies(rng, [f"v{i}" for i in range(150)], 3, 20)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(r.n_shingles, r.component_id)] for r in jaccard.similar_groups(docs, run=3, percent=80).collect()}
    assert got == plain_groups(rows, 3, 80)
    assert len(levels) > 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.similar_groups(docs).collect()] == [(1, 0, 1)]
    assert jaccard.similar_groups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_root(percent):
    rng = np.random.default_rng(percent)
    plan = jaccard.Plan(3, percent)
    for _ in range(1500):
        n = int(rng.integers(1, 700))
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        m = int(rng.integers(max(1, n * percent // 100), n * 100 // percent + 1))
        # The largest difference a pair of these sizes may have, or nearly.
        overlap = max(1, min(-(-percent * (n + m) // (100 + percent)) + int(rng.integers(0, 2)), n, m))
        b = np.concatenate([a[:overlap], rng.integers(0, 2**63, m - overlap, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
        if plan.links(overlap, n, m) and n + m > 2 * overlap:
            frequent = np.sort(rng.permutation(np.concatenate([a, b]))[: rng.integers(0, n)])
            x, y = (set(jaccard.root_edges(np.sort(s), plan, np.unique(frequent)).tolist()) for s in (a, b))
            assert x & y, (n, m, overlap)


def test_trie_finds_what_all_pairs_find():
    rng = np.random.default_rng(0)
    plan = jaccard.Plan(3, 80)
    for _ in range(60):
        base = rng.choice(200, 40, replace=False)
        sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(0, 300, 40), base)) for _ in range(25)]
        sets = [np.array(s) for s in sorted({tuple(s.tolist()) for s in sets})]
        names = list(range(100, 100 + len(sets)))
        edges, groups = jaccard.link_sets(plan, names, sets, list(names))
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if plan.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    want = [want[j] if w == want[i] else w for w in want]
        for i in range(len(sets)):
            for j in range(i):
                assert (groups[i] == groups[j]) == (want[i] == want[j])
        for a, b in edges:
            x, y = sets[a - 100], sets[b - 100]
            assert plan.links(len(np.intersect1d(x, y)), len(x), len(y))


def test_one_of_each_group(spark):
    rows = corpus(11, sizes=(6, 25, 60))
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, label string, content int")
    out = jaccard.one_of_each_group(docs)
    assert out.columns == docs.columns
    groups = {}
    for i, members in plain_groups(rows, 5, 80).items():
        for n, smallest in members:
            groups.setdefault(smallest if n else ("empty", i), []).append(i)
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(groups)
    assert {i for i in kept if i is not None} == {k if not isinstance(k, tuple) else k[1] for k in groups if k is not None}
    assert jaccard.one_of_each_group(docs.limit(0)).collect() == []
