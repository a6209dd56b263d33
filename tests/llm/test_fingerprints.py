import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillsight.llm import fingerprints as fp
from tillsight.llm.components import components, forest

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text, run=3):
    ws = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in (text or "").translate(LOWER)).split(" ") if w]
    runs = [" ".join(ws[i : i + run]) for i in range(len(ws) - run + 1)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_of(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("piece", [4, 5, 1 << 16])
def test_fingerprint_equals_the_definition(spark, monkeypatch, piece):
    monkeypatch.setattr(fp, "PIECE_WORDS", piece)
    rng = random.Random(5)
    texts = ["", "one", "One TWO", "a b c", "Ä Ö ß x\x0by\x1cz w"]
    texts += [" \n".join(rng.choice(["Aa", "bé", "c,", "日本"]) for _ in range(n)) + "\t" for n in range(1, 30)]
    assert [fp.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    hashed = spark.createDataFrame([("größe a b",)], "t string").select(F.xxhash64("t").alias("h")).first().h
    assert xxhash.xxh64_intdigest("größe a b".encode(), fp.SEED) == hashed % 2**64


def crowd(rng, n):
    """Dense balls around a few fingerprints, chains of two bits, and scattered ones."""
    out = {0, 2**64 - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(n):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            out.add(x)
        for _ in range(10):
            for b in rng.sample(range(64), 2):
                centre ^= 1 << b
            out.add(centre)
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


@pytest.mark.parametrize("common,held,within", [(1 << 16, 1 << 16, 2), (5, 64, 2), (30, 16, 1), (20, 100, 3)])
def test_links_lose_no_pair(spark, monkeypatch, common, held, within):
    monkeypatch.setattr(fp, "COMMON_KEY", common)
    monkeypatch.setattr(fp, "HELD", held)
    prints = crowd(random.Random(common + within), 60)
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(4)
    got = {r.node: r.label for r in components(fp.links(df, within)).collect()}
    want = groups_of(signed, lambda a, b: (a ^ b).bit_count() <= within if (a < 0) == (b < 0) else ((a ^ b) & (2**64 - 1)).bit_count() <= within)
    assert {p: got.get(p, p) for p in signed} == want


def test_near_copies(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice([f"w{i}" for i in range(200)]) for _ in range(n))
    base = [say(rng.randint(0, 80)) for _ in range(60)]
    rows = [(2**53 + 2 * i + 1, t) for i, t in enumerate(base)]
    rows += [(-i - 1, base[i] + " " + base[i + 1].split(" ")[0]) for i in range(0, 50, 3)]
    rows += [(None, base[3]), (None, None), (5, None), (4, " \n"), (9, base[7].upper()), (9, base[7]), (None, "quite alone")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, label int")
    got = fp.near_copies(df.repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = {t: plain_fingerprint(t) for _, t in rows}
    label = groups_of(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in rows:
        if i is not None:
            least[label[prints[t]]] = min(i, least.get(label[prints[t]], i))
    want = [(i, f"{prints[t]:016x}", least.get(label[prints[t]])) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert fp.near_copies(df.limit(0)).collect() == []


def test_forest_connects_the_same_without_circles():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, (2, 300))
    kept = forest(a, b)
    whole = groups_of(range(60), lambda x, y: bool(np.any((a == x) & (b == y) | (a == y) & (b == x))))
    edges = {(int(x), int(y)) for x, y in zip(a[kept], b[kept])}
    assert groups_of(range(60), lambda x, y: (x, y) in edges or (y, x) in edges) == whole
    assert len(kept) == 60 - len(set(whole.values()))


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_components_of_odd_shapes(spark, monkeypatch, held):
    monkeypatch.setattr("tillsight.operators.components.HELD_EDGES", held)
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(60)]
    loops = [(5000, 5000), (None, 3), (4, None), (7, 7)]
    ring = [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)] * 2
    edges = chain + star + loops + ring + [(-5, 1020)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    want = {i: 0 for i in range(101)} | {1000 + i: -5 for i in range(60)} | {2000 + i: 2000 for i in range(30)} | {-5: -5}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
