import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillsight.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, k string, x double"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "extra", None, 0.5) for i, t, s in rows], SCHEMA)


def shares(sizes):
    """Word shares by plain resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    left = total
    while free:
        w = sum(weight[s] for s in free)
        trial = {s: left * weight[s] / w for s in free}
        full = {s for s in free if trial[s] > 3 * sizes[s]}
        if not full:
            return target | trial
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= full
    return target


def test_mix_targets_and_totals(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        s = rng.choice(["hot"] * 9 + ["b", "é", None, "", "tiny"])
        if s == "tiny" and i > 900:
            s = "hot"
        rows.append((i, " ".join(["w"] * int(rng.paretovariate(1.1) * 3)), s))
    rows += [(5000, None, "hot"), (5001, "", "b"), (None, "one two", "b"), (7, "a b c", "é"), (7, "a b c", "é")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    want = shares(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        share = want[r.source] / sizes[r.source]
        assert r.size == 0 or int(share) <= r.copies <= int(share) + 1
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_meetings_keep_words_and_expectation():
    rng = random.Random(1)
    for _ in range(200):
        sa, sb, a, b = rng.randint(1, 50), rng.randint(1, 50), rng.random(), rng.random()
        up = mixing.meet(sa, a, sb, b, 0.0)
        down = mixing.meet(sa, a, sb, b, 0.999999999)
        for x, y in (up, down):
            assert sa * x + sb * y == pytest.approx(sa * a + sb * b)
            assert min(abs(x), abs(1 - x), abs(y), abs(1 - y)) < 1e-9
        p = (a - down[0]) / (up[0] - down[0]) if up[0] != down[0] else 1.0
        assert p * up[0] + (1 - p) * down[0] == pytest.approx(a)


def test_copies_are_unbiased(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "ab"[i % 2]) for i in range(60)]
    docs = docs_of(spark, rows)
    total = defaultdict(float)
    runs = 12
    for seed in range(runs):
        for r in mixing.mix(docs, seed=seed).collect():
            total[r.source] += r.copies / 30
    assert total["a"] / runs < total["b"] / runs
    assert total["a"] / runs == pytest.approx(mixing.mix(docs).where("source = 'a'").select(F.first(F.expr("target / source_size"))).first()[0], abs=0.1)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).collect() == []
    only = mixing.mix(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.target) for r in only] == [(0, 0.0), (0, 0.0)]


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "abc"[i % 3]) for i in range(90)] + [(7, "x y", "a"), (7, "x y", "a")]
    docs = docs_of(spark, rows)
    copies = mixing.mix(docs).agg(F.sum("copies"), F.sum(F.col("size") * F.col("copies"))).first()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == copies[0]
    assert out.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == copies[1]
