import math
from collections import Counter

import numpy as np
import pytest

from tillsight.operators import density


def plain_topics(rows, least, min_points):
    """Density clustering that compares all pairs."""
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    keys = sorted(unit)
    near = {a: {b: round(float(unit[a] @ unit[b]), density.DIGITS) for b in keys if a != b} for a in keys}
    near = {a: {b: s for b, s in bs.items() if s >= least} for a, bs in near.items()}
    core = {a for a in keys if len(near[a]) + 1 >= min_points}
    label = {}
    for a in keys:
        if a in core and a not in label:
            todo, label[a] = [a], a
            while todo:
                for b in near[todo.pop()]:
                    if b in core and b not in label:
                        label[b] = a
                        todo.append(b)
    for a in keys:
        if a not in core and near[a].keys() & core:
            label[a] = label[min(near[a].keys() & core, key=lambda b: (-near[a][b], b))]
    sizes = Counter(label.values())
    first = {t: min(a for a in label if label[a] == t) for t in sizes}
    order = {t: i for i, t in enumerate(sorted(sizes, key=lambda t: (-sizes[t], first[t])))}
    return {a: order[label[a]] if a in label else density.OUTLIER for a in keys}


def planted(seed, clusters, per, noise, width=24):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        centre = rng.standard_normal(width)
        rows += [centre + 0.25 * rng.standard_normal(width) for _ in range(rng.integers(per // 2, per))]
    rows += list(rng.standard_normal((noise, width)))
    return [(int(k), [float(c) for c in v]) for k, v in zip(rng.permutation(len(rows)) * 3 - 50, rows)]


@pytest.mark.parametrize("bucket_rows", [1024, 40])
def test_topics_equal_a_comparison_of_all_pairs(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(density, "BUCKET_ROWS", bucket_rows)
    rows = planted(4, 7, 60, 80)
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(5)
    got = {r.id: r.topic for r in density.density_topics(df, "id", "e", 0.85, 5, tables=24).collect()}
    assert got == plain_topics(rows, 0.85, 5)
    assert len(set(got.values())) >= 7 and density.OUTLIER in got.values()


def test_neighbour_recall(spark, monkeypatch):
    monkeypatch.setattr(density, "BUCKET_ROWS", 64)
    rows = planted(9, 12, 80, 300)
    vectors = density.unit_vectors(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e")
    buckets = density._buckets(density._codes(vectors, 24, 16, 1), len(rows))
    members = buckets.groupBy("table", "depth", "bucket").agg({"node": "collect_list"}).collect()
    assert max(len(m[3]) for m in members) <= 64
    met = {(a, b) for m in members for a in m[3] for b in m[3]}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    near = [(a, b) for a in unit for b in unit if a != b and unit[a] @ unit[b] >= 0.85]
    assert sum(p in met for p in near) / len(near) > 0.95


def test_copies_count_and_vectors_without_direction_are_outliers(spark, monkeypatch):
    monkeypatch.setattr(density, "BUCKET_ROWS", 8)
    monkeypatch.setattr(density, "PLANES", 12)
    line = [(100 + i, [1.0, 1e-9 * i]) for i in range(40)]
    rows = [(i, [0.0, 2.0]) for i in range(6)] + [(6, [0.0, 4.0]), (7, [-1.0, 0.0])] + line
    rows += [(8, [0.0, 0.0]), (9, None), (10, [1.0, None]), (11, [math.nan, 1.0]), (12, [math.inf, 1.0]), (13, [1.0]), (14, [])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    got = {r.id: r.topic for r in density.density_topics(df, "id", "e", 0.99, 5).collect()}
    assert got == {i: density.OUTLIER for i in range(7, 15)} | {i: 1 for i in range(7)} | {k: 0 for k, _ in line}
    assert density.density_topics(df.limit(0), "id", "e", 0.9).collect() == []
