import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    clean = [f"word{i}" for i in range(150)] + ["the", "of", "and"] * 30
    rude = ["grumblo", "snarlix", "vexor"]
    rows, labels = [], []
    for i in range(n):
        toxic, low = rng.random() < 0.15, rng.random() < 0.3
        ws = [rng.choice(clean) for _ in range(rng.randint(5, 120))]
        if low:
            ws += ["click", "here"] * rng.randint(1, 3)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                ws.insert(rng.randrange(len(ws)), rng.choice(rude) + rng.choice(["", "s", "ing"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "x", 0.1) for i, t in rows], "doc_id long, text string, toxic string, quality double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500)
    docs, known = frames(spark, rows, labels)
    chain = toxicity.train(docs, known.where("doc_id < 1000"))
    assert chain.categories == ["low_quality", "toxic"]
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    got = {r.doc_id: r for r in toxicity.score(docs, chain).where("doc_id >= 1000").collect()}
    right = sum(got[i].rejected == bool(t) for i, _, t in labels if i >= 1000)
    low = sum((got[i].toxicity.low_quality >= 0.5) == (not q) for i, q, _ in labels if i >= 1000)
    assert right >= 495 and low >= 480


def test_chain_equals_a_plain_sum():
    rng = np.random.default_rng(0)
    texts = ["alpha beta", "BETA gamma gamma", "", None, "delta " * 3000 + "alphabetical"]
    stems = {}
    for t in ["alph", "beta", "alphabetical", "alphab"]:
        digests, _ = toxicity.words.word_digests([t.encode()], toxicity.IN_WORD)
        stems[t] = int(digests[0])
    vocabulary = np.array(sorted(stems.values()), np.uint64)
    w = [rng.normal(size=4), rng.normal(size=5)]
    chain = toxicity.Chain(vocabulary, ["a", "b"], w, [0.3, -0.2])
    got = chain(texts)
    for i, t in enumerate(texts):
        have = {x[:k] for x in (t or "").lower().split() for k in (4, 6, None)}
        at = [int(np.searchsorted(vocabulary, stems[s])) for s in stems if s in have]
        first = 1 / (1 + np.exp(-(0.3 + w[0][at].sum())))
        second = 1 / (1 + np.exp(-(-0.2 + w[1][at].sum() + w[1][4] * first)))
        assert got[i] == pytest.approx([first, second])


def test_odd_tables(spark):
    rows, labels = corpus(60)
    docs, known = frames(spark, rows + [(None, "grumblo"), (900, None), (901, "")], labels + [(None, 1, 1), (5000, 1, 0), (3, None, 1)])
    chain = toxicity.train(docs, known)
    out = toxicity.score(docs, chain)
    assert out.count() == 63 and out.where("rejected is null").count() == 0
    assert toxicity.score(docs.limit(0), chain).collect() == []
    untrained = toxicity.train(docs, known.limit(0))
    assert toxicity.score(docs, untrained).where("rejected").count() == 0
    same = toxicity.train(docs.repartition(3), known.repartition(2))
    for a, b in zip(chain.weights, same.weights):
        assert a == pytest.approx(b, abs=1e-3)
    assert out.select(F.col("toxicity.toxic")).dtypes == [("toxic", "double")]


def test_a_label_that_is_null_leaves_only_its_category_out(spark):
    rows, labels = corpus(600)
    docs, known = frames(spark, rows, labels)
    half = known.withColumn("quality", F.lit(None).cast("int"))
    chain = toxicity.train(docs, half)
    out = {r.doc_id: r.rejected for r in toxicity.score(docs, chain).collect()}
    assert sum(out[i] == bool(t) for i, _, t in labels) >= 590
    assert not np.any(chain.weights[0])


def test_features_of_a_fold_do_not_see_it(spark):
    counts = [(1, 0, 9, 9.0, 9), (1, 1, 1, 1.0, 1), (2, 1, 8, 8.0, 8), (3, 2, 4, 4.0, 4), (None, 0, 50, 9.0, 50), (None, 1, 50, 9.0, 50)]
    counted = spark.createDataFrame(counts, "stem long, fold int, n long, toxic double, known_toxic long")
    chosen = [v.tolist() for v in toxicity._tell_apart(counted, ["toxic"], 10)]
    assert chosen == [[1, 2], [2], [1], [1, 2]]


def test_linear_fit_reaches_the_least_loss(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    held, dense = rng.random((400, 12)) < 0.3, rng.random((400, 1))
    label = (rng.random(400) < 1 / (1 + np.exp(2 - held[:, 0] * 3 - held[:, 1] + held[:, 2] - dense[:, 0]))) * 1.0
    owner, at = np.nonzero(held)
    weights, intercept = toxicity.fit_linear(owner, at, dense, label, 12, steps=500)
    rows = [(float(y), Vectors.dense([*x, *d])) for y, x, d in zip(label, held * 1.0, dense)]
    table = spark.createDataFrame(rows, ["label", "features"])
    plain = LogisticRegression(regParam=toxicity.PENALTY, standardization=False, maxIter=500, tol=1e-12).fit(table)
    assert weights == pytest.approx(plain.coefficients.toArray(), abs=2e-2)
    assert intercept == pytest.approx(plain.intercept, abs=2e-2)
    for y, sure in ((np.ones(2), 20.0), (np.zeros(2), -20.0), (np.zeros(0), -20.0)):
        none = np.zeros(0, np.int64)
        weights, intercept = toxicity.fit_linear(none, none, np.zeros((len(y), 1)), y, 3)
        assert intercept == sure and not weights.any() and len(weights) == 4
