"""Tasks and jobs that must grow with the input, or must not."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.functions import text as tx
from tillsight.operators import boosting, cleaning, customers, keyphrases, models, quality, reviews, stats
from tillsight.plans import canonical as cn

SF_DIR = "/root/testdata/sf0.001"


def test_order_lines_are_dealt_over_more_tasks_as_they_grow(spark, monkeypatch):
    lines = cn.table(spark, SF_DIR, "lineitem").count()
    small = cn.transactions_raw(spark, SF_DIR)
    expected = sorted(map(str, cleaning.drop_exact_duplicates(small).collect()))
    monkeypatch.setattr(cn, "ROWS_PER_TASK", 100)
    distinct = cleaning.drop_exact_duplicates(cn.transactions_raw(spark, SF_DIR))
    # Copies meet in the tasks the lines are dealt over already: no shuffle by all columns into a fixed number.
    assert distinct.rdd.getNumPartitions() == -(-lines // 100)
    assert sorted(map(str, distinct.collect())) == expected


def test_churn_features_count_invoices_where_the_lines_are(spark):
    rows = [
        (1, "a", "2020-01-01", 1.5, False), (1, "a", "2020-01-03", 2.25, False), (1, "b", "2020-02-01", -1.0, True),
        (1, "c", "2020-06-01", 9.0, True), (1, None, "2020-01-02", 0.5, False), (1, "d", None, 7.0, True),
        (2, "e", "2020-01-31", 4.0, False), (2, "e", "2020-05-01", 8.0, False), (3, "f", "2020-07-01", 1.0, False),
        (4, "g", "2020-03-01", 3.0, None),
    ]
    lines = spark.createDataFrame(
        rows, "customer_id bigint, invoice string, invoice_date string, line_value double, is_cancellation boolean"
    )
    found = customers.churn_features(lines.repartition(20, "invoice"), "2020-05-01")
    # The lines stay dealt by invoice; only what is left of an invoice is shuffled by customer.
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert sorted(re.sub(r"#\d+L?", "", s) for s in shuffles) == ["customer_id, 8", "invoice, 20"]
    assert sorted(map(tuple, found.collect())) == [
        (1, 121, 90, 2, 3.25, 1.63, True, 0), (2, 91, 91, 1, 4.0, 4.0, False, 0), (4, 61, 61, 1, 3.0, 3.0, None, 1)
    ]


def test_every_row_is_drawn_in_every_replicate(spark):
    rows = [(i, float((i * 37) % 101), i % 3 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, v double, f boolean")
    got = {r.b: r["diff"] for r in stats.resampled_median_differences(df, "k", "v", "f", 43, 5).collect()}
    assert set(got) == set(range(1, 44))
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])
    for b in got:
        sides = {True: [], False: []}
        for k, v, f in rows:
            u = int(hashlib.md5(f"5|{b}|{k}".encode()).hexdigest()[:8], 16) / 2**32
            sides[f] += [v] * int(np.sum(u >= cuts))
        assert got[b] == pytest.approx(np.median(sides[True]) - np.median(sides[False]))


def test_terms_are_counted_without_a_row_for_each_text_and_term(spark):
    texts = [["a", "b", "a"], ["b"], ["c", "a"], [], ["d", "d", "d"]]
    rows = spark.createDataFrame([(t,) for t in texts], "_terms array<string>")
    found = models.term_frequencies(rows, 3)
    assert "monotonically_increasing_id" not in found._jdf.queryExecution().toString()
    n, n_rows = Counter(w for t in texts for w in t), Counter(w for t in texts for w in set(t))
    assert {tuple(r) for r in found.select("term", "n", "n_rows").collect()} == {(w, n[w], n_rows[w]) for w in "abd"}


def test_keyphrases_split_each_text_once_and_spell_out_ties_only(spark):
    texts = ["late parcel late parcel", "great shop great price", None, "", "the of and"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = keyphrases.keyphrases(df, "id", "t")
    # The texts are staged as words: whatever reads them again does not split them again.
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.keywords for r in found.where("id >= 2").collect()} == {2: "", 3: "", 4: ""}
    names, idf = ["b", "c", "z"], np.array([1.0, 1.0, 1.0])
    assert keyphrases.pick_phrases(np.array([2, 0, 1]), idf, names, 1, 0.5) == ["b c"]
    assert keyphrases.pick_phrases(np.array([], np.int64), idf, names, 5, 0.5) == []


def test_a_profile_compares_rows_in_more_tasks_as_they_grow(spark, monkeypatch):
    lines = cn.transactions_raw(spark, SF_DIR)
    expected = sorted(map(str, quality.table_profile(lines).collect()))
    monkeypatch.setattr(cn, "ROWS_PER_TASK", 100)
    tasks = cn.tasks_for(spark, 4321)
    assert tasks == 44 and cn.tasks_for(spark, 100) is None
    found = quality.table_profile(lines, tasks)
    assert re.search(rf"hashpartitioning\(_d#\d+, {tasks}\)", found._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(str, found.collect())) == expected


def test_boosted_labels_follow_the_entries_that_rows_hold(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        held = {int(f): float(rng.uniform(0.1, 1.0)) for f in rng.choice(np.arange(4, 40), 5, replace=False)}
        held |= {i % 3: float(rng.uniform(0.3, 1.0))} | ({3: 0.9} if i % 3 == 1 else {3: 0.2} if i % 3 == 2 else {})
        rows.append((Vectors.sparse(40, held), i % 3))
    df = spark.createDataFrame(rows, ["features", "label"])
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    model = boosting.fit_boosted_labels(df, "label", 3, 2, 2)
    # A step is one job for all labels, so three labels take no more jobs than one.
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before) <= 16
    assert model.transform(df).where("prediction = label").count() == 400
    first = json.loads(model.getOrDefault("trees"))[0][0]
    # The first tree of a label splits where that leaves the least variance, zero included.
    y = np.array([1.0 if r[1] == 0 else -1.0 for r in rows])
    x = np.array([r[0].toArray() for r in rows])

    def left(f, t):
        return sum(float(np.var(y[s]) * s.sum()) for s in (x[:, f] <= t, x[:, f] > t) if s.any())

    best = min(left(f, t) for f in range(40) for t in np.unique(x[:, f]))
    assert left(first[0][0], first[0][2]) == pytest.approx(best, abs=1e-9)


def test_words_meet_a_small_lexicon_where_they_are(spark, monkeypatch):
    texts = ["Good, not a good day", "not good not x x x good", "... good", None, "", "x", "bad odd void good bad!", "not", "good"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(2)
    lexicon = spark.createDataFrame(
        [("good", 2.0), ("bad", -1.2345678), ("bad", 0.5), ("void", None), (None, 1.0), ("", 9.0)], "word string, valence double"
    )
    for negators in (["not", "odd", ""], []):
        near = reviews.lexicon_sentiment(df, ["id"], "t", lexicon, negators)
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan  # no row for each word
        with monkeypatch.context() as m:
            m.setattr(reviews, "LEXICON_WORDS", 0)
            joined = reviews.lexicon_sentiment(df, ["id"], "t", lexicon, negators)
        assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
        got = dict(map(tuple, near.collect()))
        assert got == dict(map(tuple, joined.collect()))
        first = 2.0 + 2.0 * (reviews.NEGATION_FACTOR if negators else 1.0)
        assert got[0] == first / math.sqrt(first * first + 15) and got[3] == got[4] == got[7] == 0.0


def test_texts_are_split_once(spark):
    df = spark.createDataFrame([(1, 5, " late parcel. rude staff!\u2003 ? \n"), (2, 4, None), (3, 3, " ")], "review_id int, stars int, full_text string")
    found = reviews.aspect_mentions(df, {"delivery": ["parcel"], "staff": ["rude", "late"]})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("lower(") == 1
    assert sorted((r.aspect, r.sentence) for r in found.collect()) == [
        ("delivery", "late parcel."), ("staff", "late parcel."), ("staff", "rude staff!")
    ]
    assert [r[0] for r in df.orderBy("review_id").select(tx.sentences(F.col("full_text"))).collect()] == [
        ["late parcel.", "rude staff!", "?"], None, []
    ]
    keywords = cn.keywords_of(df.withColumnRenamed("full_text", "review"))
    assert keywords._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(r) for r in keywords.collect()] == [(1, 5, "late | parcel | rude | staff")]


def test_pairs_are_counted_for_frequent_words_only(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [[f"w{min(int(z), 60)}" for z in rng.zipf(1.3, n)] for n in rng.integers(0, 40, 200)] + [[], None, ["rare", "once"]]
    rows = spark.createDataFrame([(t,) for t in texts], "_terms array<string>").repartition(3)
    n, n_rows = Counter(), Counter()
    for t in texts:
        held = [*(t or []), *(" ".join(p) for p in zip(t or [], (t or [])[1:]))]
        n.update(held)
        n_rows.update(set(held))
    plain = models._counted_pairs
    for terms in (1, 25, 10_000):
        want = [(w, n[w], n_rows[w]) for w in sorted(n, key=lambda w: (-n[w], w))[:terms]]
        seen = []
        monkeypatch.setattr(models, "_counted_pairs", lambda r, known: seen.append(known) or plain(r, known))
        monkeypatch.setattr(models, "COUNTED_ENTRIES", 50)
        got = models.term_frequencies(rows, terms, pairs=True).select("term", "n", "n_rows").collect()
        assert sorted(map(tuple, got)) == sorted(want)
        assert len(seen[0]) == {1: 1, 25: 25}.get(terms, len({w for t in texts for w in t or []})) or terms == 25
        assert ("rare" in seen[0]) == (terms == 10_000)
    monkeypatch.setattr(models, "FREQUENT_WORDS", 3)
    assert sorted(map(tuple, models.term_frequencies(rows, 25, pairs=True).select("term", "n", "n_rows").collect())) == sorted(
        (w, n[w], n_rows[w]) for w in sorted(n, key=lambda w: (-n[w], w))[:25]
    )


def test_splits_follow_sums_over_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    bins, size = 4, 5
    held = [{int(f): int(rng.integers(1, bins)) for f in rng.choice(size, rng.integers(0, size), replace=False)} for _ in range(90)]
    rows = [(i % 2, [-1] * (i % 3 == 0) + [f * bins + b for f, b in sorted(h.items())]) for i, h in enumerate(held)]
    df = spark.createDataFrame(rows, "label int, codes array<int>").repartition(2)
    y = np.array([[1.0 if r[0] == k else -1.0 for r in rows] for k in range(2)])
    x = np.array([[h.get(f, 0) for f in range(size)] for h in held])
    done = [[[[1, 0, 0.0, 0.0], [-1, 0, 0.0, 0.5 + k], [-1, 0, 0.0, -0.25]]] for k in range(2)]
    growing = [[[0, 1, 0.0, 0.0], [2, 0, 0.0, 0.0], [-1, 0, 0.0, 0.0], *([-1, 0, 0.0, 0.0] for _ in range(4))] for _ in range(2)]
    monkeypatch.setattr(boosting, "ROWS_AT_ONCE", 7)
    got = {(s.label, s.node): s for s in boosting.best_splits(df, done, growing, 2, size, bins, 3)}
    for k in range(2):
        margin = np.where(x[:, 1] > 0, -0.25, 0.5 + k)
        target = 4 * y[k] / (1 + np.exp(2 * y[k] * margin))
        node = np.where(x[:, 0] > 1, -1, np.where(x[:, 2] > 0, 1, 0))  # rows right of the root are in a leaf
        for n in range(4):
            t, z = target[node == n], x[node == n]

            def gain(f, b):
                low = z[:, f] <= b
                sides = [s for s in (t[low], t[~low]) if len(s)]
                return sum(s.sum() ** 2 / len(s) for s in sides) - t.sum() ** 2 / len(t) if len(sides) == 2 else -np.inf

            best = max((gain(f, b) for f in range(size) for b in range(bins - 1)), default=-np.inf) if len(t) else -np.inf
            assert got[k, n].gain == pytest.approx(best, abs=1e-8)
            if np.isfinite(best):
                assert gain(got[k, n].feature, got[k, n].bin) == pytest.approx(best, abs=1e-8)
                assert got[k, n].n_low + got[k, n].n_high == len(t)


def test_words_held_by_rows_give_the_features_of_the_stages(spark):
    texts = ["The parcel was late. Late parcel, late!", "great shop great price", "", "the the", "price of a parcel: great price"]
    df = spark.createDataFrame([(t, i % 5 + 1) for i, t in enumerate(texts)], "full_text string, stars int")
    held = models.with_words(df, stop_words=["the", "of"])
    for terms in (4, 100):
        model = models.fit_tfidf(df, terms=terms, stop_words=["the", "of"])
        other = models.fit_tfidf(held.drop("full_text"), terms=terms, stop_words=["the", "of"])
        assert model.stages[4].vocabulary == other.stages[4].vocabulary
        want = models.staged_features(model, df).collect()
        got = models.staged_features(other, held.drop("full_text"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
        assert [f.dataType for f in got.schema] == [f.dataType for f in models.staged_features(model, df).schema]
