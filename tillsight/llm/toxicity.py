"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each category's model sees the
words of a text and the probabilities of the categories before it. While
training, these come from models that have not seen the text (out of fold), so
that later models learn from probabilities as wrong as they will be in use.

Words count whole and by their first bytes, at two lengths, so forms of a stem
share a feature. The features are those of the labelled rows a model is fitted on
that tell a category best apart: the models of a fold choose theirs without it. A
category's models are fitted side by side, each in a task of its own, as the
labelled rows are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm import words
from tillsight.sources.staging import materialize

#: The models are fitted on at most so many labelled rows, those with the smallest digests of their ids.
LABELLED = 20_000
#: Features per category, first bytes of a word that count beside the whole word, rows a feature must occur in.
FEATURES, STEMS, LEAST_ROWS = 300, (4, 6), 5
FOLDS = 3
#: Weight of half the squared weights beside the mean loss of a model, and its largest number of steps.
PENALTY, STEPS = 1e-5, 100
THRESHOLD = 0.5

#: Category -> condition on the labels, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}

IN_WORD = words.byte_class(rb"[0-9a-z\x80-\xff]")


def text_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text number, word stem digest) pairs without repeats, by groups of texts, and the group's size."""
    for base, group in words.groups(texts, lambda t: t.lower().encode()):
        parsed = [words.word_digests(group, IN_WORD, most) for most in (None, *STEMS)]
        digests = np.concatenate([d for d, _ in parsed])
        owner = np.concatenate([np.repeat(np.arange(len(group)), np.diff(bounds)) for _, bounds in parsed])
        order = np.lexsort((digests, owner))
        owner, digests = owner[order], digests[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (digests[1:] != digests[:-1])) if len(owner) else owner > 0
        yield base + owner[new], digests[new], len(group)


@dataclass
class Chain:
    """Weights of each category: one per feature, then one per earlier category; and the intercept."""

    vocabulary: np.ndarray
    categories: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def known(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.vocabulary, digests)
        at[at == len(self.vocabulary)] = 0
        return (self.vocabulary[at] == digests) if len(self.vocabulary) else np.zeros(len(digests), bool), at

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, texts by categories."""
        out = np.zeros((len(texts), len(self.weights)))
        sums = np.tile(np.array(self.intercepts, float), (len(texts), 1))
        n = len(self.vocabulary)
        for owner, digests, _ in text_features(texts):
            hit, at = self.known(digests)
            for k, w in enumerate(self.weights):
                sums[:, k] += np.bincount(owner[hit], w[at[hit]], len(texts))
        for k, w in enumerate(self.weights):
            z = sums[:, k] + out[:, :k] @ w[n:]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def fit_linear(
    owner: np.ndarray, at: np.ndarray, dense: np.ndarray, label: np.ndarray, width: int, steps: int = STEPS
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model by limited-memory quasi-Newton steps.

    Row `owner[i]` has feature `at[i]` (below `width`) with value 1, and the row
    of `dense` beside them. Weights are held back by PENALTY, the intercept is
    not. Rows of one class, or none, give that class, or 0, for certain.
    """
    n, k = dense.shape
    if not n or label.min() == label.max():
        return np.zeros(width + k), 20.0 if n and label[0] == 1.0 else -20.0

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(owner, p[at], n) + dense @ p[width:-1] + p[-1]
        rest = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / n
        slope = np.concatenate([np.bincount(at, rest[owner], width), dense.T @ rest, [rest.sum()]])
        slope[:-1] += PENALTY * p[:-1]
        return float(np.mean(np.logaddexp(0, z) - label * z) + PENALTY / 2 * (p[:-1] @ p[:-1])), slope

    point = np.zeros(width + k + 1)
    point[-1] = np.log(label.mean() / (1 - label.mean()))
    value, slope = loss(point)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = -slope, []
        for moved, turned in reversed(past):
            shares.append((moved @ way) / (moved @ turned))
            way = way - shares[-1] * turned
        if past:
            way = way * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (moved, turned), share in zip(past, reversed(shares)):
            way = way + (share - (turned @ way) / (moved @ turned)) * moved
        falls, length = slope @ way, 1.0
        lower, there = loss(point + way)
        while lower > value + 1e-4 * length * falls and length > 1e-8:
            length /= 2
            lower, there = loss(point + length * way)
        if not lower < value:
            break
        moved, turned = length * way, there - slope
        if moved @ turned > 0:
            past = [*past[-9:], (moved, turned)]
        gain, point, value, slope = value - lower, point + moved, lower, there
        if gain <= 1e-7 * value:
            break
    return point[:-1], float(point[-1])


def _label_sums(names: list[str]) -> list[Column]:
    """For each category the sum of its labels and the number of rows where it is known."""
    return [e for c in names for e in (F.sum(c).alias(c), F.count(c).alias(f"known_{c}"))]


def _tell_apart(counted: DataFrame, names: list[str], features: int, folds: int = FOLDS) -> list[np.ndarray]:
    """The `features` word digests per category that tell it best apart, from counts by word and fold.

    First of all rows, then of all but each fold. The row whose word is null
    counts the labelled rows themselves.
    """
    columns = [x for c in names for x in (c, f"known_{c}")]
    totals = counted.where(F.col("stem").isNull()).select("fold", *columns).collect()
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(x))).alias(f"{x}_{f}") for f in range(folds) for x in columns]
    by_word = counted.where(F.col("stem").isNotNull()).groupBy("stem").agg(*by_fold)

    def count(x: str, left_out: int | None) -> Column:
        return reduce(Column.__add__, [F.coalesce(f"{x}_{f}", F.lit(0)) for f in range(folds) if f != left_out])

    # Read once per model and category; words too rare for any of them are gone.
    frequent = reduce(Column.__or__, [count(f"known_{c}", None) >= LEAST_ROWS for c in names])
    by_word = materialize(by_word.where(frequent))
    best = []
    for left_out in [None, *range(folds)]:
        total = {x: sum(r[x] or 0 for r in totals if left_out is None or r.fold != left_out) for x in columns}
        for c in names:
            known, all_known = count(f"known_{c}", left_out), total[f"known_{c}"]
            expected = known * total[c] / max(all_known, 1)
            apart = F.pow(count(c, left_out) - expected, 2) / (expected * (1 - known / (all_known + 1)) + 1e-9)
            top = by_word.where(known >= LEAST_ROWS).orderBy(apart.desc(), "stem").limit(features)
            best.append(top.select(F.lit(-1 if left_out is None else left_out).alias("model"), "stem"))
    found: list[set[int]] = [set() for _ in range(folds + 1)]
    for r in reduce(DataFrame.unionByName, best).collect():
        found[r.model + 1].add(r.stem)
    return [np.sort(np.array(sorted(f), np.int64).view(np.uint64)) for f in found]


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str] = CATEGORIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    labelled: int = LABELLED,
    features: int = FEATURES,
) -> Chain:
    """Fit the chain on at most `labelled` labelled documents (see LABELLED).

    A category is fitted on the rows where its own label is known; rows without
    any label and labels without a document are left out. Repeated labels count
    as often as they occur.
    """
    names = list(categories)
    usable = labels.select(
        F.col(id_col).alias("_id"), *[F.expr(c).cast("double").alias(n) for n, c in categories.items()]
    ).na.drop("all", subset=names)
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", *names).limit(labelled)
    # At most `labelled` short rows: a bounded side.
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).drop("_doc")

    def stems(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for start in range(0, len(whole), 500):
                frame = whole.iloc[start : start + 500]
                found: list = [np.empty(0, np.uint64)] * len(frame)
                for owner, digests, _ in text_features(frame._text.tolist()):
                    for i in np.unique(owner):
                        found[i] = digests[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
                yield frame.drop(columns="_text").assign(stems=[f.view(np.int64) for f in found])
        words.release_memory()

    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = ", ".join(f"{n} double" for n in names)
    rows = materialize(sample.mapInPandas(stems, f"_id {id_type}, {kinds}, stems array<long>"))
    fold = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FOLDS))
    counted = materialize(
        rows.select(F.explode(F.concat("stems", F.array(F.lit(None)))).alias("stem"), fold.alias("fold"), *names)
        .groupBy("stem", "fold")
        .agg(F.count("*").alias("n"), *_label_sums(names))
    )
    # The features of the models fitted on all rows, and of those that leave a fold out.
    own = _tell_apart(counted, names, features)
    chain = Chain(np.unique(np.concatenate(own)))
    used = [np.isin(chain.vocabulary, v) for v in own]
    every = len(chain.vocabulary)
    models = F.concat(F.array(F.lit(-1)), F.array_remove(F.sequence(F.lit(0), F.lit(FOLDS - 1)), F.col("fold")))

    def placed(unseen: list[list[tuple[np.ndarray, float]]]) -> DataFrame:
        """The rows' features by their places, and the probabilities of the categories fitted so far, out of fold."""

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                places, before = [], []
                for stems, fold in zip(frame.stems, frame.fold):
                    hit, at = chain.known(np.asarray(stems, np.int64).view(np.uint64))
                    places.append(np.sort(at[hit]).astype(np.int32))
                    earlier = np.empty(0)
                    for fitted in unseen:
                        weights, intercept = fitted[fold]
                        z = intercept + weights[places[-1]].sum() + earlier @ weights[every:]
                        earlier = np.append(earlier, 1 / (1 + np.exp(-np.clip(z, -500, 500))))
                    before.append(earlier)
                yield frame.drop(columns="stems").assign(places=places, earlier=before)
            words.release_memory()

        kept = rows.withColumn("fold", fold.cast("int"))
        return kept.mapInPandas(place, f"_id {id_type}, {kinds}, fold int, places array<int>, earlier array<double>")

    unseen: list[list[tuple[np.ndarray, float]]] = []
    for k, c in enumerate(names):

        def fit(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
            """One model in one task: at most the labelled rows, each with at most the vocabulary."""
            frame = frame.sort_values("_id", kind="stable")
            owner = np.repeat(np.arange(len(frame)), [len(p) for p in frame.places])
            at = np.concatenate([np.empty(0, np.int32), *frame.places]).astype(np.int64)
            keep = used[1 + key[0]][at] if len(at) else np.zeros(0, bool)
            dense = np.array([np.asarray(e, float) for e in frame.earlier]).reshape(len(frame), k)
            weights, intercept = fit_linear(owner[keep], at[keep], dense, frame.label.to_numpy(float), every)
            words.release_memory()
            return pd.DataFrame({"model": [key[0]], "weights": [weights], "intercept": [intercept]})

        known = placed(unseen).where(F.col(c).isNotNull())
        which = F.explode(models) if k + 1 < len(names) else F.lit(-1)
        dealt = known.select(which.alias("model"), "_id", F.col(c).alias("label"), "places", "earlier")
        fits = dealt.groupBy("model").applyInPandas(fit, "model int, weights array<double>, intercept double")
        # 1 + FOLDS rows, as long as the vocabulary.
        got = {r.model: (np.array(r.weights, float), r.intercept) for r in fits.collect()}
        fitted = [got.get(m, (np.zeros(every + k), -20.0)) for m in range(-1, FOLDS)]
        chain.categories.append(c)
        chain.weights.append(fitted[0][0])
        chain.intercepts.append(fitted[0][1])
        unseen.append(fitted[1:])
    return chain


def score(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `toxicity`: a probability per category, and `rejected`: the last one reaches the threshold.

    Null and empty texts get the probabilities of a text without any known
    word. One pass over whole texts, no shuffle.
    """

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(chain(batch.tolist()), columns=chain.categories)
        words.release_memory()

    kinds = ", ".join(f"{c} double" for c in chain.categories)
    scored = docs.withColumn("toxicity", F.pandas_udf(predict, kinds)(F.col(text_col)))
    return scored.withColumn("rejected", F.col("toxicity")[chain.categories[-1]] >= threshold)
