import math
import random
import re
from collections import Counter

import pytest

from tillsight.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def score_all(docs, items, k):
    """Every document against every item, straight from the definition."""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(w for _, ws in terms for w in set(ws))
    rows = []
    for item, text in items:
        found = []
        for i, ws in terms:
            tf, m = Counter(ws), 50 + 50 * len(ws) * n_docs // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m))
                for w in set(TERM.findall((text or "").translate(LOWER)))
                if tf[w]
            )
            if score > 0:
                found.append((-score, i is None, i))
        rows += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(2**53 + 2 * i + 1, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(n)]
    docs += [(-i, docs[5][1].upper()) for i in range(1, 40)] + [(None, docs[5][1]), (None, None), (7, ""), (8, " ... ")]
    docs += [(9, "Größe ÄÖ straße w1,w2;W3 " * 3), (9, docs[0][1])]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 15)))) for i in range(25)]
    items += [(None, "größe W3"), (50, None), (51, ""), (52, "absent"), (3, docs[5][1]), (3, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("k,block", [(5, 1 << 20), (12, 300), (50, 64)])
def test_search_equals_scoring_everything(spark, monkeypatch, k, block):
    monkeypatch.setattr(ranked, "BLOCK_POSTINGS", block)
    docs, items = corpus(300, k)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, query string, n int").repartition(3)
    q = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, score string")
    got = ranked.search(d, q, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == score_all(docs, items, k)


def test_batches_of_queries_and_other_id_types(spark):
    docs, items = corpus(80, 3)
    docs = [(f"d{i}", t) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    q = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    got = ranked.search(d, q, k=4, batch_bytes=300)
    assert sorted(map(tuple, got.collect()), key=str) == score_all(docs, [(str(i), t) for i, t in items], 4)


def test_terms_of_pieces_are_those_of_the_whole_text(monkeypatch):
    text = ("ab " * 50 + "Zz9ß " * 30).encode()
    whole = ranked.term_counts(text)
    monkeypatch.setattr(ranked, "PIECE_BYTES", 7)
    assert ranked.term_counts(text) == whole == (80, Counter({b"ab": 50, "zz9ß".encode(): 30}))


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert ranked.search(d, q).collect() == []
