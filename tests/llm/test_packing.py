import random
from collections import defaultdict

import numpy as np
import pytest

from tillsight.llm import packing

tiktoken = pytest.importorskip("tiktoken")


def tools():
    from tillsight.llm.queries import BYTE_PATTERN, vocabulary

    return vocabulary("byte_bpe_50k.tiktoken"), BYTE_PATTERN


def test_words_encode_like_whole_texts():
    encoder = packing.Encoder(*tools())
    rng = random.Random(2)
    parts = ["the", "Zeit", "é", " ", "  ", "\n", "it's", "12", "!?", "\t", "日本", " ", "x" * 70]
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 12)))
        assert encoder(text).tolist() == encoder.codec.encode_ordinary(text), repr(text)


def test_best_fit_equals_a_plain_search():
    rng = random.Random(4)
    for _ in range(200):
        cap = rng.randint(1, 40)
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        got = packing.best_fit(lengths, cap)
        free: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [f for f in free if f >= lengths[i]]
            if fits:
                free[free.index(min(fits))] -= lengths[i]
            else:
                free.append(cap - lengths[i])
        assert sorted(cap - sum(lengths[i] for i in row) for row in got) == sorted(free)
        assert sorted(i for row in got for i in row) == list(range(len(lengths)))


def test_packed_rows_round_trip(spark):
    ranks, pattern = tools()
    encoder = packing.Encoder(ranks, pattern)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    rows += [(200, "long " * 500), (201, None), (202, ""), (7, rows[7][1]), (None, "no id")]
    docs = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, shard int")
    length = 64
    got = packing.packed_rows(docs, ranks, pattern, 50256, length, shard_docs=40).collect()
    texts = defaultdict(lambda: defaultdict(list))
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == length and r.cu_seqlens[0] == 0
        assert r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        for a, b, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts):
            assert positions[a:b].tolist() == list(range(b - a))
            texts[d][s].append(ids[a:b].tolist())
    want = defaultdict(lambda: defaultdict(list))
    for i, t in rows:
        if t:
            ids = encoder.codec.encode_ordinary(t) + [50256]
            for s in range(0, len(ids), length):
                want[i][s].append(ids[s : s + length])
    assert {d: {s: sorted(x) for s, x in v.items()} for d, v in texts.items()} == {
        d: {s: sorted(x) for s, x in v.items()} for d, v in want.items()
    }
    again = packing.packed_rows(docs.repartition(3), ranks, pattern, 50256, length, shard_docs=40).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.packed_rows(docs.limit(0), ranks, pattern, 50256).collect() == []
