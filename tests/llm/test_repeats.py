import hashlib
import random
from collections import Counter

import pytest

from tillsight.llm import repeats


def plain(rows, length):
    """Count all strings of that length, then mark the bytes of those that occur twice."""
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [say(n) for n in (60, 199, 200, 201, 260, 420)]
    rows = []
    for i in range(70):
        text = say(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 60)
            text += p[cut:] if rng.random() < 0.5 else p
            text += say(rng.randint(0, 150))
        rows.append((i, text))
    base = say(900)
    for i in range(70, 90):
        b = list(base)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = rng.choice("XYZ")
        rows.append((i, "".join(b)))
    rows += [(100, None), (101, ""), (102, "x" * 1000), (103, "ab" * 400 + "c"), (104, say(199)), (105, rows[104 - 104][1])]
    rows += [(106, rows[80][1]), (None, rows[80][1]), (80, rows[80][1]), (107, "\n".join([say(90)] * 12)), (108, say(230) * 2)]
    return rows


@pytest.mark.parametrize("length,gram,most", [(200, 64, 4096), (200, 64, 2), (40, 16, 3)])
def test_equal_to_counting_all_strings(spark, monkeypatch, length, gram, most):
    monkeypatch.setattr(repeats, "PLACES_IN_TASK", most)
    monkeypatch.setattr(repeats, "PART", 700)
    rows = corpus(length + most)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, anchor string, k1 int")
    got = repeats.remove_repeats(docs, length=length, gram=gram).collect()
    mine = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)
    assert mine == plain(rows, length)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:4] for r in repeats.remove_repeats(docs).collect()] == [(1, 0, 0, 0)]
    assert repeats.remove_repeats(docs.limit(0)).collect() == []
