import collections
import math
import random
import re

import pytest

from tillsight.llm import decontaminate as dc


def plain_search(items, texts):
    """Score every passage against every item, without an index."""
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    words = {i: split(t) for i, t in items if split(t)}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for d, text in texts:
        ws = split(text)
        for i, text_i in items:
            if i not in words:
                continue
            stride = 32
            while stride < len(words[i]):
                stride *= 4
            starts = [0]
            while starts[-1] + 2 * stride < len(ws):
                starts.append(starts[-1] + stride)
            for s in starts:
                passage = ws[s : s + 2 * stride]
                tf = collections.Counter(words[i])
                weight = {
                    w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
                    for w, f in tf.items()
                }
                score = sum(x for w, x in weight.items() if w in set(passage)) / sum(weight.values())

                def share(part, most=5):
                    k = min(most, len(part))
                    runs = {tuple(part[j : j + k]) for j in range(len(part) - k + 1)}
                    have = {tuple(passage[j : j + k]) for j in range(len(passage) - k + 1)}
                    return len(runs & have) / len(runs) if k else 1.0

                parts = [split(part) for part in dc.question_and_answer(text_i)]
                shares = [share(part) for part in parts]
                near = share(words[i]) >= 0.8 and min(share(part, 1) for part in parts) >= 0.5
                held = min(shares) >= 0.8 or near
                if score >= 0.5 - 1e-12 and held and score > out.get((d, i), (0,))[0]:
                    out[d, i] = (score, *shares)
    return out


def test_leaks_equal_a_plain_search(spark):
    rng = random.Random(8)
    vocabulary = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(rng.randint(5, 25))}? {say(rng.randint(1, 12)).title()}.") for i in range(40)]
    items += [(40, "single sentence item here now"), (41, None), (42, "")]
    texts = [(d, say(rng.randint(0, 400))) for d in range(60)]
    for d in range(60, 110):
        item = rng.choice(items[:41])[1].split(" ")
        if d % 3 == 0:
            item[rng.randrange(len(item))] = "changed"
        if d % 5 == 0:
            item = item[: len(item) // 2]
        texts.append((d, f"{say(rng.randint(0, 300))} {' '.join(item).upper()} {say(rng.randint(0, 200))}"))
    texts += [(200, None), (201, ""), (202, say(30000) + " " + items[3][1] + " " + say(5000))]
    docs = spark.createDataFrame([(d, t, "item_id", 1) for d, t in texts], "doc_id long, text string, leak string, score int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = dc.find_leaks(docs, bench).collect()
    assert len(found) == len(texts)
    got = {(r.doc_id, x.item_id): (x.score, x.question_overlap, x.answer_overlap) for r in found for x in r.leaks}
    want = plain_search(items, texts)
    assert set(got) == set(want) and len(got) > 20
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert dc.find_leaks(docs.limit(0), bench).collect() == []
    assert all(r.leaks == [] for r in dc.find_leaks(docs, bench.limit(0)).collect())


def test_shards_change_nothing(spark, monkeypatch):
    items = [(i, f"alpha{i} beta{i % 3} gamma delta{i} eps{i % 7}. zeta{i} eta{i % 5}") for i in range(30)]
    docs = spark.createDataFrame([(d, "x " * d + items[d][1] + " y" * 50) for d in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, dc.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(dc, "SHARD_BYTES", 300)
    many = sorted(map(str, dc.find_leaks(docs, bench).collect()))
    assert one == many
    assert all(f"item_id={d}," in next(r for r in one if f"doc_id={d}," in r) for d in range(30))


def test_other_items_and_shards_do_not_change_what_is_found(spark, monkeypatch):
    rng = random.Random(4)
    say = lambda n: " ".join(f"v{rng.randrange(2000)}" for _ in range(n))
    items = [(i, f"{say(n)}? {say(8)}.") for i, n in enumerate([12, 20, 40, 90, 300, 700])]
    texts = [f"{say(200)} {t} {say(300)}" for _, t in items]
    far = items[0][1].replace("?", f" {say(300)}")  # question and answer 300 words apart
    docs = spark.createDataFrame(list(enumerate(texts + [far])), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    held = lambda b: {r.doc_id: [x.item_id for x in r.leaks] for r in dc.find_leaks(docs, b).collect()}
    together = held(bench)
    assert together == {**{i: [i] for i in range(6)}, 6: []}
    assert held(bench.where("item_id = 0"))[6] == []
    monkeypatch.setattr(dc, "SHARD_BYTES", 500)
    assert held(bench) == together


def test_one_changed_word_in_a_short_answer(spark):
    question = " ".join(f"q{i}" for i in range(25))
    bench = spark.createDataFrame([(1, f"{question}? a b c d e f g h.")], "item_id long, text string")
    rows = [(1, f"x y {question} a b c changed e f g h z"), (2, f"{question} and nothing of the reply"), (3, "a b c d e")]
    found = dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r.doc_id: len(r.leaks) for r in found} == {1: 1, 2: 0, 3: 0}
