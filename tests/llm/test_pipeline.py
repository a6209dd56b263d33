import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tillsight.llm import packing  # noqa: E402
from tillsight.llm.queries import BYTE_PATTERN, vocabulary  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(17)
    clean = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 30
    say = lambda n: " ".join(rng.choice(clean) for _ in range(n))
    items = [(i, f"{say(14)}. {say(9)}.") for i in range(12)]
    rows, labels = [], []
    for i in range(500):
        text = say(rng.randint(30, 120))
        toxic = i % 9 == 0
        if toxic:
            text += " snarlix vexor grumblo"
        if i % 2:
            labels.append((i, 1, int(toxic)))
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
    for i in range(500, 530):
        text = rows[i - 499][1] + " extra"
        rows.append((i, text, "en", "src0", len(text)))
    for i in range(530, 542):
        text = f"{say(20)} {items[i - 530][1]} {say(20)}"
        rows.append((i, text, "en", "src1", len(text)))
    rows += [(600, None, None, None, None), (601, "", "en", "src2", 0)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_do_what_they_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    before = {r.doc_id for r in docs.collect()}
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == names, name
        path = f"{sf_dir}/{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        ids.append([r.doc_id for r in docs.collect()])
    toxic = {i for i in range(500) if i % 9 == 0}
    clean, single, safe, mixed = ids
    assert sorted(clean) == sorted(before - toxic - {i for i in range(500, 530) if i - 499 in toxic})
    assert not [i for i in range(500, 530) if i - 499 in clean and i in single]
    assert set(range(500)) - toxic <= set(single)
    assert sorted(safe) == sorted(set(single) - set(range(530, 542)))
    assert set(mixed) <= set(safe) and max(Counter(mixed).values()) <= 3
    texts = Counter(r.text for r in docs.collect() if r.text)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    encoder = packing.Encoder(vocabulary("byte_bpe_50k.tiktoken"), BYTE_PATTERN)
    want = Counter(len(encoder(t)) + 1 for t in texts.elements())
    got = Counter(b - a for r in rows for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))
    assert got == want
    assert all(len(np.frombuffer(r.ids, "<u2")) == packing.ROW_TOKENS for r in rows)


def test_run_equals_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/source_mix")
    assert Counter(d for r in rows for d in r.doc_ids) == Counter(r.doc_id for r in docs.collect() if r.text)
    packed = defaultdict(int)
    for r in rows:
        packed[r.shard, r.row_no] += 1
    assert set(packed.values()) == {1}
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])
