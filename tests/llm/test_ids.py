"""Ids beyond 2**53 beside nulls, negative and string ids, and columns named like the operators' own."""

from collections import Counter

import pytest

from tillsight.llm import decontaminate, jaccard, licenses, mixing, packing, repeats
from tillsight.llm.queries import BYTE_END_OF_TEXT, BYTE_PATTERN, vocabulary
from tillsight.llm.stages import STAGES

WORDS = [f"word{i}" for i in range(400)]
TEXT = [" ".join(WORDS[(7 * i + k * (i + 3)) % 400] for k in range(40 + i)) for i in range(6)]
LONGS = [2**53 + 1, 2**53 + 3, 2**53 + 5, -(2**60) - 1, None]
NAMES = ["b", "10", "9", "", None]


def ids(kind):
    return (LONGS, "long") if kind == "long" else (NAMES, "string")


def docs_of(spark, kind, texts=TEXT, extra=()):
    values, id_type = ids(kind)
    rows = [(i, t, "s", *("x" for _ in extra)) for i, t in zip(values, texts)]
    schema = f"doc_id {id_type}, text string, source string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame(rows, schema).coalesce(1)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_come_out_as_they_went_in(spark, kind):
    values, id_type = ids(kind)
    docs = docs_of(spark, kind)
    want = Counter(values)
    for out in (licenses.find_licenses(docs), repeats.remove_repeats(docs), mixing.mix(docs), jaccard.similar_groups(docs)):
        assert dict(out.dtypes)["doc_id"] == docs.dtypes[0][1]
        assert Counter(r.doc_id for r in out.collect()) == want
    rows = packing.packed_rows(docs, vocabulary("byte_bpe_50k.tiktoken"), BYTE_PATTERN, BYTE_END_OF_TEXT).collect()
    assert Counter(i for r in rows for i in r.doc_ids) == want
    mixed = mixing.mixed_documents(docs)
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in taken.items() if n})


@pytest.mark.parametrize("kind", ["long", "string"])
def test_links_beside_a_null_id(spark, kind):
    values, _ = ids(kind)
    docs = docs_of(spark, kind, [TEXT[0], TEXT[0] + " more", TEXT[2], TEXT[3], TEXT[0].upper()])
    least = min(values[:2])
    found = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs).collect()}
    assert found == {values[0]: least, values[1]: least, values[2]: values[2], values[3]: values[3], None: least}
    assert Counter(r.doc_id for r in jaccard.one_of_each_group(docs).collect()) == Counter([least, *values[2:4]])


OWN = ["_id", "_content", "_k", "_copies", "_key", "_row", "_copy", "c0", "key", "copy", "leaks", "toxicity", "rejected"]


def test_stages_keep_columns_named_like_their_own(spark, tmp_path):
    docs = docs_of(spark, "long", extra=OWN)
    labels = [(i, 1, k % 2) for k, i in enumerate(LONGS[:4])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind. never.")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for name, stage in STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == "x" for r in rows for c in OWN), name
    assert STAGES[0][1](spark, docs, str(tmp_path)).columns == docs.columns


def test_repeated_rows_in_a_mix_are_repeatable(spark):
    rows = [(None, "two words", "s", str(k % 3)) for k in range(30)] + [(1, TEXT[0], "s", "a"), (1, TEXT[0], "s", "b")]
    rows += [(2, TEXT[1], "other", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark string")
    runs = [Counter(map(tuple, mixing.mixed_documents(docs.repartition(n)).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]
    taken = sum(r["size"] * r.copies for r in mixing.mix(docs).collect())
    assert taken == sum(len(r[1].split()) * n for r, n in runs[0].items())
