import random

import pytest

from tillsight.llm import unigram

tokenizers = pytest.importorskip("tokenizers")


def reference(pieces, bytes_known):
    """The library's own tokenizer over the same vocabulary."""
    vocab = [("<unk>", 0.0)] + pieces
    if bytes_known:
        vocab += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    made = tokenizers.Tokenizer(tokenizers.models.Unigram(vocab, unk_id=0, byte_fallback=bytes_known))
    made.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(
        replacement=unigram.MARK, prepend_scheme="always", split=True
    )
    return lambda t: len(made.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("bytes_known", [True, False])
def test_counts_equal_the_library(bytes_known):
    rng = random.Random(5)
    pieces = {unigram.MARK: -1.0}
    while len(pieces) < 60:
        p = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
        pieces[rng.choice(["", unigram.MARK]) + p] = -float(rng.randint(1, 6))
    pieces = [(p, s) for p, s in pieces.items() if p not in ("b", "c")]
    counter, want = unigram.Counter(pieces, bytes_known), reference(pieces, bytes_known)
    for _ in range(2000):
        text = "".join(rng.choice("abcé ☃\n▁") for _ in range(rng.randint(0, 25)))
        assert counter(text) == want(text), text


def test_query_counts(spark):
    from tillsight.llm.queries import vocabulary

    model = vocabulary("piece_bpe_32k.model")
    counter = unigram.load(model)
    usable = [(p, s) for p, s, k in unigram.read_pieces(model) if k in (1, 4)]
    want = reference(usable, True)
    long_text = "wordsandmore " * 20000 + "x" * 50000
    texts = ["a  text with  spaces ", None, "", " ", "Zeile\nzwei\ttab", "日本 ☃☃", long_text, "again", "again"]
    docs = spark.createDataFrame([(i, t, "n_tokens?") for i, t in enumerate(texts)], "doc_id long, text string, counted string")
    got = {r.doc_id: r.n_tokens for r in unigram.token_counts(docs, model).collect()}
    assert got == {i: want(t) if t else 0 for i, t in enumerate(texts)}
    assert counter(long_text) == want(long_text)
    assert unigram.token_counts(docs.limit(0), model).collect() == []


def test_query_counts_tokens_of_a_unigram_model(spark, tmp_path):
    """The query's counts are those of the library with the fitted model file, and close to the merging model's."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from tillsight.llm.queries import LLM_QUERIES, vocabulary

    english = "The children went to the market with their mother."
    texts = [english] * 30 + ["Die Kinder gingen mit ihrer Mutter zum Markt.  Zwei\nZeilen ☃", " ", "", None, "market the  children"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in LLM_QUERIES["op10_token_counts"](spark, str(tmp_path)).collect()}

    given = vocabulary("piece_bpe_32k.model")
    merging = sentencepiece.SentencePieceProcessor(model_proto=given)
    assert got[0] == len(merging.encode(english)) == 10
    uses = {}
    for t in texts:
        for part in unigram.cut(t) if t else ():
            for i in merging.encode(part) if part else [merging.piece_to_id(unigram.MARK)]:
                uses[i] = uses.get(i, 0) + 1
    assert {r.piece: r.n for r in unigram.piece_counts(docs, given).collect()} == uses
    model = unigram.fitted(docs, given)
    assert unigram.fitted(docs.repartition(3), model=given) == model
    usable = [(p, s) for p, s, k in unigram.read_pieces(model) if k in (1, 4)]
    assert abs(sum(2.718281828459045**s for _, s in usable) - 1) < 1e-4
    want = reference(usable, True)
    assert got == {i: want(t) if t else 0 for i, t in enumerate(texts)}
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in (0, 30, 34):
        assert got[i] == sum(len(library.encode(p)) if p else 1 for p in unigram.cut(texts[i]))
    assert unigram.token_counts(docs.limit(0), unigram.fitted(docs.limit(0), given)).collect() == []
