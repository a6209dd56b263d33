"""Queries over the corpus tables, one per operator, and the SQL that checks them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import (
    decontaminate,
    dedup,
    fingerprints,
    jaccard,
    licenses,
    mixing,
    packing,
    ranked,
    repeats,
    secrets,
    toxicity,
    unigram,
    whitening,
)

LLM_QUERIES: dict = {}
LLM_CHECKS: dict = {}


def query(name: str, check: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if check is not None:
            LLM_CHECKS[name] = check
        return fn

    return register


TOKENIZERS = os.environ.get("TILLSIGHT_TOKENIZERS", "/opt/tokenizers")


#: How the byte-level vocabulary cuts texts before it merges bytes (a fixed value of that vocabulary).
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_END_OF_TEXT = 50256


def vocabulary(name: str, folder: str = TOKENIZERS) -> bytes:
    """A public tokenizer's file; the folder is a parameter."""
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


@query(
    "op8_exact_dedup",
    """
    WITH t AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(s) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY s)
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup.exact_groups(docs, dedup.lower_ascii(F.col("text")), keep="max").withColumnRenamed(
        "content_sha256", "text_sha256"
    )


@query("op10_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = unigram.fitted(docs, vocabulary("piece_bpe_32k.model"))
    return unigram.token_counts(docs, model).select("doc_id", "n_tokens")


@query("op5_token_rows")
def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed_rows(docs, vocabulary("byte_bpe_50k.tiktoken"), BYTE_PATTERN, BYTE_END_OF_TEXT)


def _license_check() -> str:
    upper, lower = dedup.UPPER, dedup.UPPER.lower()
    base = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM w, range(1, len(words) + 1) r(i) WHERE "
        + " AND ".join(f"words[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
        for phrase, label in licenses.BASE_PHRASES.items()
    )
    more = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label FROM w WHERE regexp_matches(line, '(?:^| ){licenses.as_pattern(t)}')"
        for label, t in licenses.TEMPLATES
    )
    return rf"""
    WITH w AS (
        SELECT doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents)
    ),
    base AS ({base}),
    more AS ({more}),
    b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
    m AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(method) AS method
          FROM (SELECT doc_id, label, 0 AS method FROM base UNION ALL SELECT doc_id, label, 1 FROM more)
          GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CAST(CASE method WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
    FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
    """


@query("op7_license_scan", _license_check())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op2_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query(
    "op9_ngram_jaccard",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
               ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
        FROM words
    ),
    members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same
        FROM members a JOIN members b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
        GROUP BY ALL
    ),
    links AS (SELECT a, b FROM pairs WHERE 100 * same >= 90 * (na + nb - same)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
    FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
    """,
)
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), run=3, percent=90)


@query(
    "op3_repeated_bytes",
    """
    WITH h AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    starts AS (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS s FROM h),
    windows AS (SELECT r, s, md5(substr(x, 2 * s + 1, 400)) AS k FROM starts),
    again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
    gone AS (SELECT r, s FROM windows SEMI JOIN again USING (k)),
    fresh AS (SELECT r, s, CASE WHEN s > lag(s) OVER w + 200 THEN 1 ELSE 0 END AS f FROM gone
              WINDOW w AS (PARTITION BY r ORDER BY s)),
    runs AS (SELECT r, s, sum(f) OVER (PARTITION BY r ORDER BY s) AS g FROM fresh),
    spans AS (SELECT r, min(s) AS a, max(s) + 200 AS b FROM runs GROUP BY r, g),
    cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM spans),
    kept AS (SELECT r, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head, max(b) AS b,
                    sum(b - a) AS n_removed, count(*) AS n_spans
             FROM cuts JOIN h USING (r) GROUP BY r)
    SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
           sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
    FROM h LEFT JOIN kept USING (r)
    """,
)
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op4_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).select("doc_id", "toxicity.*", "rejected")


@query("op6_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "number", F.sha2("value", 256).alias("value_sha256"), "name", "p_secret", "is_secret")


@query(
    "op11_ranked_search",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents
    ),
    totals AS (SELECT count_if(len(words) > 0) AS nn, CAST(sum(len(words)) AS BIGINT) AS ll FROM d),
    q AS (
        SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(translate(text,
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
        FROM benchmark
    ),
    posts AS (
        SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL
    ),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM posts, totals GROUP BY term, nn
    ),
    lengths AS (SELECT r, doc_id, 50 + (50 * len(words) * nn) // ll AS m FROM d, totals WHERE len(words) > 0),
    scored AS (
        SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM q JOIN weights USING (term) JOIN posts USING (term) JOIN lengths USING (r) GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50
    """,
)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_simhash_copies")
def simhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_copies(table(spark, sf_dir, "documents"))


@query("op13_whitened_embeddings")
def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
