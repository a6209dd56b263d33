"""Reviews: cleaning, sampling, sentiment, aspects, topics and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import cleaning, documents, metrics, quality, reviews, topics
from tillsight.plans import canonical as cn
from tillsight.plans import check_sql as cs
from tillsight.plans.registry import query
from tillsight.sources.staging import materialize

SAMPLE_FRACTION = 0.4
MIN_TOPIC_SIZE = 48
ONE_REVIEW = 42
LARGEST_TOPICS = 15
_RAW = ["category", "company", "description", "title", "review", "stars"]


@query(
    "p11_clean_reviews",
    cs.using("rv_raw") + f"SELECT DISTINCT * FROM rv_raw WHERE NOT {cs.JUNK_REVIEW}",
)
def _(spark, sf_dir):
    return cleaning.clean_reviews(cn.reviews_raw(spark, sf_dir))


@query(
    "p12_review_report",
    cs.using("rv_raw")
    + f""", d AS (SELECT DISTINCT * FROM rv_raw)
SELECT (SELECT COUNT(*) FROM rv_raw) AS rows_before,
  (SELECT COUNT(*) FROM rv_raw) - COUNT(*) AS duplicates_removed,
  {cs.count_if(cs.DIGITS)} AS phone_number_rows_removed, {cs.count_if(cs.PUNCT)} AS punctuation_only_rows_removed,
  {cs.count_if(cs.NON_ASCII)} AS non_english_rows_removed, {cs.count_if("NOT " + cs.JUNK_REVIEW)} AS rows_after FROM d""",
)
def _(spark, sf_dir):
    return cleaning.review_cleaning_report(cn.reviews_raw(spark, sf_dir))


@query("p13_full_text", cs.using("rv_text") + "SELECT review_id, full_text FROM rv_text")
def _(spark, sf_dir):
    return cn.reviews_text(spark, sf_dir).select("review_id", "full_text")


def _star_bucket_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 2 THEN 'negative' WHEN {x} >= 4 THEN 'positive' ELSE 'neutral' END"


def _score_bucket_sql(x: str) -> str:
    return f"CASE WHEN {x} <= -0.05e0 THEN 'negative' WHEN {x} >= 0.05e0 THEN 'positive' ELSE 'neutral' END"


@query(
    "p15_star_buckets",
    cs.using("rv") + f"SELECT {_star_bucket_sql('stars')} AS bucket, COUNT(*) AS n FROM rv GROUP BY 1",
)
def _(spark, sf_dir):
    bucket = reviews.star_bucket(F.col("stars")).alias("bucket")
    return cn.reviews(spark, sf_dir).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a9_star_shares",
    cs.using("rv")
    + "SELECT stars, COUNT(*) AS n, ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM rv), 6) AS share FROM rv GROUP BY 1",
)
def _(spark, sf_dir):
    return quality.value_shares(cn.reviews(spark, sf_dir), "stars")


@query(
    "w9_n13_stratified_sample",
    cs.using("rv")
    + f"""SELECT review_id, stars FROM (SELECT review_id, stars, COUNT(*) OVER (PARTITION BY stars) AS n,
  row_number() OVER (PARTITION BY stars ORDER BY md5('42|' || review_id), review_id) AS r FROM rv)
WHERE r <= round_even(n * {SAMPLE_FRACTION}e0, 0)""",
)
def _(spark, sf_dir):
    rows = cn.reviews(spark, sf_dir).select("review_id", "stars")
    return reviews.stratified_sample(rows, fraction=SAMPLE_FRACTION)


@query(
    "w11_first_per_company",
    cs.using("rv")
    + """SELECT company, category, description FROM (SELECT *, row_number() OVER (
  PARTITION BY company ORDER BY review_id) AS r FROM rv) WHERE r = 1""",
)
def _(spark, sf_dir):
    return reviews.first_per_company(cn.reviews(spark, sf_dir))


cs.view(
    "companies",
    ("rv",),
    """SELECT row_number() OVER (ORDER BY md5(company), company) AS company_id, company, category, description
FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY review_id) AS r FROM rv) WHERE r = 1""",
)


@query("j5_company_dimension", cs.using("companies") + "SELECT * FROM companies")
def _(spark, sf_dir):
    return reviews.company_dimension(cn.reviews(spark, sf_dir))


@query(
    "j5_review_facts",
    cs.using("companies")
    + "SELECT review_id, company_id, title, review, stars FROM rv LEFT JOIN companies ON rv.company = companies.company",
)
def _(spark, sf_dir):
    rows = cn.reviews(spark, sf_dir)
    return reviews.review_facts(rows, reviews.company_dimension(rows))


# --- sentiment ------------------------------------------------------------------

_LEX = "lex(word, valence) AS (VALUES " + ", ".join(f"('{w}', {v!r}e0)" for w, v in cn.LEXICON.items()) + ")"


def _compound_views(prefix: str, relation: str, key: str, text: str) -> str:
    """CTEs that end in `<prefix>_scored(key, compound)`."""
    return rf"""{prefix}_w AS (SELECT {key}, list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS ws
  FROM {relation}),
{prefix}_t AS (SELECT {key}, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM {prefix}_w),
{prefix}_n AS (SELECT *, coalesce(greatest(
    lag(word IN ({cs.quoted(cn.NEGATORS)}), 1) OVER w, lag(word IN ({cs.quoted(cn.NEGATORS)}), 2) OVER w,
    lag(word IN ({cs.quoted(cn.NEGATORS)}), 3) OVER w), false) AS negated
  FROM {prefix}_t WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{prefix}_s AS (SELECT {key}, CAST(SUM(CAST(valence * CASE WHEN negated THEN {reviews.NEGATION_FACTOR}e0 ELSE 1e0 END
    AS DECIMAL(18,6))) AS DOUBLE) AS s FROM {prefix}_n JOIN lex ON {prefix}_n.word = lex.word GROUP BY {key}),
{prefix}_scored AS (SELECT r.{key}, coalesce(s, 0e0) / sqrt(coalesce(s, 0e0) * coalesce(s, 0e0) + 15e0) AS compound
  FROM {relation} r LEFT JOIN {prefix}_s ON r.{key} = {prefix}_s.{key})"""


_STARS_OF = "CAST(1 + least(floor((compound + 1) * 2.5e0), 4) AS INTEGER)"


def scorer(spark):
    return reviews.lexicon_star_scorer(reviews.lexicon_table(spark, cn.LEXICON), cn.NEGATORS)


def with_compound(spark, df):
    table = reviews.lexicon_table(spark, cn.LEXICON)
    return reviews.lexicon_sentiment(df, ["review_id"], "full_text", table, cn.NEGATORS)


@query(
    "n1_lexicon_sentiment",
    cs.using("rv_text")
    + f", {_LEX}, {_compound_views('c', 'rv_text', 'review_id', 'full_text')} "
    + f"SELECT review_id, ROUND(compound, 6) AS compound, {_score_bucket_sql('compound')} AS bucket FROM c_scored",
)
def _(spark, sf_dir):
    rows = cn.reviews_text(spark, sf_dir).select("review_id", "full_text")
    scored = with_compound(spark, rows)
    return scored.select(
        "review_id", F.round("compound", 6).alias("compound"), reviews.score_bucket(F.col("compound")).alias("bucket")
    )


cs.view(
    "sentiment_rows",
    ("rv_text",),
    "WITH "
    + f"{_LEX}, {_compound_views('c', 'rv_text', 'review_id', 'full_text')} "
    + f"""SELECT review_id, compound AS lexicon_compound, {_score_bucket_sql('compound')} AS lexicon_bucket,
  {_STARS_OF} AS model_predicted_stars, {_star_bucket_sql(_STARS_OF)} AS model_bucket FROM c_scored""",
)


def staged_reviews(spark, sf_dir):
    """Cleaned reviews with their text, written once for all parts of a query that read them.

    The full text, of title and review, is put together again by whatever reads it.
    """
    return cn.with_full_text(materialize(cn.reviews(spark, sf_dir)))


def sentiment_table(spark, rows):
    """Both scorers side by side, one row per review."""
    rows = rows.select("review_id", "full_text")
    stars = 1 + F.least(F.floor((F.col("compound") + 1.0) * 2.5), F.lit(4)).cast("int")
    return with_compound(spark, rows).select(
        "review_id",
        F.col("compound").alias("lexicon_compound"),
        reviews.score_bucket(F.col("compound")).alias("lexicon_bucket"),
        stars.alias("model_predicted_stars"),
        reviews.star_bucket(stars).alias("model_bucket"),
    )


@query(
    "n3_a11_scorer_comparison",
    cs.using("sentiment_rows")
    + f""", j AS (SELECT s.*, {_star_bucket_sql('stars')} AS actual FROM sentiment_rows s JOIN rv ON s.review_id = rv.review_id)
SELECT 'lexicon' AS scorer, ROUND(AVG(CASE WHEN lexicon_bucket = actual THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM j
UNION ALL SELECT 'model', ROUND(AVG(CASE WHEN model_bucket = actual THEN 1e0 ELSE 0e0 END), 6) FROM j""",
)
def _(spark, sf_dir):
    rows = staged_reviews(spark, sf_dir)
    actual = rows.select("review_id", reviews.star_bucket(F.col("stars")).alias("actual"))
    joined = sentiment_table(spark, rows).join(actual, "review_id")
    compared = reviews.compare_scorers(joined, {"lexicon": "lexicon_bucket", "model": "model_bucket"}, "actual")
    return compared.select("scorer", F.round("accuracy", 6).alias("accuracy"))


@query(
    "n2_whole_review_stars",
    cs.using("sentiment_rows") + "SELECT review_id, model_predicted_stars AS predicted_stars FROM sentiment_rows",
)
def _(spark, sf_dir):
    rows = cn.reviews_text(spark, sf_dir).select("review_id", "full_text")
    return reviews.score_distinct(rows, "full_text", scorer(spark)).select("review_id", "predicted_stars")


# --- aspects ---------------------------------------------------------------------

_SENTENCES = rf"""sent AS (SELECT review_id, stars, {cs.strip("p")} AS sentence FROM (SELECT review_id, stars, unnest(string_split(
  regexp_replace(full_text, '([.!?])[{cs.SPACE}]+', '\1' || chr(1), 'g'), chr(1))) AS p FROM rv_text)),
asp(aspect, keyword) AS (VALUES {", ".join(f"('{a}', '{k}')" for a, ks in cn.ASPECTS.items() for k in ks)}),
mentions AS (SELECT review_id, stars, aspect, sentence FROM sent,
  (SELECT aspect, list(keyword) AS ks FROM asp GROUP BY aspect) a
  WHERE length(sentence) > 0 AND len(list_filter(ks, lambda k: contains(lower(sentence), k))) > 0),
distinct_s AS (SELECT DISTINCT sentence FROM mentions)"""
cs.view(
    "aspect_rows",
    ("rv_text",),
    f"WITH {_SENTENCES}, {_LEX}, {_compound_views('d', 'distinct_s', 'sentence', 'sentence')} "
    + f"""SELECT m.review_id, m.stars, m.aspect, m.sentence, {_STARS_OF} AS predicted_stars
FROM mentions m JOIN d_scored ON m.sentence = d_scored.sentence""",
)


def mentions(rows):
    return reviews.aspect_mentions(rows, cn.ASPECTS)


def scored_mentions(spark, rows):
    """Sentences are scored once, whatever number of aspects they mention."""
    stars = scorer(spark)
    found = reviews.aspect_sentences(rows, cn.ASPECTS)
    if not hasattr(stars, "stars_of"):  # read twice: for the distinct sentences and for all
        found = materialize(found).where(F.size("aspects") > 0)
    scored = reviews.by_aspect(reviews.score_sentences(found, stars))
    return scored.select("review_id", "stars", "aspect", "sentence", "predicted_stars")


@query(
    "n4_j12_aspect_mentions",
    cs.using("rv_text") + f", {_SENTENCES} SELECT * FROM mentions",
)
def _(spark, sf_dir):
    return mentions(cn.reviews_text(spark, sf_dir))


@query("n5_j13_scored_mentions", cs.using("aspect_rows") + "SELECT * FROM aspect_rows")
def _(spark, sf_dir):
    return scored_mentions(spark, cn.reviews_text(spark, sf_dir))


@query(
    "a10_aspect_summary",
    cs.using("aspect_rows")
    + "SELECT aspect, ROUND(AVG(predicted_stars), 6) AS mean_stars, COUNT(*) AS mentions FROM aspect_rows GROUP BY aspect",
)
def _(spark, sf_dir):
    scored = scored_mentions(spark, cn.reviews_text(spark, sf_dir))
    return reviews.aspect_summary(scored).withColumn("mean_stars", F.round("mean_stars", 6)).orderBy("mean_stars", "aspect")


# --- topics ----------------------------------------------------------------------

cs.view(
    "topic_rows",
    ("topic_given",),
    f"""SELECT review_id, CAST(CASE WHEN COUNT(*) OVER (PARTITION BY topic) >= {MIN_TOPIC_SIZE} THEN topic ELSE -1 END
  AS INTEGER) AS topic FROM topic_given""",
)


def given_topics(spark, sf_dir):
    return topics.small_topics_to_outliers(cn.topics(spark, sf_dir), MIN_TOPIC_SIZE)


@query("n8_outlier_rule", cs.using("topic_rows") + "SELECT review_id, topic FROM topic_rows")
def _(spark, sf_dir):
    return given_topics(spark, sf_dir)


cs.view(
    "topic_labels",
    ("topic_rows", "rv_text"),
    r"""
WITH a AS (SELECT t.topic, full_text FROM topic_rows t JOIN rv_text r ON t.review_id = r.review_id),
w AS (SELECT topic, unnest(list_filter(string_split_regex(lower(full_text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM a),
tf AS (SELECT topic, word, COUNT(*) AS tf FROM w GROUP BY 1, 2),
s AS (SELECT topic, word, ROUND(tf * ln(1e0 + (SELECT CAST(SUM(tf) AS DOUBLE) / COUNT(DISTINCT topic) FROM tf)
   / SUM(tf) OVER (PARTITION BY word)), 6) AS score FROM tf),
p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS place FROM s),
n AS (SELECT topic, string_agg(word, '_' ORDER BY place) AS ws FROM p WHERE place <= 4 GROUP BY topic)
SELECT c.topic, c.count, CAST(c.topic AS VARCHAR) || '_' || ws AS name
FROM (SELECT topic, COUNT(*) AS count FROM a GROUP BY topic) c JOIN n ON c.topic = n.topic""",
)


def topic_labels(rows, given):
    return topics.topic_summary(given.join(rows.select("review_id", "full_text"), "review_id"), "full_text")


def all_topic_labels(spark, sf_dir):
    return topic_labels(staged_reviews(spark, sf_dir), materialize(given_topics(spark, sf_dir)))


@query("n9_topic_summary", cs.using("topic_labels") + "SELECT * FROM topic_labels")
def _(spark, sf_dir):
    return all_topic_labels(spark, sf_dir)


@query(
    "k4_largest_topics",
    cs.using("topic_labels") + f"SELECT * FROM topic_labels ORDER BY count DESC, topic LIMIT {LARGEST_TOPICS}",
)
def _(spark, sf_dir):
    return all_topic_labels(spark, sf_dir).orderBy(F.col("count").desc(), "topic").limit(LARGEST_TOPICS)


_CATEGORY = """, a AS (SELECT t.review_id, topic, category FROM topic_rows t LEFT JOIN rv ON t.review_id = rv.review_id)"""


@query(
    "j14_topic_categories",
    cs.using("topic_rows", "rv") + _CATEGORY + " SELECT topic, category, COUNT(*) AS n FROM a GROUP BY topic, category",
)
def _(spark, sf_dir):
    categories = cn.reviews(spark, sf_dir).select("review_id", "category")
    joined = given_topics(spark, sf_dir).join(categories, "review_id", "left")
    return joined.groupBy("topic", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "n10_a15_category_concentration",
    cs.using("topic_rows", "rv")
    + _CATEGORY
    + """, c AS (SELECT topic, category, COUNT(*) AS n FROM a GROUP BY topic, category),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY category IS NULL, n DESC, category) AS r,
  SUM(n) OVER (PARTITION BY topic) AS total, SUM(CASE WHEN category IS NOT NULL THEN n END) OVER (PARTITION BY topic) AS known,
  COUNT(category) OVER (PARTITION BY topic) AS u FROM c)
SELECT topic, CAST(total AS BIGINT) AS count, category AS dominant_category, ROUND(CAST(n AS DOUBLE) / known, 3) AS dominant_pct,
  u AS n_unique_categories FROM r WHERE r = 1 ORDER BY total DESC, topic LIMIT 16""",
)
def _(spark, sf_dir):
    categories = cn.reviews(spark, sf_dir).select("review_id", "category")
    return topics.category_concentration(given_topics(spark, sf_dir).join(categories, "review_id", "left"))


# --- documents ---------------------------------------------------------------------


def review_documents(spark, sf_dir, only=None):
    """Documents of all reviews, or of the rows that a condition picks; only their own parts are computed then."""
    every = staged_reviews(spark, sf_dir)
    rows = every if only is None else materialize(every.where(only))
    given = materialize(given_topics(spark, sf_dir))
    labels = materialize(topic_labels(every, given))
    topic = given if only is None else given.join(rows.select("review_id"), "review_id", "left_semi")
    facts = reviews.review_facts(rows, materialize(reviews.company_dimension(every)))
    return documents.build_documents(
        facts, sentiment_table(spark, rows), scored_mentions(spark, rows), topic, labels, cn.keywords_of(rows)
    )


def child_counts(spark, sf_dir):
    rows = staged_reviews(spark, sf_dir)
    return documents.child_counts(rows, mentions(rows), cn.keywords_of(rows))


cs.view(
    "docs",
    ("companies", "sentiment_rows", "aspect_rows", "topic_labels", "kw_strings"),
    """
WITH asp AS (SELECT review_id, list({'aspect': aspect, 'sentence': sentence, 'predicted_stars': predicted_stars}
    ORDER BY aspect, sentence, predicted_stars) AS aspects FROM aspect_rows GROUP BY review_id)
SELECT r.review_id AS _id, c.company_id, r.title, r.review, r.stars, s.lexicon_compound, s.lexicon_bucket,
  s.model_predicted_stars, s.model_bucket, coalesce(aspects, []) AS aspects, coalesce(t.topic, -1) AS topic_id,
  coalesce(l.name, 'unknown') AS topic_label, coalesce(string_split(k.keywords, ' | '), []) AS keywords
FROM rv r LEFT JOIN companies c ON r.company = c.company LEFT JOIN sentiment_rows s ON r.review_id = s.review_id
LEFT JOIN asp ON r.review_id = asp.review_id LEFT JOIN topic_rows t ON r.review_id = t.review_id
LEFT JOIN topic_labels l ON coalesce(t.topic, -1) = l.topic LEFT JOIN kw_strings k ON r.review_id = k.review_id""",
)


def _flat(df):
    """The nested record with its arrays rendered, to compare engines."""
    rendered = F.array_join(
        F.transform("aspects", lambda a: F.concat_ws("~", a["aspect"], a["sentence"], a["predicted_stars"].cast("string"))),
        "^",
    )
    return df.select(
        "_id", "company_id", "title", "review", "stars",
        F.round("sentiment.lexicon_compound", 6).alias("lexicon_compound"),
        F.col("sentiment.lexicon_bucket").alias("lexicon_bucket"),
        F.col("sentiment.model_predicted_stars").alias("model_predicted_stars"),
        F.col("sentiment.model_bucket").alias("model_bucket"),
        rendered.alias("aspects"), F.col("topic.topic_id").alias("topic_id"),
        F.col("topic.topic_label").alias("topic_label"), F.array_join("keywords", "^").alias("keywords"),
    )


_FLAT = """SELECT _id, company_id, title, review, stars, ROUND(lexicon_compound, 6) AS lexicon_compound, lexicon_bucket,
  model_predicted_stars, model_bucket,
  coalesce(array_to_string(list_transform(aspects, lambda a: a.aspect || '~' || a.sentence || '~' || a.predicted_stars), '^'), '')
    AS aspects, topic_id, topic_label, coalesce(array_to_string(keywords, '^'), '') AS keywords FROM docs"""


@query("a20_j9_review_documents", cs.using("docs") + _FLAT)
def _(spark, sf_dir):
    return _flat(review_documents(spark, sf_dir))


@query("p18_find_document", cs.using("docs") + _FLAT + f" WHERE _id = {ONE_REVIEW}")
def _(spark, sf_dir):
    return _flat(review_documents(spark, sf_dir, F.col("review_id") == ONE_REVIEW))


@query(
    "p19_search_by_topic",
    cs.using("docs") + "SELECT _id, topic_id, topic_label FROM docs WHERE contains(lower(topic_label), 'the')",
)
def _(spark, sf_dir):
    rows, given = staged_reviews(spark, sf_dir), materialize(given_topics(spark, sf_dir))
    found = documents.search_by_topic(documents.topic_of(rows, given, topic_labels(rows, given)), "The")
    return found.select("_id", F.col("topic.topic_id").alias("topic_id"), F.col("topic.topic_label").alias("topic_label"))


@query(
    "a21_aspect_coverage",
    cs.using("docs")
    + f"""SELECT COUNT(*) AS reviews, {cs.count_if("len(aspects) > 0")} AS with_aspects,
  ROUND(AVG(CASE WHEN len(aspects) > 0 THEN 1e0 ELSE 0e0 END), 4) AS share_with_aspects,
  CAST(MIN(CASE WHEN len(aspects) > 0 THEN len(aspects) END) AS INTEGER) AS fewest_aspects,
  CAST(MAX(len(aspects)) AS INTEGER) AS most_aspects FROM docs""",
)
def _(spark, sf_dir):
    return documents.coverage(child_counts(spark, sf_dir))


@query(
    "j11_fan_out",
    cs.using("docs")
    + """SELECT _id AS review_id, CAST(len(aspects) AS INTEGER) AS aspects, CAST(len(keywords) AS INTEGER) AS keywords,
  CAST(greatest(len(aspects), 1) * greatest(len(keywords), 1) AS INTEGER) AS joined_rows FROM docs""",
)
def _(spark, sf_dir):
    return documents.fan_out(child_counts(spark, sf_dir))


@query(
    "k5_first_with_and_without",
    cs.using("docs")
    + """SELECT with_aspects, _id, stars, topic_id, CAST(len(aspects) AS INTEGER) AS aspects FROM docs JOIN (
  SELECT len(aspects) > 0 AS with_aspects, MIN(_id) AS first FROM docs GROUP BY 1) f ON _id = first""",
)
def _(spark, sf_dir):
    firsts = materialize(documents.first_with_and_without(child_counts(spark, sf_dir)))
    picked = [r.review_id for r in firsts.collect()]  # at most two rows
    found = documents.as_json(review_documents(spark, sf_dir, F.col("review_id").isin(picked)))
    shape = "stars int, topic struct<topic_id: int>, aspects array<struct<aspect: string>>"
    body = F.from_json("document", shape)
    return found.join(firsts, F.col("_id") == F.col("review_id")).select(
        "with_aspects",
        "_id",
        body["stars"].alias("stars"),
        body["topic"]["topic_id"].alias("topic_id"),
        F.size(body["aspects"]).alias("aspects"),
    )


def bridge_of(spark, sf_dir, every, rows=None):
    """The sentiment bridge of `rows` (default all); topic labels come from all reviews."""
    given = materialize(given_topics(spark, sf_dir))
    return documents.sentiment_bridge(
        sentiment_table(spark, every if rows is None else rows), given, topic_labels(every, given)
    )


_BRIDGE = f"""SELECT s.review_id, CAST(lexicon_compound AS DECIMAL(6,4)) AS lexicon_compound, lexicon_bucket,
  CAST(model_predicted_stars AS SMALLINT) AS model_predicted_stars, model_bucket, t.topic AS topic_id,
  CASE WHEN t.topic = -1 THEN '{documents.OUTLIER_LABEL}' ELSE l.name END AS topic_label
FROM sentiment_rows s LEFT JOIN topic_rows t ON s.review_id = t.review_id LEFT JOIN topic_labels l ON t.topic = l.topic"""


@query(
    "j10_s9_sentiment_bridge",
    cs.using("sentiment_rows", "topic_labels")
    + f", b AS ({_BRIDGE}) SELECT * REPLACE (CAST(ROUND(lexicon_compound, 3) AS DOUBLE) AS lexicon_compound) FROM b",
)
def _(spark, sf_dir):
    bridge = bridge_of(spark, sf_dir, staged_reviews(spark, sf_dir))
    return bridge.withColumn("lexicon_compound", F.round("lexicon_compound", 3).cast("double"))


@query(
    "s9_aspects_bridge",
    cs.using("aspect_rows") + "SELECT review_id, aspect, sentence, predicted_stars FROM aspect_rows",
)
def _(spark, sf_dir):
    scored = scored_mentions(spark, cn.reviews_text(spark, sf_dir))
    return scored.select("review_id", "aspect", "sentence", "predicted_stars")


@query(
    "n12_s9_keyword_rows",
    cs.using("kw_strings") + "SELECT review_id, unnest(string_split(keywords, ' | ')) AS keyword FROM kw_strings",
)
def _(spark, sf_dir):
    return documents.keyword_rows(cn.keyword_strings(spark, sf_dir))


@query(
    "j11_one_review_profile",
    cs.using("sentiment_rows", "topic_labels", "aspect_rows", "kw_strings")
    + f""", b AS ({_BRIDGE}), k AS (SELECT review_id, unnest(string_split(keywords, ' | ')) AS keyword FROM kw_strings)
SELECT r.review_id, r.stars, b.lexicon_bucket, b.topic_label, a.aspect, a.sentence AS aspect_sentence, k.keyword
FROM rv r JOIN b ON r.review_id = b.review_id LEFT JOIN aspect_rows a ON r.review_id = a.review_id
LEFT JOIN k ON r.review_id = k.review_id WHERE r.review_id = {ONE_REVIEW}""",
)
def _(spark, sf_dir):
    every = staged_reviews(spark, sf_dir)
    rows = materialize(every.where(F.col("review_id") == ONE_REVIEW))
    keywords = documents.keyword_rows(cn.keywords_of(rows))
    bridge = bridge_of(spark, sf_dir, every, rows)
    return documents.review_profile(ONE_REVIEW, rows, bridge, scored_mentions(spark, rows), keywords)


# --- evaluation of star predictions ---------------------------------------------------


@query(
    "a16_confusion_matrix",
    cs.using("preds")
    + "SELECT stars AS actual, "
    + ", ".join(f"{cs.count_if(f'pred = {v}')} AS pred_{v}" for v in range(1, 6))
    + " FROM preds GROUP BY stars",
)
def _(spark, sf_dir):
    return metrics.confusion_matrix(cn.predictions(spark, sf_dir), "stars", "pred", [1, 2, 3, 4, 5])


cs.view(
    "report_rows",
    ("preds",),
    """SELECT label, CASE WHEN p > 0 THEN CAST(tp AS DOUBLE) / p ELSE 0 END AS "precision",
  CASE WHEN s > 0 THEN CAST(tp AS DOUBLE) / s ELSE 0 END AS recall,
  CASE WHEN p + s > 0 THEN 2e0 * tp / (p + s) ELSE 0 END AS f1, s AS support
FROM (SELECT k.c AS label, (SELECT COUNT(*) FROM preds WHERE pred = k.c) AS p, (SELECT COUNT(*) FROM preds WHERE stars = k.c) AS s,
    (SELECT COUNT(*) FROM preds WHERE stars = k.c AND pred = k.c) AS tp
  FROM (SELECT stars AS c FROM preds UNION SELECT pred FROM preds) k)""",
)


@query(
    "a17_class_report",
    cs.using("report_rows")
    + 'SELECT label, ROUND("precision", 6) AS "precision", ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, support FROM report_rows',
)
def _(spark, sf_dir):
    report = metrics.class_report(cn.predictions(spark, sf_dir), "stars", "pred")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "a17_overall_scores",
    cs.using("report_rows")
    + """SELECT (SELECT ROUND(AVG(CASE WHEN stars = pred THEN 1e0 ELSE 0e0 END), 6) FROM preds) AS accuracy,
  ROUND(AVG(f1), 6) AS macro_f1 FROM report_rows""",
)
def _(spark, sf_dir):
    scores = metrics.overall_scores(cn.predictions(spark, sf_dir), "stars", "pred")
    return scores.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(
    "a18_off_by_one",
    cs.using("preds")
    + """SELECT COUNT(*) AS wrong, ROUND(AVG(CASE WHEN abs(pred - stars) = 1 THEN 1e0 ELSE 0e0 END), 6) AS off_by_one_share
FROM preds WHERE pred <> stars""",
)
def _(spark, sf_dir):
    wrong = metrics.off_by_one(cn.predictions(spark, sf_dir), "stars", "pred")
    return wrong.withColumn("off_by_one_share", F.round("off_by_one_share", 6))


@query(
    "a19_binary_scores",
    cs.using("preds")
    + """, r AS (SELECT *, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2e0 AS rk FROM preds),
c AS (SELECT COUNT(*) AS n, CAST(count_if(label = 1) AS DOUBLE) AS p, CAST(count_if(score > 0.5) AS DOUBLE) AS c,
  CAST(count_if(score > 0.5 AND label = 1) AS DOUBLE) AS tp, AVG(CASE WHEN (score > 0.5) = (label = 1) THEN 1e0 ELSE 0e0 END) AS acc,
  SUM(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs FROM r)
SELECT n, ROUND(acc, 6) AS accuracy, ROUND(tp / c, 6) AS "precision", ROUND(tp / p, 6) AS recall,
  ROUND((rs - p * (p + 1) / 2) / (p * (n - p)), 6) AS roc_auc FROM c""",
)
def _(spark, sf_dir):
    scores = metrics.binary_scores(cn.predictions(spark, sf_dir), "label", "score")
    return scores.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "roc_auc")])


# --- profiles ---------------------------------------------------------------------------


@query(
    "q4_text_length",
    cs.using("rv_raw")
    + """SELECT MIN(length(review)) AS shortest, CAST(quantile_cont(length(review), 0.5) AS DOUBLE) AS median,
  MAX(length(review)) AS longest FROM rv_raw""",
)
def _(spark, sf_dir):
    return reviews.text_length(cn.reviews_raw(spark, sf_dir), "review")


@query(
    "q4_name_endings",
    cs.using("rv_raw")
    + """SELECT CASE WHEN company LIKE '%1' THEN '1' WHEN company LIKE '%0' THEN '0' ELSE 'other' END AS ending, COUNT(*) AS names
FROM (SELECT DISTINCT company FROM rv_raw) GROUP BY 1""",
)
def _(spark, sf_dir):
    return reviews.name_endings(cn.reviews_raw(spark, sf_dir), "company", ["1", "0"])


@query(
    "q1_review_profile",
    cs.using("rv_raw")
    + "SELECT column_name, (SELECT COUNT(*) FROM rv_raw) AS row_count, "
    + "(SELECT COUNT(*) FROM rv_raw) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM rv_raw)) AS duplicate_rows, "
    + "distinct_values, missing, ROUND(100e0 * missing / (SELECT COUNT(*) FROM rv_raw), 4) AS pct_missing FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_values, COUNT(*) - COUNT({c}) AS missing FROM rv_raw"
        for c in _RAW
    )
    + ")",
)
def _(spark, sf_dir):
    return quality.table_profile(cn.reviews_raw(spark, sf_dir))
