"""Order lines: cleaning, customer tables, revenue, churn and invoice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import cleaning, customers, quality
from tillsight.plans import canonical as cn
from tillsight.plans import check_sql as cs
from tillsight.plans.registry import query
from tillsight.sources import staging, writers
from tillsight.sources.staging import materialize

CUT = f"DATE '{cn.CUTOFF}'"


def customer_lines(spark, sf_dir):
    return cleaning.customer_lines(cn.transactions(spark, sf_dir))


def stored_lines(spark, sf_dir):
    """The curated table, written once for queries that read it more than once."""
    return materialize(cn.transactions(spark, sf_dir))


# --- cleaning ---------------------------------------------------------------


@query("p5_exact_duplicates", cs.using("tx_distinct") + "SELECT * FROM tx_distinct")
def _(spark, sf_dir):
    return cleaning.drop_exact_duplicates(cn.transactions_raw(spark, sf_dir))


@query("p6_junk_lines", cs.using("tx_raw") + f"SELECT * FROM tx_raw WHERE NOT {cs.JUNK_LINE}")
def _(spark, sf_dir):
    return cleaning.drop_junk_lines(cn.transactions_raw(spark, sf_dir))


@query("p7_test_lines", cs.using("tx_raw") + f"SELECT * FROM tx_raw WHERE NOT {cs.TEST_LINE}")
def _(spark, sf_dir):
    return cleaning.drop_test_lines(cn.transactions_raw(spark, sf_dir))


@query("p8_clean_transactions", cs.using("tx") + "SELECT * FROM tx")
def _(spark, sf_dir):
    return cn.transactions(spark, sf_dir)


@query("p9_customer_transactions", cs.using("tx_c") + "SELECT * FROM tx_c")
def _(spark, sf_dir):
    return customer_lines(spark, sf_dir)


_REPORT = f"""
, kept AS (SELECT * FROM tx_distinct WHERE NOT {cs.JUNK_LINE} AND NOT {cs.TEST_LINE}),
r AS (SELECT
  (SELECT COUNT(*) FROM tx_raw) AS rows_before,
  (SELECT COUNT(*) FROM tx_raw) - (SELECT COUNT(*) FROM tx_distinct) AS duplicates_removed,
  (SELECT COUNT(*) FROM tx_distinct WHERE {cs.JUNK_LINE}) AS junk_rows_removed,
  (SELECT COUNT(*) FROM tx_distinct WHERE NOT {cs.JUNK_LINE} AND {cs.TEST_LINE}) AS test_rows_removed,
  (SELECT COUNT(*) FROM kept) AS rows_after_all,
  (SELECT COUNT(*) FROM kept WHERE customer_id IS NULL) AS rows_missing_customer_id,
  (SELECT COUNT(*) FROM kept WHERE customer_id IS NOT NULL) AS rows_after_customer_level,
  (SELECT COUNT(*) FROM kept WHERE NOT {cs.PRODUCT}) AS non_product_rows_flagged,
  (SELECT COUNT(*) FROM kept WHERE starts_with(invoice, 'C')) AS cancellation_rows_kept)
SELECT *, """ + ", ".join(
    f"ROUND(100e0 * {c} / rows_before, 2) AS pct_{c}"
    for c in (
        "duplicates_removed",
        "junk_rows_removed",
        "test_rows_removed",
        "rows_after_all",
        "rows_missing_customer_id",
        "rows_after_customer_level",
    )
) + " FROM r"


@query("p10_cleaning_report", cs.using("tx_distinct") + _REPORT)
def _(spark, sf_dir):
    return cleaning.transaction_cleaning_report(cn.transactions_raw(spark, sf_dir))


# --- customer tables --------------------------------------------------------

_RFM = f"""SELECT customer_id,
  CAST(date_diff('day', MAX(CAST(invoice_date AS DATE)), (SELECT MAX(CAST(invoice_date AS DATE)) FROM tx)) AS INTEGER)
    AS recency_days,
  COUNT(DISTINCT invoice) AS frequency, {cs.money("line_value")} AS monetary, BOOL_OR(is_cancellation) AS has_returned
FROM tx_c GROUP BY customer_id"""


@query("a1_rfm", cs.using("tx_c") + _RFM)
def _(spark, sf_dir):
    return customers.rfm(cn.transactions(spark, sf_dir))


_SPEND = f"""SELECT customer_id, {cs.money("line_value")} AS monetary, BOOL_OR(is_cancellation) AS has_returned
FROM tx_c GROUP BY customer_id"""


@query(
    "a2_returner_spend",
    cs.using("tx_c")
    + f""", spend AS ({_SPEND})
SELECT has_returned, COUNT(*) AS num_customers, {cs.rounded(cs.money("monetary") + " / COUNT(*)", 2)} AS avg_monetary,
  {cs.rounded("quantile_cont(monetary, 0.5)", 2)} AS median_monetary
FROM spend GROUP BY has_returned""",
)
def _(spark, sf_dir):
    return customers.returner_spend(customers.customer_spend(customer_lines(spark, sf_dir)))


def _modal(relation: str, key: str, value: str) -> str:
    return f"""SELECT {key}, coalesce(max(CASE WHEN r = 1 THEN {value} END), 'UNKNOWN') AS {value} FROM (
  SELECT {key}, {value}, CASE WHEN {value} IS NULL THEN 0 ELSE row_number() OVER (
    PARTITION BY {key}, {value} IS NULL ORDER BY COUNT(*) DESC, {value}) END AS r
  FROM {relation} GROUP BY {key}, {value}) GROUP BY {key}"""


@query("a6_products", cs.using("tx") + _modal("tx", "stock_code", "description"))
def _(spark, sf_dir):
    return customers.modal_value(cn.transactions(spark, sf_dir), "stock_code", "description")


@query("a6_customers", cs.using("tx_c") + _modal("tx_c", "customer_id", "country"))
def _(spark, sf_dir):
    return customers.modal_value(customer_lines(spark, sf_dir), "customer_id", "country")


_SPEND_BY_COUNTRY = f""", dim AS ({_modal("tx_c", "customer_id", "country")}),
s AS (SELECT t.customer_id, dim.country, {cs.money("line_value")} AS monetary
  FROM tx_c t JOIN dim ON t.customer_id = dim.customer_id GROUP BY t.customer_id, dim.country)
"""


@query(
    "j1_fact_to_dimension",
    cs.using("tx_c")
    + _SPEND_BY_COUNTRY
    + f"SELECT country, COUNT(*) AS customers, {cs.money('monetary')} AS monetary FROM s GROUP BY country",
)
def _(spark, sf_dir):
    lines = cleaning.customer_lines(stored_lines(spark, sf_dir))
    dim = customers.modal_value(lines, "customer_id", "country")
    per_customer = lines.groupBy("customer_id").agg(customers.exact_sum(F.col("line_value")).alias("monetary"))
    return (
        per_customer.join(dim, "customer_id")
        .groupBy("country")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            customers.exact_sum(F.col("monetary")).alias("monetary"),
        )
    )


@query(
    "w2_rank_in_country",
    cs.using("tx_c")
    + _SPEND_BY_COUNTRY
    + "SELECT *, RANK() OVER (PARTITION BY country ORDER BY monetary DESC) AS rank_in_country FROM s",
)
def _(spark, sf_dir):
    lines = cleaning.customer_lines(stored_lines(spark, sf_dir))
    return customers.rank_in_country(lines, customers.modal_value(lines, "customer_id", "country"))


_MONTHLY = f"""SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, {cs.money("line_value")} AS revenue
FROM tx GROUP BY 1"""


@query("a5_monthly_revenue", cs.using("tx") + _MONTHLY)
def _(spark, sf_dir):
    return customers.monthly_revenue(cn.transactions(spark, sf_dir))


@query(
    "w3_cumulative_revenue",
    cs.using("tx")
    + f""", m AS ({_MONTHLY})
SELECT month, revenue, CAST(SUM(CAST(revenue AS DECIMAL(28,4))) OVER (ORDER BY month) AS DOUBLE) AS cumulative_revenue
FROM m""",
)
def _(spark, sf_dir):
    return customers.cumulative_revenue(customers.monthly_revenue(cn.transactions(spark, sf_dir)))


CHURN_SQL = f"""SELECT c.customer_id,
  CAST(date_diff('day', first_day, {CUT}) AS INTEGER) AS tenure_days,
  CAST(date_diff('day', last_day, {CUT}) AS INTEGER) AS recency_days,
  frequency, monetary, {cs.rounded('monetary / frequency', 2)} AS avg_order_value, has_returned,
  CASE WHEN h.customer_id IS NULL THEN 1 ELSE 0 END AS churned
FROM (SELECT customer_id, MIN(CAST(invoice_date AS DATE)) AS first_day, MAX(CAST(invoice_date AS DATE)) AS last_day,
    COUNT(DISTINCT invoice) AS frequency, {cs.money("line_value")} AS monetary, BOOL_OR(is_cancellation) AS has_returned
  FROM tx_c WHERE CAST(invoice_date AS DATE) < {CUT} GROUP BY customer_id) c
LEFT JOIN (SELECT DISTINCT customer_id FROM tx_c WHERE CAST(invoice_date AS DATE) >= {CUT}) h
  ON c.customer_id = h.customer_id"""


def churn_table(spark, sf_dir):
    return customers.churn_features(customer_lines(spark, sf_dir), cn.CUTOFF)


@query("a3_churn_features", cs.using("tx_c") + CHURN_SQL)
def _(spark, sf_dir):
    return churn_table(spark, sf_dir)


@query(
    "p16_churn_rate",
    cs.using("tx_c")
    + f", c AS ({CHURN_SQL}) SELECT churned, COUNT(*) AS customers, "
    + f"ROUND({cs.money('monetary')} / COUNT(*), 4) AS avg_monetary FROM c GROUP BY churned",
)
def _(spark, sf_dir):
    return (
        churn_table(spark, sf_dir)
        .groupBy("churned")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.round(customers.exact_sum(F.col("monetary")) / F.count(F.lit(1)), 4).alias("avg_monetary"),
        )
    )


INVOICE_SQL = f"""SELECT customer_id, invoice, MIN(CAST(invoice_date AS DATE)) AS invoice_date,
  {cs.money("line_value")} AS invoice_value, BOOL_OR(is_cancellation) AS is_cancellation
FROM tx_c GROUP BY customer_id, invoice"""


@query(
    "a4a_sale_invoices",
    cs.using("tx_c")
    + f"""SELECT customer_id, invoice, MIN(CAST(invoice_date AS DATE)) AS invoice_date,
  {cs.money("line_value")} AS invoice_value FROM tx_c WHERE NOT is_cancellation GROUP BY customer_id, invoice""",
)
def _(spark, sf_dir):
    return customers.sale_invoices(customer_lines(spark, sf_dir))


@query("a4b_invoices", cs.using("tx_c") + INVOICE_SQL)
def _(spark, sf_dir):
    return customers.invoices(customer_lines(spark, sf_dir))


REVERSED_SQL = """SELECT DISTINCT unnest([a.invoice, b.invoice]) AS invoice FROM inv a JOIN inv b
  ON a.customer_id = b.customer_id AND a.invoice_date = b.invoice_date AND a.invoice <> b.invoice
  AND a.invoice_value > 0 AND abs(a.invoice_value + b.invoice_value) < 0.01"""


@query("j7_reversed_invoices", cs.using("tx_c") + f", inv AS ({INVOICE_SQL}) {REVERSED_SQL}")
def _(spark, sf_dir):
    return customers.reversed_invoices(customers.invoices(customer_lines(spark, sf_dir)))


GENUINE_SQL = f"""inv AS ({INVOICE_SQL}), rev AS ({REVERSED_SQL}),
genuine AS (SELECT * EXCLUDE (is_cancellation) FROM inv
  WHERE NOT is_cancellation AND invoice NOT IN (SELECT invoice FROM rev))"""


@query("j8_genuine_invoices", cs.using("tx_c") + f", {GENUINE_SQL} SELECT * FROM genuine")
def _(spark, sf_dir):
    return customers.genuine_invoices(customers.invoices(customer_lines(spark, sf_dir)))


@query(
    "k1_rfm_by_spend",
    cs.using("tx_c") + f", r AS ({_RFM}) SELECT * FROM r ORDER BY monetary DESC, customer_id",
)
def _(spark, sf_dir):
    return customers.rfm(cn.transactions(spark, sf_dir)).orderBy(F.col("monetary").desc(), "customer_id")


# --- profiles ---------------------------------------------------------------


@query(
    "a7_dependency_checks",
    cs.using("tx_c", "rv_raw")
    + "\nUNION ALL ".join(
        f"SELECT '{k} -> {v}' AS dependency, COUNT(*) AS keys, {cs.count_if('n > 1')} AS violations "
        f"FROM (SELECT {k}, COUNT(DISTINCT {v}) AS n FROM {t} GROUP BY {k})"
        for t, k, v in (
            ("tx", "stock_code", "description"),
            ("tx_c", "customer_id", "country"),
            ("rv_clean", "company", "category"),
            ("rv_clean", "company", "description"),
        )
    ).replace("rv_clean", f"(SELECT DISTINCT * FROM rv_raw WHERE NOT {cs.JUNK_REVIEW})"),
)
def _(spark, sf_dir):
    lines = stored_lines(spark, sf_dir)
    reviews = materialize(cleaning.clean_reviews(cn.reviews_raw(spark, sf_dir)).drop("title", "review", "stars"))
    checks = [
        quality.dependency_check(lines, "stock_code", "description"),
        quality.dependency_check(cleaning.customer_lines(lines), "customer_id", "country"),
        quality.dependency_check(reviews, "company", "category"),
        quality.dependency_check(reviews, "company", "description"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


_TX_COLUMNS = ["invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country"]


@query(
    "q1_transaction_profile",
    cs.using("tx_distinct")
    + "SELECT column_name, (SELECT COUNT(*) FROM tx_raw) AS row_count, "
    + "(SELECT COUNT(*) FROM tx_raw) - (SELECT COUNT(*) FROM tx_distinct) AS duplicate_rows, distinct_values, missing, "
    + "ROUND(100e0 * missing / (SELECT COUNT(*) FROM tx_raw), 4) AS pct_missing FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_values, COUNT(*) - COUNT({c}) AS missing FROM tx_raw"
        for c in _TX_COLUMNS
    )
    + ")",
)
def _(spark, sf_dir):
    lines = cn.table(spark, sf_dir, "lineitem").count()
    return quality.table_profile(cn.transactions_raw(spark, sf_dir), cn.tasks_for(spark, lines))


@query(
    "q1_date_span",
    cs.using("tx_raw")
    + "SELECT CAST(MIN(invoice_date) AS DATE) AS first_day, CAST(MAX(invoice_date) AS DATE) AS last_day, "
    + "COUNT(DISTINCT CAST(invoice_date AS DATE)) AS active_days FROM tx_raw",
)
def _(spark, sf_dir):
    return quality.date_span(cn.transactions_raw(spark, sf_dir), "invoice_date")


_CLASSES = {
    "cancellations": "starts_with(invoice, 'C')",
    "non_positive_price": "price <= 0",
    "test_codes": cs.TEST_LINE,
    "charge_codes": f"NOT {cs.PRODUCT}",
    "unclear_prefix": "starts_with(stock_code, 'DCGS')",
    "missing_customer": "customer_id IS NULL",
}


@query(
    "q2_rule_classes",
    cs.using("tx_raw")
    + " UNION ALL ".join(
        f"SELECT '{k}' AS rule, {cs.count_if(v)} AS matched, ROUND(100e0 * count_if({v}) / COUNT(*), 4) AS pct FROM tx_raw"
        for k, v in _CLASSES.items()
    ),
)
def _(spark, sf_dir):
    return quality.rule_classes(
        cn.transactions_raw(spark, sf_dir),
        {
            "cancellations": cleaning.is_cancellation(),
            "non_positive_price": F.col("price") <= 0,
            "test_codes": cleaning.is_test_line(),
            "charge_codes": ~cleaning.is_product(),
            "unclear_prefix": F.col("stock_code").startswith("DCGS"),
            "missing_customer": F.col("customer_id").isNull(),
        },
    )


@query(
    "q3_country_shares",
    cs.using("tx_raw")
    + "SELECT country, COUNT(*) AS n, ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM tx_raw), 6) AS share "
    + "FROM tx_raw GROUP BY country",
)
def _(spark, sf_dir):
    return quality.value_shares(cn.transactions_raw(spark, sf_dir), "country")


# --- constraints of the star schema ------------------------------------------


@query(
    "s11_constraint_checks",
    cs.using("tx_c")
    + f""", dim_p AS ({_modal("tx", "stock_code", "description")}), dim_c AS ({_modal("tx_c", "customer_id", "country")})
SELECT 'products.stock_code unique' AS rule, COUNT(*) AS violations
  FROM (SELECT stock_code FROM dim_p GROUP BY 1 HAVING COUNT(*) > 1)
UNION ALL SELECT 'customers.customer_id unique', COUNT(*) FROM (SELECT customer_id FROM dim_c GROUP BY 1 HAVING COUNT(*) > 1)
UNION ALL SELECT 'transactions.stock_code references products', COUNT(*) FROM tx
  WHERE stock_code IS NOT NULL AND stock_code NOT IN (SELECT stock_code FROM dim_p)
UNION ALL SELECT 'transactions.customer_id references customers', COUNT(*) FROM tx
  WHERE customer_id IS NOT NULL AND CAST(customer_id AS BIGINT) NOT IN (SELECT customer_id FROM dim_c)""",
)
def _(spark, sf_dir):
    lines = stored_lines(spark, sf_dir).withColumn("customer_id", F.col("customer_id").cast("bigint"))
    products = customers.modal_value(lines, "stock_code", "description")
    buyers = customers.modal_value(lines.where("customer_id IS NOT NULL"), "customer_id", "country")
    return quality.union_all(
        quality.unique_key(products, ["stock_code"], "products.stock_code unique"),
        quality.unique_key(buyers, ["customer_id"], "customers.customer_id unique"),
        quality.references(lines, products, "stock_code", "transactions.stock_code references products"),
        quality.references(lines, buyers, "customer_id", "transactions.customer_id references customers"),
    )


@query(
    "a14_distinct_counts",
    cs.using("tx_c", "rv_keyed")
    + """SELECT (SELECT COUNT(DISTINCT customer_id) FROM tx_c) AS customers,
  (SELECT COUNT(DISTINCT stock_code) FROM tx_c) AS products, (SELECT COUNT(DISTINCT invoice) FROM tx_c) AS invoices""",
)
def _(spark, sf_dir):
    return quality.distinct_counts(
        customer_lines(spark, sf_dir),
        {"customers": "customer_id", "products": "stock_code", "invoices": "invoice"},
    )


@query(
    "s8_published_reload",
    "SELECT o_custkey, COUNT(*) AS orders FROM orders "
    "WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey",
)
def _(spark, sf_dir):
    """A table that is published, then reloaded with repeated keys: the reload is rejected, the first version read."""
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"))
    placed = spark.read.parquet(f"{sf_dir}/orders.parquet").join(known, "o_custkey", "left_semi")
    counts = placed.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    rules = [
        lambda t: quality.unique_key(t, ["o_custkey"], "one row a customer"),
        lambda t: quality.references(t, known, "o_custkey", "customer exists"),
    ]
    path = staging.new_folder(spark)
    writers.publish_table(counts, path, rules)
    repeated = writers.read_published(spark, path)
    try:
        writers.publish_table(repeated.unionByName(repeated), path, rules)
    except writers.RulesBroken:
        pass
    return writers.read_published(spark, path)
