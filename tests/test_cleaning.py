import pytest

from tillsight.operators import cleaning, customers

TX = "invoice string, stock_code string, description string, quantity int, invoice_date string, price double, customer_id double, country string"
ROWS = [
    ("500001", "85048", "GLASS BALL", 12, "2010-01-01", 6.95, 1001.0),
    ("500001", "85048", "GLASS BALL", 12, "2010-01-01", 6.95, 1001.0),
    ("C500002", "85048", "GLASS BALL", -2, "2010-01-02", 6.95, 1001.0),
    ("500003", "22041", "RECORD FRAME", 48, "2010-01-03", 2.10, None),
    ("A500004", "B", "Adjust bad debt", 1, "2010-01-04", -100.0, None),
    ("500005", "22042", "damaged", 1, "2010-01-05", 0.0, 1002.0),
    ("500006", "TEST001", "This is a test", 1, "2010-01-06", 1.0, 1003.0),
    ("500007", "POST", "POSTAGE", 1, "2010-01-07", 15.0, 1003.0),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(*r, "United Kingdom") for r in ROWS], TX)


@pytest.fixture(scope="module")
def clean(raw):
    return {r.invoice: r for r in cleaning.clean_transactions(raw).collect()}


@pytest.fixture(scope="module")
def report(raw):
    return cleaning.transaction_cleaning_report(raw).first()


def test_duplicates_are_removed(raw, report):
    assert report.duplicates_removed == 1
    assert cleaning.clean_transactions(raw).where("invoice = '500001'").count() == 1


def test_cancellations_are_kept(clean, report):
    assert clean["C500002"].is_cancellation and clean["C500002"].quantity == -2
    assert report.cancellation_rows_kept == 1


def test_missing_customer_only_in_all_view(raw, clean, report):
    assert "500003" in clean
    kept = cleaning.customer_lines(cleaning.clean_transactions(raw))
    assert kept.where("invoice = '500003'").count() == 0
    assert dict(kept.dtypes)["customer_id"] == "bigint"
    assert report.rows_missing_customer_id == 1


def test_junk_and_test_rows_removed(clean, report):
    assert not {"A500004", "500005", "500006"} & set(clean)
    assert (report.junk_rows_removed, report.test_rows_removed) == (2, 1)


def test_charge_codes_flagged(clean, report):
    assert clean["500007"].is_product is False
    assert report.non_product_rows_flagged == 1


def test_line_value(clean):
    assert clean["500001"].line_value == pytest.approx(83.4)
    assert clean["C500002"].line_value == pytest.approx(-13.9)


def test_counts_are_consistent(clean, report):
    assert (report.rows_before, report.rows_after_all, report.rows_after_customer_level) == (8, len(clean), 3)


def test_edge_rows(spark):
    rows = [
        ("1", "A", None, 1, "2010-01-01", 0.0, 1.0, "X"),
        ("2", "gift_0001_20", "CARD", 1, "2010-01-01", 20.0, 1.0, "X"),
        ("3", "m", "Manual", 1, "2010-01-01", 5.0, 1.0, "X"),
        ("4", "post", "lower case", 1, "2010-01-01", 5.0, 1.0, "X"),
        ("5", "A", " Damaged\t", 1, "2010-01-01", 0.0, 1.0, "X"),
    ]
    got = {r.invoice: r for r in cleaning.clean_transactions(spark.createDataFrame(rows, TX)).collect()}
    assert got["1"].is_zero_value and got["1"].is_product
    assert not got["2"].is_product and not got["3"].is_product and got["4"].is_product
    assert "5" not in got


RV = "category string, company string, description string, title string, review string, stars int"
GOOD = ("Shop", "example.co.uk", "We sell.", "Great service", "Really happy with the quick delivery and helpful staff.", 5)
REVIEWS = [
    GOOD,
    ("Shop", "example.co.uk", "We sell.", "Bit pricey", "Far too expensive", 2),
    ("Money", "phonelookalike.co.uk", "Finance.", "review", "5550142", 1),
    ("Build", "builders.co.uk", "We build.", "meh", "...........", 3),
    ("Travel", "greekco.com", "Agency.", "oxi", "γνωρησα ανθρωπους που ηταν με αλον τροπο", 4),
    GOOD,
]


def test_review_rules(spark):
    raw = spark.createDataFrame(REVIEWS, RV)
    kept = {r.review for r in cleaning.clean_reviews(raw).collect()}
    assert kept == {GOOD[4], "Far too expensive"}
    assert cleaning.review_cleaning_report(raw).first().asDict() == {
        "rows_before": 6,
        "duplicates_removed": 1,
        "phone_number_rows_removed": 1,
        "punctuation_only_rows_removed": 1,
        "non_english_rows_removed": 1,
        "rows_after": 2,
    }


def test_review_edges(spark):
    rows = [("c", "x", "d", "t", None, 1), ("c", "x", "d", "t", "", 2), ("c", "x", "d", "t", "٠١٢٣", 3)]
    raw = spark.createDataFrame(rows, RV)
    assert {r.stars for r in cleaning.clean_reviews(raw).collect()} == {1, 2}
    report = cleaning.review_cleaning_report(raw).first()
    assert (report.phone_number_rows_removed, report.non_english_rows_removed, report.rows_after) == (1, 1, 2)


def test_modal_value(spark):
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", None), ("a", None), ("n", None)], "k string, v string")
    assert {r.k: r.v for r in customers.modal_value(df, "k", "v").collect()} == {"a": "b", "n": "UNKNOWN"}


def test_reversed_invoices_against_all_pairs(spark):
    import random

    random.seed(7)
    rows = []
    for i in range(400):
        value = random.choice([0.004, 0.003, -0.004, 5.0, -5.0, 5.009, -5.01, 4.995, 0.0, -0.009, 12.34, -12.335, 99.99, 0.29, -0.29])
        rows.append((i % 9, f"i{i}", "2011-01-0%d" % (1 + i % 3), value, value < 0))
    df = spark.createDataFrame(rows, "customer_id int, invoice string, d string, invoice_value double, is_cancellation boolean")
    df = df.selectExpr("customer_id", "invoice", "to_date(d) invoice_date", "invoice_value", "is_cancellation")
    want = set()
    for a in rows:
        for b in rows:
            if a[1] != b[1] and a[0] == b[0] and a[2] == b[2] and a[3] > 0 and abs(a[3] + b[3]) < 0.01:
                want |= {a[1], b[1]}
    assert {r.invoice for r in customers.reversed_invoices(df).collect()} == want
