import pytest

from tillsight.operators import documents, quality
from tillsight.sources import readers, writers


def test_transactions_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    text = (
        "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
        '536365,85123A,"CAF\xc9 ""SIGN""",6,2010-12-01 08:26:00,2.55,17850.0,United Kingdom\n'
        "C536379,D,Discount,-1,2010-12-01 09:41:00,27.5,,United Kingdom\n"
    )
    path.write_bytes(text.encode("latin-1"))
    rows = readers.read_transactions(spark, f"file:{path}").orderBy("invoice").collect()
    assert rows[0].description == 'CAF\xc9 "SIGN"' and rows[0].invoice_date.hour == 8
    assert rows[1].customer_id is None and rows[1].quantity == -1


def test_reviews_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('category,company,description,title,review,stars\nA,b.co,d,t,"line one\nline ""two""",4\n')
    row = readers.read_reviews(spark, f"file:{path}").first()
    assert row.review == 'line one\nline "two"' and row.stars == 4


def test_snapshots_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(
        "experiment_id,variant_id,metric_id,time_since_start,count_c,count_t,mean_c,mean_t,variance_c,variance_t\n"
        "036afc,1,2.0,0.5,10.0,12.0,1.0,2.0,,3.0\n"
    )
    row = readers.read_snapshots(spark, f"file:{path}").first()
    assert (row.experiment_id, row.metric_id, row.variance_c) == ("036afc", 2, None)


def test_tables_documents_and_parameters(spark, tmp_path):
    base = f"file:{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "review_id int, keyword string")
    writers.write_table(df, f"{base}/t")
    writers.write_table(df, f"{base}/t")
    assert spark.read.parquet(f"{base}/t").count() == 2
    writers.write_table(df, f"{base}/t", mode="append")
    assert spark.read.parquet(f"{base}/t").count() == 4
    writers.write_csv(df, f"{base}/c")
    assert spark.read.option("header", True).csv(f"{base}/c").count() == 2
    docs = df.selectExpr("review_id AS _id", "array(keyword) AS keywords")
    writers.write_documents(docs, f"{base}/d")
    assert documents.find_document(spark.read.json(f"{base}/d"), 2).first().keywords == ["b"]
    writers.write_bridges(df, df, df, f"{base}/bridges")
    assert spark.read.parquet(f"{base}/bridges/review_keywords").count() == 2
    writers.save_parameters(spark, {"r": 1.5, "alpha": 2.0}, f"{base}/p")
    assert readers.read_sql(spark, "SELECT max(review_id) AS m FROM {t}", t=df).first().m == 2
    from tillsight.sources.writers import load_parameters

    assert load_parameters(spark, f"{base}/p") == {"r": 1.5, "alpha": 2.0}
    assert readers.peek(df)[0] == [("review_id", "int"), ("keyword", "string")]


def test_jdbc_options_and_tables(spark):
    plain = readers.jdbc_options("jdbc:x", "SELECT 1")
    assert plain == {"url": "jdbc:x", "dbtable": "(SELECT 1) t"}
    split = readers.jdbc_options("jdbc:x", "SELECT id FROM a", "id", (0, 99), 4, fetchsize="10")
    assert split["partitionColumn"] == "id" and split["lowerBound"] == "0" and split["upperBound"] == "99"
    assert split["numPartitions"] == "4" and split["fetchsize"] == "10"
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "SELECT 1", "id")
    options = writers.jdbc_append_options("jdbc:x", "t", 500, user="u")
    assert options == {"url": "jdbc:x", "dbtable": "t", "batchsize": "500", "user": "u"}
    spark.range(1).createOrReplaceTempView("some_rows")
    assert ("some_rows", True) in [tuple(r) for r in readers.list_tables(spark).collect()]


def test_a_rejected_reload_leaves_the_old_table(spark, tmp_path):
    path = f"file:{tmp_path}/orders"
    parents = spark.createDataFrame([(1,), (2,)], "customer int")
    rules = [
        lambda t: quality.unique_key(t, ["id"], "order key"),
        lambda t: quality.references(t, parents, "customer", "customer of an order"),
    ]
    kind = "id int, customer int"
    rows = lambda: sorted(map(tuple, writers.read_published(spark, path).collect()))
    with pytest.raises(FileNotFoundError):
        writers.read_published(spark, path)
    first = writers.publish_table(spark.createDataFrame([(1, 1), (2, None)], kind), path, rules)
    assert rows() == [(1, 1), (2, None)]
    with pytest.raises(writers.RulesBroken) as broken:
        writers.publish_table(spark.createDataFrame([(1, 1), (1, 7), (2, 8)], kind), path, rules)
    assert broken.value.violations == {"order key": 1, "customer of an order": 2}
    assert rows() == [(1, 1), (2, None)]
    assert sorted(p.name for p in (tmp_path / "orders").iterdir()) == ["current", first]


def test_a_reload_that_fails_half_way_leaves_the_old_table(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    kind = "id int, customer int"
    writers.publish_table(spark.createDataFrame([(1, 1)], kind), path)
    failing = spark.range(50, numPartitions=5).selectExpr("CAST(id AS int) id", "IF(id = 49, raise_error('lost'), 1) customer")
    with pytest.raises(Exception, match="lost"):
        writers.publish_table(failing, path)
    assert writers.read_published(spark, path).count() == 1


def test_older_versions_go_when_new_ones_are_published(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    made = [writers.publish_table(spark.range(n), path, keep=1) for n in (1, 2, 3)]
    assert writers.read_published(spark, path).count() == 3
    left = {p.name for p in (tmp_path / "t").iterdir()}
    assert left == {"current", made[1], made[2]}
    again = writers.read_published(spark, path)
    writers.publish_table(again.where("id > 0"), path)
    assert writers.read_published(spark, path).count() == 2 and again.count() == 3
