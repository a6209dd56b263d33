"""Explicit schemas of the raw inputs."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


def _schema(*fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


SNAPSHOTS = _schema(
    ("experiment_id", StringType()),
    ("variant_id", IntegerType()),
    ("metric_id", IntegerType()),
    ("time_since_start", DoubleType()),
    ("count_c", DoubleType()),
    ("count_t", DoubleType()),
    ("mean_c", DoubleType()),
    ("mean_t", DoubleType()),
    ("variance_c", DoubleType()),
    ("variance_t", DoubleType()),
)

# Published header -> column name, in file order.
TRANSACTION_HEADERS = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}
TRANSACTIONS_FILE = _schema(
    ("Invoice", StringType()),
    ("StockCode", StringType()),
    ("Description", StringType()),
    ("Quantity", IntegerType()),
    ("InvoiceDate", StringType()),
    ("Price", DoubleType()),
    ("Customer ID", DoubleType()),
    ("Country", StringType()),
)

REVIEWS = _schema(
    ("category", StringType()),
    ("company", StringType()),
    ("description", StringType()),
    ("title", StringType()),
    ("review", StringType()),
    ("stars", IntegerType()),
)
