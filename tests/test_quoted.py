import random
from collections import Counter

import pytest
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tillsight.sources import quoted

SCHEMA = StructType(
    [StructField("a", StringType()), StructField("b", IntegerType()), StructField("c", StringType()), StructField("d", DoubleType())]
)


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def csv_text(rng, rows, end):
    parts = ["x", "é", ",", '""', "\n", "\r\n", "日本", " ", "word", "\n\n", '"",""']
    lines = ["a,b,c,d"]
    for i in range(rows):
        long = '"' + "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 10, 80]))) + '"'
        plain = rng.choice(["", "plain", "two words", '"q"'])
        lines.append(rng.choice([f"{long},{i},{plain},{i}.5", f"{plain},,{long},", f'"{i}",{i},{plain},1e3']))
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + rng.choice(["", end])


def plain_reader(spark, path):
    return spark.read.schema(SCHEMA).options(header=True, multiLine=True, quote='"', escape='"').csv(path)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n"), (4, "\n")])
def test_rows_equal_those_of_the_reader_that_cannot_split(spark, tmp_path, small_ranges, seed, end):
    rng = random.Random(seed)
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(csv_text(rng, rng.choice([1, 60]), end).encode())
    path = f"file:{tmp_path}"
    got = quoted.read_quoted_csv(spark, path, SCHEMA)
    assert got.schema == SCHEMA
    assert quoted.lines_of(spark, path).rdd.getNumPartitions() > 3
    states = quoted.quote_state(quoted.lines_of(spark, path)).collect()
    assert len(states) > 3 and any(s.inside for s in states)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain_reader(spark, path).collect()))


@pytest.mark.parametrize("shift", range(0, 12))
def test_quotes_and_line_breaks_on_the_border_of_a_range(spark, tmp_path, small_ranges, shift):
    text = "a,b,c,d\n" + "p" * (80 + shift) + ',1,"q""r\ns\n""",2.0\n"' + "\n" * 250 + '",3,z,4.0\n'
    (tmp_path / "f.csv").write_text(text)
    got = quoted.read_quoted_csv(spark, f"file:{tmp_path}", SCHEMA).collect()
    assert sorted(map(tuple, got)) == sorted([("p" * (80 + shift), 1, 'q"r\ns\n"', 2.0), ("\n" * 250, 3, "z", 4.0)])


def test_a_header_across_ranges_and_files_without_rows(spark, tmp_path, small_ranges):
    (tmp_path / "long.csv").write_text('"a' + "\n" * 200 + '",b,c,d\nx,1,y,2.0\n')
    (tmp_path / "header.csv").write_text("a,b,c,d\n")
    (tmp_path / "empty.csv").write_text("")
    got = quoted.read_quoted_csv(spark, f"file:{tmp_path}", SCHEMA).collect()
    assert list(map(tuple, got)) == [("x", 1, "y", 2.0)]
    every = quoted.read_quoted_csv(spark, f"file:{tmp_path}/header.csv", SCHEMA, header=False)
    assert [r.a for r in every.collect()] == ["a"]


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b,c,d\n"x,1,y,2.0\n')
    with pytest.raises(ValueError, match="inside quotes"):
        quoted.read_quoted_csv(spark, f"file:{tmp_path}", SCHEMA)
