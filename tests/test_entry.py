import pytest

from tillsight.sources import staging


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    master = "spark://head:7077"

    def getConf(self):
        return _Conf()


class _Session:
    conf = _Conf()
    sparkContext = _Context()


def test_staging_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(_Session())


def test_clear_staged_removes_what_was_staged(spark):
    kept = staging.materialize(spark.range(3))
    path = kept.inputFiles()[0]
    assert "tillsight-stage-" in path and kept.count() == 3
    assert staging.clear_staged(spark)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        spark.read.parquet(path).count()


def test_entry_lists_unique_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
