"""Tables on the way to a result."""

import pytest

from tessera.sources import scratch


def test_stored_tables_are_told_apart_and_removed(spark):
    with scratch.scope() as made:
        one, two = scratch.stored(spark.range(5).toDF("n"), "test"), scratch.stored(spark.range(7).toDF("n"), "test")
        assert made == [one, two] and (one.count(), two.count()) == (5, 7) and ":/" in one.stored_at
    three = scratch.stored(spark.range(3).toDF("n"), "test")
    assert made == [one, two]
    scratch.removed(one, two, one)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(one.stored_at)
    assert three.count() == 3


def test_clusters_must_name_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_root(Session())
