from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernlab import session
from quernlab.operators import skew


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_join(spark, how):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 700).alias("k"), "id")
    one = spark.range(600).select((F.col("id") % 400).alias("k"), F.col("id").alias("x"))
    plain = Counter(map(tuple, many.join(one, "k", how).select("k", "id", "x").collect()))
    assert Counter(map(tuple, skew.spread_join(many, one, "k", how, part=100).select("k", "id", "x").collect())) == plain
    assert skew.spread_join(many.limit(0), one, "k", how).count() == 0
    assert skew.spread_join(many, one.limit(0), ["k"], how, part=100).count() == (3000 if how == "left" else 0)


def test_hot_keys_are_few(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in skew.hot_keys(many, ["k"], 100).collect()] == [(0, 10)]


def test_tables_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    kept = session.materialise(spark.range(5))
    assert kept.count() == 5 and len(list(tmp_path.iterdir())) == 1
    session.discard(kept)
    assert not list(tmp_path.iterdir())
    session.discard(spark.range(1))


def test_a_cluster_must_name_its_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: "")

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Cluster)


def test_wide_tables_use_every_core(spark, small):
    assert session.table(spark, small, "pairs", wide=True).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(10).distinct()).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
