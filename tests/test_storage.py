"""Results written to the shared folder."""

from pyspark.sql import functions as F

from newsloom import storage


def test_no_shuffle_stays_behind_a_result(spark):
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = spark.conf.get(storage.CLEANUP)
    first = kept.size()
    rows = storage.materialize(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts", free=False)
    assert kept.size() <= first and rows.count() == 7
    assert spark.conf.get(storage.CLEANUP) == before
