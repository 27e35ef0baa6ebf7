import time
from pathlib import Path

from pyspark.sql import functions as F

from corvane.llm.common import _CLEAR, keep


def test_shuffles_of_what_is_kept_are_deleted(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p for f in folders for p in Path(f).rglob("shuffle_*")}
    old, setting = files(), spark.conf.get(_CLEAR)
    kept = keep(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.2)
    assert not files() - old
    assert kept.count() == 100 and kept.agg(F.sum("count")).first()[0] == 10_000
    assert spark.conf.get(_CLEAR) == setting
