from __future__ import annotations

import time

from pyspark.sql import functions as F

from codeveritas import session


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    conf = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 97).repartition(5, "k")
    kept = session.write_and_read(rows.groupBy("k").agg(F.sum("id").alias("n")), "sums")
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) == conf
    # Spark removes them a moment after the end of the execution; the frame itself can be run again.
    end = time.time() + 20
    while (left := {f for f in shuffle_files(spark) if f.endswith(".data")} - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert kept.count() == 97 and rows.count() == 20_000
