"""Lineage cuts leave nothing behind but the checkpoint."""

import os
import time

from pyspark.sql import functions as F

from docsieve.session import CLEANUP, cut


def shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_cut_deletes_its_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    done = cut(counts.join(counts.withColumnRenamed("n", "m"), "k").groupBy("n").agg(F.sum("m").alias("m")))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP) == setting
    # neither the cut table nor the one it was made from depends on them
    assert sorted(map(tuple, done.collect())) == [(142, 142), (143, 858)]
    assert counts.agg(F.sum("n")).first()[0] == 1000
