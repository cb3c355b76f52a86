"""What the corpus operators share."""

from __future__ import annotations

import time

from tidewell.llm import common


def shuffle_files(spark) -> set[str]:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split(" ") if b.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    """At once, while Python still holds the table that was written, and no matter when a heap is collected."""
    before = shuffle_files(spark)
    df = spark.range(1000).repartition(3).selectExpr("id % 7 AS k").groupBy("k").count()
    out = common.materialize(df, "test")
    end = time.time() + 10
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == "false"
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect())) and df.count() == 7
    common.discard(out)
