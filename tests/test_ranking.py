"""Distributed row numbering equals the window row_number, skewed keys too."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsweave.operators.ranking import distributed_row_number


def test_equals_window_row_number(spark):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(1, 30), rnd.randrange(5), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, size int, id long").repartition(7)
    got = distributed_row_number(df, ["k"], [F.desc("size"), F.asc("id")], "rn")
    w = Window.partitionBy("k").orderBy(F.desc("size"), F.asc("id"))
    want = df.withColumn("rn", F.row_number().over(w).cast("long"))
    assert sorted(got.select("k", "id", "rn").collect()) == sorted(want.select("k", "id", "rn").collect())
