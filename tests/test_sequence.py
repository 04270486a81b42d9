from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldcounts.operators.sequence import global_sequence


def test_sequence_matches_row_number_after_a_shuffle(spark):
    base = spark.range(0, 20000).select((F.col("id") * 7919 % 20011).alias("k"), (F.col("id") % 7).alias("g"))
    # input order comes out of a shuffle, so it is not deterministic
    shuffled = base.groupBy("k").agg(F.max("g").alias("g"))
    s = global_sequence(shuffled, ["-g", "k"], "seq", num_partitions=5)
    ref = s.withColumn("rn", F.row_number().over(Window.orderBy(F.col("g").desc(), "k")))
    assert ref.filter(F.col("seq") != F.col("rn")).count() == 0
    assert s.agg(F.countDistinct("seq")).first()[0] == shuffled.count()


def test_sequence_nulls_last(spark):
    df = spark.createDataFrame([(None,), (3,), (1,)], "k int")
    got = {r.k: r.seq for r in global_sequence(df, ["k"], "seq", 2).collect()}
    assert got == {1: 1, 3: 2, None: 3}
