"""Order-sensitive identity of two tables."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldcounts.functions.nullsafe import arrange
from fieldcounts.operators import identity as I

P = I.PRIME


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, P - 1), st.integers(0, P - 1)), min_size=1, max_size=20))
def test_products_modulo_the_prime(pairs):
    a, b = (np.array(c, dtype=np.uint64) for c in zip(*pairs))
    assert I.times(a, b).tolist() == [x * y % P for x, y in pairs]


def test_polynomial_does_not_depend_on_cuts():
    h = np.random.default_rng(1).integers(0, 2 ** 63, 20_000).astype(np.uint64)
    whole = 0
    for x in h.tolist():
        whole = (whole * I.BASES[0] + x) % P
    assert I.folded(h, 0) == whole
    for cut in (0, 1, I.STEP, 19_999):
        left, right = I.folded(h[:cut], 0), I.folded(h[cut:], 0)
        assert (left * pow(I.BASES[0], len(h) - cut, P) + right) % P == whole
        assert I.folded(h[cut:], 0, left) == whole


def verdict(a, b):
    rows = I.tables_identical(a, b).collect()
    assert len(rows) == 1
    return tuple(rows[0])


def test_identity_sees_order_nulls_and_types(spark):
    rows = [(k, None if k % 7 == 0 else f"t{k % 5}", k / 4) for k in range(3000)]
    kind = "k long, t string, v double"
    a = spark.createDataFrame(rows, kind)
    assert verdict(a, spark.createDataFrame(rows, kind).coalesce(1)) == (True, 3000, 3000, True)
    assert verdict(arrange(a, "t", "-k"), arrange(a.repartition(5), "t", "-k")) == (True, 3000, 3000, True)
    swapped = list(rows)
    swapped[1500], swapped[1501] = swapped[1501], swapped[1500]
    assert verdict(a, spark.createDataFrame(swapped, kind)) == (True, 3000, 3000, False)
    assert verdict(a, a.limit(2999)) == (True, 3000, 2999, False)
    assert verdict(a, a.withColumn("v", F.col("v") + 0.25)) == (True, 3000, 3000, False)
    assert verdict(a, a.withColumn("k", F.col("k").cast("int")))[0] is False
    assert verdict(a, a.select("t", "k", "v"))[3] is False
    # a value that moves into a neighbouring NULL's column
    x, y = (spark.createDataFrame([r], "a long, b long, m map<string,int>") for r in ((None, 5, {}), (5, None, {})))
    assert verdict(x, y) == (True, 1, 1, False)


def test_empty_tables(spark):
    a = spark.createDataFrame([(1,)], "k long")
    assert verdict(a.limit(0), a.filter("k > 1")) == (True, 0, 0, True)
    assert verdict(a, a.limit(0)) == (True, 1, 0, False)


def test_no_table_is_shuffled(spark):
    a = spark.range(10_000).withColumn("v", F.col("id") % 7)
    plan = I.ordered_digest(a)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below.split("Range")[0].split("Union")[-1]
