import math

from pyspark.sql import functions as F

from cladewright.functions.sequences import log_sum_exp

GROUPS = {
    "far": [-1000.0, -1001.0, -1000.5],
    "large": [800.0, 799.0],
    "one": [-3.0],
    "mixed": [float("-inf"), -2.0, None],
    "impossible": [float("-inf"), float("-inf")],
    None: [0.0, 0.0],
    "nothing": [None],
}


def direct(values):
    values = [v for v in values if v is not None]
    if not values or max(values) == float("-inf"):
        return max(values, default=None)
    return max(values) + math.log(math.fsum(math.exp(v - max(values)) for v in values))


def test_log_sum_exp(spark):
    rows = [(g, x) for g, xs in GROUPS.items() for x in xs]
    got = spark.createDataFrame(rows, "g string, x double").withColumn("y", log_sum_exp(F.col("x"), "g")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = direct(GROUPS[r.g])
        assert r.y == want or math.isclose(r.y, want, rel_tol=1e-12)
