"""Two-level scans equal single ordered windows, for any bucketing."""

import random

from pyspark.sql import functions as F

from shardwright.operators.ordering import prefix_agg, prefix_aggs, previous_row


def rows(n=300, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice([1, 2]), i, rnd.randint(-50, 50)) for i in range(n)]


def test_previous_row_across_buckets(spark):
    data = rows()
    df = spark.createDataFrame(data, "g long, o long, v long").withColumn("b", F.floor(F.col("o") / 17))
    got = {(r["g"], r["o"]): r["prev_v"] for r in previous_row(df, ["v"], ["o"], "b", ["g"]).collect()}
    last = {}
    for g, o, v in data:
        assert got[(g, o)] == last.get(g)
        last[g] = v


def test_prefix_aggs_match_running_values(spark):
    data = rows(seed=2)
    df = spark.createDataFrame(data, "g long, o long, v long").withColumn("b", F.floor(F.col("o") / 23))
    out = prefix_aggs(df, [("s", "v", "sum", True), ("mn", "v", "min", False), ("mx", "v", "max", True)],
                      ["o"], "b", ["g"]).collect()
    got = {(r["g"], r["o"]): (r["s"], r["mn"], r["mx"]) for r in out}
    state = {}
    for g, o, v in data:
        s, mn, mx = state.get(g, (0, None, None))
        assert got[(g, o)] == (s + v, mn, v if mx is None else max(mx, v))
        state[g] = (s + v, v if mn is None else min(mn, v), v if mx is None else max(mx, v))
    single = {(r["g"], r["o"]): r["s"] for r in prefix_agg(df, "v", ["o"], "b", "s", ["g"], how="sum").collect()}
    assert single == {k: v[0] for k, v in got.items()}
