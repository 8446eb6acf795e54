"""Cross-entropy, validation summaries, task accuracy, lists and limits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shardwright.functions.columns import parse_list, parse_list_py, select_accuracy, softcap
from shardwright.operators import evaluate as ev


def test_cross_entropy_matches_formula(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-5, 5) for _ in range(17)], rnd.randrange(17)) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, logits array<double>, target int")
    got = {r["vec_id"]: r["loss"] for r in ev.cross_entropy(df).collect()}
    for i, z, t in rows:
        m = max(z)
        assert got[i] == pytest.approx(m + math.log(sum(math.exp(x - m) for x in z)) - z[t], rel=1e-12)


def test_ignored_targets_leave_the_mean(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 1.0], 1), (1, 0, [0.0, 1.0], -1)],
                               "vec_id long, seq_index long, logits array<double>, target int")
    s = ev.sequence_loss(ev.cross_entropy(df)).first()
    assert s["n_tokens"] == 1 and s["seq_loss"] == pytest.approx(math.log(1 + math.e) - 1)


def test_full_validation(spark):
    seqs = spark.createDataFrame([(0, 2.0, 4), (1, 4.0, 4)], "seq_index long, seq_loss double, n_tokens long")
    v = ev.full_validation(seqs, 4).first()
    assert v["loss"] == 3.0 and v["perplexity"] == pytest.approx(math.exp(3.0)) and v["tokens"] == 8
    empty = spark.createDataFrame([], "seq_index long, seq_loss double, n_tokens long")
    with pytest.raises(Exception):
        ev.full_validation(empty, 4).collect()


def test_softcap(spark):
    df = spark.createDataFrame([([30.0, -30.0, 0.0],)], "z array<double>")
    got = df.select(softcap("z", 15.0).alias("c")).first()["c"]
    assert got == pytest.approx([15 * math.tanh(2), -15 * math.tanh(2), 0.0])
    assert df.select(softcap("z", 0.0).alias("c")).first()["c"] == [30.0, -30.0, 0.0]


def test_task_list():
    assert parse_list_py(" arc_easy,hellaswag,arc_easy, ") == ["arc_easy", "hellaswag"]
    with pytest.raises(ValueError):
        parse_list_py(" , ")


def test_task_list_column(spark):
    df = spark.createDataFrame([(" arc_easy,hellaswag,arc_easy, ",)], "t string")
    assert df.select(parse_list("t").alias("l")).first()["l"] == ["arc_easy", "hellaswag"]
    bad = spark.createDataFrame([(" , ",)], "t string")
    with pytest.raises(Exception):
        bad.select(parse_list("t")).collect()


def test_select_accuracy(spark):
    df = spark.createDataFrame([({"acc,none": 0.0, "acc_norm,none": 0.5},), ({"acc_norm,none": 0.4},), ({"x": 1.0},)],
                               "m map<string,double>")
    assert [r["a"] for r in df.select(select_accuracy("m").alias("a")).collect()] == [0.0, 0.4, None]


def test_choice_accuracy_tie_takes_lowest(spark):
    rows = [("t", 0, 0, -1.0, 1, 0), ("t", 0, 1, -1.0, 1, 0), ("t", 1, 0, -2.0, 10, 1), ("t", 1, 1, -1.0, 1, 1)]
    df = spark.createDataFrame(rows, "task string, item_id long, choice int, loglik double, n_bytes int, gold int")
    r = ev.choice_accuracy(df).first()
    assert r["acc"] == 1.0 and r["acc_norm"] == 0.5


def test_limit_per_group(spark):
    df = spark.range(10).select(F.lit("a").alias("task"), F.col("id").alias("item_id"))
    assert ev.limit_per_group(df, ["task"], ["item_id"], 3).count() == 3
    assert ev.limit_per_group(df, ["task"], ["item_id"], 0).count() == 10
    with pytest.raises(ValueError):
        ev.limit_per_group(df, ["task"], ["item_id"], -1)
