"""Candidate filters and the decoding policy on one- and two-row tables."""

import pytest
from pyspark.sql import functions as F

from shardwright.config import DecodeConfig
from shardwright.operators import candidates as C


def scores(spark, vals, ctx=0):
    return spark.createDataFrame([(ctx, i, float(v)) for i, v in enumerate(vals)], "ctx_id long, cand_id long, score double")


def hist(spark, ids, ctx=0):
    return spark.createDataFrame([(ctx, ids)], "ctx_id long, ids array<int>")


def ids(df):
    return sorted(r["cand_id"] for r in df.collect())


def test_top_k(spark):
    assert ids(C.top_k(scores(spark, [1, 4, 3, 2]), 2)) == [1, 2]
    assert ids(C.top_k(scores(spark, [5, 5, 5, 3]), 2)) == [0, 1, 2]


def test_repetition_penalty(spark):
    out = C.repetition_penalty(scores(spark, [1, 4, 3]), hist(spark, [1, 1]), 2.0)
    assert [r["score"] for r in out.orderBy("cand_id").collect()] == [1.0, 2.0, 3.0]
    neg = C.repetition_penalty(scores(spark, [-1.0]), hist(spark, [0]), 2.0)
    assert neg.first()["score"] == -2.0


def test_ngram_ban(spark):
    b = C.banned_continuations(hist(spark, [1, 2, 3, 1, 2]), 3)
    assert sorted(r["cand_id"] for r in b.collect()) == [3]
    assert C.banned_continuations(hist(spark, [4, 5, 6, 4, 7]), 3).count() == 0
    assert sorted(r["cand_id"] for r in C.banned_continuations(hist(spark, [4, 5, 4]), 1).collect()) == [4, 5]
    assert C.banned_continuations(hist(spark, [1]), 3).count() == 0


def test_greedy_with_ban(spark):
    cfg = DecodeConfig(greedy=True, no_repeat_ngram_size=3, temperature=0.0)
    got = C.decode_policy(scores(spark, [0, 1, 2, 10]), hist(spark, [1, 2, 3, 1, 2]), cfg).first()["choice"]
    assert got == 2
    cfg0 = DecodeConfig(greedy=True, temperature=0.0)
    assert C.decode_policy(scores(spark, [0, 4, 1]), hist(spark, []), cfg0).first()["choice"] == 1


def test_top_p_keeps_crossing_candidate(spark):
    df = scores(spark, [0.0, 0.0, 0.0]).withColumn("score", F.log(F.array(F.lit(.5), F.lit(.3), F.lit(.2))[F.col("cand_id")]))
    assert ids(C.top_p(df, 0.6)) == [0, 1]


def test_min_p(spark):
    import math

    df = scores(spark, [math.log(0.5), math.log(0.3), math.log(0.02)])
    assert ids(C.min_p(df, 0.1)) == [0, 1]


def test_seeded_sample_is_reproducible(spark):
    s = C.softmax(scores(spark, [0.1, 0.2, 0.3, 0.4]))
    a = C.sample(C.replicate(s, 20), 7, sample_col="sample").orderBy("sample").collect()
    b = C.sample(C.replicate(s, 20), 7, sample_col="sample").orderBy("sample").collect()
    assert a == b and len({r["choice"] for r in a}) > 1


def test_sample_law(spark):
    import math

    probs = [0.1, 0.2, 0.7]
    s = C.softmax(scores(spark, [math.log(p) for p in probs]))
    draws = C.sample(C.replicate(s, 4000), 3, sample_col="sample")
    freq = {r["choice"]: r["count"] / 4000 for r in draws.groupBy("choice").count().collect()}
    for i, p in enumerate(probs):
        assert abs(freq.get(i, 0) - p) < 0.03


def test_selector_output_is_checked(spark):
    df = scores(spark, [0.1, 0.9])
    assert C.apply_selector(df, lambda p: int(p["score"].idxmax()), 2).first()["choice"] == 1
    with pytest.raises(Exception):
        C.apply_selector(df, lambda p: 5, 2).collect()


def test_batched_selector(spark):
    df = spark.createDataFrame([(c, i, float((c * 7 + i * 3) % 5)) for c in range(40) for i in range(4)], "ctx_id long, cand_id long, score double")
    best = lambda p: p.sort_values(["score", "cand_id"], ascending=[False, True]).drop_duplicates("ctx_id").set_index("ctx_id")["cand_id"]
    got = {r["ctx_id"]: r["choice"] for r in C.apply_selector(df, best, 4, batched=True, contexts_per_batch=8).collect()}
    assert got == {r["ctx_id"]: r["choice"] for r in C.argmax(df).collect()} and len(got) == 40
    with pytest.raises(Exception, match="every context"):
        C.apply_selector(df, lambda p: best(p).iloc[1:], 4, batched=True).collect()


def test_context_with_every_candidate_banned_keeps_its_row(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 1, 1.0), (1, 9, 0.0)], "ctx_id long, cand_id long, score double")
    h = spark.createDataFrame([(0, [1, 2]), (1, [1, 2])], "ctx_id long, ids array<int>")
    for cfg in (DecodeConfig(greedy=True, no_repeat_ngram_size=1), DecodeConfig(no_repeat_ngram_size=1)):
        assert {r["ctx_id"]: r["choice"] for r in C.decode_policy(df, h, cfg).collect()} == {0: None, 1: 9}


def test_config_bounds():
    with pytest.raises(ValueError):
        DecodeConfig(temperature=0.0)
    with pytest.raises(ValueError):
        DecodeConfig(top_p=0.0)
    with pytest.raises(ValueError):
        DecodeConfig(top_k=-1)


def test_policy_over_a_wide_vocabulary(spark):
    """50,000 candidates a context, next to a history of thousands of ids."""
    import time

    n = 50_000
    scores = spark.range(3).withColumnRenamed("id", "ctx_id").select("ctx_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cand_id")).select(
        "ctx_id", F.col("cand_id").cast("long").alias("cand_id"), (F.pmod(F.xxhash64("ctx_id", "cand_id"), F.lit(1000)) / 100.0).alias("score"))
    history = spark.createDataFrame([(0, [i * 7 % n for i in range(4000)] + [1, 2, 9, 1, 2]), (1, []), (2, None)], "ctx_id long, ids array<int>")
    began = time.time()
    from shardwright.config import DecodeConfig
    from shardwright.operators.candidates import decode_policy

    got = {r["ctx_id"]: r["choice"] for r in decode_policy(scores, history, DecodeConfig(greedy=True, repetition_penalty=2.0, no_repeat_ngram_size=3)).collect()}
    assert time.time() - began < 60
    rows = scores.collect()
    seen, banned = {i * 7 % n for i in range(4000)} | {1, 2, 9}, {9}
    for ctx in range(3):
        s = {r["cand_id"]: r["score"] / (2.0 if ctx == 0 and r["cand_id"] in seen else 1.0) for r in rows
             if r["ctx_id"] == ctx and not (ctx == 0 and r["cand_id"] in banned)}
        assert got[ctx] == min(s, key=lambda c: (-s[c], c))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_history_facts_by_definition(spark, monkeypatch, n):
    import random

    from shardwright.operators import candidates as C

    monkeypatch.setattr(C, "FACT_IDS", 10)
    rnd = random.Random(n)
    rows = [(i, [rnd.randint(0, 3) for _ in range(rnd.randint(0, 12))]) for i in range(60)] + [(60, None), (61, [])]
    got = {(r["ctx_id"], r["cand_id"]): r["_ban"] for r in C.history_facts(spark.createDataFrame(rows, "ctx_id long, ids array<int>"), n).collect()}
    want = {}
    for c, h in rows:
        for x in set(h or []):
            want[c, x] = n > 0 and len(h) >= n and any(h[i + n - 1] == x and h[i:i + n - 1] == h[len(h) - n + 1:] for i in range(len(h) - n + 1))
    assert got == want
