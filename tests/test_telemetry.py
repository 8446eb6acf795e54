"""Rolling rate, ETA, interval means, best-so-far, held values, throttle, text."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwright.functions.columns import format_rate, run_name
from shardwright.operators import telemetry as tl


def counters(spark, samples, run=1):
    rows = [(run, i, int(t * 1e6), float(u)) for i, (t, u) in enumerate(samples)]
    return spark.createDataFrame(rows, "run_id long, seq long, us long, units double")


def rates(spark, samples, window=10.0, block_us=None):
    df = tl.rolling_rate(counters(spark, samples), window, block_us=block_us)
    return [r["rate"] for r in df.orderBy("seq").collect()]


def test_rolling_rate(spark):
    assert rates(spark, [(0, 100), (2, 140), (22, 240)]) == [0.0, 20.0, 5.0]


def test_rolling_rate_rewind(spark):
    assert rates(spark, [(0, 100), (2, 120), (3, 5)]) == [0.0, 10.0, 0.0]


def meter(samples, window):
    """The rate by its definition: every sample against all earlier ones."""
    out = []
    for i, (t, u) in enumerate(samples):
        earlier = [k for k in range(i) if all(samples[j][1] <= samples[j + 1][1] for j in range(k, i))]
        inside = [k for k in earlier if samples[k][0] >= t - window]
        against = min(inside) if inside else max(earlier, default=i)
        span = t - samples[against][0]
        out.append(max(0.0, u - samples[against][1]) / span if span > 0 else 0.0)
    return out


def test_rolling_rate_matches_sequential_meter_across_blocks(spark):
    rnd = random.Random(5)
    t, u, s = 0.0, 0.0, []
    for _ in range(300):
        t += rnd.choice([0.5, 1, 3, 12, 40])
        u = u + rnd.randint(0, 9) if rnd.random() > 0.05 else rnd.randint(0, 5)
        s.append((t, u))
    got = rates(spark, s, 10.0, block_us=25_000_000)
    assert got == pytest.approx(meter(s, 10.0))


def test_eta_and_throughput(spark):
    # 240 tokens per step; steps 4 at 0 s and 6 at 2 s → 1 step/s; 14 steps left
    df = counters(spark, [(0, 4), (2, 6)])
    r = tl.eta(tl.rolling_rate(df, 30.0), 20).orderBy("seq").collect()[-1]
    assert r["rate"] == 1.0 and r["rate"] * 240 == 240.0 and r["eta_s"] == 14
    df2 = counters(spark, [(0, 100), (2, 300)])
    r2 = tl.eta(tl.rolling_rate(df2, 30.0), 1000).orderBy("seq").collect()[-1]
    assert r2["rate"] == 100.0 and r2["eta_s"] == 7


def test_counter_audit(spark):
    rows = [(1, 0, 0, 100.0, 0.0), (1, 1, 1, 150.0, 40.0), (1, 2, 2, 120.0, -30.0)]
    df = spark.createDataFrame(rows, "run_id long, seq long, us long, units double, added double")
    rules = sorted((r["seq"], r["rule"]) for r in tl.audit_counters(df).collect())
    assert rules == [(1, "delta_mismatch"), (2, "backwards"), (2, "negative_delta")]


def log(spark, rows):
    return spark.createDataFrame(
        [(1, s, s * 1_000_000, tr, dv, ev) for s, tr, dv, ev in rows],
        "run_id long, step long, us long, train_loss double, dev_loss double, is_eval boolean")


def test_interval_average_and_best(spark):
    rows = [(1, 4.0, None, False), (2, 2.0, None, False), (3, 3.0, 2.5, True),
            (4, 5.0, None, False), (5, 1.0, 2.8, True)]
    t = tl.training_log(log(spark, rows)).filter("is_eval").orderBy("step").collect()
    assert [r["average_train_loss"] for r in t] == [3.0, 3.0]
    assert [r["best_dev_loss"] for r in t] == [2.5, 2.5]
    assert t[-1]["best_average_train_loss"] == 3.0


def test_interval_average_skips_non_finite(spark):
    rows = [(1, float("nan"), None, False), (2, float("inf"), None, False), (3, 4.0, 1.0, True),
            (4, float("nan"), None, False), (5, float("nan"), 2.0, True)]
    t = tl.training_log(log(spark, rows)).filter("is_eval").orderBy("step").collect()
    assert t[0]["average_train_loss"] == 4.0
    assert math.isnan(t[1]["average_train_loss"])     # only non-finite: the evaluation's own loss


def test_hold_last(spark):
    rows = [(1, 3.0, None, False), (2, 3.0, 2.75, True), (3, 3.0, None, False), (4, 3.0, None, False)]
    t = tl.training_log(log(spark, rows)).orderBy("step").collect()
    assert [r["held_dev_loss"] for r in t if not r["is_eval"]] == [None, 2.75, 2.75]


def test_run_summary(spark):
    rows = [(1, 3.0, None, False), (2, 3.0, 2.5, True), (3, 2.0, 2.8, True)]
    s = tl.run_summary(log(spark, rows), 2 * 3 * 10 * 4, 20).first()
    assert s["latest_dev_loss"] == 2.8 and s["best_dev_loss"] == 2.5 and s["evaluations"] == 2
    assert s["tokens_processed"] == 3 * 240


def test_format_rate(spark):
    vals = [0.0, -1.0, float("nan"), float("inf"), 1500.0, 2.5e6, 3e9]
    df = spark.createDataFrame([(v,) for v in vals], "r double").select(format_rate("r", "tok").alias("t"))
    assert [r["t"] for r in df.collect()] == ["— tok/s"] * 4 + ["1.5k tok/s", "2.50M tok/s", "3.00G tok/s"]


def test_run_name(spark):
    df = spark.createDataFrame([("fresh",), ("continue",)], "m string").withColumn(
        "ts", F.lit("2026-08-06 19:33:56").cast("timestamp"))
    got = [r["n"] for r in df.select(run_name("m", "ts", "pretraining").alias("n")).collect()]
    assert got == ["20260806-193356-pretraining", "pretraining"]


def gate(samples, gap, target):
    out, last = [], None
    for i, (t, u) in enumerate(samples):
        if last is None or t - last >= gap or (target is not None and u >= target):
            out.append(i)
            last = t
    return out


@pytest.mark.parametrize("target", [None, 60])
def test_throttle_matches_greedy(spark, target):
    rnd = random.Random(11)
    t, s = 0.0, []
    for i in range(200):
        t += rnd.choice([0.1, 0.2, 0.3, 0.7, 2.0])
        s.append((round(t, 3), float(i % 70)))
    df = counters(spark, s)
    for blocks in (1, 2, 7, 1024):                 # blocks of so many gaps
        got = sorted(r["seq"] for r in tl.throttle(df, 0.5, target, block_gaps=blocks).collect())
        assert got == gate(s, 0.5, target)


def test_streaming_rate_equals_batch(spark, tmpdir_path):
    from shardwright.streaming.telemetry import rolling_rate_stream, throttle_stream

    samples = [(0, 100), (2, 140), (22, 240), (23, 5), (24, 25)]
    import glob
    import os

    df = counters(spark, samples)
    src = f"{tmpdir_path}/in"
    # one file per sample, in time order (a live log arrives in order)
    for i, row in enumerate(df.orderBy("seq").collect()):
        spark.createDataFrame([row], df.schema).coalesce(1).write.mode("append").parquet(src)
        for f in glob.glob(f"{src}/part-*.parquet"):
            if not os.path.exists(f + ".seen"):
                os.utime(f, (1_000_000 + i, 1_000_000 + i))
                open(f + ".seen", "w").close()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
        "pathGlobFilter", "*.parquet").parquet(src)
    q = (rolling_rate_stream(stream, 10.0).writeStream.format("memory").queryName("rr_test")
         .outputMode("append").option("checkpointLocation", f"{tmpdir_path}/ck").start())
    q.processAllAvailable()
    q.stop()
    got = [r["rate"] for r in spark.sql("select * from rr_test order by seq").collect()]
    assert got == rates(spark, samples)
    q2 = (throttle_stream(stream, 10.0).writeStream.format("memory").queryName("th_test")
          .outputMode("append").option("checkpointLocation", f"{tmpdir_path}/ck2").start())
    q2.processAllAvailable()
    q2.stop()
    got2 = [r["seq"] for r in spark.sql("select * from th_test order by seq").collect()]
    assert got2 == gate(samples, 10.0, None)


@pytest.mark.parametrize("cuts", [(), (1,), (40, 41, 90), tuple(range(1, 150))])
def test_live_meters_agree_for_any_cut(cuts):
    import numpy as np
    import pandas as pd

    from shardwright.streaming import telemetry as live

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, ms):
            assert ms > 0

    rnd = random.Random(31)
    t, u, s = 0.0, 0.0, []
    for _ in range(150):
        t += rnd.choice([0.5, 1, 3, 12, 40])
        u = u + rnd.randint(0, 9) if rnd.random() > 0.05 else float(rnd.randint(0, 5))
        s.append((t, u))
    rows = pd.DataFrame({"run_id": 1, "seq": range(150), "us": [int(t * 1e6) for t, _ in s], "units": [u for _, u in s]})
    parts = [rows.iloc[a:b] for a, b in zip((0, *cuts), (*cuts, 150))]

    class Source:                                            # takes the update function a stream would run
        def groupBy(self, _):
            return self

        def applyInPandasWithState(self, update, *_):
            state = State()
            return pd.concat([out for part in parts for out in update((1,), iter([part]), state)])

    assert live.rolling_rate_stream(Source(), 10.0, idle_ms=1000)["rate"].tolist() == pytest.approx(meter(s, 10.0))
    assert live.throttle_stream(Source(), 5.0, 30)["seq"].tolist() == gate(s, 5.0, 30)
    assert np.array_equal(live.emitted(np.zeros(0, np.int64), np.zeros(0, bool), 5, None), [])


def test_clock_set_back(spark):
    """Steps order the log, whatever the clock says."""
    rows = [(1, 1, 10 ** 12, 2.0, 2.0, True), (1, 2, 0, 1.0, None, False), (1, 3, 10 ** 12 + 5, 7.0, 3.0, True)]
    df = spark.createDataFrame(rows, "run_id long, step long, us long, train_loss double, dev_loss double, is_eval boolean")
    got = {r["step"]: r for r in tl.training_log(df, block_steps=1).collect()}
    assert got[2]["held_dev_loss"] == 2.0
    assert [got[s]["average_train_loss"] for s in (1, 3)] == [2.0, 4.0]


def test_metric_without_a_policy_is_kept(spark):
    m = spark.createDataFrame([(1, 1, "a", 3.0), (1, 2, "a", 1.0), (1, 1, "zzz", 5.0), (1, 2, "zzz", 4.0)], "run_id long, step long, name string, value double")
    pol = spark.createDataFrame([("a", "max")], "name string, policy string")
    assert sorted(map(tuple, tl.summarise(m, pol).collect())) == [(1, "a", "max", 3.0), (1, "zzz", "last", 4.0)]


def test_dense_run_is_throttled_fast(spark):
    """Many rows inside one gap: cost stays near linear."""
    import time

    df = spark.range(60_000).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("seq"), (F.col("id") * 7).alias("us"),
                                    (F.col("id") % 1000).cast("double").alias("units"))
    t0 = time.time()
    got = sorted(r["seq"] for r in tl.throttle(df, 0.1, 999).select("seq").collect())
    assert got == gate([(i * 7 / 1e6, i % 1000) for i in range(60_000)], 0.1, 999) and time.time() - t0 < 120


def test_seed_samples_start_a_meter(spark):
    df = counters(spark, [(5, 200), (6, 230)])
    seeds = spark.createDataFrame([(1, 0, 100.0)], "run_id long, us long, units double")
    got = [r["rate"] for r in tl.rolling_rate(df, 30.0, seeds=seeds).orderBy("seq").collect()]
    assert got == pytest.approx([20.0, 130 / 6])


def plain_log(rows):
    """Sequential reference for held dev loss, interval averages and bests."""
    out, held, acc, n, best_dev, best_avg = {}, None, 0.0, 0, math.inf, math.inf
    for step, tr, dv, ev in rows:
        rec = {"held": held}
        if math.isfinite(tr):
            acc, n = acc + tr, n + 1
        if ev:
            avg = acc / n if n else tr
            acc, n = 0.0, 0
            best_dev = min(best_dev, dv)
            best_avg = min(best_avg, avg)
            rec.update(avg=avg, best_dev=best_dev, best_avg=best_avg)
            held = dv
        out[step] = rec
    return out


def test_training_log_across_blocks_and_runs(spark):
    rnd = random.Random(17)
    rows, ref = [], {}
    for run in (1, 2, 3):
        n = 400 if run == 1 else 40          # one hot run
        seq = []
        for step in range(n):
            ev = rnd.random() < 0.15
            tr = rnd.choice([rnd.uniform(1, 5), float("nan")]) if rnd.random() < 0.1 else rnd.uniform(1, 5)
            dv = rnd.uniform(1, 4) if ev else None
            seq.append((step, tr, dv, ev))
            rows.append((run, step, step * 7_000_000, tr, dv, ev))
        ref[run] = plain_log(seq)
    df = spark.createDataFrame(rows, "run_id long, step long, us long, train_loss double, dev_loss double, is_eval boolean")
    got = tl.training_log(df, block_steps=9).collect()     # ~9 rows per block
    for r in got:
        exp = ref[r["run_id"]][r["step"]]
        assert r["held_dev_loss"] == pytest.approx(exp["held"]) if exp["held"] is not None else r["held_dev_loss"] is None
        if r["is_eval"]:
            assert r["average_train_loss"] == pytest.approx(exp["avg"], nan_ok=True)
            assert r["best_dev_loss"] == pytest.approx(exp["best_dev"])
            assert r["best_average_train_loss"] == pytest.approx(exp["best_avg"])


def test_rolling_rate_interleaved_runs(spark):
    rnd = random.Random(23)
    rows, ref = [], {}
    for run in (1, 2):
        t, u, s = 0.0, 0.0, []
        for i in range(150):
            t += rnd.choice([0.5, 2, 9, 31])
            u = u + rnd.randint(0, 9) if rnd.random() > 0.05 else 0
            s.append((t, u))
            rows.append((run, i, int(t * 1e6), float(u)))
        ref[run] = meter(s, 30.0)
    df = spark.createDataFrame(rows, "run_id long, seq long, us long, units double")
    got = tl.rolling_rate(df, 30.0, block_us=120_000_000).collect()
    for r in got:
        assert r["rate"] == pytest.approx(ref[r["run_id"]][r["seq"]])


# ---------------------------------------------------------------- null runs, clocks, steps and counters
def by_seq(df, *cols):
    return {r["seq"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_a_null_run_is_a_run(spark):
    s = 1_000_000
    rows = [(r, i, i * s, float(10 * i), 10.0) for r in (1, None) for i in range(3)]
    df = spark.createDataFrame([(r, i + (0 if r else 10), us, u, a) for r, i, us, u, a in rows],
                               "run_id long, seq long, us long, units double, added double")
    assert by_seq(tl.rolling_rate(df), "rate") == {0: (0.0,), 1: (10.0,), 2: (10.0,), 10: (0.0,), 11: (10.0,), 12: (10.0,)}
    bad = df.withColumn("added", F.when(F.col("seq") == 12, 3.0).otherwise(F.col("added")))
    assert [(r["run_id"], r["seq"], r["rule"]) for r in tl.audit_counters(bad).collect()] == [(None, 12, "delta_mismatch")]
    assert sorted(r["seq"] for r in tl.throttle(df, 2.0).collect()) == [0, 2, 10, 12]


def test_samples_that_cannot_be_compared_are_kept_and_seen_by_none(spark):
    s = 1_000_000
    rows = [(1, 0, 0, 0.0, 0.0), (1, 1, s, 10.0, 10.0), (1, 2, 2 * s, float("nan"), 1.0), (1, 3, None, 5.0, 1.0), (1, 4, 3 * s, None, 1.0),
            (1, 5, 4 * s, 40.0, 30.0)]
    df = spark.createDataFrame(rows, "run_id long, seq long, us long, units double, added double")
    got = by_seq(tl.rolling_rate(df), "rate", "elapsed_s")
    assert got == {0: (0.0, 0.0), 1: (10.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (10.0, 4.0)}
    assert sorted((r["seq"], r["rule"]) for r in tl.audit_counters(df).collect()) == [(2, "missing"), (3, "missing"), (4, "missing")]
    assert sorted(r["seq"] for r in tl.throttle(df, 2.0, 40.0).collect()) == [0, 2, 5]


def test_training_log_keeps_null_runs_and_steps(spark):
    rows = [(None, 1, 4.0, None, False), (None, 2, 2.0, 2.5, True), (7, None, 9.0, None, False), (7, 1, 1.0, 3.0, True)]
    df = spark.createDataFrame([(r, s, 0, a, b, e) for r, s, a, b, e in rows],
                               "run_id long, step long, us long, train_loss double, dev_loss double, is_eval boolean")
    got = sorted(((r["run_id"] or 0, r["step"] or 0, r["interval"], r["average_train_loss"], r["best_dev_loss"]) for r in tl.training_log(df).collect()), key=str)
    assert got == [(0, 1, 0, None, None), (0, 2, 0, 3.0, 2.5), (7, 0, 0, None, None), (7, 1, 0, 5.0, 3.0)]


# ---------------------------------------------------------------- the throttle as composed jumps
def greedy(rows, gap, target):
    out, last = [], {}
    for run, seq, us, units in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        due = target is not None and units is not None and units == units and units >= target
        if run not in last or us >= last[run] + gap or due:
            last[run] = us
            out.append(seq)
    return sorted(out)


@pytest.mark.parametrize("target", [None, 95.0])
def test_throttle_in_small_blocks(spark, monkeypatch, target):
    from shardwright.operators import throttle as th

    monkeypatch.setattr(th, "EVENTS", 6)
    monkeypatch.setattr(th, "GROUP", 3)
    rnd = random.Random(4)
    rows, seq = [], 0
    for run, n, spread in ((1, 400, 40), (2, 120, 3000), (None, 60, 9), (3, 150, 0), (4, 1, 1)):   # run 3: one clock value
        for _ in range(n):
            rows.append((run, seq, rnd.randint(0, spread) * 100_000, rnd.random() * 100))
            seq += 1
    rows += [(5, seq + i, i * 1_700_000 + (i % 3) * 100_000, float("nan") if i % 5 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "run_id long, seq long, us long, units double").repartition(5)
    for gap in (0.3, 5.0):
        assert sorted(r["seq"] for r in th.throttle(df, gap, target).collect()) == greedy(rows, int(gap * 1_000_000), target)


def test_jump_tables_compose_as_the_walk_does():
    from shardwright.operators import throttle as th

    rng = np.random.default_rng(8)
    for trial in range(200):
        us = np.unique(rng.integers(0, 200, int(rng.integers(2, 60))))
        due = rng.random(len(us)) < rng.choice([0, 0.05, 0.3])
        gap = int(rng.integers(1, 60))
        cuts = np.sort(rng.choice(np.arange(1, len(us)), min(len(us) - 1, 4), replace=False)) if len(us) > 1 else []
        tables = [th.jumps(u, d, gap) for u, d in zip(np.split(us, cuts), np.split(due, cuts))]
        whole = tables[0]
        for t in tables[1:]:
            whole = th.composed(whole, t, gap)
        for last in range(int(us[0]) - gap - 2, int(us[0])):
            at = th.emitted(us, due, gap, last)
            assert th.through(whole, np.array([last]), gap)[0] == (us[at[-1]] if len(at) else last)
        assert th.entries(tables, None, gap)[1:] == [int(us[th.emitted(us[:c], due[:c], gap, None)[-1]]) for c in cuts]
