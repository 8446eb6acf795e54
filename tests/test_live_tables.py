"""Live meters over state tables: the same rows as the batch operators, however the rows are cut."""

import random

import pytest
from pyspark.sql import functions as F

from shardwright.operators import telemetry as tl
from shardwright.sources import store
from shardwright.streaming import live_tables as L

SCHEMA = "run_id long, seq long, us long, units double"


def rows(seed=1, n=260):
    """One run with most of the rows, rewinds, silences, equal clocks, a null run and samples that cannot be compared."""
    rnd = random.Random(seed)
    out, us, units = [], 0, {}
    for i in range(n):
        us += rnd.choice([0, 200_000, 1_000_000, 45_000_000 if rnd.random() < 0.1 else 300_000])
        run = rnd.choice([1, 1, 1, 2, None])
        units[run] = 0.0 if rnd.random() < 0.05 else units.get(run, 0.0) + rnd.random() * 10
        out.append((run, i, us, rnd.choice([units[run]] * 30 + [float("nan"), None])))
    return out


def cut(df, parts):
    hi = df.agg(F.max("seq")).first()[0] + 1
    edges = [hi * k // parts for k in range(parts + 1)]
    return [df.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(edges, edges[1:])]


def canon(df, *cols):
    return sorted((tuple(None if r[c] is None else round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_rates(spark, tmpdir_path, parts):
    df = spark.createDataFrame(rows(), SCHEMA)
    for number, part in enumerate(cut(df, parts)):
        L.rate_batch(part, number, tmpdir_path, 30.0)
        if number == 1:
            L.rate_batch(part, number, tmpdir_path, 30.0)           # run again: the same
    cols = ("run_id", "seq", "us", "rate", "elapsed_s")
    assert canon(L.LiveTable(spark, tmpdir_path).rows(), *cols) == canon(tl.rolling_rate(df, 30.0), *cols)
    assert len(store.place(tmpdir_path)[0].get_file_info(store.fs.FileSelector(f"{tmpdir_path}/state"))) <= 2


@pytest.mark.parametrize("parts", [1, 5])
def test_throttled_rows(spark, tmpdir_path, parts):
    df = spark.createDataFrame(rows(2), SCHEMA)
    for number, part in enumerate(cut(df, parts)):
        L.throttle_batch(part, number, tmpdir_path, 5.0, 60.0)
        if number == 2:
            L.throttle_batch(part, number, tmpdir_path, 5.0, 60.0)
    assert canon(L.LiveTable(spark, tmpdir_path).rows(), "run_id", "seq") == canon(tl.throttle(df, 5.0, 60.0), "run_id", "seq")


def test_silent_runs_are_forgotten(spark, tmpdir_path):
    s = 1_000_000
    first = spark.createDataFrame([(1, 0, 0, 1.0), (2, 1, 50 * s, 1.0)], SCHEMA)
    second = spark.createDataFrame([(1, 2, 51 * s, 5.0), (2, 3, 51 * s, 5.0)], SCHEMA)
    for name, apply, kept in (("r", L.rate_batch, {(1, 2), (2, 3)}), ("t", L.throttle_batch, {(1, 0), (2, 1), (1, 2)})):
        for n, part in enumerate((first, second)):
            apply(part, n, f"{tmpdir_path}/{name}", 30.0, idle_s=20.0)
        got = L.LiveTable(spark, f"{tmpdir_path}/{name}").rows()
        if name == "t":
            assert {(r["run_id"], r["seq"]) for r in got.collect()} == kept      # run 1 starts anew, run 2 is held back
        else:
            assert {r["seq"]: r["rate"] for r in got.collect()} == {0: 0.0, 1: 0.0, 2: 0.0, 3: 4.0}


def test_on_a_stream(spark, tmpdir_path):
    df = spark.createDataFrame(rows(3, 120), SCHEMA)
    for n, part in enumerate(cut(df, 3)):
        part.coalesce(1).write.mode("append").parquet(f"{tmpdir_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmpdir_path}/in")
        L.start(stream, f"{tmpdir_path}/rates", f"{tmpdir_path}/check", L.rate_batch, window_s=30.0).awaitTermination()
    assert canon(L.LiveTable(spark, f"{tmpdir_path}/rates").rows(), "seq", "rate") == canon(tl.rolling_rate(df, 30.0), "seq", "rate")
