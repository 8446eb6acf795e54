"""Sample geometry: windows, lookup, split, permutation, batches, resume."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwright.config import PackingConfig, TrainConfig, windows_in
from shardwright.functions.columns import data_position, wsd_lr, xy
from shardwright.operators import packing
from shardwright.plans import corpus
from shardwright.sources.token_shards import read_windows


def write_bins(d, shards):
    for i, arr in enumerate(shards):
        np.asarray(arr, dtype="<u2").tofile(os.path.join(d, f"shard_{i:05d}.bin"))


def xs(spark, d, T, stride=None):
    w = read_windows(spark, d, T, stride)
    x, y = xy("window", T)
    return {r["seq_index"]: (r["x"], r["y"]) for r in w.select("seq_index", x, y).collect()}


def test_two_shards_of_twenty(spark, tmpdir_path):
    write_bins(tmpdir_path, [np.arange(20), np.arange(100, 120)])
    got = xs(spark, tmpdir_path, 4)
    n = len(got)
    assert got[0][0] == [0, 1, 2, 3]
    assert got[4][0] == [100, 101, 102, 103]
    assert got[n - 1][0] == [112, 113, 114, 115]
    dim = spark.createDataFrame([(0, 4, 0, 4), (1, 0, 4, 4), (2, 4, 4, 8)], "shard int, n_seqs long, seq_start long, seq_end long")
    req = spark.createDataFrame([(0,), (4,), (-1,), (8,)], "idx long")
    res = {r["idx"]: (r["shard"], r["k"], r["error"]) for r in packing.lookup_windows(req, dim).collect()}
    assert res[0][:2] == (0, 0) and res[4][:2] == (2, 0) and res[-1][:2] == (2, 3)
    assert res[8][0] is None and "8" in res[8][2]
    same = {r["idx"]: (r["shard"], r["k"], r["error"] is None) for r in packing.lookup_uniform(req, 2, 4).collect()}
    assert same == {0: (0, 0, True), 4: (1, 0, True), -1: (1, 3, True), 8: (None, None, False)}


def test_one_shard_of_seventeen(spark, tmpdir_path):
    write_bins(tmpdir_path, [np.arange(17)])
    got = xs(spark, tmpdir_path, 4)
    assert len(got) == 4
    assert got[3][1] == [13, 14, 15, 16]


def test_two_shards_of_thirteen(spark, tmpdir_path):
    write_bins(tmpdir_path, [np.arange(13), np.arange(100, 113)])
    got = xs(spark, tmpdir_path, 4)
    assert len(got) == 6
    assert got[2][0] == [8, 9, 10, 11] and got[3][0] == [100, 101, 102, 103]


def test_invalid_geometry():
    with pytest.raises(ValueError):
        windows_in(100, 0, 1)
    with pytest.raises(ValueError):
        windows_in(100, 4, 0)
    with pytest.raises(ValueError):
        PackingConfig(shard_size=10, seq_len=4, stride=-1)


def test_short_shard_has_no_windows():
    assert windows_in(4, 4, 4) == 0
    assert windows_in(5, 4, 4) == 1


def test_split_cutoffs():
    assert [packing.train_shard_count(n) for n in (2, 3, 10, 30, 100)] == [1, 2, 9, 28, 95]


def test_single_shard_split_gap():
    n = windows_in(200, 8, 2)
    assert n == 96
    split, dev = packing.single_shard_split(n, 8, 2)
    assert split == 91 and dev == 95
    # last train window ends before the first dev window starts
    assert (split - 1) * 2 + 8 < dev * 2


def _plain_windows(doc_ids, S, T, stride, max_shards):
    stream = []
    for d in doc_ids:
        stream.extend(d)
    n_sh = min(max_shards, len(stream) // S)
    out = []
    for s in range(n_sh):
        shard = stream[s * S:(s + 1) * S]
        for k in range(windows_in(S, T, stride)):
            out.append((s, k, shard[k * stride:k * stride + T + 1]))
    return out


@pytest.mark.parametrize("S,T,stride", [(200, 16, 16), (200, 16, 4), (200, 16, 1), (200, 16, 50),
                                        (200, 199, 7), (200, 200, 200), (17, 16, 16), (16, 16, 16)])
def test_packing_geometries(spark, S, T, stride):
    rnd = random.Random(S * 1000 + T * 10 + stride)
    docs = [[rnd.randrange(0, 250) for _ in range(rnd.randint(1, 300))] for _ in range(60)]
    rows = [(i, d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("n_tokens", F.size("ids").cast("long"))
    off, total = packing.token_offsets(df, n_buckets=5, with_total=True)
    segs = packing.cut_shards(off, S, ids_col="ids")
    comm, _ = packing.split_committed(segs, packing.committed_shards(total, S, 10_000))
    got = packing.pack_windows(comm.select("shard", "pos", "tokens"), S, T, stride)
    got = sorted((r["shard"], r["k"], r["window"]) for r in got.collect())
    assert got == _plain_windows(docs, S, T, stride, 10_000)


def test_generated_windows_come_from_many_tasks(spark):
    """One shard with many windows is no one task, in closed form or from a shard table."""
    dim = packing.uniform_shard_dim(spark, 1, 200_000, 16, 4)
    a, b = packing.window_spans(spark, dim, 16, 4), packing.uniform_window_spans(spark, 1, 200_000, 16, 4)
    for spans in (a, b):
        assert spans.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count() == 49_996
    many = packing.uniform_window_spans(spark, 7, 100, 16, 16)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, packing.window_spans(
        spark, packing.uniform_shard_dim(spark, 7, 100, 16, 16), 16, 16).select(*many.columns).collect()))


def test_offsets_equal_for_any_bucketing(spark):
    rows = [(i * 3 + (i % 7), (i * 37) % 101 + 1) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    ref = sorted((r["doc_id"], r["start"]) for r in packing.token_offsets(df, n_buckets=1).collect())
    for nb in (2, 17, 300):
        got = sorted((r["doc_id"], r["start"]) for r in packing.token_offsets(df, n_buckets=nb).collect())
        assert got == ref
    acc, exp = 0, []
    for d, n in sorted(rows):
        exp.append((d, acc))
        acc += n
    assert ref == exp


def test_sparse_ids_use_quantile_buckets(spark):
    rows = [(i ** 3, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = sorted((r["doc_id"], r["start"]) for r in packing.token_offsets(df, n_buckets=8).collect())
    assert [s for _, s in got] == list(range(300))


def test_epoch_permutation_contract(spark):
    df = spark.range(100).withColumnRenamed("id", "local_index")
    a = [r["local_index"] for r in packing.epoch_order(df, 42, 0).orderBy("position").collect()]
    b = [r["local_index"] for r in packing.epoch_order(df, 42, 0).orderBy("position").collect()]
    c = [r["local_index"] for r in packing.epoch_order(df, 42, 1).orderBy("position").collect()]
    pos = sorted(r["position"] for r in packing.epoch_order(df, 42, 0).collect())
    assert a == b and sorted(a) == list(range(100)) and a != c and pos == list(range(100))
    with pytest.raises(ValueError):
        packing.epoch_order(df, 42, -1)


def test_data_position(spark):
    assert [packing.data_position_py(s, 1, 4) for s in (0, 1, 3, 4, 9)] == [(0, 0), (0, 1), (0, 3), (1, 0), (2, 1)]
    assert packing.data_position_py(152_587, 4, 579_832) == (1, 30_516)
    with pytest.raises(ValueError):
        packing.data_position_py(-1, 1, 4)
    e, o = data_position("s", 1, 4)
    rows = spark.createDataFrame([(9,)], "s long").select(e, o).first()
    assert (rows["epoch"], rows["batch_offset"]) == (2, 1)


def test_dev_rotation(spark):
    plan = packing.dev_sample_plan(spark, 3, 4, 2)
    got = [[r["dev_batch"] for r in plan.filter(F.col("eval_no") == j).orderBy("i").collect()] for j in range(3)]
    assert got == [[0, 1], [2, 3], [0, 1]]
    assert packing.dev_sample_plan(spark, 1, 4, 2, cursor=6).orderBy("i").first()["dev_batch"] == 2


def test_wsd_schedule(spark):
    cfg = TrainConfig(learning_rate=1e-2, min_lr=1e-3, warmup_steps=2, max_steps=10)
    assert cfg.decay_start_step == 8
    df = spark.createDataFrame([(0,), (2,), (8,), (10,)], "step long").select("step", wsd_lr("step", cfg).alias("lr"))
    got = {r["step"]: r["lr"] for r in df.collect()}
    assert got[0] == pytest.approx(5e-3) and got[2] == pytest.approx(1e-2)
    assert got[8] == pytest.approx(1e-2) and got[10] == pytest.approx(1e-3)


def test_steps_need_divisible_epochs(spark):
    df = spark.range(3).select(F.lit(0).alias("epoch"), F.col("id").alias("batch"))
    with pytest.raises(ValueError):
        packing.assign_steps(df, 4, 6)


def test_offsets_plan_has_no_single_partition_over_rows(spark, sf):
    from shardwright.sources.documents import read_documents

    docs = read_documents(spark, f"{sf}/documents.parquet")
    off = corpus.offsets_only(docs)
    plan = off._jdf.queryExecution().executedPlan().toString()
    # the only SinglePartition exchange is the one over per-bucket sums
    assert plan.count("SinglePartition") <= 1
    assert "hashpartitioning(_pb" in plan


def test_coverage_and_leakage(spark):
    dim = packing.uniform_shard_dim(spark, 1, 200, 8, 2)
    spans = packing.window_spans(spark, dim, 8, 2)
    cov = packing.coverage_report(spans).first()
    assert cov["windows"] == 96 and cov["unique_tokens"] == 95 * 2 + 9
    split = packing.split_windows(spans, 1, 96, 8, 2)
    assert packing.leakage_report(split).first()["leaked_tokens"] == 0
    nogap = spans.withColumn("split", F.when(F.col("seq_index") < 91, "train").otherwise("dev"))
    assert packing.leakage_report(nogap).first()["leaked_tokens"] > 0


@pytest.mark.parametrize("stride, chunk", [(16, 32), (5, 20), (1, 7), (40, 8), (16, 1 << 15)])
def test_windows_do_not_depend_on_their_chunks(spark, stride, chunk):
    rnd = random.Random(stride)
    S, T = 200, 16
    stream = [rnd.randint(0, 500) for _ in range(3 * S)]
    rows, at = [], 0
    while at < len(stream):
        n = min(rnd.choice([1, 2, 3, 50, 150]), S - at % S, len(stream) - at)
        rows.append((at // S, at % S, stream[at:at + n]))
        at += n
    segs = spark.createDataFrame(rows + [(1, 30, [])], "shard int, pos long, tokens array<int>")
    got = {(r["shard"], r["k"]): r["window"] for r in packing.pack_windows(segs, S, T, stride, chunk_tokens=chunk).collect()}
    want = {(s, k): stream[s * S + k * stride:s * S + k * stride + T + 1] for s in range(3) for k in range((S - T - 1) // stride + 1)}
    assert got == want


def test_offsets_keep_null_and_repeated_ids(spark):
    rows = [(None, "aa"), (None, "b"), (None, "aa"), (3, "x"), (3, "yy"), (1, ""), (9, "zzz")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    from shardwright.plans import corpus

    runs = [sorted(((r["start"], r["end"], r["doc_id"]) for r in corpus.offsets_only(d.repartition(n), n_buckets=4).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    assert [s for s, _, _ in runs[0]] == [0, *(e for _, e, _ in runs[0][:-1])] and [i for _, _, i in runs[0]] == [None] * 3 + [1, 3, 3, 9]
