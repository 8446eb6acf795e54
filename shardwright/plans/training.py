"""The training data plan.

shards → windows → leakage-safe split → per-epoch permutation → batches →
optimizer steps → what is left after a resume step → export in training order.
Windows come either from ``.bin`` shards (the ``token_shards`` source) or from
an in-memory build; the shard directory table is small (one row per shard) and
is the only thing collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.config import TrainConfig
from shardwright.operators import packing


@dataclass
class TrainingPlan:
    train: DataFrame          # (seq_index, shard, k, local_index)
    dev: DataFrame            # (seq_index, shard, k, local_index, batch)
    n_train: int
    n_dev: int
    batches_per_epoch: int
    dev_batches: int


def split_plan(windows: DataFrame, dim_rows: list, cfg: TrainConfig, stride: int | None = None) -> TrainingPlan:
    """Split windows by the shard table and size the loaders."""
    rows = sorted(dim_rows, key=lambda r: r["shard"])
    n_shards = len(rows)
    total = sum(r["n_seqs"] for r in rows)
    if n_shards >= 2:
        cut = packing.train_shard_count(n_shards)
        dev_base = rows[cut]["seq_start"]
        n_train = sum(r["n_seqs"] for r in rows[:cut])
        n_dev = total - n_train
    else:
        split, dev_start = packing.single_shard_split(total, cfg.T, stride)
        dev_base, n_train, n_dev = None, split, total - dev_start
    packing.check_split(n_train, n_dev)
    split = packing.split_windows(windows, n_shards, total, cfg.T, stride, dev_base=dev_base)
    train = split.filter(F.col("split") == "train").drop("split")
    dev = packing.assign_batches(split.filter(F.col("split") == "dev").drop("split")
                                 .withColumn("position", F.col("local_index")), cfg.B, n_dev, False)
    per_epoch = packing.n_batches(n_train, cfg.B, True)
    if per_epoch % cfg.grad_accum_steps:
        raise ValueError(f"{per_epoch} batches per epoch are no whole number of steps of {cfg.grad_accum_steps} batches")
    return TrainingPlan(train, dev, n_train, n_dev, per_epoch, packing.n_batches(n_dev, cfg.B, False))


def resume_plan(plan: TrainingPlan, cfg: TrainConfig, step: int) -> DataFrame:
    """Batches still to run from ``step`` to ``max_steps`` (G10–G14), with
    worker ranks (G13) and the windows' own columns."""
    out = packing.remaining_plan(plan.train.sparkSession, cfg.data_seed, cfg.B, cfg.grad_accum_steps, plan.n_train, step,
                                 cfg.max_steps)
    return packing.assign_ranks(out.join(plan.train, "local_index"), cfg.num_processes)


def evaluation_steps(spark, cfg: TrainConfig, start_step: int = 0) -> DataFrame:
    """Optimizer steps that evaluate (P19): every interval and the last step."""
    from shardwright.functions.columns import is_eval_step

    steps = spark.range(start_step + 1, cfg.max_steps + 1).withColumnRenamed("id", "step")
    return steps.filter(is_eval_step("step", cfg.eval_interval, cfg.max_steps))


def dev_samples(spark, plan: TrainingPlan, cfg: TrainConfig, n_evals: int, cursor: int = 0) -> DataFrame:
    """Which dev windows each evaluation reads (G15): join of the rotation
    with the dev batches on the batch number."""
    rot = packing.dev_sample_plan(spark, n_evals, plan.dev_batches, cfg.eval_batches, cursor)
    return rot.join(plan.dev.withColumnRenamed("batch", "dev_batch"), "dev_batch")
