"""Evaluation analytics.

Logits arrive as a table, either dense (``ARRAY<DOUBLE>`` per position) or long
(``ctx, cand, score`` rows). Sums are float64; the full-validation loss is a
mean of sequence means, the sampled loss is token weighted (trap 12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.functions.columns import select_accuracy, softcap

IGNORE_INDEX = -1


def logsumexp(values: Column | str) -> Column:
    """One pass carrying (running max, scaled sum): no per-element array_max."""
    v = F.col(values) if isinstance(values, str) else values
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        x = x.cast("double")
        m = F.greatest(acc["m"], x)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(x - m)).alias("s"))

    return F.aggregate(v, init, step, lambda acc: acc["m"] + F.log(acc["s"]))


def cross_entropy(df: DataFrame, logits: str = "logits", target: str = "target",
                  cap: float = 0.0, out: str = "loss") -> DataFrame:
    """M1 dense: loss = logsumexp(z) − z[target]; target −1 → NULL (ignored)."""
    z = softcap(F.col(logits), cap) if cap > 0 else F.col(logits)
    t = F.col(target)
    loss = logsumexp(z) - F.element_at(z, (t + 1).cast("int")).cast("double")
    return df.withColumn(out, F.when(t == IGNORE_INDEX, F.lit(None).cast("double")).otherwise(loss))


def cross_entropy_long(scores: DataFrame, targets: DataFrame, key: list[str],
                       cand: str = "cand_id", score: str = "score", target: str = "target") -> DataFrame:
    """M1 long form: two aggregates per key (max, then sum of exp), one join
    for the target's score. For vocabularies too wide for one array."""
    mx = scores.groupBy(*key).agg(F.max(score).alias("_m"))
    lse = (scores.join(mx, key).groupBy(*key)
           .agg((F.first("_m") + F.log(F.sum(F.exp(F.col(score) - F.col("_m"))))).alias("_lse")))
    tgt = targets.filter(F.col(target) != IGNORE_INDEX)
    picked = tgt.join(scores, [*key], "inner").filter(F.col(cand) == F.col(target)).select(*key, F.col(score).alias("_zt"))
    return lse.join(picked, key).select(*key, (F.col("_lse") - F.col("_zt")).alias("loss"))


def sequence_loss(pos_loss: DataFrame, seq: str = "seq_index", loss: str = "loss") -> DataFrame:
    """M2: mean loss per sequence over kept (non-null) positions."""
    return pos_loss.groupBy(seq).agg(F.avg(F.col(loss).cast("double")).alias("seq_loss"),
                                     F.count(loss).cast("long").alias("n_tokens"))


def full_validation(seq_losses: DataFrame, seq_len: int) -> DataFrame:
    """M3: mean of sequence means, perplexity e^L, sequences, tokens."""
    return (seq_losses.agg(F.avg("seq_loss").alias("loss"), F.count(F.lit(1)).cast("long").alias("sequences"))
            .withColumn("perplexity", F.exp("loss"))
            .withColumn("tokens", (F.col("sequences") * seq_len).cast("long"))
            .withColumn("loss", F.when(F.col("sequences") > 0, F.col("loss"))
                        .otherwise(F.raise_error(F.lit("validation produced no sequences")))))


def choice_accuracy(choices: DataFrame) -> DataFrame:
    """Per task raw and length-normalised accuracy; ties → lowest choice.

    Input ``(task, item_id, choice, loglik, n_bytes, gold)``. Per item the
    arg-max is a partial/final aggregate, never a sort of the group."""
    per_item = choices.groupBy("task", "item_id").agg(
        F.max_by("choice", F.struct(F.col("loglik"), -F.col("choice"))).alias("pick"),
        F.max_by("choice", F.struct(F.col("loglik") / F.col("n_bytes"), -F.col("choice"))).alias("pick_norm"),
        F.first("gold").alias("gold"),
        F.count(F.lit(1)).alias("n_choices"))
    return per_item.groupBy("task").agg(
        F.count(F.lit(1)).cast("long").alias("items"),
        F.avg((F.col("pick") == F.col("gold")).cast("double")).alias("acc"),
        F.avg((F.col("pick_norm") == F.col("gold")).cast("double")).alias("acc_norm"),
        F.avg(F.lit(1.0) / F.col("n_choices")).alias("chance"))


def task_metrics(acc: DataFrame) -> DataFrame:
    """(task, metrics MAP) in the evaluation-harness shape; P15 picks from it."""
    m = F.create_map(F.lit("acc,none"), F.col("acc"), F.lit("acc_norm,none"), F.col("acc_norm"))
    return acc.select("task", "items", "chance", m.alias("metrics")).withColumn("accuracy", select_accuracy("metrics"))


def macro_accuracy(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("accuracy").alias("macro_accuracy"),
                       F.sum("items").cast("long").alias("items"),
                       F.avg(F.col("accuracy") - F.col("chance")).alias("margin_over_chance"))


def limit_per_group(df: DataFrame, group: list[str], order: list[str], n: int | None) -> DataFrame:
    """First ``n`` rows per group (0/None = all). Uses a rank filter that
    Spark plans as a per-partition group limit before the shuffle."""
    if n is None or n == 0:
        return df
    if n < 0:
        raise ValueError("limit cannot be negative")
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def running_mean(seq_losses: DataFrame, order: str, bucket: Column) -> DataFrame:
    """Running mean of sequence losses in processing order (two-level)."""
    from shardwright.operators.ordering import prefix_aggs

    base = seq_losses.withColumn("_one", F.lit(1).cast("long"))
    out = prefix_aggs(base, [("_cum_loss", "seq_loss", "sum", True), ("processed", "_one", "sum", True)], [order], bucket)
    return out.withColumn("running_loss", F.col("_cum_loss") / F.col("processed")).drop("_cum_loss", "_one")
