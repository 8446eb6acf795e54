"""Telemetry analytics (W1–W4, M5–M9, M12, A9); the throttle (W5) is in ``operators.throttle``.

Inputs are long tables keyed by run: ``counters(run_id, seq, us, units)`` and
``metrics(run_id, step, us, name, value)``; the clock is integer microseconds.
A run may hold a large share of all rows, so nothing here windows over a whole
run: running aggregates are two-level scans over time blocks
(``shardwright.operators.ordering``), and the trailing rate window reads its own
block plus a halo copy of the block before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.operators.ordering import prefix_agg, prefix_aggs
from shardwright.operators.throttle import throttle  # noqa: F401  (W5)

RUN = "run_id"
RUN_KEY = "_run_id_key"
DEFAULT_BLOCK_US = 3_600_000_000      # one hour of clock per block
DEFAULT_BLOCK_STEPS = 65_536          # steps of a training log per block


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ clock, whatever
    the session time zone (trap 4). For TIMESTAMP (instant) columns use
    ``F.unix_micros`` instead."""
    t = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, t.cast("timestamp_ntz"))


def _block(col: str, width: int) -> Column:
    return F.floor(F.col(col) / F.lit(width)).cast("long")


# ---------------------------------------------------------------- W1, W2
def rolling_rate(counters: DataFrame, window_s: float = 30.0, block_us: int | None = None,
                 run: str = RUN, seeds: DataFrame | None = None, keep_seeds: bool = False) -> DataFrame:
    """Rate over the trailing ``window_s`` seconds of each counter sample.

    Samples restart after a rewind (units below the previous sample); the two
    latest samples are always kept even if older than the window; the rate is
    ≥ 0 and 0 with a single sample or no elapsed time. A null run is a run. A sample without
    a clock, or whose units are null or NaN, has rate 0 and is not seen by other samples.
    Adds ``rate`` (units/s) and ``elapsed_s``. ``seeds (run, us, units)`` are samples
    known before the log starts (a resumed run), in the order of ``seq`` if they have it; they are compared
    against but not returned, unless ``keep_seeds`` asks for all rows with ``_seed``, ``_ok`` and the segment ``_seg``.
    """
    if window_s <= 0:
        raise ValueError("a rate needs a window longer than zero seconds")
    W = int(round(window_s * 1_000_000))
    blk = block_us or max(W, DEFAULT_BLOCK_US)
    if seeds is not None:
        order = F.col("seq") if "seq" in seeds.columns else F.lit(-1)
        before = seeds.select(run, order.cast("long").alias("seq"), "us", "units", F.lit(True).alias("_seed"))
        counters = counters.withColumn("_seed", F.lit(False)).unionByName(before, allowMissingColumns=True)
    df = _prev_and_segments(counters, blk, run)
    # previous sample inside the same segment, else none
    same = F.col("_rs") == 0
    df = (df.withColumn("_pus", F.when(same, F.col("prev_us")))
          .withColumn("_pun", F.when(same, F.col("prev_units")))
          .withColumn("_pseq", F.when(same, F.col("prev_seq"))))
    # trailing window: own W-block plus a halo copy of the W-block before
    df = df.withColumn("_wb", F.when(F.col("_ok"), _block("us", W)).otherwise(F.col("_tb")))
    both = df.withColumn("_h", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_wb", F.col("_wb") + F.col("_h")).withColumn("_halo", F.col("_h") == 1).drop("_h")
    w = (Window.partitionBy(run, "_ok", "_seg", "_wb").orderBy("us")
         .rangeBetween(-W, Window.currentRow))
    first = F.min(F.struct("us", "seq", "units")).over(w)
    got = both.withColumn("_first", first).filter(~F.col("_halo"))
    prev = F.struct(F.col("_pus").alias("us"), F.col("_pseq").alias("seq"), F.col("_pun").alias("units"))
    j0 = F.when(F.col("_pus").isNull(), F.lit(None)).otherwise(F.least(F.col("_first"), prev))
    elapsed = (F.col("us") - j0["us"]) / F.lit(1e6)
    rate = F.when(j0.isNull() | (elapsed <= 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), (F.col("units") - j0["units"]) / elapsed))
    alone = j0.isNull() | ~F.col("_ok")
    out = got.withColumn("elapsed_s", F.when(alone, F.lit(0.0)).otherwise(F.greatest(elapsed, F.lit(0.0))))
    out = out.withColumn("rate", F.when(alone, F.lit(0.0)).otherwise(rate))
    out = out.drop("_tb", "_rs", "_pus", "_pun", "_pseq", "_wb", "_halo", "_first", "prev_units", "prev_us", "prev_seq")
    if keep_seeds:
        return out if seeds is not None else out.withColumn("_seed", F.lit(False))
    return (out if seeds is None else out.where("not _seed").drop("_seed")).drop("_seg", "_ok")


def _measured() -> Column:
    """Samples that can be compared: they have a clock, and units that are a number."""
    return F.col("us").isNotNull() & F.col("units").isNotNull() & ~F.isnan(F.col("units").cast("double"))


def _prev_and_segments(df: DataFrame, block_us: int, run: str) -> DataFrame:
    """Previous sample (``prev_us/units/seq``), rewind flag ``_rs`` and the
    number of rewinds so far ``_seg``, in one two-level pass over clock
    blocks ``_tb``: one window inside each block, one small per-block table
    carrying each block's last sample and rewind count to the next block. Samples that cannot be
    compared (``_ok`` false) are runs of their own, dealt by a hash."""
    df = df.withColumn("_ok", _measured())
    df = df.withColumn("_tb", F.when(F.col("_ok"), _block("us", block_us)).otherwise(F.pmod(F.xxhash64("seq"), F.lit(1 << 12))))
    df = df.withColumn(RUN_KEY, F.struct(run, "_ok"))              # never null, so no run is lost in the join
    inner = Window.partitionBy(RUN_KEY, "_tb").orderBy("us", "seq")
    d = (df.withColumn("_rn", F.row_number().over(inner))
         .withColumn("_lu", F.lag("units").over(inner))
         .withColumn("_lus", F.lag("us").over(inner))
         .withColumn("_lseq", F.lag("seq").over(inner)))
    d = d.withColumn("_ri", (F.col("_lu").isNotNull() & (F.col("units") < F.col("_lu"))).cast("long"))
    d = d.withColumn("_ci", F.sum("_ri").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = d.groupBy(RUN_KEY, "_tb").agg(
        F.min(F.struct("us", "seq", "units")).alias("_first"),
        F.max(F.struct("us", "seq", "units")).alias("_last"),
        F.sum("_ri").alias("_ni"))
    bw = Window.partitionBy(RUN_KEY).orderBy("_tb")
    blocks = blocks.withColumn("_pl", F.lag("_last").over(bw))
    blocks = blocks.withColumn("_bd", (F.col("_pl").isNotNull() & (F.col("_first")["units"] < F.col("_pl")["units"]))
                               .cast("long"))
    blocks = blocks.withColumn("_bb", F.coalesce(F.sum(F.col("_ni") + F.col("_bd")).over(
        bw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_bd"))
    d = d.join(blocks.select(RUN_KEY, "_tb", "_pl", "_bd", "_bb"), [RUN_KEY, "_tb"])
    first = F.col("_rn") == 1
    return (d.withColumn("prev_units", F.when(first, F.col("_pl")["units"]).otherwise(F.col("_lu")))
            .withColumn("prev_us", F.when(first, F.col("_pl")["us"]).otherwise(F.col("_lus")))
            .withColumn("prev_seq", F.when(first, F.col("_pl")["seq"]).otherwise(F.col("_lseq")))
            .withColumn("_rs", F.when(first, F.col("_bd")).otherwise(F.col("_ri")))
            .withColumn("_seg", F.col("_bb") + F.col("_ci"))
            .drop("_rn", "_lu", "_lus", "_lseq", "_ri", "_ci", "_pl", "_bd", "_bb", RUN_KEY))


def eta(df: DataFrame, target: float | Column, units: str = "units", rate: str = "rate") -> DataFrame:
    """⌊remaining / rate⌋ seconds, 0 when the rate is 0."""
    t = F.lit(target) if not isinstance(target, Column) else target
    remaining = F.greatest(F.lit(0.0), t - F.col(units))
    return df.withColumn("eta_s", F.when(F.col(rate) > 0, F.floor(remaining / F.col(rate))).otherwise(0).cast("long"))


# ---------------------------------------------------------------- A9
def audit_counters(counters: DataFrame, block_us: int = DEFAULT_BLOCK_US, run: str = RUN) -> DataFrame:
    """Violations ``(run, seq, rule, expected, found)`` of a counter log with
    ``added`` increments: negative increments, an increment that differs from
    the observed change, units going backwards, and samples without a clock or a number of
    units (``missing``), which the other rules pass over."""
    df = _prev_and_segments(counters, block_us, run)
    change = F.col("units") - F.col("prev_units")
    odd = F.struct(F.lit("missing").alias("rule"), F.lit(None).cast("double").alias("expected"), F.col("units").cast("double").alias("found"))
    rules = F.when(~F.col("_ok"), F.array(odd)).otherwise(F.array(
        F.when(F.col("added") < 0, F.struct(F.lit("negative_delta").alias("rule"), F.lit(0).cast("double").alias("expected"),
                                            F.col("added").cast("double").alias("found"))),
        F.when(F.col("prev_units").isNotNull() & (change != F.col("added")),
               F.struct(F.lit("delta_mismatch").alias("rule"), F.col("added").cast("double").alias("expected"),
                        change.cast("double").alias("found"))),
        F.when(F.col("prev_units").isNotNull() & (F.col("units") < F.col("prev_units")),
               F.struct(F.lit("backwards").alias("rule"), F.col("prev_units").cast("double").alias("expected"),
                        F.col("units").cast("double").alias("found")))))
    return (df.select(run, "seq", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("v"))
            .select(run, "seq", "v.rule", "v.expected", "v.found"))


# ---------------------------------------------------------------- W3, M5, M6
def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def training_log(log: DataFrame, block_steps: int = DEFAULT_BLOCK_STEPS, run: str = RUN) -> DataFrame:
    """Per-step training log ``(run, step, us, train_loss, dev_loss, is_eval)``
    → adds ``held_dev_loss`` (W3), ``interval`` and, on evaluation rows,
    ``average_train_loss`` (M5), ``best_dev_loss`` and ``best_average_train_loss`` (M6).
    A null run is a run; rows without a step come before its others.
    """
    df = log.withColumn("_tb", _block("step", block_steps))      # blocks follow the order, not the clock
    # one two-level pass: W3 last dev loss of an earlier evaluation (struct max
    # = latest by step), M5 interval = evaluations strictly before the row,
    # M6 best dev loss so far (NaN never wins)
    ev = F.when(F.col("is_eval") & F.col("dev_loss").isNotNull(), F.struct("step", "dev_loss"))
    bd = F.when(F.col("is_eval") & _finite(F.col("dev_loss")), F.col("dev_loss"))
    df = prefix_aggs(df, [("_held", ev, "max", False),
                          ("interval", F.col("is_eval").cast("long"), "sum", False),
                          ("best_dev_loss", bd, "min", True)], ["step"], "_tb", [run])
    df = df.withColumn("held_dev_loss", F.col("_held")["dev_loss"]).drop("_held")
    ok = _finite(F.col("train_loss"))
    # one row per interval: its average (the closing evaluation's own loss
    # when nothing finite is left) and, over evaluations so far, the best one
    df = df.withColumn(RUN_KEY, F.struct(run))
    per = (df.groupBy(RUN_KEY, "interval")
           .agg(F.sum(F.when(ok, F.col("train_loss"))).alias("_s"), F.sum(ok.cast("long")).alias("_n"),
                F.max(F.col("is_eval").cast("int")).alias("_has_eval"),
                F.max(F.when(F.col("is_eval"), F.col("train_loss"))).alias("_own")))
    per = per.withColumn("_avg", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.col("_own")))
    fin = F.when((F.col("_has_eval") == 1) & _finite(F.col("_avg")), F.col("_avg"))
    per = prefix_agg(per.withColumn("_ba", fin), "_ba", ["interval"], F.floor(F.col("interval") / 4096),
                     "best_average_train_loss", [RUN_KEY], how="min")
    df = df.join(per.select(RUN_KEY, "interval", "_avg", "best_average_train_loss"), [RUN_KEY, "interval"], "left")
    df = df.withColumn("average_train_loss", F.when(F.col("is_eval"), F.col("_avg")))
    df = df.withColumn("best_dev_loss", F.when(F.col("is_eval"), F.col("best_dev_loss")))
    df = df.withColumn("best_average_train_loss", F.when(F.col("is_eval"), F.col("best_average_train_loss")))
    return df.drop("_tb", "_avg", RUN_KEY)


# ---------------------------------------------------------------- M7, M8, M9, M12
def summarise(metrics: DataFrame, policy: DataFrame, run: str = RUN) -> DataFrame:
    """M7: summary value per (run, name) by policy last/min/max; ``last`` without a policy."""
    agg = metrics.groupBy(run, "name").agg(
        F.max_by("value", "step").alias("_last"), F.min("value").alias("_min"), F.max("value").alias("_max"))
    j = agg.join(policy, "name", "left").withColumn("policy", F.coalesce("policy", F.lit("last")))
    return j.select(run, "name", "policy",
                    F.when(F.col("policy") == "last", F.col("_last"))
                    .when(F.col("policy") == "min", F.col("_min"))
                    .when(F.col("policy") == "max", F.col("_max")).alias("summary"))


def loss_comparison(evals_long: DataFrame, names: list[str], run: str = RUN) -> DataFrame:
    """M8: (run, step) × metric names, pivoted with the names given up front."""
    return evals_long.groupBy(run, "step").pivot("name", names).agg(F.first("value"))


def run_summary(log: DataFrame, tokens_per_step: int, max_steps: int, run: str = RUN, schedule=None) -> DataFrame:
    """M9: totals, latest, best, number of evaluations and status per run.

    A log that ``training_log`` has gone over also gives the latest and best average train
    loss of an interval; with ``us`` the run's rates; with a ``schedule`` (the learning rate
    as a function of a step column) the current learning rate."""
    e = F.col("is_eval")
    aggs = [
        F.max("step").alias("current_step"),
        F.max_by("train_loss", "step").alias("latest_train_loss"),
        F.max_by(F.when(e, F.col("dev_loss")), F.when(e, F.col("step"))).alias("latest_dev_loss"),
        F.min(F.when(e & _finite(F.col("dev_loss")), F.col("dev_loss"))).alias("best_dev_loss"),
        F.sum(e.cast("long")).alias("evaluations"),
        F.count(F.lit(1)).alias("rows")]
    if "average_train_loss" in log.columns:
        avg = F.col("average_train_loss")
        aggs += [F.max_by(F.when(e, avg), F.when(e, F.col("step"))).alias("latest_average_train_loss"),
                 F.min(F.when(e & _finite(avg), avg)).alias("best_average_train_loss")]
    if "us" in log.columns:
        aggs += [((F.max("us") - F.min("us")) / F.lit(1e6)).alias("elapsed_s"), (F.max("step") - F.min("step")).alias("_steps")]
    out = (log.groupBy(run).agg(*aggs)
           .withColumn("tokens_processed", (F.col("current_step") * F.lit(tokens_per_step)).cast("long"))
           .withColumn("progress_percent", F.lit(100.0) * F.col("current_step") / F.lit(max_steps))
           .withColumn("status", F.when(F.col("current_step") >= max_steps, "finished").otherwise("running")))
    if "us" in log.columns:
        rate = F.when(F.col("elapsed_s") > 0, F.col("_steps") / F.col("elapsed_s")).otherwise(F.lit(0.0))
        out = (out.withColumn("steps_per_s", rate).withColumn("tokens_per_s", F.col("steps_per_s") * F.lit(tokens_per_step))
               .withColumn("eta_s", F.when(F.col("steps_per_s") > 0, F.floor(F.greatest(F.lit(0), F.lit(max_steps) - F.col("current_step"))
                                                                             / F.col("steps_per_s"))).otherwise(0).cast("long")).drop("_steps"))
    if schedule is not None:
        out = out.withColumn("learning_rate", schedule("current_step"))
    return out


def average_throughput(df: DataFrame, seq_len: int, run: str = RUN, count_col: str | None = None) -> DataFrame:
    """sequences·T / elapsed seconds (0 when no time passed)."""
    n = F.count(F.lit(1)) if count_col is None else F.max(count_col)
    g = df.groupBy(run).agg(n.alias("sequences"), ((F.max("us") - F.min("us")) / F.lit(1e6)).alias("elapsed_s"))
    return g.withColumn("tokens_per_s", F.when(F.col("elapsed_s") > 0,
                                               F.col("sequences") * F.lit(seq_len) / F.col("elapsed_s")).otherwise(0.0))
