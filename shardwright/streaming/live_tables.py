"""T3/T4 over runs of any size: live rates and throttled rows whose state is a table.

Every micro-batch is one batch job: the batch operators, which deal a run over blocks of its clock, go on from a
state table, so a run that sends most of the rows is many tasks, not one key of a stateful operator. The state of a
run is its samples of the last window since its last rewind, and always the latest one (rates), or the time of the row let
through last (throttle). State and results of batch N are written to folders of that number, the results last; a batch
that is run again finds the state of N - 1 and writes the same. States before the last two are removed.

The rows of a run must not be older than those of earlier batches. With ``idle_s`` a run whose
latest row lies so far behind the latest of all is forgotten. A null run is a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.operators import telemetry as T
from shardwright.operators.throttle import throttle
from shardwright.sources import store

RATE_STATE = "run_id {run}, seq long, us long, units double"
GATE_STATE = "run_id {run}, last_us long, latest_us long"


class LiveTable:
    """``<directory>/state/<batch>`` and ``<directory>/rows/batch=<batch>``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir = spark, directory

    def state(self, batch: int, schema: str) -> DataFrame:
        """The state before a batch: that of the batch before it, or none."""
        path = store.below(self.dir, "state", f"{batch - 1:012d}")
        return self.spark.read.schema(schema).parquet(path) if batch and store.exists(path) else self.spark.createDataFrame([], schema)

    def commit(self, batch: int, rows: DataFrame, state: DataFrame) -> None:
        state.write.mode("overwrite").parquet(store.below(self.dir, "state", f"{batch:012d}"))
        rows.write.mode("overwrite").parquet(store.below(self.dir, "rows", f"batch={batch}"))
        if batch >= 2:
            store.remove(store.below(self.dir, "state", f"{batch - 2:012d}"))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(store.below(self.dir, "rows")).drop("batch")


def _awake(state: DataFrame, clock: str, idle_s: float | None) -> DataFrame:
    """Without the runs whose latest row lies ``idle_s`` behind the latest of all."""
    if idle_s is None:
        return state
    latest = state.agg(F.max(clock).alias("m")).first()["m"]
    if latest is None:
        return state
    alive = state.groupBy(F.struct("run_id").alias("_k")).agg(F.max(clock).alias("_m")).where(F.col("_m") >= latest - int(idle_s * 1_000_000))
    return state.withColumn("_k", F.struct("run_id")).join(alive.select("_k"), "_k", "left_semi").drop("_k")


def rate_batch(batch: DataFrame, number: int, directory: str, window_s: float = 30.0, idle_s: float | None = None) -> None:
    """Applies one micro-batch of ``(run_id, seq, us, units)`` to the live rates in ``directory``."""
    live = LiveTable(batch.sparkSession, directory)
    schema = RATE_STATE.format(run=batch.schema["run_id"].dataType.simpleString())
    rows = batch.select("run_id", F.col("seq").cast("long").alias("seq"), F.col("us").cast("long").alias("us"), F.col("units").cast("double").alias("units"))
    before = live.state(number, schema)
    rated = T.rolling_rate(rows, window_s, seeds=before, keep_seeds=True)
    folder = store.below(directory, "rated", f"{number:012d}")
    rated.write.mode("overwrite").parquet(folder)                  # once; rows and state are read from it
    rated = batch.sparkSession.read.parquet(folder)
    key = F.struct("run_id")
    measured = rated.where("_ok").withColumn("_k", key)
    last = measured.groupBy("_k").agg(F.max(F.struct("_seg", "us", "seq")).alias("_l"))
    kept = measured.join(last, "_k").where((F.col("_seg") == F.col("_l._seg")) & (
        (F.col("us") >= F.col("_l.us") - int(round(window_s * 1_000_000))) | (F.struct("us", "seq") == F.struct("_l.us", "_l.seq"))))
    live.commit(number, rated.where("not _seed").drop("_seed", "_seg", "_ok"), _awake(kept.select("run_id", "seq", "us", "units"), "us", idle_s))
    store.remove(folder)


def throttle_batch(batch: DataFrame, number: int, directory: str, gap_s: float = 0.5, target: float | None = None,
                   idle_s: float | None = None) -> None:
    """Applies one micro-batch of rows with ``run_id, seq, us, units`` to the throttled rows in ``directory``."""
    live = LiveTable(batch.sparkSession, directory)
    before = live.state(number, GATE_STATE.format(run=batch.schema["run_id"].dataType.simpleString()))
    chosen = throttle(batch, gap_s, target, after=before)
    folder = store.below(directory, "chosen", f"{number:012d}")
    chosen.write.mode("overwrite").parquet(folder)
    chosen = batch.sparkSession.read.schema(chosen.schema).parquet(folder)
    seen = (chosen.select("run_id", F.col("us").alias("last_us"), F.col("us").alias("latest_us"))
            .unionByName(batch.where("us is not null").select("run_id", F.lit(None).cast("long").alias("last_us"), F.col("us").alias("latest_us"))).unionByName(before))
    state = seen.groupBy("run_id").agg(F.max("last_us").alias("last_us"), F.max("latest_us").alias("latest_us"))
    live.commit(number, chosen, _awake(state, "latest_us", idle_s))
    store.remove(folder)


def start(stream: DataFrame, directory: str, checkpoint: str, apply: Callable[..., None], available_now: bool = True, **options):
    """Runs ``rate_batch`` or ``throttle_batch`` over a stream; its results are in ``LiveTable.rows``."""
    w = stream.writeStream.foreachBatch(lambda df, number: apply(df, number, directory, **options)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
