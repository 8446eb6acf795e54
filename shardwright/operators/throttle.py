"""The greedy throttle of a run as composed jumps.

A throttled emitter lets the first row through, then every row at least a gap after the last one it
let through, and every row that is due. What comes later depends on the past only by the time of the
last row let through, so a stretch of a run is a function from that time to the next such time. It
has one step for each row of the stretch's first gap at most, and two of them compose into one that has no
more steps than the first. Hence:

1. Rows of one run and one clock value become one event (map-side combined): of those that are not
   due only the first can be let through, those that are due all are.
2. Events go to blocks of clock, of a width at which no block of any run holds more than ``EVENTS``
   (widths are tried from ``block_gaps`` gaps downwards; a microsecond holds one event).
3. Each block becomes its table of jumps; the tables of ``GROUP`` neighbouring blocks are composed
   into one, and these along the run. No group holds a run, only tables of its blocks' blocks.
4. With the time at which each block is entered, every block emits by itself.

A null run is a run. Rows without a clock have no place in the order and are not let through; units that
are null or NaN are never due.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.session import checkpoint_dir

EVENTS, GROUP = 1 << 16, 256
KEY = "_run_id_key"
Table = tuple[np.ndarray, np.ndarray, bool]      # thresholds, exits, whether the last one always holds


def successors(us: np.ndarray, due: np.ndarray, gap_us: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows in time order: the row let through after each one, and the first due row at or
    after each place (both may be the number of rows: none)."""
    n = len(us)
    next_due = np.append(np.minimum.accumulate(np.where(due, np.arange(n), n)[::-1])[::-1], n)
    after = np.maximum(np.arange(n) + 1, np.searchsorted(us, us + gap_us, "left"))
    return np.minimum(after, next_due[1:]), next_due


def emitted(us: np.ndarray, due: np.ndarray, gap_us: int, last_us: int | None) -> np.ndarray:
    """Indexes of the rows a throttle lets through after ``last_us``, for rows in time order."""
    after, next_due = successors(us, due, gap_us)
    at = 0 if last_us is None else min(int(np.searchsorted(us, last_us + gap_us, "left")), int(next_due[0]))
    out = []
    while at < len(us):
        out.append(at)
        at = int(after[at])
    return np.array(out, np.int64)


def jumps(us: np.ndarray, due: np.ndarray, gap_us: int) -> Table:
    """The table of a block: entered with a last time L, the first threshold at or above L + gap (the last
    one, if it always holds) tells the last time at its end; without any, L remains."""
    n = len(us)
    after, next_due = successors(us, due, gap_us)
    end = np.arange(n)                                             # where the chain of each row ends
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            end[i] = end[after[i]]
    return trimmed((us, us[end], False), int(us[0]), gap_us) if next_due[0] == n else trimmed(
        (us[:next_due[0] + 1], us[end[:next_due[0] + 1]], True), int(us[0]), gap_us)


def trimmed(t: Table, first_us: int, gap_us: int) -> Table:
    """Without thresholds beyond the first gap, which nothing can ask for, and without repeated exits."""
    thresholds, exits, always = t
    far = int(np.searchsorted(thresholds, first_us + gap_us, "left"))
    if far + 1 < len(thresholds):
        thresholds, exits = thresholds[:far + 1], exits[:far + 1]
    if far < len(thresholds):
        always = True
    keep = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.zeros(0, bool)
    return thresholds[keep], exits[keep], always


def through(t: Table, last: np.ndarray, gap_us: int) -> np.ndarray:
    thresholds, exits, always = t
    at = np.searchsorted(thresholds, last + gap_us, "left")
    at = np.minimum(at, len(thresholds) - 1) if always else at
    return np.where(at < len(thresholds), exits[np.minimum(at, len(thresholds) - 1)], last)


def composed(a: Table, b: Table, gap_us: int) -> Table:
    """First ``a``, then ``b``."""
    thresholds, exits, always = a
    exits = through(b, exits, gap_us)
    if always:
        return trimmed((thresholds, exits, True), int(thresholds[0]), gap_us)
    return trimmed((np.concatenate((thresholds, b[0])), np.concatenate((exits, b[1])), b[2]), int(thresholds[0]), gap_us)


def entries(tables: list[Table], last: int | None, gap_us: int) -> list[int | None]:
    """The last time with which each of some tables in order is entered."""
    out: list[int | None] = []
    for t in tables:
        out.append(last)
        last = int(t[1][0]) if last is None else int(through(t, np.array([last]), gap_us)[0])
    return out


def _width(events: DataFrame, gap_us: int, block_gaps: int) -> int:
    """The widest of the tried block widths at which no block holds more than ``EVENTS`` events."""
    width = gap_us * block_gaps
    while width > 1:
        most = events.groupBy(KEY, F.floor(F.col("us") / F.lit(width)).alias("b")).count().agg(F.max("count")).first()[0]
        if most is None or most <= EVENTS:
            return width
        width = max(1, width // 32)
    return width


TABLE = "thresholds array<long>, exits array<long>, always boolean"


def _per_row(df: DataFrame, out: str, each: Callable, keep: list[str]) -> DataFrame:
    """``each`` over the columns of every row that are not kept, as a dict; one row or several come back."""
    types = {c: df.schema[c].dataType.simpleString() for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = [c for c in batch.schema.names if c not in keep]
            got = [each(**{c: batch.column(c)[i].as_py() for c in args}) for i in range(batch.num_rows)]
            which = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
            names = [c.strip().split(" ")[0] for c in out.split(",")]
            kinds = {"array<long>": pa.list_(pa.int64()), "long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
            cols = [pa.array([row[j] for g in got for row in g], kinds[c.strip().split(" ")[1]]) for j, c in enumerate(out.split(","))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(which) for c in keep), *cols], [*keep, *names])

    return df.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), out]))


def throttle(rows: DataFrame, gap_s: float = 0.5, target: float | None = None, units: str = "units",
             run: str = "run_id", block_gaps: int = 1024, after: DataFrame | None = None) -> DataFrame:
    """The rows a throttled emitter lets through: the first row of a run, every row at least ``gap_s`` after
    the last one let through, and every row whose ``units`` reached ``target``. ``after (run, last_us)`` tells when
    the last row of a run was let through before these rows."""
    gap = int(round(gap_s * 1_000_000))
    if gap <= 0:
        raise ValueError("a throttle needs a gap longer than zero")
    spark, columns = rows.sparkSession, rows.columns
    folder = checkpoint_dir(spark).rstrip("/") + f"/throttle-{uuid.uuid4().hex}"
    number = F.col(units).cast("double")
    due = F.coalesce((number >= target) & ~F.isnan(number), F.lit(False)) if target is not None else F.lit(False)
    rows.where(F.col("us").isNotNull()).withColumn("_due", due).write.parquet(folder + "-rows")
    stored = spark.read.parquet(folder + "-rows").withColumn(KEY, F.struct(run))
    row = F.struct(*columns)
    events = stored.groupBy(KEY, "us").agg(
        F.max("_due").alias("due"), F.min_by(F.struct(F.col("_due").alias("due"), row.alias("row")), "seq").alias("first"))
    width = _width(stored.select(KEY, "us").distinct(), gap, block_gaps)
    (events.groupBy(KEY, F.floor(F.col("us") / F.lit(width)).alias("b"))
     .agg(F.array_sort(F.collect_list(F.struct("us", "due", "first"))).alias("e")).write.parquet(folder + "-blocks"))
    blocks = spark.read.parquet(folder + "-blocks")
    clocks = [F.transform("e", lambda x: x["us"]).alias("us"), F.transform("e", lambda x: x["due"].cast("int")).alias("due")]

    def reduce(us, due):
        t = jumps(np.array(us, np.int64), np.array(due, bool), gap)
        return [(t[0].tolist(), t[1].tolist(), t[2])]

    def tables_of(ts) -> list[Table]:
        return [(np.array(t["thresholds"], np.int64), np.array(t["exits"], np.int64), t["always"]) for t in ts]

    def compose(ts):
        tables = tables_of(ts)
        whole = tables[0]
        for t in tables[1:]:
            whole = composed(whole, t, gap)
        return [(whole[0].tolist(), whole[1].tolist(), whole[2])]

    def along(ts, last0):
        return list(zip([t["g"] for t in ts], entries(tables_of(ts), last0, gap)))

    def inside(ts, last):
        return list(zip([t["b"] for t in ts], entries(tables_of(ts), last, gap)))

    def emit(us, due, last):
        us, due = np.array(us, np.int64), np.array(due, bool)
        at = emitted(us, due, gap, last)
        before = np.concatenate(([np.iinfo(np.int64).min // 2 if last is None else last], us[at[:-1]])) if len(at) else at
        return [((at[us[at] - before >= gap]).tolist(),)]          # a due event lets its first row through only after a gap

    small = _per_row(blocks.select(KEY, "b", *clocks), TABLE, reduce, [KEY, "b"])
    groups = small.groupBy(KEY, F.floor(F.col("b") / GROUP).alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("b", "thresholds", "exits", "always"))).alias("ts"))
    wide = _per_row(groups, TABLE, compose, [KEY, "g"])
    runs = wide.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("g", "thresholds", "exits", "always"))).alias("ts"))
    if after is None:
        runs = runs.withColumn("last0", F.lit(None).cast("long"))
    else:
        runs = runs.join(after.select(F.struct(run).alias(KEY), F.col("last_us").alias("last0")), KEY, "left")
    entered = _per_row(runs, "g long, last long", along, [KEY])
    starts = _per_row(groups.join(entered, [KEY, "g"]).drop("g"), "b long, last long", inside, [KEY])
    chosen = _per_row(blocks.join(starts, [KEY, "b"]).select(KEY, "b", *clocks, "last"), "at array<int>", emit, [KEY, "b"])
    firsts = (blocks.select(KEY, "b", "e").join(chosen, [KEY, "b"])
              .select(F.explode(F.transform("at", lambda i: F.get("e", i)["first"])).alias("f")).where("not f.due").select("f.row.*"))
    return stored.where("_due").select(*columns).unionByName(firsts)
