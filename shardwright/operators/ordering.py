"""Global order without a single partition.

A prefix aggregate over an ordered key ("running total of tokens by doc_id",
"rank by shuffle key") would, written as ``Window.orderBy`` without
``partitionBy``, pull every row into one task. These helpers compute it in two
levels instead:

1. rows are assigned to buckets that are contiguous in the order and bounded in
   size, with boundaries that are literals (never ``spark_partition_id``), so a
   retried task puts every row in the same bucket;
2. a per-bucket aggregate (one row per bucket) is turned into bucket bases by a
   window over that small table;
3. the bases are joined back (AQE broadcasts them when the measured size allows)
   and a window partitioned by bucket finishes the prefix inside each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A bucket is one window partition. Document rows carry their text through that
# shuffle, so a bucket is sized to ~0.5 GB of average web text, not to a row count
# that only fits narrow rows.
DEFAULT_ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 1 << 20
MIN_BUCKETS_PER_CORE = 4   # enough buckets to keep every core busy in the inner window


NO_BLOCK = -(1 << 63)      # block of rows without an order key: before all others, as nulls sort


def keyed(df: DataFrame, partition: Sequence[str], block: Column, key: str, out: str) -> DataFrame:
    """``df`` with its partition as one struct and its block as a number, neither of them ever
    null: joins and windows over them lose no row whose partition or order key is null."""
    return df.withColumn(key, F.struct(*partition) if partition else F.lit(0)).withColumn(out, F.coalesce(block.cast("long"), F.lit(NO_BLOCK)))


def _key_name(partition: Sequence[str]) -> str:
    return "_" + "_".join(partition) + "_key"


def _cols(names: Sequence[str] | str | None) -> list[str]:
    if names is None:
        return []
    if isinstance(names, str):
        return [names]
    return list(names)


def prefix_sum(df: DataFrame, value: Column | str, order: Sequence[str] | str,
               bucket: Column | str, out: str,
               partition: Sequence[str] | str | None = None,
               inclusive: bool = False, return_sums: bool = False, sums: DataFrame | None = None,
               also: dict[str, Callable] | None = None):
    """``out`` = sum of ``value`` over rows before this one in ``order``.

    ``also`` names further columns over the ordered window of a bucket (no other shuffle). ``bucket`` must be non-decreasing in ``order`` within ``partition`` and keep
    buckets bounded; the result equals a single ordered window.
    """
    part = _cols(partition)
    order_cols = _cols(order)
    v = F.col(value) if isinstance(value, str) else value
    tagged = _tagged(df, v, bucket, part)
    keys = [c for c in tagged.columns if c == "_pb" or part and c == _key_name(part)]
    if sums is None:
        sums = bucket_sums(df, value, bucket, partition)
    before = Window.partitionBy(*keys[:-1]).orderBy("_pb").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = sums.select(*keys, F.coalesce(F.sum("_ps").over(before), F.lit(0))
                        .alias("_pbase"))
    inner_end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, inner_end)
    joined = tagged.join(bases, keys)
    result = joined.withColumn(
        out, F.col("_pbase") + F.coalesce(F.sum("_pv").over(inner), F.lit(0))
    ).withColumns({name: over(Window.partitionBy(*keys).orderBy(*order_cols)) for name, over in (also or {}).items()}
                  ).drop("_pv", "_pbase", *keys)
    if return_sums:
        return result, sums
    return result


def _tagged(df: DataFrame, value: Column, bucket: Column | str, part: list[str]) -> DataFrame:
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    df = df.withColumn("_pv", value)
    if part:
        return keyed(df, part, b, _key_name(part), "_pb")
    return df.withColumn("_pb", F.coalesce(b.cast("long"), F.lit(NO_BLOCK)))


def bucket_sums(df: DataFrame, value: Column | str, bucket: Column | str,
                partition: Sequence[str] | str | None = None) -> DataFrame:
    """``(partition key, _pb, _ps)``: the per-bucket totals of a prefix sum."""
    part = _cols(partition)
    tagged = _tagged(df, F.col(value) if isinstance(value, str) else value, bucket, part)
    return tagged.groupBy(*([_key_name(part)] if part else []), "_pb").agg(F.sum("_pv").alias("_ps"))


def with_range_bucket(df: DataFrame, key: str, out: str = "bucket",
                      rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                      n_buckets: int | None = None, tie: str | None = None) -> DataFrame:
    """Add a bucket column over an integer key, contiguous in key order.

    Rows without a key come before the others (nulls sort first); ``tie``, a 64-bit hash that
    orders them among themselves, deals them over 4,096 buckets of their own.

    Boundaries are literals taken once from ``min``/``max``/``count`` (dense
    keys: equal width) or from ``percentile_approx`` (sparse keys, placed by the
    JVM binary search of ``Bucketizer``), so they are stable across task
    retries and no bucket holds much more than ``rows_per_bucket`` rows.
    """
    stats = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"),
                   F.count(F.lit(1)).alias("n")).first()
    lo, hi, n = stats["lo"], stats["hi"], stats["n"]
    if n_buckets is None:
        parallel = df.sparkSession.sparkContext.defaultParallelism
        n_buckets = max(MIN_BUCKETS_PER_CORE * parallel, math.ceil((n or 0) / rows_per_bucket))
    n_buckets = max(1, min(MAX_BUCKETS, n_buckets))
    none = F.lit(-1).cast("long") if tie is None else F.floor(F.col(tie) / F.lit(1 << 52)).cast("long") - 4096
    if not n or lo is None:
        return df.withColumn(out, none if n else F.lit(0).cast("long"))
    span = hi - lo + 1
    if n * 2 >= span or n_buckets == 1:
        # dense keys: equal-width buckets hold near-equal row counts
        return df.withColumn(out, F.coalesce(F.floor((F.col(key) - F.lit(lo)) * F.lit(n_buckets)
                                                     / F.lit(span)).cast("long"), none))
    from pyspark.ml.feature import Bucketizer

    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = df.agg(F.percentile_approx(key, probs, 10_000).alias("c")).first()["c"]
    splits = [float("-inf")] + sorted(set(float(c) for c in cuts)) + [float("inf")]
    tmp = "_bkey"
    bucketed = Bucketizer(splits=splits, inputCol=tmp, outputCol=out + "_d").transform(
        df.withColumn(tmp, F.coalesce(F.col(key), F.lit(lo)).cast("double")))
    return bucketed.withColumn(out, F.when(F.col(key).isNull(), none).otherwise(F.col(out + "_d").cast("long"))).drop(tmp, out + "_d")


def global_position(df: DataFrame, order: Sequence[str] | str, bucket: Column | str,
                    out: str = "position", partition: Sequence[str] | str | None = None
                    ) -> DataFrame:
    """0-based rank in ``order`` (ties broken by the order columns themselves)."""
    return prefix_sum(df, F.lit(1).cast("long"), order, bucket, out, partition)


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def prefix_agg(df: DataFrame, value: Column | str, order: Sequence[str] | str, bucket: Column | str,
               out: str, partition: Sequence[str] | str | None = None, how: str = "max",
               inclusive: bool = True) -> DataFrame:
    """Running ``min``/``max``/``sum`` in two levels (nulls ignored, like SQL).

    ``max`` over a struct ``(order…, x)`` gives "last non-null x so far"."""
    agg = _AGG[how]
    part = _cols(partition)
    order_cols = _cols(order)
    v = F.col(value) if isinstance(value, str) else value
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    key = _key_name(part)
    tagged = keyed(df.withColumn("_av", v), part, b, key, "_ab")
    per = tagged.groupBy(key, "_ab").agg(agg("_av").alias("_as"))
    before = Window.partitionBy(key).orderBy("_ab").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select(key, "_ab", agg("_as").over(before).alias("_abase"))
    inner = Window.partitionBy(key, "_ab").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    run = agg("_av").over(inner)
    if how == "sum":
        comb = F.coalesce(F.col("_abase"), F.lit(0)) + F.coalesce(run, F.lit(0))
    elif how == "min":
        comb = F.least(F.col("_abase"), run)
    else:
        comb = F.greatest(F.col("_abase"), run)
    return tagged.join(bases, [key, "_ab"]).withColumn(out, comb).drop("_av", "_ab", "_abase", key)


def previous_row(df: DataFrame, cols: Sequence[str], order: Sequence[str] | str, bucket: Column | str,
                 partition: Sequence[str] | str | None = None, prefix: str = "prev_") -> DataFrame:
    """``prev_<col>`` = value on the row just before in ``order`` (two levels):
    ``lag`` inside a bucket, else the last row of the nearest earlier bucket."""
    part = _cols(partition)
    order_cols = _cols(order)
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    key = _key_name(part)
    tagged = keyed(df, part, b, key, "_qb")
    payload = F.struct(*[F.col(c).alias(c) for c in order_cols], *[F.col(c).alias("v_" + c) for c in cols])
    last = tagged.groupBy(key, "_qb").agg(F.max(payload).alias("_ql"))
    prev_b = Window.partitionBy(key).orderBy("_qb")
    carry = last.select(key, "_qb", F.lag("_ql").over(prev_b).alias("_qc"))
    inner = Window.partitionBy(key, "_qb").orderBy(*order_cols)
    out = tagged.join(carry, [key, "_qb"])
    first = F.row_number().over(inner) == 1
    for c in cols:
        out = out.withColumn(prefix + c, F.when(first, F.col("_qc")["v_" + c]).otherwise(F.lag(c).over(inner)))
    return out.drop("_qb", "_qc", key)


def prefix_aggs(df: DataFrame, specs: list[tuple], order: Sequence[str] | str, bucket: Column | str,
                partition: Sequence[str] | str | None = None) -> DataFrame:
    """Several running aggregates over the same order in one two-level pass.

    ``specs`` = ``[(out, value, how, inclusive), …]`` with ``how`` in
    sum/min/max. One per-bucket aggregate table, one join, one inner window
    partitioning for all of them."""
    part = _cols(partition)
    order_cols = _cols(order)
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    key = _key_name(part)
    tagged = keyed(df, part, b, key, "_mb")
    for i, (_, v, _, _) in enumerate(specs):
        tagged = tagged.withColumn(f"_mv{i}", F.col(v) if isinstance(v, str) else v)
    per = tagged.groupBy(key, "_mb").agg(*[_AGG[h](f"_mv{i}").alias(f"_ms{i}")
                                            for i, (_, _, h, _) in enumerate(specs)])
    before = Window.partitionBy(key).orderBy("_mb").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select(key, "_mb", *[_AGG[h](f"_ms{i}").over(before).alias(f"_mbase{i}")
                                       for i, (_, _, h, _) in enumerate(specs)])
    out = tagged.join(bases, [key, "_mb"])
    inner = Window.partitionBy(key, "_mb").orderBy(*order_cols)
    drop = ["_mb", key]
    for i, (name, _, how, inclusive) in enumerate(specs):
        w = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        run = _AGG[how](f"_mv{i}").over(w)
        base = F.col(f"_mbase{i}")
        if how == "sum":
            comb = F.coalesce(base, F.lit(0)) + F.coalesce(run, F.lit(0))
        elif how == "min":
            comb = F.least(base, run)
        else:
            comb = F.greatest(base, run)
        out = out.withColumn(name, comb)
        drop += [f"_mv{i}", f"_mbase{i}"]
    return out.drop(*drop)
