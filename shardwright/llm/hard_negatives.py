"""Hard negatives by a secondary-sort shuffle: scored pairs stream past in order of their keys.

A pair of an anchor and another row is packed into one key of bytes that sorts as (anchor, descending
score, same label first, id). ``repartition(anchor).sortWithinPartitions(key)``, which is
repartitionAndSortWithinPartitions in the DataFrame API, brings an anchor's pairs to one task in order,
and an iterator over Arrow batches reads them once: a pair of the same label (the first five of an
anchor) opens a window of admissible scores, a pair of another label is emitted for every
open window that admits it, until a window has its ten or the scores fall below it. Per anchor only the
windows are held, never its pairs.

Which pairs are worth a key is decided before the shuffle, exactly:

1. One row for each vec_id, as integers, written once to the shared folder.
2. Scores are computed in blocks: rows are dealt by a hash of their id to stripes of at most about
   ``STRIPE_ROWS`` (fewer where that leaves cores idle, at least about ``LEAST_ROWS``), anchors to blocks
   of about ``ANCHOR_ROWS``; stripe and block meet in one cogroup.
   An anchor has at most five positives in a stripe that can be among its first five, and in each
   window at most ten negatives that can be among its first ten: the rest of a stripe is left there.
3. First secondary sort: the positives of all stripes; the first five of each anchor stay.
4. The blocks again, now with the windows of each anchor; second secondary sort with the positives and
   the negatives that are left: windows open and negatives are emitted.

Shuffled are the rows once for each block of anchors and at most 55 pairs for each anchor and stripe.

Defined cases. Rows with a null id, label or vector, or any null or non-finite component take no part;
nor do rows with another length than most vectors have (ties: the longer), or with a component whose
square times the length exceeds 2^62 (their scores would not be longs). Of rows with the same id
the one with the least (label, vector) counts. An anchor without positives, or a positive without
admissible negatives, has no rows. Ties go to the smaller id. An empty table gives an empty result. Other
columns of the input never clash: only the three asked for are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import staged
from shardwright.llm.whitening import dimension, vectors

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90                 # percent of the positive's score that a negative's lies between
STRIPE_ROWS, LEAST_ROWS, ANCHOR_ROWS = 1 << 17, 1 << 11, 1 << 14
CELLS = 1 << 21                    # scores that are held at once
PAIR = "key binary, anchor_id long, score long, id long, same boolean"


def integer_rows(df: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """``(id, label, x)`` of the rows that take part, one for each id."""
    d = dimension(df, vector)
    limit = min((1 << 31) - 1, math.isqrt((1 << 62) // d)) if d else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, v = vectors(batch.column("v"), d)
            x = np.floor(v * SCALE)
            small = (np.abs(x) <= limit).all(1)
            keep = np.flatnonzero(good)[small]
            x = x[small].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep)) for c in ("id", "label")), lists], ["id", "label", "x"])

    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).where(
        "id is not null and label is not null and v is not null" if d else "false")
    return rows.mapInArrow(run, "id long, label long, x array<int>").groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.*")


def matrix(table: pa.Table, column: str, d: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(table.column(column).combine_chunks())).reshape(-1, d)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by float64 where no sum can reach 2^53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative: 30 p <= 100 s <= 90 p."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def big_endian(v: np.ndarray) -> np.ndarray:
    """Longs as 8 bytes each that sort as the numbers do."""
    return ((v.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")).view(np.uint8).reshape(-1, 8)


def packed(anchor: np.ndarray, score: np.ndarray, id_: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
    """Pairs with their key: anchor, score falling, same label first, id."""
    key = np.concatenate([big_endian(anchor), 255 - big_endian(score), (~same).astype(np.uint8)[:, None], big_endian(id_)], 1)
    keys = pa.Array.from_buffers(pa.binary(25), len(key), [None, pa.py_buffer(np.ascontiguousarray(key))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([keys, pa.array(anchor), pa.array(score), pa.array(id_), pa.array(same)],
                                      ["key", "anchor_id", "score", "id", "same"])


def first_positives(score: np.ndarray, same: np.ndarray, self_: np.ndarray, tops: None) -> np.ndarray:
    """Places of the first positives of an anchor; rows are sorted by id."""
    at = np.flatnonzero(same & ~self_)
    if len(at) > POSITIVES:
        least = np.partition(score[at], -POSITIVES)[-POSITIVES]
        at = at[score[at] >= least]
    return at[np.argsort(-score[at], kind="stable")][:POSITIVES]


def first_negatives(score: np.ndarray, same: np.ndarray, self_: np.ndarray, tops: list[int]) -> np.ndarray:
    """Places of the rows that can be among the first negatives of a window."""
    other, chosen = np.flatnonzero(~same), []
    values = score[other]
    for p in tops:
        lo, hi = bounds(p)
        at = np.flatnonzero((values >= lo) & (values <= hi))
        if len(at) > NEGATIVES:
            least = np.partition(values[at], -NEGATIVES)[-NEGATIVES]
            at = at[values[at] >= least]
        chosen.append(at[np.argsort(-values[at], kind="stable")][:NEGATIVES])
    return other[np.unique(np.concatenate(chosen))] if chosen else other[:0]


def pairs(rows: DataFrame, anchors: DataFrame, d: int, choose: Callable) -> DataFrame:
    """For each anchor ``(anchor_id, anchor_label, anchor_x, tops)`` and stripe of ``rows`` the pairs that ``choose`` takes."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    stripes = max(1, math.ceil(n / STRIPE_ROWS), min(math.ceil(n / LEAST_ROWS), 3 * cores))
    blocks = max(1, math.ceil(anchors.count() / ANCHOR_ROWS))
    dealt = lambda key, seed, n: F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("stripe", dealt("id", 41, stripes)).withColumn("block", every(blocks))
    right = anchors.withColumn("anchor_block", dealt("anchor_id", 43, blocks)).withColumn("anchor_stripe", every(stripes))

    def run(stripe: pa.Table, block: pa.Table) -> pa.Table:
        stripe = stripe.sort_by("id")
        ids, labels, x = np.asarray(stripe["id"]), np.asarray(stripe["label"]), matrix(stripe, "x", d)
        own, own_labels, ax = np.asarray(block["anchor_id"]), np.asarray(block["anchor_label"]), matrix(block, "anchor_x", d)
        tops = block["tops"].to_pylist()
        out, tile = [], max(1, CELLS // max(1, len(ids)))
        for at in range(0, len(own) if len(ids) else 0, tile):
            s = scores(ax[at:at + tile], x)
            for j in range(len(s)):
                i = at + j
                same = labels == own_labels[i]
                got = choose(s[j], same, ids == own[i], tops[i])
                if len(got):
                    out.append(packed(np.full(len(got), own[i]), s[j][got], ids[got], same[got]))
        return pa.Table.from_batches(out, packed(*[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)).schema)

    return left.groupBy("block", "stripe").cogroup(right.groupBy("anchor_block", "anchor_stripe")).applyInArrow(run, PAIR)


def in_order(pairs: DataFrame, each: Callable, schema: str) -> DataFrame:
    """The secondary sort: ``each`` gets an iterator over the pairs of a task in order of their keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(zip(*(b.column(c).to_pylist() for c in ("anchor_id", "score", "id", "same"))) for b in batches)

    return pairs.repartition("anchor_id").sortWithinPartitions("key").mapInArrow(run, schema)


def batched(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == 1 << 14:
            yield pa.RecordBatch.from_pydict({n: [h[i] for h in held] for i, n in enumerate(names)})
            held = []
    if held:
        yield pa.RecordBatch.from_pydict({n: [h[i] for h in held] for i, n in enumerate(names)})


def keep_first(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """The first positives of each anchor."""
    def rows() -> Iterator[tuple]:
        anchor, n = None, 0
        for batch in batches:
            for a, score, id_, _ in batch:
                anchor, n = a, n + 1 if a == anchor else 1
                if n <= POSITIVES:
                    yield a, score, id_

    for b in batched(rows(), ["anchor_id", "score", "id"]):
        yield b.cast(pa.schema([("anchor_id", pa.int64()), ("score", pa.int64()), ("id", pa.int64())]))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def emit(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """Opens a window for each positive and emits the negatives that open windows admit."""
    def rows() -> Iterator[tuple]:
        anchor, windows = None, []
        for batch in batches:
            for a, score, id_, same in batch:
                if a != anchor:
                    anchor, windows = a, []
                if same:
                    windows.append([*bounds(score), 0, id_, score])
                    continue
                full = False
                for w in windows:
                    if score < w[0]:
                        w[2] = NEGATIVES                            # scores only fall from here
                    elif score <= w[1] and w[2] < NEGATIVES:
                        w[2] += 1
                        yield a, w[3], w[2], id_, w[4], score
                    full |= w[2] >= NEGATIVES
                if full:
                    windows = [w for w in windows if w[2] < NEGATIVES]

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()),
                        ("positive_score", pa.int64()), ("negative_score", pa.int64())])
    for b in batched(rows(), schema.names):
        yield b.cast(schema)


def mine(df: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """The first negatives of each positive of each anchor; ``is_anchor`` is a condition on the column ``id``."""
    rows = staged(integer_rows(df, vec_id, label, vector), "hard-negative-rows")
    first = rows.limit(1).collect()
    if not first:
        return df.sparkSession.createDataFrame([], RESULT)
    d = len(first[0]["x"])
    anchors = rows.where(is_anchor).select(*(F.col(c).alias(f"anchor_{c}") for c in rows.columns))
    positive = staged(in_order(pairs(rows, anchors.withColumn("tops", F.lit(None).cast("array<long>")), d, first_positives),
                               keep_first, "anchor_id long, score long, id long"), "hard-negative-positives")
    tops = positive.groupBy("anchor_id").agg(F.sort_array(F.collect_list("score"), False).alias("tops"))
    negative = pairs(rows, anchors.join(tops, "anchor_id"), d, first_negatives)
    own = positive.mapInArrow(lambda batches: (packed(*(np.asarray(b.column(c)) for c in ("anchor_id", "score", "id")),
                                                      np.ones(b.num_rows, bool)) for b in batches), PAIR)
    return in_order(negative.unionByName(own), emit, RESULT)
