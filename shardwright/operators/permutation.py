"""Orders in closed form (G10, G14): a seeded bijection from position to index, without a sort.

Six Feistel rounds permute the smallest square power-of-two domain that holds ``n`` numbers; a
result outside ``[0, n)`` goes through them again until it is inside (cycle walking), which keeps the map
a bijection of ``[0, n)`` and takes fewer than four turns on average. The keys come from the seed and
the epoch. Any position can be asked for by itself, so a resumed run makes the batches it
needs and nothing else: no ranking of an epoch, no shuffle, no state.

The number of turns depends on the number, which built-in expressions cannot say; it is numpy over
Arrow batches of a generated range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
MULTIPLIER = 0x45D9F3B
WORD = np.uint64(0xFFFFFFFF)


def half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def round_keys(seed: int, epoch: int) -> list[int]:
    """The first 32 bits of md5("seed+epoch:round") for each round."""
    return [int(hashlib.md5(f"{seed + epoch}:{r}".encode()).hexdigest()[:8], 16) for r in range(ROUNDS)]


def _mixed(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    m = np.uint64(MULTIPLIER)
    t = (half * m + np.uint64(key)) & WORD
    t ^= t >> np.uint64(16)
    t = (t * m) & WORD
    return (t ^ (t >> np.uint64(15))) & mask


def _walk(x: np.ndarray, n: int, once) -> np.ndarray:
    x = once(x.astype(np.uint64))
    outside = np.flatnonzero(x >= n)
    while len(outside):
        x[outside] = once(x[outside])
        outside = outside[x[outside] >= n]
    return x.astype(np.int64)


def index_at(position: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The indices that stand at these positions of an epoch's order of ``[0, n)``."""
    h, keys = half_bits(n), round_keys(seed, epoch)
    mask, h = np.uint64((1 << h) - 1), np.uint64(h)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for k in keys:
            left, right = right, left ^ _mixed(right, k, mask)
        return (left << h) | right

    return _walk(position, n, once)


def position_of(index: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The inverse of ``index_at``."""
    h, keys = half_bits(n), round_keys(seed, epoch)
    mask, h = np.uint64((1 << h) - 1), np.uint64(h)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for k in reversed(keys):
            left, right = right ^ _mixed(left, k, mask), left
        return (left << h) | right

    return _walk(index, n, once)


def orders(spark: SparkSession, n: int, per_epoch: int, first: int, end: int, seed: int) -> DataFrame:
    """``(epoch, position, local_index)`` for the places ``[first, end)`` of a run that takes ``per_epoch``
    places of every epoch's order of ``[0, n)``: a generated range and one pass, no shuffle."""
    from shardwright.operators.packing import range_of

    if first < 0 or not 0 < per_epoch <= n:
        raise ValueError("an epoch takes between one and all of its places, and none before the first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = np.asarray(b.column("place"))
            epoch, position = place // per_epoch, place % per_epoch
            index = np.empty(len(place), np.int64)
            for e in np.unique(epoch):
                own = epoch == e
                index[own] = index_at(position[own], n, seed, int(e))
            yield pa.RecordBatch.from_arrays([pa.array(epoch), pa.array(position), pa.array(index)], ["epoch", "position", "local_index"])

    return range_of(spark, max(0, end - first)).select((F.col("id") + first).alias("place")).mapInArrow(
        run, "epoch long, position long, local_index long")
