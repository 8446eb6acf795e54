"""A bounded, documented sample of labelled rows, and models fitted to it in one task."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_ids(labels: DataFrame, label: str, bound: int, learn: Column, doc_id: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled ids (those with the least hash), ``(doc_id, label)``.

    Rows without id or label are ignored; of contradicting labels the lowest counts."""
    clean = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & learn)
    one = clean.groupBy(doc_id).agg(F.min(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64(F.lit(29), F.col(doc_id)), doc_id).limit(bound)


def with_labels(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents of ``ids``, one for each: of rows that share an id the one whose text has the least hash
    (ties: the least text), so the sample is as small as its bound says. The ids' number is bounded where they are
    drawn (12 bytes a row), so every task gets them all; repeats of an id meet already on the map side."""
    joined = docs.join(F.broadcast(ids), doc_id)
    rest = [c for c in joined.columns if c != doc_id]
    one = joined.groupBy(doc_id).agg(F.min_by(F.struct(*rest), F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("_r"))
    return one.select(doc_id, "_r.*")


def fit_in_one_task(rows: DataFrame, fit: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """``fit`` over the rows of a bounded sample, on one executor; its arrays come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            out = io.BytesIO()
            np.savez_compressed(out, **fit(pa.Table.from_batches(got)))
            yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return dict(np.load(io.BytesIO(bytes(found[0]["model"])))) if found else {}
