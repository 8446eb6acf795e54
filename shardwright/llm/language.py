"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; runs of one to three characters are hashed into buckets. A
bucket's document frequency is counted over every document the model may learn
from. Weights are fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of those documents, so most stay exactly zero; a
temperature fitted on a part of the sample that the weights have not seen turns
scores into probabilities. Documents are scored in Arrow batches without a shuffle.

Defined cases: a null text, an empty one and one without a letter get ``und`` with
score 0; without a learnable document every text is ``und``; with one language all
texts with a letter get it. Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.common import fold
from shardwright.llm.labelled import fit_in_one_task, with_labels
from shardwright.llm.texts import Texts, slices

BITS, GRAMS = 14, (1, 2, 3)
SAMPLE = 4000              # documents the weights are fitted to, at most (per language: a fair share)
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 0.5, 1.0, 2e-4, 1e-5, 4, 32
SCALE = 30.0               # features are term shares times idf times this
SALTS = 32                 # parts of a language when its sample is drawn
UND = "und"


def characters(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of a slice and where its texts end."""
    low = pc.utf8_lower(t.array)
    off = np.concatenate(([0], np.cumsum(pc.utf8_length(low).to_numpy()))).astype(np.int64)
    raw = np.frombuffer(low.buffers()[1], np.int64)[low.offset:low.offset + t.n + 1]
    body = low.buffers()[2].to_pybytes()[raw[0]:raw[-1]] if off[-1] else b""
    return np.frombuffer(body.decode("utf-8", "replace").encode("utf-32-le"), np.uint32), off


def letters(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter."""
    seen = np.zeros(0x110000, bool)
    seen[cps] = True
    for c in np.flatnonzero(seen).tolist():
        seen[c] = chr(c).isalpha()
    return np.diff(np.searchsorted(np.flatnonzero(seen[cps]), off)) > 0


def grams(cps: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per n: the bucket of each run of n characters, and the first and last run of each text."""
    c, out = cps.astype(np.uint64), []
    for n in GRAMS:
        m = max(0, len(c) - n + 1)
        g = np.full(m, n, np.uint64)
        for j in range(n):
            g = (g + c[j:m + j]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(31)
        lo = np.minimum(off[:-1], m)
        out.append(((g >> np.uint64(64 - BITS)).astype(np.int32), lo, np.maximum(lo, np.minimum(off[1:] - n + 1, m))))
    return out


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents in all. A task emits one row, its packed vector
    of counts; vectors are added in a tree of two levels, one held at a time."""
    layout = "task int, counts binary"

    def packed(task: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()),
                                           "counts": pa.array([pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    def unpacked(counts: bytes) -> np.ndarray:
        size = 8 * (1 + (1 << BITS))
        return np.frombuffer(pa.decompress(counts, decompressed_size=size, codec="zstd", asbytes=True), "<i8")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column("counts"):
                total = unpacked(row.as_py()) + (0 if total is None else total)
        if total is not None:
            yield packed(TaskContext.get().partitionId(), total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for _, t in slices(batches, "text"):
            cps, off = characters(t)
            parts = grams(cps, off)
            for at in range(0, t.n, 256):
                to = min(t.n, at + 256)
                held = np.zeros((to - at, 1 << BITS), bool)
                for index, lo, hi in parts:
                    size = hi[at:to] - lo[at:to]
                    held[np.repeat(np.arange(to - at), size), np.concatenate([index[lo[d]:hi[d]] for d in range(at, to)])] = True
                total += held.sum(0)
            n += t.n
        if n:
            yield packed(TaskContext.get().partitionId(), np.concatenate(([n], total)))

    parts = docs.select("text").mapInArrow(run, layout)
    whole = parts.repartition("task").mapInArrow(added, layout).repartition(1).mapInArrow(added, layout).first()
    if whole is None:
        return np.zeros(1 << BITS, np.int64), 0
    counts = unpacked(bytes(whole["counts"]))
    return counts[1:], int(counts[0])


def fit_with(idf: np.ndarray):
    def fit(table: pa.Table) -> dict[str, np.ndarray]:
        names, y = np.unique(np.array(table["label"].to_pylist(), dtype=object).astype(str), return_inverse=True)
        order = np.lexsort((table["rank"].to_numpy(), table["tune"].to_numpy()))
        rows = []
        for _, t in slices(table.select(["text"]).combine_chunks().to_batches(), "text"):
            cps, off = characters(t)
            parts = grams(cps, off)
            for d in range(t.n):
                every = np.concatenate([index[lo[d]:hi[d]] for index, lo, hi in parts])
                i, c = np.unique(every, return_counts=True)
                rows.append((i, c / max(1, len(every)) * idf[i] * SCALE))
        tune = table["tune"].to_numpy()
        train, held = [d for d in order if not tune[d]], [d for d in order if tune[d]]
        k, dim = len(names), 1 << BITS
        z, n = np.zeros((dim, k)), np.zeros((dim, k))

        def weights(i: np.ndarray) -> np.ndarray:
            rate = (BETA + np.sqrt(n[i])) / ALPHA + L2
            return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / rate)

        def logits(batch: list[int], w_of) -> np.ndarray:
            return np.stack([rows[d][1] @ w_of(rows[d][0]) for d in batch])

        for _ in range(EPOCHS):
            for at in range(0, len(train), BATCH):
                batch = train[at:at + BATCH]
                touched, place = np.unique(np.concatenate([rows[d][0] for d in batch]), return_inverse=True)
                w = weights(touched)
                value = np.concatenate([rows[d][1] for d in batch])
                doc = np.repeat(np.arange(len(batch)), [len(rows[d][0]) for d in batch])
                s = np.stack([np.bincount(doc, value * w[place, j], len(batch)) for j in range(k)], 1)
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), y[batch]] -= 1
                g = np.stack([np.bincount(place, value * p[doc, j], len(touched)) for j in range(k)], 1) / len(batch)
                sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / ALPHA
                z[touched] += g - sigma * w
                n[touched] += g * g
        w = weights(np.arange(dim))
        temperature = 1.0
        if held:
            s = logits(held, lambda i: w[i])

            def loss(t: float) -> float:
                q = s / t
                return float((np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(held)), y[held]]).mean())

            temperature = min(np.geomspace(0.05, 20, 200), key=loss)
        return {"weights": (w * idf[:, None] * SCALE).astype(np.float32), "names": names.astype(str),
                "temperature": np.array([temperature])}

    return fit


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model, from the rows of ``docs (doc_id, text, lang)`` that satisfy ``learn``."""
    own = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull())
    df, n = document_frequency(own)
    if not n:
        return {}
    idf = np.log((1 + n) / (1 + df)) + 1
    langs = own.select("lang").distinct().count()
    share = max(1, sample // max(1, langs))
    # a fair share for each language: the least hashes of its ids, first among each of the salts
    # of a language and then among what these leave (SALTS shares at most)
    ranked = Window.partitionBy("label").orderBy("rank", "doc_id")
    salted = Window.partitionBy("label", "_salt").orderBy("rank", "doc_id")
    ids = (own.where("doc_id is not null").select("doc_id", F.col("lang").alias("label"), F.xxhash64(F.lit(31), "doc_id").alias("rank"))
           .withColumn("_salt", F.pmod(F.xxhash64(F.lit(37), "doc_id"), F.lit(SALTS)))
           .withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= share)
           .withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= share).drop("_n", "_salt")
           .orderBy("rank", "doc_id", "label").limit(sample)
           .groupBy("doc_id", "rank").agg(F.min("label").alias("label")))
    rows = with_labels(own.select("doc_id", "text"), ids).select("label", "rank", (F.pmod("rank", F.lit(5)) == 0).alias("tune"), "text")
    return fit_in_one_task(rows, fit_with(idf))


def predict(docs: DataFrame, model: dict[str, np.ndarray], columns: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of ``docs`` with the predicted language and its calibrated probability, called
    ``names`` (which must not be among ``columns``)."""
    kept = docs.select(*columns, *(() if "text" in columns else ("text",)))
    out = docs.select(*columns).withColumn(names[0], F.lit("")).withColumn(names[1], F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches, "text"):
            cps, off = characters(t)
            has = letters(cps, off) & bool(model)
            if model:
                w = model["weights"]
                s, total = np.zeros((t.n, w.shape[1])), np.zeros(t.n)
                for index, lo, hi in grams(cps, off):
                    total += hi - lo
                    for j in range(w.shape[1]):
                        c = np.zeros(len(index) + 1)
                        np.cumsum(w[:, j][index], out=c[1:])
                        s[:, j] += c[hi] - c[lo]
                s /= np.maximum(1, total)[:, None] * model["temperature"][0]
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                name, value = np.where(has, model["names"].astype(object)[best], UND), np.where(has, p[np.arange(t.n), best], 0.0)
            else:
                name, value = np.full(t.n, UND, object), np.zeros(t.n)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(columns)], pa.array(name.tolist(), pa.string()), pa.array(value)], names=[*columns, *names])

    return kept.mapInArrow(run, out.schema)


def learnable(doc_id: str = "doc_id") -> Column:
    """Three quarters of the documents; the rest is held out."""
    return fold(doc_id, 4) != 2
