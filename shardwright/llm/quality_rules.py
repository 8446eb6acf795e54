"""Quality rules and a hashed logistic regression.

Fixed rules on word statistics come first. What they leave is judged by a logistic
regression over hashed word unigrams and bigrams and character 3- and 5-grams (code points), trained on
a bounded sample of labelled documents, calibrated by Platt's method on a part of
it that the weights were not fitted to, and compared with a fixed threshold.
Documents are scored in Arrow batches; no row is shuffled.

Defined cases: a null text has no words and fails the base rules; so do texts of
fewer than 50 words. Without any labelled row, or with one class only, the rules
alone decide (probability 1). Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import fold
from shardwright.llm.labelled import fit_in_one_task, labelled_ids, with_labels
from shardwright.llm.texts import SYMBOL, Texts, slices

BITS = 16                  # buckets for words and as many for runs of characters
GRAMS = (3, 5)
SAMPLE = 2000              # labelled documents the model is fitted to, at most
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
STEPS, RATE, RIDGE = 60, 0.5, 1e-6


def buckets(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per feature group: the bucket of each occurrence and where the texts' occurrences end."""
    cut = np.uint64(64 - BITS)
    words = t.word_hash()
    pairs, at = t.runs(2)
    firsts = np.concatenate(([0], np.cumsum(t.count)))
    out = [((words >> cut).astype(np.int32), firsts),
           ((pairs >> cut).astype(np.int32), np.searchsorted(at, firsts))]
    c, off = code_points(t)
    for n in GRAMS:
        m = max(0, len(c) - n + 1)
        g = np.full(m, n, np.uint64)
        for j in range(n):                                                 # three bytes hold any character
            g = (g * np.uint64(0xBF58476D1CE4E5B9)) ^ c[j:m + j]
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        stop = np.maximum(off[1:] - n + 1, off[:-1])                       # runs inside one text
        out.append(((g >> cut).astype(np.int32), np.stack((np.minimum(off[:-1], m), np.minimum(stop, m)))))
    return out


def code_points(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a slice as numbers, and where its texts end among them."""
    first = (t.buf & 0xC0) != 0x80                                         # bytes that begin a character
    off = np.concatenate(([0], np.cumsum(first)))[t.off]
    return np.frombuffer(t.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), off


GROUPS = 2 + len(GRAMS)


def bounds(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (at[0], at[1]) if at.ndim == 2 else (at[:-1], at[1:])


def score(t: Texts, weights: np.ndarray, bias: float) -> np.ndarray:
    """Linear score of each text: weights averaged over the occurrences of each group."""
    total = np.full(t.n, bias)
    for g, (index, at) in enumerate(buckets(t)):
        c = np.zeros(len(index) + 1)
        np.cumsum(weights[g][index], out=c[1:])
        lo, hi = bounds(at)
        total += (c[hi] - c[lo]) / np.maximum(1, hi - lo)
    return total


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, t in slices(batches, "text"):
        t.split()
        rows: list[list[np.ndarray]] = [[[], []] for _ in range(t.n)]
        for g, (index, at) in enumerate(buckets(t)):
            lo, hi = bounds(at)
            for d in range(t.n):
                i, c = np.unique(index[lo[d]:hi[d]], return_counts=True)
                rows[d][0].append(i.astype(np.int32) + (g << BITS))
                rows[d][1].append((c / max(1, hi[d] - lo[d])).astype(np.float32))
        yield pa.RecordBatch.from_pydict({
            "label": part.column("label"), "tune": part.column("tune"),
            "index": pa.array([np.concatenate(r[0]) for r in rows], pa.list_(pa.int32())),
            "value": pa.array([np.concatenate(r[1]) for r in rows], pa.list_(pa.float32()))})


def fit(table: pa.Table) -> dict[str, np.ndarray]:
    """Class-balanced logistic regression (Adam on the whole sample), then Platt's two numbers."""
    y, tune = table["label"].to_numpy().astype(float), table["tune"].to_numpy()
    lists = table["index"].combine_chunks()
    value = table["value"].combine_chunks().flatten().to_numpy().astype(np.float64)
    index, lens = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(y)), lens)
    if len(np.unique(y[~tune])) < 2:
        return {}
    w, bias = np.zeros(GROUPS << BITS), 0.0
    share = y[~tune].mean()
    gain = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * ~tune / max(1, (~tune).sum())
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    linear = lambda: np.bincount(row, value * w[index], len(y)) + bias
    for step in range(1, STEPS + 1):
        err = (1 / (1 + np.exp(-np.clip(linear(), -30, 30))) - y) * gain
        g, gb = np.bincount(index, value * err[row], len(w)) + RIDGE * w, err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9 ** step, 1 - 0.99 ** step
        w -= RATE * (m / fix) / (np.sqrt(v / fix2) + 1e-7)
        bias -= RATE * (mb / fix) / (np.sqrt(vb / fix2) + 1e-7)
    z, t = linear()[tune], y[tune]
    a, b = 1.0, 0.0
    if len(np.unique(t)) == 2:
        scale = max(1e-9, z.std())
        goal = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))      # Platt's smoothed targets
        x, a = z / scale, 1.0
        for _ in range(50):                                                                # Newton in two unknowns
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            q = p * (1 - p) + 1e-9
            h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-3]])
            da, db = np.linalg.solve(h, [((p - goal) * x).sum() + 1e-3 * a, (p - goal).sum()])
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        a /= scale
    return {"weights": w.reshape(GROUPS, -1).astype(np.float32), "numbers": np.array([bias, a, b])}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model, from labelled documents outside the held-out fifth."""
    ids = labelled_ids(labels, "quality", sample, fold("doc_id", 5) != 0).withColumn("tune", fold("doc_id", 5) == 1)
    rows = with_labels(docs.select("doc_id", "text"), ids).select("label", "tune", "text")
    sparse = rows.mapInArrow(featurise, "label int, tune boolean, index array<int>, value array<float>")
    return fit_in_one_task(sparse, fit)


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, probability double")


def judge(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """Rule counts, calibrated probability of good quality and the verdict of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches, "text"):
            t.split()
            letters = np.concatenate(([0], np.cumsum(t.inside & ((t.buf & 0xC0) != 0x80))))
            repeats = t.repeated_words(3)
            failed = (t.count < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PCT * t.count)
            if model:
                bias, a, b = model["numbers"]
                p = 1 / (1 + np.exp(-np.clip(a * score(t, model["weights"], bias) + b, -30, 30)))
            else:
                p = np.ones(t.n)
            longs = lambda x: pa.array(np.asarray(x, np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": longs(t.count), "word_chars": longs(np.diff(letters[t.off])),
                "n_symbols": longs(t.per_text(SYMBOL[t.buf])), "n_dup_lines": longs(t.repeated_lines()),
                "n_repeat_words": longs(repeats), "base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= threshold)),
                "probability": pa.array(p)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
