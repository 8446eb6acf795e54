"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text (lengths, shares of character classes, repetition) are
computed in Arrow batches. Trees of fixed depth are grown on binned statistics of a
bounded sample of labelled documents: a level's histograms give the gain of every
split at once. The forest is flattened into arrays (feature, threshold, children,
value), which a batch descends together, one level at a time.

Defined cases: null and empty texts have all statistics zero and are scored like any
other; without labels, or with one class, the score is the share of label 1 (0.5
without any). Repeated rows are scored alike; extra columns are ignored.
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

SAMPLE = 12_000            # labelled documents the trees are grown on, at most
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 80, 0.15, 1.0, 8
THRESHOLD = 0.3
_ALL = np.arange(256)
CLASSES = {"upper": (_ALL >= 65) & (_ALL <= 90), "lower": (_ALL >= 97) & (_ALL <= 122), "digit": (_ALL >= 48) & (_ALL <= 57),
           "symbol": SYMBOL, "bang": np.isin(_ALL, list(b"!?")), "stop": np.isin(_ALL, list(b".,;:")),
           "wide": _ALL >= 128, "bar": _ALL == 124, "feed": _ALL == 10, "quote": np.isin(_ALL, list(b"'\"()[]{}/\\=_-+@"))}


def statistics(t: Texts) -> np.ndarray:
    """One row of numbers per text."""
    t.split()
    size, n = np.diff(t.off), t.count
    by_byte = 1 / np.maximum(1, size)
    by_word = 1 / np.maximum(1, n)
    out = [np.log1p(size), np.log1p(n)]
    for of in CLASSES.values():
        out.append(t.per_text(of[t.buf]) * by_byte)
    length = (t.end - t.start).astype(float)
    firsts = np.concatenate(([0], np.cumsum(n)))
    mean = t.sums_of(length, firsts) * by_word
    out += [mean, np.sqrt(np.maximum(0, t.sums_of(length * length, firsts) * by_word - mean * mean))]
    tail = t.buf[t.end - 1] if len(t.end) else np.zeros(0, np.uint8)
    head = t.buf[t.start] if len(t.start) else np.zeros(0, np.uint8)
    for flag in (CLASSES["bang"][tail], SYMBOL[tail], CLASSES["upper"][head], CLASSES["upper"][tail], length == 1, length > 12):
        out.append(np.bincount(t.doc[flag], minlength=t.n) * by_word)
    words = t.word_hash()
    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (t.doc[1:] == t.doc[:-1])
    out.append(np.bincount(t.doc[same], minlength=t.n) * by_word)
    key = np.sort(t.doc.astype(np.uint64) << np.uint64(40) | words >> np.uint64(24))     # distinct words of each text
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    out.append(np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=t.n) / np.sqrt(np.maximum(1, n)))
    _, doc, width = t.lines()
    lines = np.bincount(doc, minlength=t.n)
    out += [np.log1p(lines), np.bincount(doc, width, t.n) / np.maximum(1, lines) / 100, t.repeated_lines() / np.maximum(1, lines),
            t.repeated_words(2) * by_word, t.repeated_words(3) * by_word]
    return np.stack(out, 1).astype(np.float32)


def grow(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Boosted trees for the logistic loss; complete binary trees laid out level by level."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)      # x <= edges[b] iff bin <= b
    feats, inner, leaves = x.shape[1], (1 << DEPTH) - 1, 1 << DEPTH
    base = np.log(y.mean() / (1 - y.mean()))
    s = np.full(len(y), base)
    feature, threshold = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf, np.float32)
    value = np.zeros((TREES, leaves), np.float32)
    offset = np.arange(feats) * BINS
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-s))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width = 1 << level
            cell = (node[:, None] * feats * BINS + offset + binned).ravel()
            hist = lambda v: np.bincount(cell, np.repeat(v, feats), width * feats * BINS).reshape(width, feats, BINS)
            gl, hl, nl = (np.cumsum(hist(v), 2) for v in (g, h, np.ones(len(y))))
            ga, ha, na = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl ** 2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga ** 2 / (ha + RIDGE)
            gain = np.where((nl >= LEAST) & (na - nl >= LEAST), gain, 0.0).reshape(width, -1)
            best = gain.argmax(1)
            f, b = best // BINS, best % BINS
            split = gain[np.arange(width), best] > 1e-9
            cut = np.array([edges[i][j] if ok and j < len(edges[i]) else np.inf for i, j, ok in zip(f, b, split)])
            at = slice(width - 1, 2 * width - 1)
            feature[tree, at], threshold[tree, at] = np.where(split, f, 0), cut
            go = x[np.arange(len(y)), feature[tree, at][node]] > threshold[tree, at][node]
            node = 2 * node + go
        value[tree] = -RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + RIDGE)
        s += value[tree][node]
    return {"feature": feature, "threshold": threshold, "value": value, "base": np.array([base])}


def descend(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of label 1 for each row: all rows go down a tree together."""
    s = np.full(len(x), model["base"][0])
    rows = np.arange(len(x))
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        s += value[node - len(feature)]
    return 1 / (1 + np.exp(-s))


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, t in slices(batches, "text"):
        x = statistics(t)
        yield pa.RecordBatch.from_pydict({"label": part.column("label"), "x": pa.array(list(x), pa.list_(pa.float32()))})


def fit(table: pa.Table) -> dict[str, np.ndarray]:
    x = np.stack(table["x"].to_numpy())
    y = table["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))                     # the same forest whatever the order of the rows
    if len(np.unique(y)) < 2:
        return {"base": np.array([30.0 if y[0] else -30.0]), "feature": np.zeros((0, 0)), "threshold": np.zeros((0, 0)), "value": np.zeros((0, 0))}
    return grow(x[order], y[order])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The forest, from labelled documents outside the held-out fifth."""
    ids = labelled_ids(labels, "quality", sample, fold("doc_id", 5) != 0)
    rows = with_labels(docs.select("doc_id", "text"), ids).select("label", "text")
    return fit_in_one_task(rows.mapInArrow(measure, "label int, x array<float>"), fit)


def classify(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches, "text"):
            p = descend(statistics(t), model) if model else np.full(t.n, 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(p.astype(float)),
                                              "predicted": pa.array((p >= threshold).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
