"""N-gram Jaccard self-join by chosen paths.

A document's set is its distinct runs of five words (one run of all words if it has
fewer). Documents with a Jaccard similarity of at least 0.8 are linked; a class is
a connected group of links.

1. Sketch: one pass over the texts gives each document a digest of its set and a
   MinHash vector. Equal sets are one entry from here on, with a count of copies.
2. Chosen paths: a run starts with all entries in one node. A node samples a
   coordinate or two, and each entry moves on to the child named by its token there
   (the run of words with the least hash), so two sets go the same way with the
   probability of their similarity. Nodes of at most ``LIMIT`` entries are buckets; larger
   ones split again, up to ``DEPTH`` times. The runs of a round are the least for which a
   single link exactly at the threshold, whose nodes stay above ``LIMIT`` through all splits, meets
   in a bucket and agrees there with the chance ``RECALL`` (20 runs for 0.8), over all ways in which
   its two vectors can agree, since the runs of a round share one vector. Other members of a group
   find most links that its own paths miss.
3. Buckets are compared entry by entry on their vectors, and each gives the tree of
   what it joins, not its pairs. The trees make candidate groups. Then recall is measured: the sets of
   ``PROBES`` entries, drawn by a hash, are compared exactly with all rows, and a link of theirs is found
   if its ends lie in one group. Rounds with vectors of their own are added until the measured
   recall reaches ``TARGET``; the figure is logged.
4. Candidate groups get their texts back and all their pairs are decided exactly, on the
   whole sets. Links are counted there and again only a tree leaves the task.

No pair is listed, so a group of thousands of near copies gives thousands of rows, not
millions. A node still above ``LIMIT`` after ``DEPTH`` splits (near copies agree nearly
everywhere) and a candidate group above ``VERIFY`` are dealt into blocks, and every pair of
blocks is compared by itself: nothing is capped, and nothing holds more than two blocks.
The links of a group of g different near copies are g * g decisions, spread over
2 * (g / VERIFY) ** 2 pairs of blocks.

Defined cases: null texts and texts without a word have no set: a class of their own
without links. Null ids take part; their class is named by the least id in it (null if there is
none). Repeated rows are copies. Empty tables give empty results; extra columns are ignored.
Sets are told apart by 64-bit digests, runs of words by 64-bit hashes.
"""

from __future__ import annotations

import logging
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import staged
from shardwright.llm.texts import RUN, Texts, give_back, mix, slices

WORDS, SIMILAR = 5, 0.8
COORDS = 64                # length of a MinHash vector
RECALL = 0.999             # chance that a single link exactly at the threshold is found
DEPTH = 6                  # splits of a node
LIMIT = 2048               # entries of a bucket, compared by their vectors
VERIFY = 512               # sets of a task, compared exactly
SECOND = 4                 # one node in four samples a second coordinate
TARGET = 0.99              # recall of the sampled links at which rounds end
PROBES, PROBE_RUNS = 512, 1 << 15      # sets that recall is measured on, and runs of words of one at most
log = logging.getLogger(__name__)


def agreements(similar: float) -> list[float]:
    """Chance of each number of agreeing coordinates of two vectors."""
    return [math.comb(COORDS, x) * similar ** x * (1 - similar) ** (COORDS - x) for x in range(COORDS + 1)]


def least_agreeing(similar: float) -> int:
    """Coordinates that must agree in a bucket: a quarter of the misses allowed may fall below."""
    below = np.cumsum(agreements(similar))
    return int(np.searchsorted(below, (1 - RECALL) / 4, "right"))


def recall(similar: float, runs: int, agree: int) -> float:
    """Chance that two sets meet in a bucket after all ``DEPTH`` splits, with ``agree`` coordinates alike.

    The runs are independent only for a given number of coordinates that agree."""
    total = 0.0
    for x, chance in enumerate(agreements(similar)):
        together = 1.0
        for _ in range(DEPTH + 1):
            on = x / COORDS * together
            together = on + on * (1 - on) / SECOND
        total += chance * (1 - (1 - together) ** runs) * (x >= agree)
    return total


def runs_needed(similar: float, agree: int) -> int:
    """The least number of runs with a recall of ``RECALL``."""
    high = 1
    while recall(similar, high, agree) < RECALL:
        high *= 2
    return next(r for r in range(high // 2 + 1, high + 1) if recall(similar, r, agree) >= RECALL)


def word_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Runs of five words of all texts in a row, and where each text's runs begin and end."""
    t.split()
    runs, at = t.runs(WORDS)
    firsts = np.concatenate(([0], np.cumsum(t.count)))
    size = np.where((t.count > 0) & (t.count < WORDS), 1, np.maximum(0, t.count - WORDS + 1))
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(ends[-1], np.uint64)
    long = np.repeat(t.count >= WORDS, size)
    out[long] = runs
    h = t.word_hash()
    for d in np.flatnonzero((t.count > 0) & (t.count < WORDS)):
        w = h[firsts[d]:firsts[d + 1]]
        out[ends[d]] = mix(np.array([(w * RUN[8:8 + len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))[0]
    return out, ends


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, whatever its order."""
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ RUN[15]).sum(dtype=np.uint64).astype(np.int64))


def _sketch(number: int):
    """The sketches of a round: each has its own scrambles of the runs."""
    scale = np.random.default_rng(0xC0DE + number).integers(1, 1 << 62, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches, "text"):
            runs, ends = word_sets(t)
            held = np.flatnonzero(np.diff(ends))
            vector = np.zeros((t.n, COORDS), np.uint32)
            for c in range(COORDS if len(held) else 0):
                vector[held, c] = np.minimum.reduceat(runs * scale[c], ends[held]) >> np.uint64(32)
            name = [None] * t.n
            for d in held.tolist():
                name[d] = digest(np.unique(runs[ends[d]:ends[d + 1]]))
            raw = vector.tobytes()
            w = COORDS * 4
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("_h"), pa.array([x and x[0] for x in name], pa.int64()), pa.array([x and x[1] for x in name], pa.int64()),
                pa.array([raw[d * w:(d + 1) * w] if name[d] else None for d in range(t.n)], pa.binary())],
                names=["doc_id", "_h", "d1", "d2", "vector"])

    return run


def sketches(own: DataFrame, number: int = 0) -> DataFrame:
    """``doc_id, _h, rid, vector`` of every row: ``rid`` names its set (null: none)."""
    return staged(own.mapInArrow(_sketch(number), "doc_id long, _h long, d1 long, d2 long, vector binary")
                  .withColumn("rid", F.when(F.col("d1").isNotNull(), F.xxhash64("d1", "d2"))), "sketch")


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from rows sorted by ``key``, and where each group begins."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))                            # the last group may go on
        if last or (rest and rest[0].column(key)[0].as_py() != k[0]):
            table = pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = []
            if table.num_rows:
                v = table[key].to_numpy()
                yield table, np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        rest.append(batch.slice(last))
    if rest:
        table = pa.Table.from_batches(rest)
        v = table[key].to_numpy()
        yield table, np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's group under the links ``a - b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
    return label


def _bucket_trees(agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups_of(batches, "key"):
            rid = table["rid"].to_numpy()
            vector = np.frombuffer(b"".join(table["vector"].to_pylist()), np.uint32).reshape(-1, COORDS)
            ends = np.append(starts[1:], len(rid))
            group = np.repeat(np.arange(len(starts)), ends - starts)
            left, right = [], []
            small = (ends - starts <= 24)[group]
            for step in range(1, 24):                                        # all small buckets together
                i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
                if not len(i):
                    break
                i = i[(vector[i] == vector[i + step]).sum(1) >= agree]
                left.append(i), right.append(i + step)
            for g in np.flatnonzero(ends - starts > 24).tolist():
                v, one, two = vector[starts[g]:ends[g]], [], []
                for at in range(0, len(v), 32):
                    i, j = np.nonzero((v[at:at + 32, None, :] == v[None, at:, :]).sum(2) >= agree)
                    one.append((at + i).astype(np.int32)), two.append((at + j).astype(np.int32))
                # only the tree of a large bucket is kept beside the next one's pairs
                left.append(np.arange(starts[g], ends[g])), right.append(starts[g] + roots(len(v), np.concatenate(one), np.concatenate(two)))
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            label = roots(len(rid), a, b)
            moved = np.flatnonzero(rid != rid[label])
            yield pa.RecordBatch.from_pydict({"a": pa.array(rid[moved]), "b": pa.array(rid[label[moved]])})
        give_back()

    return run


def dealt_in_blocks(rows: DataFrame, group: str, n: str, member: str, limit: int) -> DataFrame:
    """``key, block, cross``: a group of at most ``limit`` is one key; a larger one is dealt into
    blocks by a hash of ``member``, and each pair of blocks is a key."""
    blocks = F.ceil(F.col(n) * 2 / F.lit(limit)).cast("int")
    own = F.when(F.col(n) > limit, F.pmod(F.xxhash64(F.lit(3), member), blocks)).otherwise(F.lit(0)).cast("int")
    other = F.explode(F.when(F.col(n) > limit, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0))))
    return (rows.withColumn("block", own).withColumn("_o", other)
            .withColumn("key", F.xxhash64(F.col(group), F.least("block", "_o"), F.greatest("block", "_o")))
            .withColumn("cross", F.col("block") != F.col("_o")).drop("_o"))


def chosen_paths(entries: DataFrame, runs: int, seed: int = 5) -> DataFrame:
    """``(rid, key)``: the buckets of every entry in which it is not alone."""
    draw = random.Random(seed)
    first = []
    for run in range(runs):
        for c in draw.sample(range(COORDS), 2 if draw.randrange(SECOND) == 0 else 1):
            first.append(F.xxhash64(F.lit(run), F.lit(c), F.substring("vector", 4 * c + 1, 4)))
    rows = entries.select("rid", F.explode(F.array(*first)).alias("node"))
    found = None
    for level in range(DEPTH + 1):
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = staged(rows.join(counts, "node"), "paths")
        fit = sized if level == DEPTH else sized.where(F.col("n") <= LIMIT)
        fit = dealt_in_blocks(fit, "node", "n", "rid", LIMIT).select("rid", "key")
        found = fit if found is None else found.unionByName(fit)
        large = sized.where(F.col("n") > LIMIT)
        if level == DEPTH or large.isEmpty():
            return found
        one = F.pmod(F.xxhash64(F.lit(seed + level), "node"), F.lit(COORDS)).cast("int")
        two = F.pmod(F.xxhash64(F.lit(seed - level - 1), "node"), F.lit(COORDS)).cast("int")
        coords = F.when(F.pmod(F.xxhash64(F.lit("two"), F.lit(level), "node"), F.lit(SECOND)) == 0, F.array_distinct(F.array(one, two))).otherwise(F.array(one))
        rows = (large.join(entries, "rid").select("rid", "vector", "node", F.explode(coords).alias("c"))
                .select("rid", F.xxhash64("node", "c", F.expr("substring(vector, 4 * c + 1, 4)")).alias("node")))
    return found


def settled(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``: the edges are stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 or (low = 1 and top = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(rid, root)`` for every end of an edge: the least id of its connected group.

    Alternating large and small stars: each round every entry points its neighbours to the
    least of them. Rows stay linear in the edges; a hub's rows are split by the join."""
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        e = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "small-star")
    return e.select(F.col("u").alias("rid"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("rid"), F.col("v").alias("root")).distinct())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, t in slices(batches, "text"):
        runs, ends = word_sets(t)
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in ("rid", "copies", "root", "n")),
             pa.array([np.unique(runs[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
            names=["rid", "copies", "root", "n", "runs"])


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: a product of incidence matrices, some thousands of runs at a time."""
    every = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(new) - 1
    held = np.bincount(column)[column] > 1                               # runs of one set share nothing
    who, column = who[held], column[held]
    out = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
        for at in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(column, (at, at + 4096))
            m = np.zeros((len(sets), 4096), np.float32)
            m[who[lo:hi], column[lo:hi] - at] = 1
            out += m @ m.T
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups_of(batches, "key"):
            ends = np.append(starts[1:], table.num_rows)
            rid, copies = table["rid"].to_numpy(), table["copies"].to_numpy()
            block, cross = table["block"].to_numpy(), table["cross"].to_numpy(zero_copy_only=False)
            raw = table["runs"]
            for a, b in zip(starts.tolist(), ends.tolist()):
                _, keep = np.unique(rid[a:b], return_index=True)         # repeated rows bring a set twice
                keep += a
                sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in keep]
                size = np.array([len(s) for s in sets], np.float32)
                both = shared(sets)
                link = both >= np.float32(threshold) * (size[:, None] + size[None, :] - both) - np.float32(1e-4)
                np.fill_diagonal(link, False)
                if cross[keep].any():
                    link &= block[keep][:, None] != block[keep][None, :]
                i, j = np.nonzero(link)
                label = roots(len(keep), i, j)
                yield pa.RecordBatch.from_pydict({"rid": pa.array(rid[keep]), "tree": pa.array(rid[keep][label]),
                                                  "links": pa.array(link.astype(np.int64) @ copies[keep])})
        give_back()

    return run


def probe_sets(own: DataFrame, entries: DataFrame) -> dict[int, np.ndarray]:
    """The sets of ``PROBES`` entries drawn by a hash; those of more than ``PROBE_RUNS`` runs are not used."""
    drawn = (entries.orderBy(F.xxhash64(F.lit(17), "rid"), "rid").limit(PROBES)
             .select("rid", F.col("row.doc_id").alias("_id"), F.col("row._h").alias("_g")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches, "text"):
            runs, ends = word_sets(t)
            sets = [np.unique(runs[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([s.tobytes() if len(s) <= PROBE_RUNS else None for s in sets], pa.binary())], ["rid", "runs"])

    # a probe's row by its id and the hash of its text; both are bounded by PROBES
    rows = own.join(F.broadcast(drawn), own["doc_id"].eqNullSafe(drawn["_id"]) & (own["_h"] == drawn["_g"])).select("rid", "text")
    got = rows.mapInArrow(run, "rid long, runs binary").where("runs is not null").groupBy("rid").agg(F.first("runs").alias("runs")).collect()
    return {r["rid"]: np.frombuffer(r["runs"], np.uint64) for r in got}


def probed_links(own: DataFrame, probes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """``rid, probes``: for every set that is at least ``threshold`` similar to a probe's, the numbers of these
    probes: one row for each set, decided on whole sets."""
    sets = list(probes.values())
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    keys, first = np.unique(every, return_index=True)
    first = np.append(first, len(every))
    size = np.array([len(x) for x in sets], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in slices(batches, "text"):
            runs, ends = word_sets(t)
            near = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            real = keys[near] == runs
            matched = np.concatenate(([0], np.cumsum(real)))[ends]
            out = []
            for d in np.flatnonzero(matched[1:] > matched[:-1]).tolist():
                a, b = ends[d], ends[d + 1]
                own_set = np.unique(runs[a:b])
                own_keys = np.unique(near[a:b][real[a:b]])
                if len(own_keys) < threshold * len(own_set) - 1e-4:          # too few for any probe
                    continue
                both = np.bincount(np.concatenate([who[first[k]:first[k + 1]] for k in own_keys]), minlength=len(sets))
                links = np.flatnonzero(both >= threshold * (size + len(own_set) - both) - 1e-4)
                if len(links):
                    out.append((*digest(own_set), links.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                              pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["d1", "d2", "probes"])

    hits = own.select("text").mapInArrow(run, "d1 long, d2 long, probes array<int>").select(F.xxhash64("d1", "d2").alias("rid"), "probes")
    return hits.groupBy("rid").agg(F.first("probes").alias("probes"))


def found_share(links: DataFrame, probes: list[int], groups: DataFrame) -> tuple[int, int]:
    """Of the probes' links to other sets: how many lie in one candidate group, and how many there are."""
    place = {r["rid"]: r["root"] for r in groups.where(F.col("rid").isin(probes)).select("rid", "root").collect()}
    roots_of = F.array(*(F.lit(place.get(p)).cast("long") for p in probes))
    names = F.array(*(F.lit(p).cast("long") for p in probes))
    other = F.filter("probes", lambda i: F.get(names, i) != F.col("rid"))
    held = F.filter(other, lambda i: F.get(roots_of, i) == F.col("root"))
    got = links.join(groups, "rid", "left").agg(F.coalesce(F.sum(F.size(held)), F.lit(0)).alias("found"), F.coalesce(F.sum(F.size(other)), F.lit(0)).alias("all")).first()
    return int(got["found"]), int(got["all"])


def candidate_groups(own: DataFrame, entries: DataFrame, threshold: float, runs: int | None, target: float = TARGET) -> DataFrame:
    """``rid, root``: groups that hold the links; rounds of chosen paths until ``target`` of the probed links is in them."""
    agree = least_agreeing(threshold)
    runs = runs or runs_needed(threshold, agree)
    edges, links, probes, number, vectors = None, None, {}, 0, entries.select("rid", "vector")
    while True:
        buckets = chosen_paths(vectors, runs, 5 + 100 * number).join(vectors, "rid")
        trees = buckets.repartition("key").sortWithinPartitions("key").select("key", "rid", "vector").mapInArrow(_bucket_trees(agree), "a long, b long")
        edges = staged(trees if edges is None else trees.unionByName(edges), "trees")
        groups = staged(components(edges), "groups")
        if links is None:
            probes = probe_sets(own, entries)
            links = staged(probed_links(own, probes, threshold), "probed") if probes else None
        found, every = found_share(links, list(probes), groups) if probes else (0, 0)
        log.info("round %d of %d runs: %d of %d links of %d probed sets found", number + 1, runs, found, every, len(probes))
        if found >= target * every:
            return groups
        number += 1
        vectors = staged(sketches(own, number).where("rid is not null").groupBy("rid").agg(F.first("vector").alias("vector")), "vectors")


def classes(docs: DataFrame, threshold: float = SIMILAR, runs: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links`` and ``_h`` (a hash of the text) for each row of ``docs``.

    ``class_id`` is the least ``doc_id`` of the class, ``n_links`` the number of other rows whose sets
    are at least ``threshold`` similar. ``runs``: of chosen paths in a round, by default as many as ``RECALL`` needs."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_h"))
    sketch = sketches(own)
    entries = staged(sketch.where("rid is not null").groupBy("rid").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "_h")).alias("row"), F.count(F.lit(1)).alias("copies"),
        F.first("vector").alias("vector")), "entries")
    groups = candidate_groups(own, entries, threshold, runs)
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = staged(groups.join(sizes, "root").join(entries.select("rid", "row", "copies"), "rid")
                     .select("rid", "copies", "root", "n", F.col("row.doc_id").alias("_id"), F.col("row._h").alias("_h")), "members")
    texts = own.join(members.hint("shuffle_hash"), own["doc_id"].eqNullSafe(members["_id"]) & (own["_h"] == members["_h"]))
    sets = texts.select("rid", "copies", "root", "n", "text").mapInArrow(
        _sets, "rid long, copies long, root long, n long, runs binary")
    verified = staged(dealt_in_blocks(sets, "root", "n", "rid", VERIFY).repartition("key").sortWithinPartitions("key")
                      .select("key", "rid", "copies", "block", "cross", "runs").mapInArrow(_verify(threshold), "rid long, tree long, links long"), "verified")
    links = verified.groupBy("rid").agg(F.sum("links").alias("links"))
    final = components(verified.select(F.col("rid").alias("a"), F.col("tree").alias("b")))
    named = entries.select("rid", "least", "copies").join(final, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    answer = (named.join(least, "root").join(links, "rid", "left")
              .select("rid", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return sketch.select("doc_id", "_h", "rid").join(answer, "rid", "left").select(
        "doc_id", F.when(F.col("rid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "_h", F.col("root"))


def deduplicate(docs: DataFrame, threshold: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each class (the one with the least id, then text hash)."""
    found = staged(classes(docs, threshold, doc_id=doc_id, text=text), "classes")
    kept = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "_h")).alias("row"))
    gone = (found.where("root is not null").groupBy("root", "doc_id", "_h").agg(F.count(F.lit(1)).alias("n")).join(kept, "root")
            .withColumn("stays", F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("_h") == F.col("row._h")))
            .where("not stays or n > 1").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g"), "stays"))
    keyed = docs.withColumn("_x", F.xxhash64(text))
    on = keyed[doc_id].cast("long").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_g"))
    rest = keyed.join(gone.select("_d", "_g").hint("shuffle_hash"), on, "left_anti").select(*docs.columns)
    twice = keyed.join(gone.where("stays").select("_d", "_g"), on, "left_semi").dropDuplicates([doc_id, "_x"]).select(*docs.columns)
    return rest.unionByName(twice)
