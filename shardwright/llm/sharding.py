"""Uniform shuffle into shards of exact size (DataFrame functions only).

The rows lie in blocks; how many of a block's rows go to each shard is drawn first,
as a matrix whose row sums are the block sizes and whose column sums are the shard
sizes. Drawing it from the multivariate hypergeometric law and then dealing the
rows of each block in random order gives every assignment with those shard sizes
the same probability, so no row needs to know of any other block's rows:

1. count equal rows first (map-side combined) and number the copies of each, in stretches of ``COPIES``; so
   every row has an identity of its own, and copies of one row are dealt like different rows, however
   many there are. Count the rows of each block (hash of that identity, so every retry agrees);
2. draw the matrix by halving: a node of a binary tree over the blocks gives its left
   half a hypergeometric share of each shard's remaining places, the right half gets
   the rest. A level is a projection and a generate over the nodes; one row per block
   comes out, and each draw is an inversion around the mode in built-in functions;
3. permute locally: number the rows of a block by a seeded hash and deal them out
   against the cumulated row of the matrix;
4. exchange, and permute again: slots of a shard come from a second hash, in
   sub-buckets of bounded size whose sizes give the first slot of each.

Laws: ``rows`` (shard sizes at most one apart). Defined cases: a null text has size 1
and the checksum of no bytes; null ids are identities like others; repeated rows are
dealt like any two rows (a third of all rows may be one row repeated); with fewer rows than
shards some shards stay empty; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.common import let, staged, utf8

BLOCK_ROWS = 4096          # rows of a block, about
COPIES = 4096              # copies of one row that are written out by one row of a task
SLOT_ROWS = 50_000         # rows of a sub-bucket of a shard, about
MAX_BLOCKS = 1 << 15       # beyond, blocks grow instead: the counts of all blocks are one array


def uniform(*parts: Column) -> Column:
    """A seeded uniform number in [0, 1) with 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """Number of ``good`` among ``draws`` out of ``total``, by inversion of ``u``.

    Outcomes are laid out from the mode upwards, then downwards; beyond 12 standard
    deviations plus 40 their mass is below what a double can hold."""
    d = lambda c: c.cast("double")

    def walk(p: Column) -> Column:
        lo, hi = F.greatest(F.lit(0).cast("long"), p["draws"] - p["N"] + p["K"]), F.least(p["draws"], p["K"])
        mode = F.least(hi, F.greatest(lo, F.floor((d(p["draws"]) + 1) * (d(p["K"]) + 1) / (d(p["N"]) + 2)).cast("long")))
        var = d(p["draws"]) * d(p["K"]) / d(p["N"]) * (d(p["N"]) - d(p["K"])) / d(p["N"])
        half = F.ceil(F.lit(12.0) * F.sqrt(var) + 40).cast("long")
        return let(F.struct(p["N"].alias("N"), p["K"].alias("K"), p["draws"].alias("draws"), p["u"].alias("u"), mode.alias("mode"),
                            F.greatest(lo, mode - half).alias("lo"), F.least(hi, mode + half).alias("hi")), invert)

    def up(p: Column, k: Column) -> Column:        # P(k) / P(k - 1)
        return d(p["K"] - k + 1) * d(p["draws"] - k + 1) / (d(k) * d(p["N"] - p["K"] - p["draws"] + k))

    def sides(p: Column) -> tuple[Column, Column]:
        none = F.array().cast("array<bigint>")
        above = F.when(p["hi"] > p["mode"], F.sequence(p["mode"] + 1, p["hi"])).otherwise(none)
        below = F.when(p["lo"] < p["mode"], F.sequence(p["mode"] - 1, p["lo"], F.lit(-1).cast("long"))).otherwise(none)
        return above, below

    def invert(p: Column) -> Column:
        above, below = sides(p)
        # state: the last outcome's weight, the sum so far, the sought sum, the outcome found (-1: none yet)
        def run(ks: Column, start: Column, ratio) -> Column:
            return F.aggregate(ks, start, lambda s, k: let(s["w"] * ratio(k), lambda w: F.struct(
                w.alias("w"), (s["sum"] + w).alias("sum"), s["goal"].alias("goal"),
                F.when((s["k"] < 0) & (s["sum"] + w > s["goal"]), k).otherwise(s["k"]).alias("k"))))

        def state(total: Column, goal: Column, found: Column) -> Column:
            return F.struct(F.lit(1.0).alias("w"), total.alias("sum"), goal.alias("goal"), found.alias("k"))

        def both(goal: Column, found: Column) -> Column:
            rise = run(above, state(F.lit(1.0), goal, found), lambda k: up(p, k))
            return let(rise, lambda r: run(below, state(r["sum"], goal, r["k"]), lambda k: F.lit(1.0) / up(p, k + 1)))

        none = F.lit(-1).cast("long")
        mass = both(F.lit(float("inf")), none)["sum"]
        return let(mass, lambda m: let(both(p["u"] * m, F.when(p["u"] * m < 1.0, p["mode"]).otherwise(none)),
                                       lambda r: F.when(r["k"] < 0, p["mode"]).otherwise(r["k"])))

    sure = F.when(draws == 0, F.lit(0).cast("long")).when(draws == total, good).when(good == 0, F.lit(0).cast("long")) \
            .when(good == total, draws)
    return sure.otherwise(let(F.struct(total.cast("long").alias("N"), good.cast("long").alias("K"),
                                       draws.cast("long").alias("draws"), u.alias("u")), walk))


def split_places(places: Column, rows: Column, seed: int, node: Column) -> Column:
    """Multivariate draw: how many of each shard's ``places`` go to ``rows`` of all rows."""
    start = F.struct(rows.cast("long").alias("left"), F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x).alias("pool"),
                     F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(places, start, lambda s, c: let(
        hypergeometric(c, s["pool"], s["left"], uniform(F.lit(seed), node, F.size(s["out"]))),
        lambda k: F.struct((s["left"] - k).alias("left"), (s["pool"] - c).alias("pool"),
                           F.concat(s["out"], F.array(k)).alias("out"))))["out"]


def communication_matrix(counts: DataFrame, n_blocks: int, sizes: list[int], seed: int) -> DataFrame:
    """``(block, places)`` from ``(block, n)``; ``n_blocks`` must be a power of two."""
    spark = counts.sparkSession
    every = counts.select(F.col("block").cast("int"), "n").unionByName(
        spark.range(n_blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("n")))
    filled = every.groupBy("block").agg(F.sum("n").alias("n"))
    root = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "n"))), lambda x: x["n"]).alias("rows"))
    nodes = root.select(F.lit(1).cast("long").alias("node"), "rows", F.array(*(F.lit(s).cast("long") for s in sizes)).alias("places"))
    depth = n_blocks.bit_length() - 1
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    for level in range(depth):
        half = n_blocks >> (level + 1)
        nodes = nodes.withColumn("left", split_places(F.col("places"), total(F.slice("rows", 1, half)), seed, F.col("node")))
        kids = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.slice("rows", 1, half).alias("rows"), F.col("left").alias("places")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.slice("rows", half + 1, half).alias("rows"),
                     F.zip_with("places", "left", lambda a, b: a - b).alias("places")))
        nodes = nodes.select(F.inline(kids))
        if level == 6:
            nodes = nodes.repartition("node")         # 128 nodes: the deeper levels in parallel
    return nodes.select((F.col("node") - n_blocks).cast("int").alias("block"), "places")


def with_copies(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Every row with the number of its copy: equal rows are counted, and their copies written out in
    stretches that are dealt over the tasks."""
    counted = rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("_m"))
    stretches = counted.select(*identity, "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(COPIES).cast("long"))).alias("_at"))
    return stretches.repartition(*identity, "_at").select(
        *identity, F.explode(F.sequence("_at", F.least(F.col("_at") + COPIES, F.col("_m")) - 1)).alias("copy"))


def shuffle_into_shards(docs: DataFrame, n_shards: int = 16, seed: int = 7, doc_id: str = "doc_id", text: str = "text",
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``."""
    body = utf8(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    rows = staged(with_copies(rows, ["doc_id", "size", "text_crc32"]), "shard-copies")
    n = rows.count()
    n_blocks = min(MAX_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, n) / block_rows)))) if n else 1
    sizes = [n // n_shards + (j < n % n_shards) for j in range(n_shards)]
    identity = ("doc_id", "size", "text_crc32", "copy")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(n_blocks)).cast("int"))
    counts = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    places = staged(communication_matrix(counts, n_blocks, sizes, seed + 1), "shard-matrix")
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 2), *identity), *identity)
    ends = places.select("block", F.transform(F.sequence(F.lit(1), F.size("places")), lambda i: F.aggregate(
        F.slice("places", 1, i), F.lit(0).cast("long"), lambda a, x: a + x)).alias("ends"))
    dealt = (rows.withColumn("_p", F.row_number().over(local)).join(ends, "block")
             .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("_p"))).cast("int")))
    parts = max(1, math.ceil(n / n_shards / SLOT_ROWS))
    key = F.xxhash64(F.lit(seed + 3), *identity)
    dealt = staged(dealt.select(*identity, "shard", F.pmod(F.shiftrightunsigned(key, 16), F.lit(parts)).cast("int").alias("_b"),
                                key.alias("_k")), "shard-dealt")
    sums = dealt.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy("shard", "_b").orderBy("_k", *identity)
    return (dealt.withColumn("_r", F.row_number().over(inner)).join(first, ["shard", "_b"])
            .select(*identity[:3], "shard", (F.col("_first") + F.col("_r") - 1).cast("long").alias("slot")))
