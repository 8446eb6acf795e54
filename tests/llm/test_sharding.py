import zlib
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from shardwright.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards, uniform

SCHEMA = "doc_id long, text string"


def shards(make, rows, **options):
    return shuffle_into_shards(make(rows, SCHEMA), **options).collect()


@pytest.mark.parametrize("n,block", [(0, 64), (1, 64), (5, 64), (1000, 64), (777, 4096)])
def test_exact_sizes_and_gapless_slots(make, n, block):
    rows = [(i, "ä" * (i % 7) if i % 5 else None) for i in range(n)]
    got = shards(make, rows, block_rows=block)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r["shard"] for r in got)
    assert [sizes[j] for j in range(16)] == [n // 16 + (j < n % 16) for j in range(16)]
    for j in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(sizes[j]))


def test_repeated_rows_nulls_and_a_long_text(make):
    rows = [(1, "same")] * 300 + [(None, None)] * 50 + [(2, "x" * 3_000_000)]
    got = shards(make, rows, block_rows=32)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert max(Counter(r["shard"] for r in got).values()) == 22


def test_same_rows_same_answer(make):
    rows = [(i, str(i)) for i in range(500)]
    assert sorted(map(tuple, shards(make, rows, block_rows=64))) == sorted(map(tuple, shards(make, rows[::-1], block_rows=64)))


def test_draws_follow_the_hypergeometric_law(spark):
    n = 20_000
    k = F.lit(30).cast("long"), F.lit(100).cast("long"), F.lit(40).cast("long")
    seen = Counter(r["k"] for r in spark.range(n).select(hypergeometric(*k, uniform(F.lit(3), F.col("id"))).alias("k")).collect())
    chi = sum((seen[x] - e) ** 2 / e for x in range(5, 20) if (e := n * comb(30, x) * comb(70, 40 - x) / comb(100, 40)) > 5)
    assert chi < 40                                        # 14 degrees of freedom: beyond 36 once in a thousand


def test_matrix_has_the_given_margins(spark):
    rows = [(b, (b * 37) % 90) for b in range(32) if b != 5]
    total = sum(n for _, n in rows)
    sizes = [total // 16 + (j < total % 16) for j in range(16)]
    got = {r["block"]: r["places"] for r in communication_matrix(spark.createDataFrame(rows, "block int, n long"), 32, sizes, 9).collect()}
    assert {b: sum(p) for b, p in got.items()} == {**dict(rows), 5: 0}
    assert [sum(p[j] for p in got.values()) for j in range(16)] == sizes and all(min(p) >= 0 for p in got.values())


def test_every_place_is_as_likely_for_every_row(make):
    """Over many seeds a row's shard and slot are spread evenly."""
    rows = [(i, "t") for i in range(32)]
    seen = Counter((r["doc_id"] % 4, r["shard"]) for seed in range(12) for r in shards(make, rows, n_shards=4, seed=seed * 10, block_rows=8))
    assert all(8 <= seen[d, s] <= 42 for d in range(4) for s in range(4))      # 24 expected of 96


def test_plan_is_native(make):
    p = shuffle_into_shards(make([(1, "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in p and "Arrow" not in p and "Pandas" not in p


def test_one_row_repeated_is_dealt_over_all_blocks(make):
    """A third of all rows is one row: its copies lie in every block and every sub-bucket."""
    from shardwright.llm import sharding as S

    df = make([(None, None)] * 20_000 + [(i, "t") for i in range(40_000)], SCHEMA)
    rows = df.select("doc_id", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"))
    copies = S.with_copies(rows, ["doc_id", "size", "text_crc32"])
    got = copies.groupBy(F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "copy"), F.lit(16)).alias("b")).agg(
        F.sum(F.col("doc_id").isNull().cast("int")).alias("hot"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 16 and max(r["hot"] for r in got) < 1500 and sum(r["n"] for r in got) == 60_000
    assert copies.where("doc_id is null").select("copy").distinct().count() == 20_000
    sizes = Counter(r["shard"] for r in shuffle_into_shards(df, block_rows=4096).select("shard").collect())
    assert set(sizes.values()) == {3750}


def test_against_a_reference_deal(make):
    """The deal by definition, from the hashes and the matrix: blocks in hashed order against cumulated places, then
    slots by a second hash."""
    from shardwright.llm import sharding as S

    rows = [(i % 90, "x" * (i % 4)) for i in range(300)]
    df = make(rows, SCHEMA)
    got = sorted(tuple(r) for r in shuffle_into_shards(df, block_rows=64, seed=7).collect())
    base = S.with_copies(df.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")),
                         ["doc_id", "size", "text_crc32"])
    own = ("doc_id", "size", "text_crc32", "copy")
    hashed = base.select(*own, *(F.xxhash64(F.lit(7 + k), *own).alias(f"h{k}") for k in (0, 2, 3))).collect()
    n_blocks, sizes = 8, [300 // 16 + (j < 300 % 16) for j in range(16)]
    blocks = {}
    for r in hashed:
        blocks.setdefault(r["h0"] % n_blocks, []).append(r)
    counts = base.sparkSession.createDataFrame([(b, len(v)) for b, v in blocks.items()], "block int, n long")
    places = {r["block"]: r["places"] for r in communication_matrix(counts, n_blocks, sizes, 8).collect()}
    shards_of = {}
    for b, members in blocks.items():
        order = sorted(members, key=lambda r: (r["h2"], r["doc_id"], r["size"], r["text_crc32"], r["copy"]))
        dealt = [j for j, k in enumerate(places[b]) for _ in range(k)]
        for r, j in zip(order, dealt):
            shards_of.setdefault(j, []).append(r)
    want = sorted((r["doc_id"], r["size"], r["text_crc32"], j, slot) for j, members in shards_of.items()
                  for slot, r in enumerate(sorted(members, key=lambda r: (r["h3"], r["doc_id"], r["size"], r["text_crc32"], r["copy"]))))
    assert [(i, s, c) for i, s, c, _, _ in got] == [(i, s, c) for i, s, c, _, _ in want] and got == want
