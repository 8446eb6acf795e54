"""Artifact audits as joins.

Each audit returns a violations table ``(shard, rule, expected, found)``;
``raise_first`` turns it into the reference's behaviour of failing on the first
problem in shard order. Rule names are fixed values shared with the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.config import SHARD_DTYPE

# Fixed rule names.
RULES = ("state_missing", "incomplete", "file_missing", "file_size", "meta_missing", "meta_mismatch",
         "orphan_outputs", "config_drift", "pending_missing", "pending_mismatch", "seed_drift",
         "unknown_config", "odd_length")

VIOLATION = "shard long, rule string, expected string, found string"


def _v(shard: Column, rule: str, expected: Column, found: Column) -> Column:
    return F.struct(shard.cast("long").alias("shard"), F.lit(rule).alias("rule"),
                    expected.cast("string").alias("expected"), found.cast("string").alias("found"))


def _explode(df: DataFrame, checks: list[Column]) -> DataFrame:
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(F.explode(arr).alias("v")).select("v.*")


# A1 (three metadata fields) and the shard part of A2 (five fields)
def audit_committed(spark: SparkSession, files: DataFrame, meta: DataFrame, next_shard: int,
                    shard_size: int | Column, revisions: tuple | None = None, first: int = 0) -> DataFrame:
    """Every index from ``first`` to below ``next_shard`` needs a file of 2·S bytes and metadata
    with the right index, token count and dtype (and revisions, when given)."""
    S = F.lit(shard_size) if isinstance(shard_size, int) else shard_size
    from shardwright.operators.packing import range_of

    idx = range_of(spark, max(0, next_shard - first)).select((F.col("id") + first).alias("shard"))
    f = files.select(F.col("shard").cast("long").alias("shard"), F.col("length").alias("_len"), F.lit(True).alias("_hf"))
    m = meta.select(F.col("shard_index").cast("long").alias("shard"), F.lit(True).alias("_hm"),
                    F.col("shard_index").alias("_mi"), F.col("tokens").alias("_mt"), F.col("dtype").alias("_md"),
                    F.col("dataset_revision").alias("_mdr"), F.col("tokenizer_revision").alias("_mtr"))
    j = idx.join(f, "shard", "left").join(m, "shard", "left")
    bad_meta = (F.col("_mi") != F.col("shard")) | (F.col("_mt") != S) | (F.col("_md") != F.lit(SHARD_DTYPE))
    if revisions is not None:
        dr, tr = revisions
        bad_meta = bad_meta | ~F.col("_mdr").eqNullSafe(dr if isinstance(dr, Column) else F.lit(dr)) | \
            ~F.col("_mtr").eqNullSafe(tr if isinstance(tr, Column) else F.lit(tr))
    sh = F.col("shard")
    checks = [
        F.when(F.col("_hf").isNull(), _v(sh, "file_missing", S * 2, F.lit(None))),
        F.when(F.col("_hf") & (F.col("_len") != S * 2), _v(sh, "file_size", S * 2, F.col("_len"))),
        F.when(F.col("_hm").isNull(), _v(sh, "meta_missing", F.lit("metadata"), F.lit(None))),
        F.when(F.col("_hm") & bad_meta, _v(sh, "meta_mismatch", F.concat_ws("/", sh, S, F.lit(SHARD_DTYPE)),
                                          F.concat_ws("/", F.col("_mi"), F.col("_mt"), F.col("_md")))),
    ]
    return _explode(j, checks)


def audit_complete(spark: SparkSession, ledger: DataFrame, files: DataFrame, meta: DataFrame) -> DataFrame:
    """A2: the latest state exists, every configured shard is committed, and
    every shard pair matches the state (both revisions included)."""
    st = ledger.agg(F.max_by(F.struct(*ledger.columns), "commit_id").alias("s")).select("s.*")
    has = ledger.limit(1).count() > 0
    if not has:
        return spark.createDataFrame([(None, "state_missing", "state", None)], VIOLATION)
    row = st.first()
    inc = []
    want = row["next_shard"] if row["max_shards"] is None else row["max_shards"]     # no limit: what is committed
    if row["next_shard"] != want or row["committed_tokens"] != want * row["shard_size_tokens"]:
        inc.append((None, "incomplete", f"{want}/{want * row['shard_size_tokens']}",
                    f"{row['next_shard']}/{row['committed_tokens']}"))
    shards = audit_committed(spark, files, meta, int(want), int(row["shard_size_tokens"]),
                             (row["dataset_revision"], row["tokenizer_revision"]))
    return spark.createDataFrame(inc, VIOLATION).unionByName(shards)


def audit_orphans(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """A3: shard files with no build state at all are refused; with a state none is an orphan."""
    orphan = files.where(F.lit(ledger.isEmpty()))
    return orphan.select(F.col("shard").cast("long").alias("shard"), F.lit("orphan_outputs").alias("rule"),
                         F.lit("state").alias("expected"), F.col("path").alias("found"))


def config_drift(spark: SparkSession, state: dict, expected: dict) -> DataFrame:
    """A4: long (key, value) tables, full outer join, null-safe comparison;
    every mismatching key is listed."""
    keys = sorted(expected)
    a = spark.createDataFrame([(k, None if state.get(k) is None else str(state.get(k))) for k in keys],
                              "key string, found string")
    b = spark.createDataFrame([(k, None if expected[k] is None else str(expected[k])) for k in keys],
                              "key string, expected string")
    j = a.join(b, "key", "full_outer").filter(~F.col("found").eqNullSafe(F.col("expected")))
    return j.select(F.lit(None).cast("long").alias("shard"), F.lit("config_drift").alias("rule"),
                    F.concat_ws("=", "key", "expected").alias("expected"), F.concat_ws("=", "key", "found").alias("found"))


def audit_pending(spark: SparkSession, state: dict, pending: DataFrame | None) -> DataFrame:
    """A5: the pending buffer exists, has int ids in 0..65535 and the recorded length."""
    if pending is None:
        return spark.createDataFrame([(None, "pending_missing", state.get("pending_path"), None)], VIOLATION)
    agg = pending.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n"),
                      F.max(F.array_max("tokens")).alias("mx"), F.min(F.array_min("tokens")).alias("mn"))
    exp = int(state.get("pending_tokens") or 0)
    bad = (F.col("n") != exp) | (F.col("mx") > 65535) | (F.col("mn") < 0)
    return agg.filter(bad).select(F.lit(None).cast("long").alias("shard"), F.lit("pending_mismatch").alias("rule"),
                                  F.lit(str(exp)).alias("expected"), F.col("n").cast("string").alias("found"))


def is_complete(state: dict) -> bool:
    """All shards committed and the token total matches. Without a limit a build
    can always go on."""
    return (state["max_shards"] is not None and state["next_shard"] == state["max_shards"]
            and state["committed_tokens"] == state["max_shards"] * state["shard_size_tokens"])


def audit_plan(spark: SparkSession, stored: DataFrame, cfg_seed: int, known_fields: list[str]) -> DataFrame:
    """A recorded data seed must equal the configured one (a missing one
    is accepted); stored config keys must be known (set difference)."""
    seed = stored.filter(F.col("data_seed").isNotNull() & (F.col("data_seed") != cfg_seed)).select(
        F.lit(None).cast("long").alias("shard"), F.lit("seed_drift").alias("rule"),
        F.lit(str(cfg_seed)).alias("expected"), F.col("data_seed").cast("string").alias("found"))
    keys = stored.select(F.explode(F.json_object_keys("model_config")).alias("key"))
    known = spark.createDataFrame([(k,) for k in known_fields], "key string")
    unknown = keys.join(known, "key", "left_anti").select(
        F.lit(None).cast("long").alias("shard"), F.lit("unknown_config").alias("rule"),
        F.lit("known field").alias("expected"), F.col("key").alias("found"))
    return seed.unionByName(unknown)


def corpus_totals(dim: DataFrame) -> DataFrame:
    """Shard count, tokens and GiB at two bytes per token."""
    return dim.agg(F.count(F.lit(1)).cast("long").alias("shards"), F.sum("n_tokens").cast("long").alias("tokens"),
                   F.round(F.sum("n_tokens") * 2 / F.lit(float(1 << 30)), 6).alias("gib"))


def odd_lengths(files: DataFrame) -> DataFrame:
    """An odd trailing byte is ignored by readers; report it (trap 16)."""
    return files.filter(F.pmod("length", F.lit(2)) == 1).select(
        F.col("shard").cast("long").alias("shard"), F.lit("odd_length").alias("rule"),
        F.lit("even").alias("expected"), F.col("length").cast("string").alias("found"))


def raise_first(violations: DataFrame) -> None:
    """Fail with the first violation in shard order, like the reference."""
    first = violations.orderBy(F.col("shard").asc_nulls_first(), "rule").limit(1).collect()
    if first:
        v = first[0]
        raise RuntimeError(f"{v['rule']}: shard {v['shard']}, expected {v['expected']}, found {v['found']}")
