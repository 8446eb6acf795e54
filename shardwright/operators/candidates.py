"""Candidate-score operators.

A decoding step is a table: ``scores(ctx_id, cand_id, score)`` with one row per
candidate and ``history(ctx_id, ids)``. Removed candidates are dropped (the
reference sets them to −inf). Every per-context computation is a window or an
aggregate partitioned by ``ctx_id``; a context holds at most one vocabulary of
rows, so groups are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardwright.config import DecodeConfig
from shardwright.functions.columns import temperature
from shardwright.functions.columns import strip_padding

CTX = "ctx_id"


def _by_ctx(ctx: str = CTX) -> Window:
    return Window.partitionBy(ctx)


# C1
def repetition_penalty(scores: DataFrame, history: DataFrame, penalty: float, ctx: str = CTX) -> DataFrame:
    """Seen ids: score < 0 → ·p, else /p; each id once (distinct history)."""
    if penalty == 1.0:
        return scores
    seen = (history.select(ctx, F.explode(F.array_distinct("ids")).alias("cand_id"))
            .withColumn("_seen", F.lit(True)))
    j = scores.join(seen, [ctx, "cand_id"], "left")
    s = F.col("score")
    pen = F.when(F.col("_seen").isNull(), s).when(s < 0, s * penalty).otherwise(s / penalty)
    return j.withColumn("score", pen).drop("_seen")


# C2
def banned_continuations(history: DataFrame, n: int, ctx: str = CTX) -> DataFrame:
    """(ctx, cand_id) ids that would repeat an n-gram already in the history.

    The prefix is the last n−1 ids; every earlier occurrence bans the id that
    followed it. n = 1 bans every seen id; a history shorter than n bans none."""
    if n <= 0:
        return history.select(ctx, F.lit(None).cast("int").alias("cand_id")).filter(F.lit(False))
    return history.select(ctx, F.explode(banned_ids("ids", n)).alias("cand_id"))


def banned_ids(ids: str, n: int) -> Column:
    """The ids that would repeat an n-gram, as an array expression over a history."""
    h = F.col(ids)
    size = F.size(h)
    if n == 1:
        banned = F.array_distinct(h)
    else:
        # n shifted views of the history, zipped: position i holds h[i..i+n-1]
        m = size - n + 1
        views = [F.when(m > 0, F.slice(h, j + 1, m)).otherwise(F.array().cast("array<int>")) for j in range(n)]
        grams = F.arrays_zip(*[v.alias(f"g{j}") for j, v in enumerate(views)])
        last = [F.element_at(h, size - (n - 1) + 1 + j) for j in range(n - 1)]
        hit = F.filter(grams, lambda g: F.forall(F.array(*[g[f"g{j}"] == last[j] for j in range(n - 1)]),
                                                 lambda x: x))
        banned = F.array_distinct(F.transform(hit, lambda g: g[f"g{n - 1}"]))
    return banned


def ban_ngrams(scores: DataFrame, history: DataFrame, n: int, ctx: str = CTX) -> DataFrame:
    if n == 0:
        return scores
    return scores.join(banned_continuations(history, n, ctx), [ctx, "cand_id"], "left_anti")


FACT_IDS = 1 << 22          # history ids that are looked at together


def history_facts(history: DataFrame, n: int, ctx: str = CTX) -> DataFrame:
    """``(ctx, cand_id, _seen, _ban)``: every id of a context's history once, and whether it would
    repeat an n-gram (n = 0 bans none). One numpy pass over the histories, a batch of them at a time."""
    import numpy as np
    import pyarrow as pa

    kind = history.schema[ctx].dataType

    def pairs(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = part.column("ids")
        size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        ids = np.asarray(lists.flatten().cast(pa.int64()))
        ends = np.cumsum(size)
        row = np.repeat(np.arange(len(size)), size)
        banned = np.zeros(len(ids), bool)
        if n == 1:
            banned[:] = True
        elif n > 1:
            at = np.arange(len(ids))                                # is the (n-1)-gram before this id the last one?
            banned = at - (ends - size)[row] >= n - 1
            for j in range(1, n):
                banned[banned] = ids[at[banned] - j] == ids[ends[row[banned]] - j]
        order = np.lexsort((~banned, ids, row))
        r, i = row[order], ids[order]
        first = np.ones(len(order), bool)
        first[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
        return pa.RecordBatch.from_arrays([part.column(ctx).take(pa.array(r[first])), pa.array(i[first]),
                                           pa.array(np.ones(int(first.sum()), bool)), pa.array(banned[order][first])], [ctx, "cand_id", "_seen", "_ban"])

    def run(batches):
        for batch in batches:
            total = np.cumsum(np.asarray(batch.column("ids").value_lengths().fill_null(0)).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FACT_IDS, "right")))
                yield pairs(batch.slice(at, to - at))
                at = to

    return history.select(ctx, "ids").mapInArrow(run, f"{ctx} {kind.simpleString()}, cand_id long, _seen boolean, _ban boolean")


# C3
def top_k(scores: DataFrame, k: int, ctx: str = CTX) -> DataFrame:
    """Keep scores ≥ the k-th largest (ties with it survive); 0 = off."""
    if k <= 0:
        return scores
    w = _by_ctx(ctx).orderBy(F.col("score").desc())
    return scores.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= k).drop("_r")


# C6
def softmax(scores: DataFrame, ctx: str = CTX, out: str = "prob") -> DataFrame:
    w = _by_ctx(ctx)
    e = F.exp(F.col("score") - F.max("score").over(w))
    return scores.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


# C4
def top_p(scores: DataFrame, p: float, ctx: str = CTX) -> DataFrame:
    """Nucleus: walk scores high→low; a candidate stays while the probability
    mass *before* it is ≤ p, so the one that crosses p is kept (trap 7)."""
    if p >= 1.0:
        return scores
    pr = softmax(scores, ctx, "_p")
    w = _by_ctx(ctx).orderBy(F.col("score").desc(), F.col("cand_id")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_p").over(w), F.lit(0.0))
    return pr.withColumn("_b", before).filter(F.col("_b") <= p).drop("_p", "_b")


# C5
def min_p(scores: DataFrame, m: float, ctx: str = CTX) -> DataFrame:
    """Keep score ≥ max + ln(m); 0 = off."""
    if m <= 0.0:
        return scores
    import math

    return (scores.withColumn("_mx", F.max("score").over(_by_ctx(ctx)))
            .filter(F.col("score") >= F.col("_mx") + F.lit(math.log(m))).drop("_mx"))


# C7
def argmax(scores: DataFrame, ctx: str = CTX) -> DataFrame:
    """Highest score; the lowest candidate id among equals."""
    return scores.groupBy(ctx).agg(F.max_by("cand_id", F.struct(F.col("score"), -F.col("cand_id"))).alias("choice"))


# C8
def uniform(*parts: Column) -> Column:
    """Deterministic u in (0, 1) from md5 of the parts (first 32 bits)."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def sample(probs: DataFrame, seed: int, ctx: str = CTX, sample_col: str | None = None) -> DataFrame:
    """One seeded draw per (ctx[, sample]) with law ``prob``: the candidate
    with the smallest −ln(u)/p wins (exponential race). Same seed → same draw."""
    keys = [ctx] + ([sample_col] if sample_col else [])
    s_col = F.col(sample_col) if sample_col else F.lit(0)
    race = -F.log(uniform(F.lit(seed), F.col(ctx), s_col, F.col("cand_id"))) / F.col("prob")
    return (probs.filter(F.col("prob") > 0).withColumn("_race", race)
            .groupBy(*keys).agg(F.min_by("cand_id", F.struct(F.col("_race"), F.col("cand_id"))).alias("choice")))


# C9
def replicate(df: DataFrame, n: int, out: str = "sample") -> DataFrame:
    if n <= 0:
        raise ValueError("samples must be greater than zero")
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(n))))


# C10
def decode_policy(scores: DataFrame, history: DataFrame, cfg: DecodeConfig, ctx: str = CTX,
                  vocab_size: int | None = None, samples: int = 1) -> DataFrame:
    """Whole selection in the reference's order: padding strip → penalty →
    n-gram ban → (greedy arg-max) or temperature → top-k → top-p → min-p →
    softmax → seeded draw. Returns ``(ctx[, sample], choice)``; a context whose
    candidates are all banned keeps its row with a NULL choice. ``history`` has one row per
    context."""
    real = strip_padding(scores, vocab_size) if vocab_size else scores
    penalty, n = cfg.repetition_penalty, cfg.no_repeat_ngram_size
    s = real
    if penalty != 1.0 or n > 0:
        # candidates and the facts about a context's history meet in one shuffle by context: a fact is a
        # row next to its candidate, however wide the vocabulary
        facts = history_facts(history, n, ctx).select(ctx, F.col("cand_id").cast(s.schema["cand_id"].dataType).alias("cand_id"), "_seen", "_ban")
        both = s.unionByName(facts, allowMissingColumns=True).withColumn("_own", F.col("_seen").isNull())
        same = Window.partitionBy(ctx, "cand_id")
        x, seen = F.col("score"), F.col("_seen")
        penalised = F.when(seen & (x < 0), x * penalty).when(seen, x / penalty).otherwise(x)
        s = (both.repartition(ctx).withColumn("_seen", F.coalesce(F.max("_seen").over(same), F.lit(False)))
             .withColumn("_ban", F.coalesce(F.max("_ban").over(same), F.lit(False)))
             .where(F.col("_own") & ~F.col("_ban")).withColumn("score", penalised).drop("_seen", "_ban", "_own"))
    contexts = real.select(ctx).distinct()
    if cfg.greedy:
        return contexts.join(argmax(s, ctx), ctx, "left")
    s = s.withColumn("score", temperature(F.col("score"), float(cfg.temperature)))
    s = top_k(s, cfg.top_k, ctx)
    s = top_p(s, cfg.top_p, ctx)
    s = min_p(s, cfg.min_p, ctx)
    probs = softmax(s, ctx)
    if samples > 1:
        drawn = sample(replicate(probs, samples), cfg.seed, ctx, "sample").select(ctx, "sample", "choice")
        return replicate(contexts, samples).join(drawn, [ctx, "sample"], "left").select(ctx, "sample", "choice")
    return contexts.join(sample(probs, cfg.seed, ctx).select(ctx, "choice"), ctx, "left")


# C11
def ngram_loops(df: DataFrame, ids_col: str, n: int) -> DataFrame:
    """Per text: n-grams, distinct n-grams and the repeated share.

    Each n-gram becomes one exact, hashable key (length-prefixed items joined)
    built from n shifted views of the sequence, so the distinct count is a hash
    set over strings rather than pairwise array comparisons."""
    h = F.col(ids_col)
    m = F.size(h) - n + 1
    views = [F.when(m > 0, F.slice(h, j + 1, m)).otherwise(F.array()) for j in range(n)]

    def key(g):
        parts = []
        for j in range(n):
            w = g[f"g{j}"].cast("string")
            parts += [F.length(w).cast("string"), F.lit(":"), w]
        return F.concat(*parts)

    keys = F.transform(F.arrays_zip(*[v.alias(f"g{j}") for j, v in enumerate(views)]), key)
    return (df.withColumn("_k", keys)
            .withColumn("ngrams", F.size("_k").cast("long"))
            .withColumn("distinct_ngrams", F.size(F.array_distinct("_k")).cast("long"))
            .withColumn("repeated_share", F.when(F.col("ngrams") > 0,
                                                 F.round(1 - F.col("distinct_ngrams") / F.col("ngrams"), 6))
                        .otherwise(F.lit(0.0)))
            .drop("_k"))


# U1
def apply_selector(scores: DataFrame, fn, vocab_size: int, ctx: str = CTX, batched: bool = False,
                   contexts_per_batch: int = 4096) -> DataFrame:
    """Run a caller's selector over the candidates; one id in ``[0, vocab_size)`` per context.

    ``fn(DataFrame(cand_id, score)) → int`` for one context, or with ``batched``
    ``fn(DataFrame(ctx, cand_id, score)) → Series of ids indexed by ctx`` for many contexts in
    one call. Contexts are grouped by a hash into about ``contexts_per_batch`` each."""
    import pandas as pd

    schema = T.StructType([T.StructField(ctx, T.LongType()), T.StructField("choice", T.LongType())])

    def checked(picks: pd.Series) -> pd.DataFrame:
        import numbers

        for pick in picks:
            if isinstance(pick, bool) or not isinstance(pick, numbers.Integral):
                raise TypeError(f"a selector must choose an integer id, not {pick!r}")
            if not 0 <= int(pick) < vocab_size:
                raise ValueError(f"selector chose id {pick} outside [0, {vocab_size})")
        return pd.DataFrame({ctx: picks.index.astype("int64"), "choice": picks.to_numpy().astype("int64")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = pdf[[ctx, "cand_id", "score"]]
        if batched:
            picks = fn(frame.reset_index(drop=True))
            if set(picks.index) != set(frame[ctx]):
                raise ValueError("a selector must choose once for every context")
            return checked(picks)
        return checked(pd.Series({c: fn(g[["cand_id", "score"]].reset_index(drop=True)) for c, g in frame.groupby(ctx, sort=False)},
                                 dtype=object))

    n = scores.select(F.approx_count_distinct(ctx).alias("n")).first()["n"]
    groups = max(scores.sparkSession.sparkContext.defaultParallelism, -(-n // contexts_per_batch))
    return (scores.withColumn("_g", F.pmod(F.xxhash64(ctx), F.lit(groups)))
            .groupBy("_g").applyInPandas(run, schema))
