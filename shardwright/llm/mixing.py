"""Mixing sources to target weights by hierarchical budgets (DataFrame functions only).

Weights sit on a tree (domain, then language, then source). The token budget goes
down from the root: each node's budget is dealt to its children by weight, no child
getting more than its subtree can give (its tokens times ``max_epochs``). What a full
child cannot take goes to its siblings first; only when all siblings are full does a
shortage reach the parent's level, because a node's capacity is the sum of its
children's. A leaf's budget is filled from seeded epochs: whole epochs first, then
the prefix, by tokens, of the next epoch's order.

The tables of nodes have one row per node. Only the partial epoch is ordered, by the
md5 of seed, epoch and id: token sums per leaf and leading hex digits (as many as the root of the leaf's rows asks for) find the one
stretch of keys in which a leaf's budget ends, and rows are ordered inside that stretch only.
Each leaf is left with a last key; documents are then picked in a pass that shuffles
no text (the join brings one row per leaf).

Defined cases: null path values form nodes of their own (named ``(none)``); a null text
has one token; rows with equal keys (repeated rows) are taken or left together; zero
or unnamed weights get no budget; an empty table gives an empty result; other columns
pass through unless they carry the name of a result column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.common import staged
from shardwright.operators.ordering import prefix_aggs

RATIO_STEPS = 64           # stretches of cap / weight for each power of two
RESULT = ("n_tokens", "epoch", "epoch_key")
NONE = "(none)"
SEP = "\x1f"              # between the names of a path: no two paths can be confused


def byte_tokens(text: str = "text") -> Column:
    """UTF-8 bytes and an end mark: the token count of the byte encoder."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def water_fill(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    """``share`` of each node: its parent's ``budget`` dealt by ``weight``, at most ``cap``.

    Children fill up in the order cap / weight. With those before it full, the next
    child's fair share is ``rest * weight / weights left``; the first child that its
    share does not fill, and all after it, get that share. Whole tokens: a share is
    rounded down. Children of one ratio are full or open together, so sums before a child are
    taken over different ratios, in two levels: no window holds all children of a parent."""
    live = nodes.where(F.col("weight") > 0).withColumn("_ratio", F.col("cap") / F.col("weight"))
    alike = live.groupBy(parent, "budget", "_ratio").agg(F.sum("cap").alias("_c"), F.sum("weight").alias("_w"))
    alike = prefix_aggs(alike, [("_cap_before", "_c", "sum", False), ("_weight_before", "_w", "sum", False)], "_ratio",
                        F.floor(F.log2("_ratio") * RATIO_STEPS).cast("long"), parent)
    alike = (alike.join(live.groupBy(parent).agg(F.sum("weight").alias("_all")), parent)
             .withColumn("_rest", F.col("budget") - F.col("_cap_before")).withColumn("_left", F.col("_all") - F.col("_weight_before")))
    is_open = F.col("_rest").cast("decimal(38,0)") * F.col("_w") < F.col("_c").cast("decimal(38,0)") * F.col("_left")
    # the first open children fix the level for themselves and all after them
    level = alike.where(is_open).groupBy(parent).agg(F.min(F.struct("_ratio", "_rest", "_left")).alias("_at"))
    fair = F.expr("cast(_at._rest as decimal(30,0)) * weight div _at._left")
    return (live.join(level, parent, "left")
            .withColumn("share", F.when(F.col("_at").isNull() | (F.col("_ratio") < F.col("_at._ratio")), F.col("cap"))
                        .otherwise(F.least(F.col("cap"), F.greatest(fair.cast("long"), F.lit(0)))).cast("long"))
            .drop("_ratio", "_at"))


def budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, budget: str) -> DataFrame:
    """``node`` (path of a leaf), ``tokens`` and ``share``.

    ``leaves``: one row per leaf with the ``levels``, ``tokens`` and ``cap``. ``weights``:
    ``(level, name, weight)`` with whole weights up to 10^7; a name without a row has
    weight 1. ``budget``: SQL for that of the whole tree, from its ``cap`` and ``tokens``."""
    path = lambda k: F.concat_ws(SEP, *levels[:k])
    upper = staged(leaves.agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap")).select(
        F.lit("").alias("parent"), F.least("cap", F.expr(budget)).cast("long").alias("budget")), "mix-root")
    for k, level in enumerate(levels, 1):
        here = leaves.groupBy(path(k).alias("node"), path(k - 1).alias("parent") if k > 1 else F.lit("").alias("parent"),
                             F.col(level).alias("name")).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        named = weights.where(F.col("level") == level).select("name", "weight")
        here = here.join(named, "name", "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))
        shared = water_fill(staged(here.join(upper, "parent"), "mix-nodes"))
        upper = shared.select(F.col("node").alias("parent"), F.col("share").alias("budget"))
    return shared.select("node", "tokens", "share")


def key_of(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NONE)))
                 .cast("binary"))


def stretch_digits(rows: Column) -> Column:
    """Leading hex digits that part a leaf's keys: one for each byte of its number of rows, so that the
    stretches, and the rows of one, are both fewer than 16 times the root of that number."""
    return F.ceil(F.length(F.hex(rows)) / 2).cast("int")


def mix(docs: DataFrame, levels: list[str], weights: DataFrame, budget_share: tuple[int, int] = (1, 2),
        max_epochs: int = 2, seed: int = 11, doc_id: str = "doc_id", text: str = "text",
        tokens: Column | None = None) -> DataFrame:
    """Selected rows of ``docs`` with ``n_tokens``, ``epoch`` and ``epoch_key`` (their place in
    that epoch's order); a row is returned once for each epoch that takes it.

    ``budget_share``: the budget as a fraction of the tokens of ``docs``."""
    base = docs.drop(*RESULT)
    count = byte_tokens(text) if tokens is None else tokens
    node = F.concat_ws(SEP, *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in levels))
    narrow = staged(base.select(F.col(doc_id).alias("_id"), node.alias("node"), count.alias("n_tokens"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in levels)), "mix-rows")
    leaves = staged(narrow.groupBy("node", *levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
                    .withColumn("cap", F.col("tokens") * max_epochs), "mix-leaves")
    num, den = budget_share
    share = budgets(leaves, levels, weights, f"tokens * {num} div {den}")
    plan = staged(share.join(leaves.select("node", "rows"), "node")
                  .select("node", F.expr("cast(share div tokens as int)").alias("_full"),
                          (F.col("share") % F.col("tokens")).alias("_rest"), stretch_digits(F.col("rows")).alias("_digits")), "mix-plan")
    # the last key of each leaf's partial epoch
    keyed = (narrow.join(plan.where("_rest > 0"), "node")
             .select("node", "_rest", "_digits", "n_tokens", key_of(seed, F.col("_full"), F.col("_id")).alias("_key")))
    keyed = keyed.withColumn("_bin", F.substring(F.col("_key"), F.lit(1), F.col("_digits")))
    sums = keyed.groupBy("node", "_rest", "_bin").agg(F.sum("n_tokens").alias("_t"), F.max("_key").alias("_top"))
    below = Window.partitionBy("node").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.withColumn("_base", F.coalesce(F.sum("_t").over(below), F.lit(0))), "mix-bins")
    whole = sums.where(F.col("_base") + F.col("_t") <= F.col("_rest")).groupBy("node").agg(F.max("_top").alias("_last"))
    edge = sums.where((F.col("_base") <= F.col("_rest")) & (F.col("_base") + F.col("_t") > F.col("_rest"))).select("node", "_bin", "_base")
    upto = Window.partitionBy("node", "_bin").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (keyed.join(edge, ["node", "_bin"]).withColumn("_cum", F.col("_base") + F.sum("n_tokens").over(upto))
              .where(F.col("_cum") <= F.col("_rest")).groupBy("node").agg(F.max("_key").alias("_last")))
    last = whole.unionByName(inside).groupBy("node").agg(F.max("_last").alias("_last"))
    plan = staged(plan.join(last, "node", "left").select("node", "_full", F.coalesce("_last", F.lit("")).alias("_last")), "mix-last")
    picked = (base.withColumn("_node", node).join(plan.withColumnRenamed("node", "_node"), "_node")
              .withColumn("_in", (key_of(seed, F.col("_full"), F.col(doc_id)) <= F.col("_last")).cast("int"))
              .where(F.col("_full") + F.col("_in") > 0)
              .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_full") + F.col("_in") - 1))))
    return picked.select(*base.columns, count.alias("n_tokens"), "epoch",
                         key_of(seed, F.col("epoch"), F.col(doc_id)).alias("epoch_key"))
