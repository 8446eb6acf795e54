"""Registered queries: every operator family run over the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns are
aliased exactly like the matching oracle SQL (``shardwright.plans.oracle``).
Parameters are module constants so both sides use the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.config import PackingConfig, windows_in
from shardwright.functions.columns import with_eos
from shardwright.functions.encoders import ByteEncoder, WordEncoder
from shardwright.operators import packing
from shardwright.plans import corpus
from shardwright.sources.documents import read_documents

# Fixed query parameters (shared with the oracle SQL).
S, T, STRIDE = 50_000, 256, 256


def cap_shards(total: int) -> int:
    """The limit of the capped builds: half of the stream's full shards."""
    return max(1, total // S // 2)


ONE_STRIDE = 64                     # single-shard geometry: the whole stream is one shard
SEED, B, WORLD = 1337, 16, 2
ACCUM_CHOICES = (4, 2, 1)   # gradient accumulation: the largest of these that divides an epoch
RESUME_STEP, MAX_STEPS = 100, 200
DEV_B, EVAL_BATCHES, N_EVALS = 16, 20, 5
VOCAB = 1000
LOOKUP_MUL, LOOKUP_OFF = 12, 1500

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_documents(spark, f"{sf}/documents.parquet")


def _round(c, n=6):
    return F.round(c.cast("double"), n)


# ---------------------------------------------------------------- corpus build
@query
def doc_token_counts(spark, sf):
    enc = with_eos(ByteEncoder().encode(docs(spark, sf)), ByteEncoder.eos_id)
    return enc.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"),
                      F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
                      F.try_element_at("ids", F.lit(1)).cast("long").alias("first_id"))


@query
def token_offsets(spark, sf):
    return corpus.offsets_only(docs(spark, sf)).select("doc_id", "n_tokens", "start", "end")


@query
def shard_segments(spark, sf):
    off, total = packing.token_offsets(docs(spark, sf).select("doc_id", (F.octet_length("text") + 1)
                                                              .cast("long").alias("n_tokens")), with_total=True)
    segs = packing.cut_shards(off, S, ids_col=None)
    n_comm = packing.committed_shards(total, S, cap_shards(total))
    return (segs.groupBy("shard")
            .agg(F.count(F.lit(1)).cast("long").alias("segments"),
                 F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
                 F.sum(F.col("hi") - F.col("lo")).cast("long").alias("tokens"))
            .withColumn("committed", (F.col("shard") < n_comm).cast("int"))
            .withColumn("shard", F.col("shard").cast("long")))


@query
def build_totals(spark, sf):
    off, total = packing.token_offsets(
        docs(spark, sf).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("n_tokens")),
        with_total=True)
    return packing.build_totals(off, S, cap_shards(total), total)


def _windows(spark, sf, cfg):
    return corpus.build_windows(docs(spark, sf), cfg)


def _total(spark, sf) -> int:
    """Length of the whole token stream."""
    return docs(spark, sf).agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).cast("long")).first()[0]


def _n_shards(spark, sf) -> int:
    return packing.full_shards(_total(spark, sf), S)


@query
def pack_windows(spark, sf):
    w = _windows(spark, sf, PackingConfig(shard_size=S, seq_len=T, stride=STRIDE))
    return w.select("seq_index", F.col("shard").cast("long").alias("shard"), "k",
                    F.size("window").cast("long").alias("n_tokens"),
                    F.try_element_at("window", F.lit(1)).cast("long").alias("first_token"),
                    F.try_element_at("window", F.lit(-1)).cast("long").alias("last_token"),
                    F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"),
                    F.md5(F.array_join("window", ",")).alias("window_md5"))


@query
def window_lookup(spark, sf):
    req = docs(spark, sf).select("doc_id", (F.col("doc_id") * LOOKUP_MUL - LOOKUP_OFF).alias("idx"))
    out = packing.lookup_uniform(req, _n_shards(spark, sf), windows_in(S, T, STRIDE), "idx")
    return out.select("doc_id", "idx", F.col("shard").cast("long").alias("shard"), "k",
                      F.col("error").isNotNull().cast("int").alias("out_of_range"))


@query
def split_plan(spark, sf):
    n = _n_shards(spark, sf)
    dim = packing.uniform_shard_dim(spark, n, S, T, STRIDE)
    cut = packing.train_shard_count(n)
    return dim.select(F.col("shard").cast("long").alias("shard"), "n_tokens", "n_seqs", "seq_start", "seq_end",
                      F.when(F.col("shard") < cut, "train").otherwise("dev").alias("split"))


def _single_spans(spark, sf):
    """The whole token stream as one shard (a single-file corpus)."""
    total = _total(spark, sf)
    spans = packing.uniform_window_spans(spark, 1, total, T, ONE_STRIDE)
    nw = windows_in(total, T, ONE_STRIDE)
    return packing.split_windows(spans, 1, nw, T, ONE_STRIDE)


@query
def single_shard_split(spark, sf):
    return _single_spans(spark, sf).select("seq_index", "split", "local_index")


def _train(spark, sf):
    n, nw = _n_shards(spark, sf), windows_in(S, T, STRIDE)
    cut = packing.train_shard_count(n)
    spans = packing.uniform_window_spans(spark, n, S, T, STRIDE)
    split = packing.split_windows(spans, n, 0, T, STRIDE, dev_base=cut * nw)
    n_train, n_dev = cut * nw, (n - cut) * nw
    packing.check_split(n_train, n_dev)
    return split, n_train


def accum_for(batches_per_epoch: int) -> int:
    """Exact resume needs an epoch to divide into whole optimizer steps."""
    return next(a for a in ACCUM_CHOICES if batches_per_epoch % a == 0)


@query
def epoch_order(spark, sf):
    from shardwright.operators.permutation import orders

    _, n_train = _train(spark, sf)
    return orders(spark, n_train, n_train, 0, 2 * n_train, SEED).select("epoch", "local_index", "position")


@query
def batches(spark, sf):
    _, n_train = _train(spark, sf)
    per_epoch = packing.n_batches(n_train, B, True)
    accum = accum_for(per_epoch)
    plan = packing.assign_ranks(packing.remaining_plan(spark, SEED, B, accum, n_train, 0, per_epoch // accum), WORLD)
    return plan.select("local_index", "position", "batch", "step", F.col("rank").cast("long").alias("rank"))


@query
def remaining_plan(spark, sf):
    _, n_train = _train(spark, sf)
    accum = accum_for(packing.n_batches(n_train, B, True))
    plan = packing.remaining_plan(spark, SEED, B, accum, n_train, RESUME_STEP, MAX_STEPS)
    return plan.select(F.col("epoch").cast("long").alias("epoch"), "batch", "step", "local_index", "position")


@query
def hashed_order(spark, sf):
    """G10 by a hash key: the same contract with ranks, for tables whose indices are not dense."""
    split, n_train = _train(spark, sf)
    train = split.filter(F.col("split") == "train").select("local_index")
    return packing.multi_epoch_order(train, SEED, [0, 1], n_rows=n_train).select(
        F.col("epoch").cast("long").alias("epoch"), "local_index", "position")


@query
def hashed_batches(spark, sf):
    """G11-G13 over the hashed order."""
    split, n_train = _train(spark, sf)
    train = split.filter(F.col("split") == "train").select("local_index")
    per_epoch = packing.n_batches(n_train, B, True)
    plan = packing.epoch_order(train, SEED, 0, n_rows=n_train)
    plan = packing.assign_batches(plan, B, n_train, True)
    plan = packing.assign_ranks(packing.assign_steps(plan, accum_for(per_epoch), per_epoch), WORLD)
    return plan.select("local_index", "position", "batch", "step", F.col("rank").cast("long").alias("rank"))


@query
def coverage(spark, sf):
    spans = packing.uniform_window_spans(spark, _n_shards(spark, sf), S, T, ONE_STRIDE)
    return packing.coverage_report(spans).select(
        F.col("shard").cast("long").alias("shard"), "windows", "nominal_tokens", "unique_tokens", "overlap_share")


@query
def leakage(spark, sf):
    spans = _single_spans(spark, sf).withColumn("shard", F.col("shard").cast("long"))
    return packing.leakage_report(spans).select("shard", "all_tokens", "train_tokens", "dev_tokens",
                                                "leaked_tokens")


# ---------------------------------------------------------------- word encoder
@query
def word_vocab(spark, sf):
    return WordEncoder.build_vocab(docs(spark, sf), VOCAB).select(
        "word", F.col("id").cast("long").alias("id"), "count")


@query
def word_encode(spark, sf):
    d = docs(spark, sf)
    enc = WordEncoder.fit(d, VOCAB)
    out = with_eos(enc.encode(d), enc.eos_id)
    return out.select("doc_id", "n_tokens",
                      F.size(F.filter("ids", lambda i: i == 1)).cast("long").alias("unknown"),
                      F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


# ---------------------------------------------------------------- evaluation
CAP = 15.0            # logit soft-cap of the reference model
EVAL_T = 8            # positions per evaluation sequence (embeddings rows)
TASK_LIMIT = 5


def logits(spark, sf):
    """Embeddings as logits: 64 values per position, ``label`` = target."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("logits"),
                    F.col("label").cast("int").alias("target"))


def _pos_loss(spark, sf):
    from shardwright.operators.evaluate import cross_entropy

    return cross_entropy(logits(spark, sf), cap=CAP).withColumn(
        "seq_index", F.floor(F.col("vec_id") / EVAL_T).cast("long"))


@query
def cross_entropy(spark, sf):
    return _pos_loss(spark, sf).select("vec_id", F.col("target").cast("long").alias("target"),
                                       _round(F.col("loss")).alias("loss"))


@query
def validation(spark, sf):
    from shardwright.operators.evaluate import full_validation, sequence_loss

    v = full_validation(sequence_loss(_pos_loss(spark, sf)), EVAL_T)
    return v.select(_round(F.col("loss")).alias("loss"), _round(F.col("perplexity")).alias("perplexity"),
                    "sequences", "tokens")


@query
def running_validation(spark, sf):
    from shardwright.operators.evaluate import running_mean, sequence_loss

    seqs = sequence_loss(_pos_loss(spark, sf))
    out = running_mean(seqs, "seq_index", F.floor(F.col("seq_index") / 65_536).cast("long"))
    return out.select("seq_index", "processed", _round(F.col("running_loss")).alias("running_loss"))


def choices(spark, sf):
    """Each embedding row holds 16 items × 4 choices; log-likelihood = value."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("p", "v"))
    g = F.floor(F.col("p") / 4)
    return x.select(F.concat(F.lit("task_"), F.col("label").cast("string")).alias("task"),
                    (F.col("vec_id") * 16 + g).cast("long").alias("item_id"),
                    F.pmod(F.col("p"), F.lit(4)).cast("int").alias("choice"),
                    F.col("v").cast("double").alias("loglik"),
                    (F.pmod(F.col("p"), F.lit(4)) + 1 + g).cast("int").alias("n_bytes"),
                    F.pmod(F.col("vec_id") + g, F.lit(4)).cast("int").alias("gold"))


@query
def choice_accuracy(spark, sf):
    from shardwright.operators import evaluate as ev

    m = ev.task_metrics(ev.choice_accuracy(choices(spark, sf)))
    return m.select("task", "items", _round(F.col("metrics")["acc,none"]).alias("acc"),
                    _round(F.col("metrics")["acc_norm,none"]).alias("acc_norm"),
                    _round(F.col("accuracy")).alias("accuracy"), _round(F.col("chance")).alias("chance"))


@query
def macro_accuracy(spark, sf):
    from shardwright.operators import evaluate as ev

    m = ev.macro_accuracy(ev.task_metrics(ev.choice_accuracy(choices(spark, sf))))
    return m.select(_round(F.col("macro_accuracy")).alias("macro_accuracy"), "items",
                    _round(F.col("margin_over_chance")).alias("margin_over_chance"))


@query
def limit_per_task(spark, sf):
    from shardwright.functions.columns import normalize_limit
    from shardwright.operators.evaluate import limit_per_group

    items = choices(spark, sf).select("task", "item_id").distinct()
    return limit_per_group(items, ["task"], ["item_id"], normalize_limit(TASK_LIMIT))


# ---------------------------------------------------------------- candidates
TOPK, TOPP, MINP, TEMP = 5, 0.5, 0.9, 0.05
PENALTY, NGRAM, VOCAB_REAL = 1.3, 3, 60
N_SAMPLES, SAMPLE_SEED, POLICY_SEED = 3, 7, 11


def scores(spark, sf, temperature: float = 1.0):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = e.select(F.col("vec_id").alias("ctx_id"), F.posexplode("embedding").alias("cand_id", "score"))
    return x.select("ctx_id", F.col("cand_id").cast("long").alias("cand_id"),
                    (F.col("score").cast("double") / F.lit(temperature)).alias("score"))


def history(spark, sf):
    """Context history = every byte of the document with the same id, mod 64.
    Only documents that have a context are encoded (semi join first)."""
    ctx = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"))
    d = ByteEncoder().encode(docs(spark, sf).join(ctx, "doc_id", "left_semi"))
    return d.select(F.col("doc_id").alias("ctx_id"), F.transform("ids", lambda i: F.pmod(i, F.lit(64))).alias("ids"))


@query
def candidate_topk(spark, sf):
    from shardwright.operators.candidates import top_k

    return top_k(scores(spark, sf), TOPK).select("ctx_id", "cand_id", _round(F.col("score")).alias("score"))


@query
def candidate_topp(spark, sf):
    from shardwright.operators.candidates import softmax, top_p

    return softmax(top_p(scores(spark, sf, TEMP), TOPP)).select("ctx_id", "cand_id", _round(F.col("prob")).alias("prob"))


@query
def candidate_minp(spark, sf):
    from shardwright.operators.candidates import min_p

    return min_p(scores(spark, sf, TEMP), MINP).select("ctx_id", "cand_id")


@query
def candidate_softmax(spark, sf):
    from shardwright.operators.candidates import softmax

    return softmax(scores(spark, sf)).select("ctx_id", "cand_id", _round(F.col("prob")).alias("prob"))


@query
def candidate_argmax(spark, sf):
    from shardwright.operators.candidates import argmax

    return argmax(scores(spark, sf))


@query
def candidate_sample(spark, sf):
    from shardwright.operators.candidates import replicate, sample, softmax, top_k

    probs = softmax(top_k(scores(spark, sf, TEMP), 10))
    return sample(replicate(probs, N_SAMPLES), SAMPLE_SEED, sample_col="sample").select(
        "ctx_id", F.col("sample").cast("long").alias("sample"), "choice")


def _policy_cfg(greedy: bool):
    from shardwright.config import DecodeConfig

    return DecodeConfig(greedy=greedy, temperature=TEMP, top_k=20, top_p=0.9, min_p=0.05,
                        repetition_penalty=PENALTY, no_repeat_ngram_size=NGRAM, seed=POLICY_SEED)


@query
def decode_policy(spark, sf):
    from shardwright.operators.candidates import decode_policy as policy

    raw = scores(spark, sf)
    return policy(raw, history(spark, sf), _policy_cfg(False), vocab_size=VOCAB_REAL)


@query
def greedy_policy(spark, sf):
    from shardwright.operators.candidates import decode_policy as policy

    return policy(scores(spark, sf), history(spark, sf), _policy_cfg(True), vocab_size=VOCAB_REAL)


@query
def ngram_loops(spark, sf):
    from shardwright.operators.candidates import ngram_loops as loops

    from shardwright.sources.documents import balance

    d = balance(docs(spark, sf), "doc_id").select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("text_id"),
                                                  WordEncoder.words().alias("w"))
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.lit("conversations").alias("source"), F.concat_ws("/", "conv_id", "turn").alias("text_id"),
        WordEncoder.words().alias("w"))
    return loops(d.unionByName(c), "w", NGRAM).select("source", "text_id", "ngrams", "distinct_ngrams",
                                                       "repeated_share")


PROMPT_T, MAX_NEW, STOP_ID = 256, 64, 10


def _conv_ids(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    return ByteEncoder().encode(c).drop("text")


@query
def prompt_truncate(spark, sf):
    from shardwright.functions.columns import prompt_budget, truncate_left

    kept = truncate_left("ids", prompt_budget(PROMPT_T, MAX_NEW))
    return _conv_ids(spark, sf).select("conv_id", "turn", kept.alias("k")).select(
        "conv_id", "turn", F.size("k").cast("long").alias("n_kept"),
        F.try_element_at("k", F.lit(1)).cast("long").alias("first_kept"),
        F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x).alias("kept_sum"))


@query
def stop_at_eos(spark, sf):
    from pyspark.sql import Window

    from shardwright.functions.columns import pad_with_eos, stop_at_eos as stop

    out = _conv_ids(spark, sf).select("conv_id", "turn", stop("ids", STOP_ID).alias("o"),
                                      F.array_contains("ids", STOP_ID).cast("int").alias("has_eos"))
    longest = F.max(F.size("o")).over(Window.partitionBy("conv_id"))
    padded = out.withColumn("p", pad_with_eos("o", longest, STOP_ID))
    return padded.select("conv_id", "turn", F.size("o").cast("long").alias("n_out"), "has_eos",
                         F.size("p").cast("long").alias("padded_len"),
                         F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("padded_sum"))


@query
def custom_selector(spark, sf):
    from shardwright.operators.candidates import apply_selector

    def highest_lowest_id(pdf):
        best = pdf.sort_values(["score", "cand_id"], ascending=[False, True]).drop_duplicates("ctx_id")
        return best.set_index("ctx_id")["cand_id"]

    return apply_selector(scores(spark, sf), highest_lowest_id, 64, batched=True)


# ---------------------------------------------------------------- telemetry
RATE_WINDOW_S, RATE_TARGET = 43_200.0, 20_000
THROTTLE_GAP_S, THROTTLE_TARGET = 43_200.0, 8_000
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000
TPS_SEQ_LEN = 1024
POLICY = [("view", "last"), ("signup", "last"), ("click", "max"), ("error", "min"), ("purchase", "min")]
SCHED = dict(B=16, grad_accum_steps=4, T=1024, learning_rate=1.2e-3, min_lr=1.2e-4, warmup_steps=200,
             max_steps=10_000, eval_interval=250)


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def counters(spark, sf):
    """Per user: a counter of value cents that restarts every UTC day."""
    from shardwright.operators.ordering import prefix_agg
    from shardwright.operators.telemetry import micros

    e = events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
                                 micros("ts").alias("us"), F.round(F.col("value") * 100).cast("long").alias("added"))
    e = e.withColumn("_day", F.floor(F.col("us") / DAY_US).cast("long")).withColumn(
        "_hr", F.floor(F.col("us") / HOUR_US).cast("long"))
    return prefix_agg(e, "added", ["us", "seq"], "_hr", "units", ["run_id", "_day"], how="sum").drop("_day", "_hr")


def training_rows(spark, sf):
    """Events as a training log: purchases are evaluations whose dev loss is
    props.k / 10; every event's value is that step's train loss."""
    from shardwright.operators.telemetry import micros

    e = events(spark, sf)
    is_eval = F.col("event_type") == "purchase"
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), micros("ts").alias("us"),
                    F.col("value").cast("double").alias("train_loss"),
                    F.when(is_eval, F.get_json_object("props", "$.k").cast("double") / 10).alias("dev_loss"),
                    is_eval.alias("is_eval"))


@query
def rolling_rate(spark, sf):
    from shardwright.operators.telemetry import eta, rolling_rate as rate

    r = eta(rate(counters(spark, sf), RATE_WINDOW_S), RATE_TARGET)
    return r.select("run_id", "seq", "units", _round(F.col("rate") * 3600).alias("rate_per_hour"),
                    _round(F.col("elapsed_s")).alias("elapsed_s"), "eta_s")


@query
def counter_audit(spark, sf):
    from shardwright.operators.telemetry import audit_counters

    return audit_counters(counters(spark, sf)).select("run_id", "seq", "rule", _round(F.col("expected")).alias("expected"),
                                                      _round(F.col("found")).alias("found"))


@query
def interval_average(spark, sf):
    from shardwright.operators.telemetry import training_log

    t = training_log(training_rows(spark, sf)).filter("is_eval")
    return t.select("run_id", "step", F.col("interval").cast("long").alias("interval"),
                    _round(F.col("average_train_loss")).alias("average_train_loss"),
                    _round(F.col("best_dev_loss")).alias("best_dev_loss"),
                    _round(F.col("best_average_train_loss")).alias("best_average_train_loss"))


@query
def hold_last(spark, sf):
    from shardwright.operators.telemetry import training_log

    t = training_log(training_rows(spark, sf)).filter(~F.col("is_eval"))
    return t.select("run_id", "step", _round(F.col("held_dev_loss")).alias("held_dev_loss"))


@query
def metric_summary(spark, sf):
    from shardwright.operators.telemetry import summarise

    m = events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
                                 F.col("event_type").alias("name"), F.col("value").cast("double").alias("value"))
    pol = spark.createDataFrame(POLICY, "name string, policy string")
    return summarise(m, pol).select("run_id", "name", "policy", _round(F.col("summary")).alias("summary"))


@query
def loss_comparison(spark, sf):
    from shardwright.operators.telemetry import loss_comparison as pivot, training_log

    t = training_log(training_rows(spark, sf)).filter("is_eval")
    long = t.select("run_id", "step", F.explode(F.array(
        F.struct(F.lit("average_train_loss").alias("name"), F.col("average_train_loss").alias("value")),
        F.struct(F.lit("dev_loss").alias("name"), F.col("dev_loss").alias("value")))).alias("m")).select(
        "run_id", "step", "m.name", "m.value")
    p = pivot(long, ["average_train_loss", "dev_loss"])
    return p.select("run_id", "step", _round(F.col("average_train_loss")).alias("average_train_loss"),
                    _round(F.col("dev_loss")).alias("dev_loss"))


@query
def run_summary(spark, sf):
    from shardwright.config import TrainConfig
    from shardwright.operators.telemetry import run_summary as summary

    cfg = TrainConfig(**SCHED)
    s = summary(training_rows(spark, sf), cfg.tokens_per_step, cfg.max_steps)
    return s.select("run_id", "current_step", _round(F.col("latest_train_loss")).alias("latest_train_loss"),
                    _round(F.col("latest_dev_loss")).alias("latest_dev_loss"),
                    _round(F.col("best_dev_loss")).alias("best_dev_loss"), "evaluations", "tokens_processed",
                    _round(F.col("progress_percent")).alias("progress_percent"), "status")


@query
def run_report(spark, sf):
    """M9 in full: interval averages, rates and the learning rate next to the totals."""
    from shardwright.config import TrainConfig
    from shardwright.functions.columns import wsd_lr
    from shardwright.operators.telemetry import run_summary as summary, training_log

    cfg = TrainConfig(**SCHED)
    s = summary(training_log(training_rows(spark, sf)), cfg.tokens_per_step, cfg.max_steps, schedule=lambda c: wsd_lr(c, cfg))
    return s.select("run_id", "current_step", _round(F.col("latest_average_train_loss")).alias("latest_average_train_loss"),
                    _round(F.col("best_average_train_loss")).alias("best_average_train_loss"),
                    _round(F.col("learning_rate"), 12).alias("learning_rate"), _round(F.col("elapsed_s")).alias("elapsed_s"),
                    _round(F.col("steps_per_s"), 9).alias("steps_per_s"), _round(F.col("tokens_per_s"), 3).alias("tokens_per_s"), "eta_s")


@query
def throughput(spark, sf):
    from shardwright.functions.columns import format_rate, run_name
    from shardwright.operators.telemetry import average_throughput, micros

    e = events(spark, sf).select(F.col("user_id").alias("run_id"), micros("ts").alias("us"), "ts", "event_type")
    t = average_throughput(e, TPS_SEQ_LEN)
    first = e.groupBy("run_id").agg(F.min_by("event_type", "us").alias("first_type"), F.min("ts").alias("start_ts"))
    mode = F.when(F.col("first_type") == "signup", "fresh").otherwise("continue")
    return t.join(first, "run_id").select(
        "run_id", F.col("sequences").cast("long").alias("sequences"), _round(F.col("elapsed_s")).alias("elapsed_s"),
        _round(F.col("tokens_per_s")).alias("tokens_per_s"), format_rate("tokens_per_s", "tok").alias("rate_text"),
        run_name(mode, "start_ts", "pretraining").alias("run_name"))


@query
def throttle(spark, sf):
    from shardwright.operators.telemetry import throttle as gate

    c = counters(spark, sf)
    return gate(c, THROTTLE_GAP_S, THROTTLE_TARGET).select("run_id", "seq", "units")


@query
def wsd_schedule(spark, sf):
    from shardwright.config import TrainConfig
    from shardwright.functions.columns import data_position, is_eval_step, matrix_lr, progress_columns, wsd_lr

    cfg = TrainConfig(**SCHED)
    s = events(spark, sf).select(F.col("event_id").alias("step"))
    lr = wsd_lr("step", cfg)
    epoch, off = data_position("step", cfg.grad_accum_steps, 572)
    return s.select("step", _round(lr, 12).alias("lr"), _round(matrix_lr(lr, cfg), 12).alias("matrix_lr"),
                    is_eval_step("step", cfg.eval_interval, cfg.max_steps).cast("int").alias("is_eval"),
                    epoch, off, *progress_columns("step", cfg)[:1],
                    _round(progress_columns("step", cfg)[2]).alias("progress_percent"))


# ---------------------------------------------------------------- artifacts and audits
DATASET_REV, TOKENIZER_REV = "dataset-sha", "utf-8"
CLAIMED_EXTRA = 10     # the manifest's state claims this many shards beyond those present


def _shard_tokens(spark, sf):
    """(shard, tokens) of every shard the stream touches, the partial tail included."""
    off = corpus.offsets_only(docs(spark, sf))
    segs = packing.cut_shards(off, S, ids_col=None)
    return segs.groupBy("shard").agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("tokens"))


@query
def audit_manifest(spark, sf):
    """A1/A2 over a manifest derived from the documents: one file and one
    metadata record per shard the stream touches (the partial tail written as
    if it were a shard), and a state that claims CLAIMED_EXTRA more shards."""
    from shardwright.operators.audit import audit_committed
    from shardwright.session import materialize

    st = materialize(_shard_tokens(spark, sf))
    files = st.select("shard", (F.col("tokens") * 2).alias("length"))
    meta = st.select(F.col("shard").cast("long").alias("shard_index"), "tokens", F.lit("uint16").alias("dtype"),
                     F.lit(DATASET_REV).alias("dataset_revision"), F.lit(TOKENIZER_REV).alias("tokenizer_revision"))
    claimed = int(st.agg(F.max("shard")).first()[0]) + 1 + CLAIMED_EXTRA
    v = audit_committed(spark, files, meta, claimed, S, (F.lit(DATASET_REV), F.lit(TOKENIZER_REV)))
    return v.select("shard", "rule", "expected", "found")


@query
def corpus_totals(spark, sf):
    from shardwright.operators.audit import corpus_totals as totals

    return totals(packing.uniform_shard_dim(spark, _n_shards(spark, sf), S, T, STRIDE))


@query
def shard_roundtrip(spark, sf):
    """S4 then S2: write the corpus as ``.bin`` shards into the session's
    checkpoint folder and read the windows back through the data source."""
    import uuid

    from shardwright.session import checkpoint_dir
    from shardwright.sources.token_shards import read_windows

    cfg = PackingConfig(shard_size=S, seq_len=T, stride=STRIDE)
    out = checkpoint_dir(spark).rstrip("/") + f"/corpus-{uuid.uuid4().hex}"
    corpus.write_corpus(docs(spark, sf), out, cfg)
    w = read_windows(spark, out, T, STRIDE)
    return w.select("seq_index", F.col("shard").cast("long").alias("shard"), "k",
                    F.size("window").cast("long").alias("n_tokens"),
                    F.try_element_at("window", F.lit(1)).cast("long").alias("first_token"),
                    F.try_element_at("window", F.lit(-1)).cast("long").alias("last_token"),
                    F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"),
                    F.md5(F.array_join("window", ",")).alias("window_md5"))


@query
def resume_build(spark, sf):
    """T1 after a batch build: the first third of the documents as a batch, the rest as two
    micro-batches of a stream whose numbers start at 0; the windows read back are those of
    the whole build."""
    import uuid

    from shardwright.session import checkpoint_dir
    from shardwright.sources.token_shards import read_windows
    from shardwright.streaming.corpus_build import build_batch

    cfg = PackingConfig(shard_size=S, seq_len=T, stride=STRIDE)
    out = checkpoint_dir(spark).rstrip("/") + f"/resumed-{uuid.uuid4().hex}"
    d = docs(spark, sf)
    lo, hi = d.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [lo + (hi - lo + 1) * k // 3 for k in range(4)]
    parts = [d.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(cuts, cuts[1:])]
    corpus.write_corpus(parts[0], out, cfg)
    for number, part in enumerate(parts[1:]):
        build_batch(part, number, out, cfg, stream_id="resumed")
    w = read_windows(spark, out, T, STRIDE)
    return w.select("seq_index", F.col("shard").cast("long").alias("shard"), "k",
                    F.size("window").cast("long").alias("n_tokens"),
                    F.try_element_at("window", F.lit(1)).cast("long").alias("first_token"),
                    F.try_element_at("window", F.lit(-1)).cast("long").alias("last_token"),
                    F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"),
                    F.md5(F.array_join("window", ",")).alias("window_md5"))


@query
def resume_source(spark, sf):
    """T1 inside the source: the first third of the documents as a batch build, then a stream over the
    whole table, with a checkpoint of its own, that takes what the build has not consumed."""
    import uuid

    from shardwright.session import checkpoint_dir
    from shardwright.sources.token_shards import read_windows
    from shardwright.streaming import corpus_build

    cfg = PackingConfig(shard_size=S, seq_len=T, stride=STRIDE)
    out = checkpoint_dir(spark).rstrip("/") + f"/goes-on-{uuid.uuid4().hex}"
    d = docs(spark, sf)
    lo, hi = d.agg(F.min("doc_id"), F.max("doc_id")).first()
    corpus.write_corpus(d.where(F.col("doc_id") < lo + (hi - lo + 1) // 3), out, cfg)
    corpus_build.resume_build(spark, f"{sf}/documents.parquet", out, cfg, out + "-checkpoint")
    return _window_rows(read_windows(spark, out, T, STRIDE))


def _window_rows(w):
    return w.select("seq_index", F.col("shard").cast("long").alias("shard"), "k",
                    F.size("window").cast("long").alias("n_tokens"),
                    F.try_element_at("window", F.lit(1)).cast("long").alias("first_token"),
                    F.try_element_at("window", F.lit(-1)).cast("long").alias("last_token"),
                    F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"),
                    F.md5(F.array_join("window", ",")).alias("window_md5"))


@query
def build_progress(spark, sf):
    """A build limited to half of the stream's shards, as a batch of a third of the documents and a stream
    over the table in micro-batches of a third; what each commit states, and whether it is complete."""
    import uuid

    from shardwright.operators.audit import is_complete
    from shardwright.session import checkpoint_dir
    from shardwright.sources.manifests import Ledger
    from shardwright.streaming import corpus_build

    d = docs(spark, sf)
    n, lo, hi = d.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    cfg = PackingConfig(shard_size=S, seq_len=T, stride=STRIDE, max_shards=cap_shards(_total(spark, sf)))
    out = checkpoint_dir(spark).rstrip("/") + f"/progress-{uuid.uuid4().hex}"
    corpus.write_corpus(d.where(F.col("doc_id") < lo + (hi - lo + 1) // 3), out, cfg)
    corpus_build.resume_build(spark, f"{sf}/documents.parquet", out, cfg, out + "-checkpoint", max_documents=-(-n // 3))
    ledger = Ledger(spark, out)
    done = ledger.table().withColumn("complete", (F.col("next_shard") == F.col("max_shards"))
                                     & (F.col("committed_tokens") == F.col("max_shards") * F.col("shard_size_tokens")))
    assert is_complete(ledger.latest()) == corpus_build.completion(spark, out)
    return done.select("commit_id", F.col("next_shard").cast("long").alias("next_shard"), "committed_tokens", "pending_tokens",
                       "source_documents_consumed", "last_doc_id", F.col("complete").cast("int").alias("complete"))


@query
def odd_ids(spark, sf):
    """G1 over documents of which some have no id and some share one: nulls first, equal ids by what they hold."""
    d = docs(spark, sf).withColumn("text_key", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long"))
    some = d.select(F.when(F.col("doc_id") % 7 != 0, F.floor(F.col("doc_id") / 3)).cast("long").alias("doc_id"), "text", "text_key")
    off = corpus.offsets_only(some, tie=F.col("text_key"), keep=("text_key",))
    return off.select("doc_id", "text_key", "n_tokens", "start", "end")


DEV_ROWS, ROTATION_BATCHES = 4, 5


def rotations(n: int) -> int:
    """Evaluations after which every one of ``n`` dev batches was read, and the first ones again."""
    return n // ROTATION_BATCHES + 2


@query
def dev_rotation(spark, sf):
    """G15 + M4: evaluations that rotate over the dev batches, each with its token-weighted loss."""
    from shardwright.operators.evaluate import sequence_loss

    seqs = sequence_loss(_pos_loss(spark, sf)).withColumn("batch", F.floor(F.col("seq_index") / DEV_ROWS).cast("long"))
    n = seqs.agg(F.max("batch")).first()[0] + 1
    plan = packing.dev_sample_plan(spark, rotations(n), n, ROTATION_BATCHES)
    rows = plan.join(seqs, F.col("dev_batch") == F.col("batch"))
    out = packing.weighted_loss(rows, ["eval_no", "cursor_after"], "seq_loss", "n_tokens")
    return out.select("eval_no", "cursor_after", _round(F.col("sampled_loss")).alias("sampled_loss"), "tokens", "batches")


CONFIG_SEED = 1337


@query
def audit_faults(spark, sf):
    """A2–A7 with one planted fault for every rule, over shards, pending tail and configurations
    that the documents give."""
    from shardwright.operators import audit as A
    from shardwright.sources.manifests import LEDGER_SCHEMA

    n = _n_shards(spark, sf)
    shard = packing.range_of(spark, n).select(F.col("id").cast("int").alias("shard"))
    kind = F.col("shard") % 7
    files = shard.where(kind != 3).select(
        F.concat(F.lit("shard_"), F.lpad(F.col("shard").cast("string"), 5, "0"), F.lit(".bin")).alias("path"), "shard",
        F.when(kind == 4, 2 * S - 2).when(kind == 2, 2 * S + 1).otherwise(2 * S).cast("long").alias("length"))
    meta = shard.where(kind != 5).select(
        F.col("shard").cast("long").alias("shard_index"), F.lit(S).cast("long").alias("tokens"),
        F.when(kind == 6, "int32").otherwise("uint16").alias("dtype"), F.lit(DATASET_REV).alias("dataset_revision"),
        F.lit(TOKENIZER_REV).alias("tokenizer_revision"))
    state = {"commit_id": 1, "schema_version": 1, "dataset_id": "documents", "dataset_config": "other", "shard_size_tokens": S,
             "max_shards": n, "next_shard": n - 1, "committed_tokens": (n - 1) * S, "dataset_revision": DATASET_REV,
             "tokenizer_revision": TOKENIZER_REV}
    ledger = spark.createDataFrame([{f.name: state.get(f.name) for f in LEDGER_SCHEMA.fields}], LEDGER_SCHEMA)
    empty = spark.createDataFrame([], LEDGER_SCHEMA)
    d = docs(spark, sf)
    last = d.agg(F.max("doc_id")).first()[0]
    pending = ByteEncoder().encode(d.where(F.col("doc_id") == last)).select(F.col("ids").alias("tokens"))
    stored = d.select((F.lit(CONFIG_SEED) + F.col("doc_id") % 2).alias("data_seed"),
                      F.concat(F.lit('{"B": 16, "'), F.when(F.col("doc_id") % 3 == 0, "T").otherwise("mystery"), F.lit('": 1}')).alias("model_config"))
    found = {
        "A2": A.audit_complete(spark, ledger, files, meta), "A2 empty": A.audit_complete(spark, empty, files, meta),
        "A3": A.audit_orphans(files, empty), "A4": A.config_drift(spark, state, {**state, "dataset_config": "default"}),
        "A5": A.audit_pending(spark, {"pending_tokens": 0}, pending), "A5 gone": A.audit_pending(spark, {"pending_path": "p"}, None),
        "A7": A.audit_plan(spark, stored, CONFIG_SEED, ["B", "T"]), "odd": A.odd_lengths(files)}
    out = None
    for name, v in found.items():
        v = v.select(F.lit(name).alias("audit"), "shard", "rule", "expected", "found")
        out = v if out is None else out.unionByName(v)
    return out


@query
def windows_xy(spark, sf):
    """P3 + P4: checked byte ids packed into windows, inputs and targets one token apart."""
    from shardwright.functions.columns import xy

    w = _windows(spark, sf, PackingConfig(shard_size=S, seq_len=T, stride=STRIDE))
    x, y = xy("window", T)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return w.select("seq_index", x, y).select(
        "seq_index", F.size("x").cast("long").alias("n_x"), total("x").alias("x_sum"), total("y").alias("y_sum"),
        F.try_element_at("y", F.lit(-1)).cast("long").alias("last_y"))


@query
def checked_ids(spark, sf):
    """Byte ids of every document, each checked to fit two bytes."""
    from shardwright.functions.encoders import assert_ids

    ids = assert_ids(ByteEncoder().encode(docs(spark, sf)))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.array_max("ids").cast("long").alias("max_id"))


@query
def word_lists(spark, sf):
    """Every whole text as a comma list, trimmed, ordered, distinct."""
    from shardwright.functions.columns import parse_list

    return docs(spark, sf).select("doc_id", parse_list(F.concat(F.lit("all,"), "text")).alias("l")).select(
        "doc_id", F.size("l").cast("long").alias("names"), F.array_join("l", "|").alias("list"))


@query
def cross_entropy_long(spark, sf):
    """M1 in long form: one row per candidate, for vocabularies too wide for an array."""
    from shardwright.operators.evaluate import cross_entropy_long as long_form

    sc = scores(spark, sf)
    tg = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("ctx_id"), F.col("label").cast("long").alias("target"))
    return long_form(sc, tg, ["ctx_id"]).select("ctx_id", _round(F.col("loss")).alias("loss"))


@query
def artifact_tables(spark, sf):
    """A build's shard files, found by two patterns in order, next to their metadata."""
    import uuid

    from shardwright.session import checkpoint_dir
    from shardwright.sources import manifests as M

    out = checkpoint_dir(spark).rstrip("/") + f"/artifacts-{uuid.uuid4().hex}"
    corpus.write_corpus(docs(spark, sf), out, PackingConfig(shard_size=S, seq_len=T, stride=STRIDE))
    files = M.discover_shards(spark, [f"{out}/shard_*[02468].bin", f"{out}/shard_*[13579].bin"])
    meta = M.read_shard_meta(spark, out)
    return files.join(meta, files["shard"] == meta["shard_index"]).select(
        F.col("shard").cast("long").alias("shard"), F.col("length").alias("bytes"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        "tokens", "vocab_size", "dtype", "tokenizer_revision")


def _shared(spark, name: str) -> str:
    import uuid

    from shardwright.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def window_fetch(spark, sf):
    """G6 + S2: the windows that every document asks for by index, from the byte ranges that hold them."""
    from shardwright.sources.token_shards import fetch_windows

    out = _shared(spark, "fetch")
    corpus.write_corpus(docs(spark, sf), out, PackingConfig(shard_size=S, seq_len=T, stride=STRIDE))
    req = docs(spark, sf).select("doc_id", (F.col("doc_id") * LOOKUP_MUL - LOOKUP_OFF).alias("idx"))
    got = fetch_windows(req, out, T, STRIDE)
    return got.select("doc_id", "idx", F.col("shard").cast("long").alias("shard"), "k", F.col("error").isNotNull().cast("int").alias("out_of_range"),
                      F.md5(F.array_join("window", ",")).alias("window_md5"))


@query
def published_files(spark, sf):
    """A build published, three of its files spoilt, found, published again and found whole."""
    from shardwright.sources import manifests as M
    from shardwright.sources import store

    out, target = _shared(spark, "build"), _shared(spark, "published")
    corpus.write_corpus(docs(spark, sf), out, PackingConfig(shard_size=S, seq_len=T, stride=STRIDE))
    M.publish_build(spark, out, target)
    spoil = lambda name, data: store.put(store.below(target, name), data)
    first = store.read(store.below(target, "shard_00000.bin"), 0, 2 * S)
    spoil("shard_00000.bin", bytes([first[0] ^ 1]) + first[1:])
    spoil("shard_00001.bin", first[:-2])
    store.remove(store.below(target, "shard_00000_meta.json"))
    found = M.verify_published(spark, target).select("file", F.col("status").alias("found"))
    found = spark.createDataFrame(found.collect(), found.schema)           # before it is mended: a row for each file
    again = M.publish_build(spark, out, target).select("file", F.col("copied").cast("int").alias("copied"))
    healed = M.verify_published(spark, target)
    return healed.join(found, "file").join(again, "file").select(
        "file", F.when(F.col("file").endswith(".bin"), F.col("bytes")).alias("bytes"), "found", "copied", "status")


RANK_BATCHES = 3


@query
def rank_export(spark, sf):
    """S12 + G13: the plan that is left, exported in files of a few batches, and one rank's batches of it read back."""
    from shardwright.sources.sinks import export_batches, read_batches

    _, n_train = _train(spark, sf)
    per_epoch = packing.n_batches(n_train, B, True)
    accum = accum_for(per_epoch)
    plan = packing.assign_ranks(packing.remaining_plan(spark, SEED, B, accum, n_train, RESUME_STEP, MAX_STEPS), WORLD)
    out = _shared(spark, "export")
    export_batches(plan, out, RANK_BATCHES)
    first = RESUME_STEP * accum // per_epoch
    last = max(first, (MAX_STEPS * accum - 1) // per_epoch)
    rows = None
    for epoch in range(first, last + 1):
        mine = read_batches(spark, out, 1, epoch)
        rows = mine if rows is None else rows.unionByName(mine)
    return rows.select(F.col("epoch").cast("long").alias("epoch"), F.col("rank").cast("long").alias("rank"), "part", "batch", "step", "position", "local_index")


@query
def metric_rows(spark, sf):
    """Every event's value appended as a metric, in two appends, and read back by run and name."""
    from shardwright.operators.telemetry import micros
    from shardwright.sources.sinks import append_metrics, read_metrics

    out = _shared(spark, "metrics")
    e = events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), micros("ts").alias("us"),
                                 F.create_map(F.col("event_type"), F.col("value").cast("double")).alias("metrics"))
    for half in (0, 1):
        append_metrics(e.where(F.col("step") % 2 == half), out)
    return read_metrics(spark, out).groupBy("run_id", "name").agg(
        F.count(F.lit(1)).alias("rows"), _round(F.sum("value"), 4).alias("total"), F.max("step").alias("last_step"), F.max("us").alias("last_us"))


@query
def summary_file(spark, sf):
    """The validation summary written as JSON and read back."""
    from shardwright.operators.evaluate import full_validation, sequence_loss
    from shardwright.sources.sinks import write_summary

    out = _shared(spark, "summary")
    write_summary(full_validation(sequence_loss(_pos_loss(spark, sf)), EVAL_T), out)
    back = spark.read.schema("loss string, perplexity string, sequences long, tokens long").json(out)
    return back.select(_round(F.col("loss")).alias("loss"), _round(F.col("perplexity")).alias("perplexity"), "sequences", "tokens")


@query
def config_rows(spark, sf):
    """S13 + P18: a configuration for every document, stored as JSON, read back, and the fields out of their bounds."""
    from shardwright.functions.columns import config_faults
    from shardwright.sources.manifests import config_from_row

    i = F.col("doc_id")
    stored = docs(spark, sf).select("doc_id", F.to_json(F.struct(
        (i % 5).alias("B"), F.length("text").cast("long").alias("T"), (i * 10).alias("max_steps"), (i % 4 - 1).alias("warmup_steps"),
        (i % 7 / 10000.0).alias("learning_rate"), F.lit(0.0).alias("min_lr"))).alias("model_config"))
    c = config_from_row(stored)
    return c.select("doc_id", F.col("cfg.B").alias("batch"), F.col("cfg.T").alias("seq_len"),
                    F.floor(F.col("cfg.max_steps") * 0.8).cast("long").alias("decay_start"), _round(F.col("cfg.learning_rate")).alias("learning_rate"),
                    F.array_join(config_faults("cfg"), ",").alias("faults"))


@query
def split_sizes(spark, sf):
    """G8 + G9: every document as a corpus of one shard: the sides of its split, and whether it is refused."""
    from shardwright.config import SPLIT_TRAIN_RATIO
    from shardwright.functions.columns import split_sizes as sizes

    train, dev, refused = sizes(F.octet_length("text") + 1, T, ONE_STRIDE, SPLIT_TRAIN_RATIO)
    return docs(spark, sf).select("doc_id", train.alias("train"), dev.alias("dev"), refused.cast("int").alias("refused"))


@query
def pinned_encoder(spark, sf):
    """A vocabulary saved under its digest, pinned by name and digest, and applied."""
    d = docs(spark, sf)
    enc = WordEncoder.pinned(spark, WordEncoder.fit(d, VOCAB).save(_shared(spark, "vocabularies")))
    out = with_eos(enc.encode(d), enc.eos_id)
    return out.select("doc_id", "n_tokens", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
                      F.lit(enc.revision).alias("revision"))


LIVE_CUTS = 3


def _cuts(df):
    """The rows in stretches of their clock, as micro-batches bring them."""
    lo, hi = df.agg(F.min("us"), F.max("us")).first()
    edges = [lo + (hi + 1 - lo) * k // LIVE_CUTS for k in range(LIVE_CUTS + 1)]
    return [df.where((F.col("us") >= a) & (F.col("us") < b)) for a, b in zip(edges, edges[1:])]


@query
def live_rate(spark, sf):
    """The rates of W1, micro-batch by micro-batch from a state table."""
    from shardwright.operators.telemetry import eta
    from shardwright.streaming.live_tables import LiveTable, rate_batch

    out = _shared(spark, "live-rate")
    for number, part in enumerate(_cuts(counters(spark, sf))):
        rate_batch(part, number, out, RATE_WINDOW_S)
    r = eta(LiveTable(spark, out).rows(), RATE_TARGET)
    return r.select("run_id", "seq", F.col("units").cast("long").alias("units"), _round(F.col("rate") * 3600).alias("rate_per_hour"),
                    _round(F.col("elapsed_s")).alias("elapsed_s"), "eta_s")


@query
def live_throttle(spark, sf):
    """T4: the rows that W5 lets through, micro-batch by micro-batch from a state table."""
    from shardwright.streaming.live_tables import LiveTable, throttle_batch

    out = _shared(spark, "live-throttle")
    for number, part in enumerate(_cuts(counters(spark, sf))):
        throttle_batch(part, number, out, THROTTLE_GAP_S, THROTTLE_TARGET)
    return LiveTable(spark, out).rows().select("run_id", "seq", "units")
