"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Every query is executed in full through the ``noop`` sink (no collect, no
driver transfer). Prints one JSON line; ``value`` is the total seconds of the
headline queries. Token throughputs of the corpus build are reported next to
the per-query times.
"""

from __future__ import annotations

import json
import os
import platform
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "doc_token_counts", "token_offsets", "shard_segments", "pack_windows", "epoch_order", "remaining_plan", "word_encode",
    "cross_entropy", "validation", "choice_accuracy", "decode_policy", "candidate_sample", "rolling_rate",
    "interval_average", "throttle", "audit_manifest", "ngram_loops",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("BENCH_CPUS", cpus)
    from pyspark.sql import functions as F

    from shardwright.plans.registry import REGISTRY
    from shardwright.session import checkpoint_dir, get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    checkpoint_dir(spark)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in REGISTRY]
    # warm the JVM and the Python workers once (not timed)
    REGISTRY["doc_token_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    if not sys.argv[1:]:
        # E1 written to disk, then E2's scalable read: windows straight from the
        # `.bin` shards through the data source (no shuffle)
        import uuid

        from shardwright.config import PackingConfig
        from shardwright.plans import corpus
        from shardwright.plans.registry import S, STRIDE, T, docs as read_docs
        from shardwright.sources.token_shards import read_windows

        out = checkpoint_dir(spark).rstrip("/") + f"/bench-corpus-{uuid.uuid4().hex}"
        cfg = PackingConfig(shard_size=S, seq_len=T, stride=STRIDE)
        t0 = time.perf_counter()
        state = corpus.write_corpus(read_docs(spark, sf_dir), out, cfg)
        times["corpus_write_bin"] = round(time.perf_counter() - t0, 3)
        t0 = time.perf_counter()
        read_windows(spark, out, T, STRIDE).write.format("noop").mode("overwrite").save()
        times["windows_from_bin"] = round(time.perf_counter() - t0, 3)
        committed = state["committed_tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = docs.select(F.sum(F.octet_length("text") + 1)).first()[0]
    extra = {}
    if "doc_token_counts" in times:
        extra["encode_tokens_per_s"] = round(tokens / times["doc_token_counts"])
    if "pack_windows" in times:
        extra["build_windows_tokens_per_s"] = round(tokens / times["pack_windows"])
    if "token_offsets" in times:
        extra["offsets_tokens_per_s"] = round(tokens / times["token_offsets"])
    if "shard_segments" in times:
        extra["offsets_and_cut_tokens_per_s"] = round(tokens / times["shard_segments"])
    if "epoch_order" in times:
        from shardwright.plans.registry import _train

        _, n_train = _train(spark, sf_dir)
        extra["epoch_order_windows_per_s"] = round(2 * n_train / times["epoch_order"])   # two epochs
    # largest window partition of the offsets pass (documents in one bucket)
    from shardwright.operators.ordering import with_range_bucket

    b = with_range_bucket(docs.select("doc_id"), "doc_id", "_b")
    extra["peak_bucket_docs"] = int(b.groupBy("_b").count().agg(F.max("count")).first()[0])
    if "corpus_write_bin" in times:
        extra["corpus_write_tokens_per_s"] = round(tokens / times["corpus_write_bin"])
        extra["windows_from_bin_tokens_per_s"] = round(committed / times["windows_from_bin"])
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
           "tokens": int(tokens), **extra,
           "hardware": {"cpus": int(cpus), "machine": platform.machine(), "python": platform.python_version()}}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
