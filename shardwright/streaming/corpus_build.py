"""Incremental corpus build with exact resume.

``readStream`` of documents → ``foreachBatch``. Every micro-batch continues the
token stream where the ledger says it stopped: its documents are offset after
the committed tokens plus the pending buffer, complete shards are written
(shard files, metadata), the new pending buffer is written, and the ledger row
is appended last. The state is audited before anything is added to it. A batch
number counts only within its stream: a replayed batch of the same stream finds
its row and does nothing, a first batch of another stream over the same build
is not taken for a replay. A batch that died before its ledger row is
recomputed; its earlier files no commit names. Batches must arrive in ``doc_id``
order; an out-of-order batch is refused because it would change the stream.
Shards, pending rows and documents consumed are those of the batch build for
any way the documents are cut into batches, with a limit on the shards or without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.config import BuildIdentity, PackingConfig
from shardwright.functions.encoders import ByteEncoder
from shardwright.operators import packing
from shardwright.operators.audit import is_complete
from shardwright.plans.corpus import encode_with_offsets
from shardwright.sources.manifests import Ledger, shard_meta_rows, write_shard_meta
from shardwright.sources.token_shards import write_token_shards


def build_batch(batch: DataFrame, batch_id: int, directory: str, cfg: PackingConfig, encoder=None,
                identity: BuildIdentity | None = None, stream_id: str = "") -> dict | None:
    """Apply one micro-batch of documents of a stream to the build in ``directory``."""
    encoder = encoder or ByteEncoder()
    identity = identity or BuildIdentity(tokenizer_name=encoder.name, tokenizer_revision=encoder.revision)
    spark = batch.sparkSession
    ledger = Ledger(spark, directory)
    state = ledger.load(identity, cfg)
    if state["stream_id"] == stream_id and state["batch_id"] is not None and state["batch_id"] >= batch_id:
        return None                                   # replayed batch: already committed
    if is_complete(state):
        return None                                   # T2: nothing left to do
    docs = batch.select("doc_id", "text")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("lo"),
                     F.max("doc_id").alias("hi")).first()
    if stats["n"] == 0:
        return None
    if stats["ids"] < stats["n"]:
        raise RuntimeError(f"{stats['n'] - stats['ids']} documents of the batch have no doc_id")
    if state["last_doc_id"] is not None and stats["lo"] <= state["last_doc_id"]:
        raise RuntimeError(f"documents out of order: batch starts at {stats['lo']} after {state['last_doc_id']}")
    S = cfg.shard_size
    base = int(state["committed_tokens"]) + int(state["pending_tokens"] or 0)
    enc, total = encode_with_offsets(docs, encoder, base=base, unique=True)
    new = packing.cut_shards(enc, S, ids_col="ids").select("doc_id", "shard", "lo", "pos", "tokens")
    old = ledger.pending(state)
    if state.get("pending_path"):
        old = old.select("doc_id", F.col("pos").alias("lo"), "tokens").withColumn(
            "shard", F.floor(F.col("lo") / S).cast("int")).withColumn(
            "pos", F.col("lo") - F.col("shard").cast("long") * S).select("doc_id", "shard", "lo", "pos", "tokens")
        segs = old.unionByName(new)
    else:
        segs = new
    end = base + int(total)
    n_full = packing.full_shards(end, S, cfg.max_shards)
    first = int(state["next_shard"])
    if cfg.max_shards is not None and cfg.max_shards * S < end:
        # the limit binds in this batch: documents after the one that completes it stay unread
        cut = cfg.max_shards * S
        segs = segs.join(enc.where(F.col("start") >= cut).select("doc_id"), "doc_id", "left_anti")
        stats = enc.where(F.col("start") < cut).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("hi"), F.max("end").alias("end")).first()
        end = max(base, int(stats["end"] or 0))
        if stats["n"] == 0:
            stats = {"n": 0, "hi": state["last_doc_id"]}
    if n_full > first:
        done = segs.filter((F.col("shard") >= first) & (F.col("shard") < n_full))
        chunks = packing.chunk_segments(done.select("shard", "pos", "tokens"), cfg.chunk_tokens)
        write_token_shards(chunks, directory, S, shards=n_full - first)
        dim = packing.uniform_shard_dim(spark, n_full, S, cfg.seq_len, cfg.stride).filter(F.col("shard") >= first)
        write_shard_meta(shard_meta_rows(dim, identity, encoder.vocab_size), directory)
    commit_id = int(state["commit_id"]) + 1
    pend_path = ledger.pending_path(commit_id)
    rest = segs.filter(F.col("shard") >= n_full).select("doc_id", F.col("lo").alias("pos"), "tokens")
    rest.write.mode("overwrite").parquet(pend_path)
    new_state = dict(state)
    new_state.update(commit_id=commit_id, batch_id=batch_id, stream_id=stream_id, next_shard=n_full, committed_tokens=n_full * S,
                     pending_tokens=end - n_full * S, pending_path=pend_path, last_doc_id=stats["hi"],
                     source_documents_consumed=int(state["source_documents_consumed"] or 0) + int(stats["n"]))
    ledger.commit(new_state)
    ledger.retire(new_state)
    return new_state


def start_corpus_build(stream: DataFrame, directory: str, cfg: PackingConfig, checkpoint: str,
                       encoder=None, identity: BuildIdentity | None = None, available_now: bool = True):
    """Start the incremental build; the streaming checkpoint is the source cursor and
    names the stream."""
    def run(df: DataFrame, batch_id: int) -> None:
        build_batch(df, batch_id, directory, cfg, encoder, identity, stream_id=checkpoint)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="0 seconds")
    return w.start()


def resume_build(spark: SparkSession, path: str, directory: str, cfg: PackingConfig, checkpoint: str, encoder=None,
                 identity: BuildIdentity | None = None, max_documents: int | None = None):
    """Goes on with a build over the table it has begun: a stream of the documents that its ledger does
    not count yet, in ``doc_id`` order, which ends when the table or the build is complete."""
    from shardwright.sources.document_stream import documents_after

    stream = documents_after(spark, path, directory, max_documents=max_documents)
    query = start_corpus_build(stream, directory, cfg, checkpoint, encoder, identity, available_now=max_documents is None)
    if max_documents is None:
        query.awaitTermination()
    else:
        query.processAllAvailable()
        query.stop()
    return Ledger(spark, directory).latest()


def completion(spark: SparkSession, directory: str) -> bool:
    """Report completion from the ledger (not from the source running dry)."""
    st = Ledger(spark, directory).latest()
    return bool(st) and is_complete(st)
