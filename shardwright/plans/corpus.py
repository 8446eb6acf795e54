"""Corpus build as one batch job.

documents → token counts → stream offsets (G1) → encode (P1) → EOS (P2) →
shard segments (G2) → committed shards / pending tail (G3) → windows (G5).

Offsets need only the token *count* of each document. For encoders that can
count in the JVM (bytes, words) the count is taken from the text, and the text
rides the single offsets shuffle; the encoder then runs once, after it. An
encoder that cannot count cheaply is run once and its output written to the
session's checkpoint folder, so both offset passes read the written table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.config import PackingConfig
from shardwright.functions.columns import with_eos
from shardwright.functions.encoders import BYTE_EOS, ByteEncoder, WordEncoder, pack_ids
from shardwright.operators import packing
from shardwright.operators.ordering import DEFAULT_ROWS_PER_BUCKET, bucket_sums, with_range_bucket
from shardwright.session import checkpoint_dir, materialize


def count_tokens(encoder, text_col: str = "text") -> Column | None:
    """Tokens of a document including EOS, computed in the JVM, or None."""
    if isinstance(encoder, ByteEncoder):
        return (F.octet_length(F.col(text_col)) + 1).cast("long")
    if isinstance(encoder, WordEncoder):
        return (F.size(WordEncoder.words(text_col)) + 1).cast("long")
    return None


def encode_with_offsets(docs: DataFrame, encoder=None, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                        n_buckets: int | None = None, base: int | Column = 0,
                        packed: bool = False, sums: DataFrame | None = None, unique: bool = False) -> tuple[DataFrame, int | None]:
    """``(doc_id, n_tokens, start, end, ids)`` with EOS appended to ``ids``, and
    the number of tokens the documents add to the stream. ``packed`` ids are 16-bit
    numbers in one BINARY. With ``sums``, the bucket sums of an earlier pass over the same
    buckets, nothing is counted again (and no number returned)."""
    encoder = encoder or ByteEncoder()
    bucketed = docs if "_obkt" in docs.columns else bucketed_documents(docs, rows_per_bucket, n_buckets)
    n = count_tokens(encoder)
    if n is not None:
        counted = bucketed.select("doc_id", "text", "_obkt", "_tie", n.alias("n_tokens"))
        off, total = packing.token_offsets(counted, bucket_col="_obkt", base=base, with_total=True, tie="_tie", sums=sums, unique=unique)
        off = off.select("doc_id", "n_tokens", "start", "end", "text")
        if packed and isinstance(encoder, ByteEncoder):
            return encoder.encode_packed(off, out="ids"), total
        enc = with_eos(encoder.encode(off).drop("text"), encoder.eos_id, n_col="n_tokens")
        return (pack_ids(enc, out="ids") if packed else enc), total
    spark = docs.sparkSession
    path = checkpoint_dir(spark).rstrip("/") + f"/encoded-{uuid.uuid4().hex}"
    enc = with_eos(encoder.encode(bucketed.select("doc_id", "text", "_obkt", "_tie")).drop("text"),
                   encoder.eos_id, n_col="n_tokens")
    enc.write.parquet(path)
    stored = spark.read.parquet(path)
    out, total = packing.token_offsets(stored, bucket_col="_obkt", base=base, with_total=True, tie="_tie", unique=unique)
    out = out.drop("_tie")
    return (pack_ids(out, out="ids") if packed else out), total


def bucketed_documents(docs: DataFrame, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, n_buckets: int | None = None,
                       tie: Column | None = None) -> DataFrame:
    """Documents with the bucket of their place in the stream and the hash that orders equal ids."""
    tied = docs.withColumn("_tie", F.xxhash64("text") if tie is None else tie)
    return with_range_bucket(tied, "doc_id", "_obkt", rows_per_bucket, n_buckets, "_tie")


def offsets_only(docs: DataFrame, encoder=None, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                 n_buckets: int | None = None, tie: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, start, end)`` and the columns ``keep`` without materialising any ids."""
    encoder = encoder or ByteEncoder()
    n = count_tokens(encoder)
    if n is None:
        raise ValueError("encoder cannot count tokens in the JVM; use encode_with_offsets")
    counted = docs.select("doc_id", *keep, n.alias("n_tokens"), (F.xxhash64("text") if tie is None else tie).alias("_tie"))
    return packing.token_offsets(counted, rows_per_bucket=rows_per_bucket, n_buckets=n_buckets, tie="_tie").drop("_tie")


def committed_segments(encoded: DataFrame, total: int | Column, cfg: PackingConfig
                       ) -> tuple[DataFrame, DataFrame, Column]:
    """(committed segments, pending segments, number of committed shards)."""
    segs = packing.cut_shards(encoded, cfg.shard_size, ids_col="ids")
    n_comm = packing.committed_shards(total, cfg.shard_size, cfg.max_shards)
    comm, pend = packing.split_committed(segs, n_comm)
    return comm, pend, n_comm


def build_windows(docs: DataFrame, cfg: PackingConfig, encoder=None,
                  rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, n_buckets: int | None = None) -> DataFrame:
    """Documents → ``(seq_index, shard, k, window)`` over committed shards."""
    enc, total = encode_with_offsets(docs, encoder, rows_per_bucket, n_buckets)
    comm, _, _ = committed_segments(enc, total, cfg)
    return packing.pack_windows(comm.select("shard", "pos", "tokens"), cfg.shard_size, cfg.seq_len, cfg.stride)


def shard_window_summary(windows: DataFrame) -> DataFrame:
    """Per shard: window count, first token of the first window, token sum."""
    return (windows.groupBy("shard")
            .agg(F.count(F.lit(1)).cast("long").alias("n_windows"),
                 F.min_by(F.try_element_at("window", F.lit(1)), "k").cast("long").alias("first_token"),
                 F.sum(F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x)).cast("long")
                 .alias("token_sum")))


__all__ = ["encode_with_offsets", "offsets_only", "committed_segments", "build_windows",
           "shard_window_summary", "count_tokens", "BYTE_EOS"]


# ---------------------------------------------------------------- write path
def write_corpus(docs: DataFrame, directory: str, cfg: PackingConfig, encoder=None, identity=None,
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> dict:
    """Batch corpus build into ``directory``: shard files, their metadata, the
    pending tail and a ledger row — in that order, so a crash before the ledger
    row leaves nothing a resume would trust. Returns the committed state."""
    from shardwright.config import BuildIdentity
    from shardwright.sources.manifests import Ledger, shard_meta_rows, write_shard_meta
    from shardwright.sources.token_shards import write_token_shards

    encoder = encoder or ByteEncoder()
    identity = identity or BuildIdentity(tokenizer_name=encoder.name, tokenizer_revision=encoder.revision)
    spark = docs.sparkSession
    ledger = Ledger(spark, directory)
    if ledger.exists():
        raise RuntimeError("a build already exists here; resume it with the streaming build")
    state = ledger.load(identity, cfg)                        # refuses shards that no state knows of
    S = cfg.shard_size
    narrow, read = planned(docs, encoder, rows_per_bucket)
    seen = narrow.agg(F.coalesce(F.max("end"), F.lit(0)).alias("total")).first()
    total = int(seen["total"])
    n = packing.full_shards(total, S, cfg.max_shards)
    cut = n * S
    # With a limit the build ends with the document that completes the last shard, and no
    # later document counts as consumed.
    capped = cfg.max_shards is not None and cfg.max_shards * S < total
    used = narrow.where(F.col("start") < cut) if capped else narrow
    seen = used.agg(F.count(F.lit(1)).alias("c"), F.max("doc_id").alias("m"), F.coalesce(F.max("end"), F.lit(0)).alias("end"),
                    F.min(F.when(F.col("end") > cut, F.col("doc_id"))).alias("tail")).first()
    comm, _ = packing.split_committed(packing.cut_shards(read(), S, ids_col="ids"), F.lit(n))
    chunks = packing.chunk_segments(comm.select("shard", "pos", "tokens"), cfg.chunk_tokens)
    write_token_shards(chunks, directory, S, shards=n)
    dim = packing.uniform_shard_dim(spark, n, S, cfg.seq_len, cfg.stride)
    write_shard_meta(shard_meta_rows(dim, identity, encoder.vocab_size), directory)
    # The pending tail is less than one shard: the documents past the cut are one range of
    # ids, read by a filter that reaches the scan, with the offsets they have already.
    pend_path = ledger.pending_path(1)
    ids = (F.col("doc_id") >= seen["tail"]) & (F.col("doc_id") <= seen["m"]) if seen["tail"] is not None else F.lit(False)
    tail = with_eos(encoder.encode(docs.select("doc_id", "text").where(ids)).drop("text"), encoder.eos_id, n_col="n_tokens")
    pend = packing.cut_shards(tail.drop("n_tokens").join(narrow.where(ids), "doc_id"), S, ids_col="ids").where(F.col("shard") >= n)
    pend.select("doc_id", F.col("lo").alias("pos"), F.col("tokens").cast("array<int>").alias("tokens")).write.mode("overwrite").parquet(pend_path)
    state.update(commit_id=1, batch_id=None, stream_id=None, next_shard=n, committed_tokens=cut,
                 pending_tokens=int(seen["end"]) - cut, pending_path=pend_path,
                 source_documents_consumed=int(seen["c"]), last_doc_id=seen["m"])
    ledger.commit(state)
    return state


def planned(docs: DataFrame, encoder, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET):
    """The offsets of all documents ``(doc_id, n_tokens, start, end)``, written once to the shared folder,
    and a function that gives the documents with their packed ids at these offsets.

    A build goes on by ``doc_id``: documents without one, or with one that another has, are refused."""
    spark = docs.sparkSession
    path = checkpoint_dir(spark).rstrip("/") + f"/offsets-{uuid.uuid4().hex}"
    bucketed = bucketed_documents(docs, rows_per_bucket)
    counting = count_tokens(encoder) is not None
    stored_path = path + ("-counts" if counting else "-encoded")
    if counting:                                              # one scan of the texts; what follows reads its numbers
        bucketed.select("doc_id", "_obkt", "_tie", count_tokens(encoder).alias("n_tokens")).write.parquet(stored_path)
    else:
        with_eos(encoder.encode(bucketed.select("doc_id", "text", "_obkt", "_tie")).drop("text"),
                 encoder.eos_id, n_col="n_tokens").write.parquet(stored_path)
    stored = spark.read.parquet(stored_path)
    counts = stored.select("doc_id", "_obkt", "_tie", "n_tokens")
    sums = materialize(bucket_sums(counts, "n_tokens", "_obkt"))
    off = packing.token_offsets(counts, bucket_col="_obkt", tie="_tie", sums=sums, unique=True)
    off.select("doc_id", "n_tokens", "start", "end").write.parquet(path)
    narrow = spark.read.parquet(path)

    def read() -> DataFrame:
        if counting:
            return encode_with_offsets(bucketed, encoder, packed=True, sums=sums)[0]
        return pack_ids(packing.token_offsets(stored, bucket_col="_obkt", tie="_tie", sums=sums), out="ids")

    return narrow, read
