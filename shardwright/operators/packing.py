"""Token-stream packing and sample geometry.

The global token stream is never materialised as rows. Each document carries
its ``[start, end)`` offsets in the stream (a two-level prefix sum, G1); shards
are cut as document *segments* (G2); windows are assembled from the pieces of
segments that overlap them (G5), grouped by ``(shard, k)``: such a group never
exceeds T+1 tokens. Tables of windows without tokens are generated from a range
over all windows, in as many tasks as their number asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.config import SPLIT_TRAIN_RATIO, windows_in
from shardwright.operators.ordering import (DEFAULT_ROWS_PER_BUCKET, bucket_sums, global_position,
                                            prefix_sum, with_range_bucket)


def upto(n: Column) -> Column:
    """``[0, n)`` as an array; empty for n ≤ 0 (``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(
        F.array().cast("array<long>"))


def _floor_div(x: Column, d: int) -> Column:
    """Python-style floor division for integer columns (Spark ``div`` truncates)."""
    return F.floor(x / F.lit(d)).cast("long")


# ---------------------------------------------------------------- G1
def token_offsets(df: DataFrame, id_col: str = "doc_id", n_col: str = "n_tokens",
                  bucket_col: str | None = None, base: int | Column = 0,
                  rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                  n_buckets: int | None = None, with_total: bool = False, tie: str | None = None,
                  sums: DataFrame | None = None, unique: bool = False):
    """Add ``start``/``end``: the document's range in the global token stream.

    Order is ``id_col``, documents without an id first, equal ids by ``tie`` (a 64-bit hash of what
    the documents hold) and their number of tokens. ``bucket_col`` (contiguous in id order, bounded) is
    taken from the input when given, else derived from id statistics. With
    ``with_total`` the per-bucket token sums (one row per bucket) are computed
    once and checkpointed; the stream length is returned as a number and the
    offsets reuse the same table, so later actions never re-read the corpus
    to learn its length. ``sums`` of an earlier pass are taken as they are, without a total.
    With ``unique`` a document without an id, or with the id of another one, is an error.
    """
    from shardwright.session import materialize

    if bucket_col is None:
        df = with_range_bucket(df, id_col, "_obkt", rows_per_bucket, n_buckets, tie)
        bucket_col = "_obkt"
    given = sums is not None
    if with_total and not given:
        sums = materialize(bucket_sums(df, n_col, bucket_col))
    same = {"_same": lambda w: F.lag(id_col).over(w) == F.col(id_col)} if unique else None
    out = prefix_sum(df, n_col, [id_col, *([tie] if tie else []), n_col], bucket_col, "start", sums=sums, also=same)
    if unique:
        refused = F.when(F.col(id_col).isNull(), F.raise_error(F.lit(f"a document has no {id_col}"))).when(
            F.col("_same"), F.raise_error(F.concat(F.lit(f"two documents have the {id_col} "), F.col(id_col).cast("string"))))
        out = out.withColumn(id_col, refused.otherwise(F.col(id_col))).drop("_same")
    b = F.lit(base) if isinstance(base, int) else base
    out = out.withColumn("start", (F.col("start") + b).cast("long"))
    out = out.withColumn("end", (F.col("start") + F.col(n_col)).cast("long")).drop("_obkt")
    if with_total:
        return out, None if given else int(sums.agg(F.coalesce(F.sum("_ps"), F.lit(0))).first()[0])
    return out


def total_tokens(df: DataFrame, n_col: str = "n_tokens") -> Column:
    """Scalar-subquery column with the stream length (partial + final aggregate)."""
    return df.select(F.coalesce(F.sum(n_col), F.lit(0)).cast("long")).scalar()


def full_shards(total: int, shard_size: int, max_shards: int | None = None) -> int:
    """Complete shards of a stream; ``max_shards`` is a limit only when given."""
    n = total // shard_size
    return n if max_shards is None else min(max_shards, n)


def committed_shards(total: Column | int, shard_size: int, max_shards: int | None = None) -> Column:
    if isinstance(total, int):
        return F.lit(full_shards(total, shard_size, max_shards)).cast("long")
    n = _floor_div(total, shard_size)
    return n if max_shards is None else F.least(F.lit(max_shards).cast("long"), n)


# ---------------------------------------------------------------- G2, G3, M10
def _packed(df: DataFrame, ids_col: str) -> bool:
    """Whether ids come as packed 16-bit numbers rather than as an array."""
    return df.schema[ids_col].dataType.simpleString() == "binary"


def _cutter(df: DataFrame, ids_col: str | None):
    """``(first, n) → ids[first : first + n]``, for id arrays and packed ids alike."""
    if ids_col and _packed(df, ids_col):
        return lambda a, n: F.substring(F.col(ids_col), (2 * a + 1).cast("int"), (2 * n).cast("int"))
    return lambda a, n: F.slice(F.col(ids_col), (a + 1).cast("int"), n.cast("int"))


def cut_shards(df: DataFrame, shard_size: int, ids_col: str | None = "ids",
               keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per (document, shard) segment: ``shard, lo, hi`` in stream
    coordinates, ``pos`` = offset inside the shard and, when ``ids_col`` is
    given, ``tokens`` = the segment's ids. Works on [start, end) offsets."""
    S = shard_size
    cut = _cutter(df, ids_col)
    s0, s1 = _floor_div(F.col("start"), S), _floor_div(F.col("end") - 1, S)

    def seg(s):
        lo = F.greatest(F.col("start"), s * S)
        hi = F.least(F.col("end"), (s + 1) * S)
        fields = [s.alias("shard"), lo.alias("lo"), hi.alias("hi")]
        if ids_col:
            fields.append(cut(lo - F.col("start"), hi - lo).alias("tokens"))
        return F.struct(*fields)

    segs = F.when(F.col("end") > F.col("start"), F.transform(F.sequence(s0, s1), seg))
    out = df.select(*keep, "start", "end", F.explode(segs).alias("g")).select(
        *keep, "start", "end", "g.*")
    return out.withColumn("shard", F.col("shard").cast("int")).withColumn(
        "pos", F.col("lo") - F.col("shard").cast("long") * S)


def split_committed(segments: DataFrame, n_committed: Column) -> tuple[DataFrame, DataFrame]:
    """(committed segments, pending tail). The incomplete last shard and
    anything past ``max_shards`` are pending, never a shard."""
    return (segments.filter(F.col("shard") < n_committed),
            segments.filter(F.col("shard") >= n_committed))


def build_totals(offsets: DataFrame, shard_size: int, max_shards: int | None, total: int | None = None,
                 n_col: str = "n_tokens") -> DataFrame:
    """Documents used, shards/tokens committed and pending for a build.

    Without a cap the whole source is consumed; when ``max_shards`` binds, the
    build stops with the document that completes the last shard. ``total`` is
    the stream length when already known (``token_offsets(with_total=True)``)."""
    if total is None:
        total = int(offsets.agg(F.coalesce(F.sum(n_col), F.lit(0))).first()[0])
    n_comm = full_shards(total, shard_size, max_shards)
    cut = n_comm * shard_size
    capped = max_shards is not None and max_shards * shard_size < total
    used = (F.col("start") < cut) if capped else F.lit(True)
    return offsets.agg(
        F.sum(F.when(used, 1).otherwise(0)).cast("long").alias("documents_used"),
        F.lit(n_comm).cast("long").alias("shards_committed"),
        F.lit(cut).cast("long").alias("committed_tokens"),
        F.sum(F.when(used, F.greatest(F.col("end") - F.greatest(F.col("start"), F.lit(cut)),
                                      F.lit(0))).otherwise(0)).cast("long").alias("pending_tokens"),
        F.lit(total).cast("long").alias("stream_tokens"),
    )


def chunk_segments(segments: DataFrame, chunk_tokens: int) -> DataFrame:
    """Split segments at multiples of ``chunk_tokens`` inside each shard, so no
    row holds more than one chunk: ``(shard, chunk, pos, tokens)``."""
    C = chunk_tokens
    size = F.octet_length("tokens") / 2 if _packed(segments, "tokens") else F.size("tokens")
    a, b = F.col("pos"), F.col("pos") + size.cast("long")
    cut = _cutter(segments, "tokens")

    def piece(c):
        lo = F.greatest(a, c * C)
        hi = F.least(b, (c + 1) * C)
        return F.struct(c.alias("chunk"), lo.alias("pos"), cut(lo - a, hi - lo).alias("tokens"))

    parts = F.when(b > a, F.transform(F.sequence(_floor_div(a, C), _floor_div(b - 1, C)), piece))
    return segments.select("shard", F.explode(parts).alias("p")).select("shard", "p.*")


# ---------------------------------------------------------------- G4
def shard_dim(shards: DataFrame, seq_len: int, stride: int | None = None,
              shard_col: str = "shard", n_col: str = "n_tokens") -> DataFrame:
    """Per shard: tokens, windows, [seq_start, seq_end) of its global indices.

    The input has one row per shard (thousands at most), so the running sum
    is a window over a small table."""
    step = seq_len if stride is None else stride
    windows_in(1, seq_len, step)  # validates geometry
    n = F.col(n_col)
    nseq = F.greatest(F.lit(0), F.floor((n - F.lit(seq_len + 1)) / F.lit(step)) + 1).cast("long")
    w = Window.orderBy(shard_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (shards.select(F.col(shard_col).cast("int").alias("shard"), n.cast("long").alias("n_tokens"))
            .withColumn("n_seqs", nseq)
            .withColumn("seq_end", F.sum("n_seqs").over(w).cast("long"))
            .withColumn("seq_start", (F.col("seq_end") - F.col("n_seqs")).cast("long"))
            .select("shard", "n_tokens", "n_seqs", "seq_start", "seq_end"))


ROWS_PER_TASK = 1 << 20     # generated rows of one task, at most


def range_of(spark, n: int) -> DataFrame:
    """``id`` in ``[0, n)``, over every core and never more than ``ROWS_PER_TASK`` a task."""
    parts = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    return spark.range(0, max(0, n), 1, min(parts, max(1, n)))


def uniform_shard_dim(spark, n_shards: int, shard_size: int, seq_len: int,
                      stride: int | None = None) -> DataFrame:
    """shard_dim of ``n_shards`` full shards of ``shard_size`` tokens."""
    nw = windows_in(shard_size, seq_len, seq_len if stride is None else stride)
    return (range_of(spark, n_shards)
            .select(F.col("id").cast("int").alias("shard"), F.lit(shard_size).cast("long").alias("n_tokens"),
                    F.lit(nw).cast("long").alias("n_seqs"), (F.col("id") * nw).alias("seq_start"),
                    ((F.col("id") + 1) * nw).alias("seq_end")))


def uniform_window_spans(spark, n_shards: int, shard_size: int, seq_len: int, stride: int | None = None) -> DataFrame:
    """``window_spans`` of ``n_shards`` shards of one size, in closed form over the window number."""
    step = seq_len if stride is None else stride
    nw = windows_in(shard_size, seq_len, step)
    k = F.col("id") % F.lit(max(1, nw))
    return range_of(spark, n_shards * nw).select(
        F.col("id").alias("seq_index"), F.floor(F.col("id") / F.lit(max(1, nw))).cast("int").alias("shard"), k.alias("k"),
        (k * step).alias("tok_lo"), (k * step + seq_len + 1).alias("tok_hi"))


# ---------------------------------------------------------------- G5
WINDOW_CHUNK = 1 << 15      # tokens of a shard whose windows are cut together, about


def pack_windows(segments: DataFrame, shard_size: int, seq_len: int,
                 stride: int | None = None, chunk_tokens: int = WINDOW_CHUNK) -> DataFrame:
    """Windows of T+1 tokens at ``stride`` inside full shards of S tokens.

    ``segments`` = committed ``(shard, pos, tokens)``. Output
    ``(seq_index, shard, k, window)``; windows never cross a shard.

    Tokens are shuffled once, to chunks of a shard: a chunk holds the windows that begin in its
    stretch, so the tokens they reach beyond it are copied to it as well (T of ``chunk_tokens``). Windows
    are slices of their chunk, however much they overlap.
    """
    step = seq_len if stride is None else stride
    nw = windows_in(shard_size, seq_len, step)
    L = seq_len + 1
    many = max(1, chunk_tokens // step)                       # windows of a chunk
    width = many * step
    reach = (many - 1) * step + L                             # tokens from the chunk's first to its last window's end
    chunks = -(-nw // many)
    a, b = F.col("pos"), F.col("pos") + F.size("tokens")
    c0 = F.greatest(F.lit(0).cast("long"), _floor_div(a - reach, width) + 1)
    c1 = F.least(F.lit(chunks - 1).cast("long"), _floor_div(b - 1, width))

    def piece(c):
        lo = F.greatest(a, c * width)
        hi = F.least(b, c * width + reach)
        return F.struct(c.alias("c"), lo.alias("plo"),
                        F.slice("tokens", (lo - a + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))

    pieces = F.when((c1 >= c0) & (b > a), F.transform(F.sequence(c0, c1), piece))
    held = (segments.select("shard", F.explode(pieces).alias("p"))
            .select("shard", "p.c", F.struct("p.plo", "p.piece").alias("p")).where(F.size("p.piece") > 0)
            .groupBy("shard", "c").agg(F.array_sort(F.collect_list("p")).alias("ps"))
            .select("shard", "c", F.flatten(F.transform("ps", lambda x: x["piece"])).alias("_tokens")))
    first = F.col("c") * many
    ks = F.sequence(first, F.least(first + many, F.lit(nw).cast("long")) - 1)
    out = held.select("shard", "_tokens", "c", F.explode(ks).alias("k")).select(
        "shard", "k", F.slice("_tokens", ((F.col("k") - first) * step + 1).cast("int"), L).alias("window"))
    return out.select((F.col("shard").cast("long") * nw + F.col("k")).cast("long").alias("seq_index"),
                      F.col("shard").cast("int").alias("shard"), F.col("k").cast("long").alias("k"),
                      F.col("window").cast("array<int>").alias("window"))


SPAN = 4096                 # windows of a shard generated together


def window_spans(spark, dim: DataFrame, seq_len: int, stride: int | None = None) -> DataFrame:
    """One row per window from shard_dim alone: ``(seq_index, shard, k, tok_lo, tok_hi)``
    with token offsets inside the shard. No token data needed. A shard's windows are
    generated in spans dealt over the tasks, so one large shard is no one task."""
    step = seq_len if stride is None else stride
    n = max(2, 2 * spark.sparkContext.defaultParallelism)
    spans = (dim.filter(F.col("n_seqs") > 0)
             .select("shard", "seq_start", "n_seqs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_seqs") - 1, F.lit(SPAN).cast("long"))).alias("_k0"))
             .repartition(n, "shard", "_k0"))
    return (spans.select("shard", "seq_start", F.explode(F.sequence("_k0", F.least(F.col("_k0") + SPAN, F.col("n_seqs")) - 1)).alias("k"))
            .select((F.col("seq_start") + F.col("k")).alias("seq_index"), "shard", "k",
                    (F.col("k") * step).alias("tok_lo"),
                    (F.col("k") * step + seq_len + 1).alias("tok_hi")))


# ---------------------------------------------------------------- G6
def _global_index(idx: DataFrame, idx_col: str, total: int) -> tuple[DataFrame, Column, Column]:
    gi = F.when(F.col(idx_col) < 0, F.col(idx_col) + F.lit(total)).otherwise(F.col(idx_col)).cast("long")
    ok = (F.col("_gi") >= 0) & (F.col("_gi") < F.lit(total))
    error = F.when(~ok, F.format_string("no window %d among %d", F.col(idx_col), F.lit(total)))
    return idx.withColumn("_gi", gi), ok, error


def lookup_uniform(idx: DataFrame, n_shards: int, windows_per_shard: int, idx_col: str = "idx") -> DataFrame:
    """Global index → (shard, k) over shards of one size: a division. Negative
    indices count from the end; one out of range has ``shard = NULL`` and ``error``."""
    df, ok, error = _global_index(idx, idx_col, n_shards * windows_per_shard)
    nw = F.lit(max(1, windows_per_shard))
    return (df.withColumn("shard", F.when(ok, F.floor(F.col("_gi") / nw)).cast("int"))
            .withColumn("k", F.when(ok, F.col("_gi") % nw).cast("long")).withColumn("error", error).drop("_gi"))


def lookup_windows(idx: DataFrame, dim: DataFrame, idx_col: str = "idx") -> DataFrame:
    """Global index → (shard, k) over shards of any sizes (a ``shard_dim`` table).

    The index range is cut into about as many equal bins as there are shards; a shard
    lies in the bins it touches, a request in one, so the range condition becomes an
    equality on the bin."""
    top = dim.agg(F.coalesce(F.max("seq_end"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, width = top["t"], max(1, -(-top["t"] // max(1, top["n"])))
    df, ok, error = _global_index(idx, idx_col, total)
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    bins = (dim.filter(F.col("n_seqs") > 0)
            .select(F.col("shard").cast("int").alias("shard"), F.col("seq_start").alias("_s"), F.col("seq_end").alias("_e"),
                    F.explode(F.sequence(bin_of(F.col("seq_start")), bin_of(F.col("seq_end") - 1))).alias("_b")))
    j = df.withColumn("_b", F.when(ok, bin_of(F.col("_gi")))).alias("q").join(
        bins.alias("d"), (F.col("q._b") == F.col("d._b")) & (F.col("q._gi") >= F.col("d._s")) & (F.col("q._gi") < F.col("d._e")), "left")
    return j.select("q.*", "d.shard", (F.col("q._gi") - F.col("d._s")).alias("k")).withColumn("error", error).drop("_gi", "_b")


# ---------------------------------------------------------------- G7, G8, G9
def train_shard_count(n_shards: int) -> int:
    """min(n−1, max(1, round(0.95·n))) with Python's half-even rounding."""
    if n_shards < 2:
        raise ValueError("a shard-boundary split needs at least two shards")
    return min(n_shards - 1, max(1, round(SPLIT_TRAIN_RATIO * n_shards)))


def single_shard_split(n_seqs: int, seq_len: int, stride: int | None = None) -> tuple[int, int]:
    """(split_index, dev_start) for one shard: a gap of ⌈T/stride⌉ windows."""
    step = seq_len if stride is None else stride
    split_index = int(SPLIT_TRAIN_RATIO * n_seqs)
    gap = (seq_len + step - 1) // step
    return split_index, min(n_seqs, split_index + gap)


def split_windows(windows: DataFrame, n_shards: int, n_seqs_total: int, seq_len: int,
                  stride: int | None = None, dev_base: int | None = None) -> DataFrame:
    """Add ``split`` ('train'/'dev') and ``local_index`` (index inside the
    split's dataset). Windows in the single-shard gap are dropped.

    ``dev_base`` = first global index of the dev shards (multi-shard case)."""
    if n_shards >= 2:
        cut = train_shard_count(n_shards)
        if dev_base is None:
            raise ValueError("dev_base (seq_start of shard `cut`) is required")
        is_train = F.col("shard") < cut
        return (windows.withColumn("split", F.when(is_train, "train").otherwise("dev"))
                .withColumn("local_index", F.when(is_train, F.col("seq_index"))
                            .otherwise(F.col("seq_index") - F.lit(dev_base)).cast("long")))
    split_index, dev_start = single_shard_split(n_seqs_total, seq_len, stride)
    s = F.col("seq_index")
    return (windows.filter((s < split_index) | (s >= dev_start))
            .withColumn("split", F.when(s < split_index, "train").otherwise("dev"))
            .withColumn("local_index", F.when(s < split_index, s).otherwise(s - dev_start).cast("long")))


def check_split(n_train: int, n_dev: int) -> None:
    if n_train == 0 or n_dev == 0:
        raise ValueError("one side of the train/dev split would be empty: more shards or a longer stream are needed")


# ---------------------------------------------------------------- G10
def shuffle_key(seed: int, epoch: int | Column, idx: Column | str = "local_index") -> Column:
    """md5 of "seed+epoch:index": the per-epoch permutation key."""
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.md5(F.concat((F.lit(seed) + e).cast("string"), F.lit(":"), i.cast("string")))


def hash_digits(n_rows: int | None, rows_per_bucket: int = 250_000) -> int:
    """Hex digits of the md5 prefix used as rank bucket: 16^d buckets of about
    ``rows_per_bucket`` rows each (3 digits = 4,096 buckets when unknown)."""
    if n_rows is None:
        return 3
    return max(1, min(6, math.ceil(math.log(max(n_rows / rows_per_bucket, 1), 16)) + 1))


def epoch_order(df: DataFrame, seed: int, epoch: int, idx_col: str = "local_index",
                n_rows: int | None = None, partition: str | None = None) -> DataFrame:
    """Seeded permutation for one epoch: ``position`` = rank by the md5 key.

    Two-level rank: hash-prefix buckets (uniform by construction, 16^d of
    them) → bucket counts → bases → row_number inside a bucket."""
    if epoch < 0:
        raise ValueError("epoch cannot be negative")
    digits = hash_digits(n_rows)
    keyed = (df.withColumn("epoch", F.lit(epoch).cast("int"))
             .withColumn("_key", shuffle_key(seed, epoch, idx_col))
             .withColumn("_kb", F.conv(F.substring("_key", 1, digits), 16, 10).cast("long")))
    return global_position(keyed, ["_key", idx_col], "_kb", "position",
                           partition=[partition] if partition else None).drop("_key", "_kb")


def multi_epoch_order(df: DataFrame, seed: int, epochs: list[int], idx_col: str = "local_index",
                      n_rows: int | None = None) -> DataFrame:
    """Permutations of several epochs at once (partitioned by epoch)."""
    if any(e < 0 for e in epochs):
        raise ValueError("epoch cannot be negative")
    ex = df.withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("int") for e in epochs])))
    keyed = (ex.withColumn("_key", shuffle_key(seed, F.col("epoch"), idx_col))
             .withColumn("_kb", F.conv(F.substring("_key", 1, hash_digits(n_rows)), 16, 10).cast("long")))
    return global_position(keyed, ["_key", idx_col], "_kb", "position", partition=["epoch"]).drop("_key", "_kb")


# ---------------------------------------------------------------- G11–G14
def assign_batches(df: DataFrame, batch_size: int, n_rows: int, drop_last: bool,
                   position_col: str = "position") -> DataFrame:
    """``batch = position div B``; train drops the last partial batch."""
    if batch_size <= 0:
        raise ValueError("batch size must be greater than zero")
    out = df.withColumn("batch", F.floor(F.col(position_col) / batch_size).cast("long"))
    if drop_last:
        out = out.filter(F.col(position_col) < F.lit((n_rows // batch_size) * batch_size))
    return out


def n_batches(n_rows: int, batch_size: int, drop_last: bool) -> int:
    return n_rows // batch_size if drop_last else -(-n_rows // batch_size)


def assign_steps(df: DataFrame, accum: int, batches_per_epoch: int) -> DataFrame:
    """``step = batch div accum`` inside an epoch; the epoch must divide evenly."""
    if batches_per_epoch % accum:
        raise ValueError(f"{batches_per_epoch} batches per epoch are no whole number of steps of {accum} batches")
    steps_per_epoch = batches_per_epoch // accum
    return df.withColumn("step", (F.col("epoch").cast("long") * steps_per_epoch
                                  + F.floor(F.col("batch") / accum)).cast("long"))


def assign_ranks(df: DataFrame, world: int) -> DataFrame:
    """Batches to worker ranks, round-robin."""
    return df.withColumn("rank", F.pmod(F.col("batch"), F.lit(world)).cast("int"))


def data_position_py(step: int, accum: int, batches_per_epoch: int) -> tuple[int, int]:
    if step < 0:
        raise ValueError("step cannot be negative")
    return divmod(step * accum, batches_per_epoch)


def remaining_plan(spark, seed: int, batch_size: int, accum: int, n_train: int, step: int, max_steps: int) -> DataFrame:
    """The batches still to run after ``step``, epoch by epoch, each epoch in its own order
    (``operators.permutation``): ``(epoch, position, local_index, batch, step)``. Only what is left to run is
    generated, whatever was consumed; a window's columns come by a join on ``local_index``."""
    from shardwright.operators.permutation import orders

    if batch_size <= 0:
        raise ValueError("batch size must be greater than zero")
    per_epoch = n_batches(n_train, batch_size, True)
    if per_epoch == 0:
        raise ValueError("no full training batch")
    if step < 0:
        raise ValueError("step cannot be negative")
    plan = orders(spark, n_train, per_epoch * batch_size, step * accum * batch_size, max_steps * accum * batch_size, seed)
    plan = plan.withColumn("batch", F.floor(F.col("position") / batch_size).cast("long"))
    return assign_steps(plan.withColumn("epoch", F.col("epoch").cast("int")), accum, per_epoch)


# ---------------------------------------------------------------- G15, M4
def dev_sample_plan(spark, n_evals: int, dev_batches: int, eval_batches: int,
                    cursor: int = 0) -> DataFrame:
    """Rotating dev sample: evaluation j reads batches (cursor + j·k + i) mod n,
    i < k = min(eval_batches, n). ``n_evals`` is the number of evaluations."""
    if dev_batches <= 0:
        raise RuntimeError("there is no dev batch to sample")
    k = min(eval_batches, dev_batches)
    c = cursor % dev_batches
    return (spark.range(n_evals).withColumnRenamed("id", "eval_no")
            .select("eval_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1))).alias("i"))
            .withColumn("dev_batch", F.pmod(F.lit(c) + F.col("eval_no") * k + F.col("i"), F.lit(dev_batches)))
            .withColumn("cursor_after", F.pmod(F.lit(c) + (F.col("eval_no") + 1) * k, F.lit(dev_batches))))


def weighted_loss(df: DataFrame, by: list[str], loss_col: str = "loss", n_col: str = "n_tokens") -> DataFrame:
    """M4: token-weighted mean loss, float64 sums."""
    return df.groupBy(*by).agg(
        (F.sum(F.col(loss_col).cast("double") * F.col(n_col)) / F.sum(F.col(n_col))).alias("sampled_loss"),
        F.sum(n_col).cast("long").alias("tokens"),
        F.countDistinct("batch").cast("long").alias("batches"))


# ---------------------------------------------------------------- G16, G17
INTERVAL_BUCKET = 1 << 20   # tokens


def _covered(iv: DataFrame, part: list[str], kinds: dict[str, Column]) -> DataFrame:
    """For each kind, the tokens that its intervals ``[lo, hi)`` cover, per row: what an
    interval adds to the intervals before it. One two-level pass over buckets of ``lo``,
    so a long shard is many groups."""
    from shardwright.operators.ordering import prefix_aggs

    tagged = iv.withColumn("_ib", F.floor(F.col("lo") / F.lit(INTERVAL_BUCKET)).cast("long"))
    specs = [(f"_top_{name}", F.when(kind, F.col("hi")), "max", False) for name, kind in kinds.items()]
    seen = prefix_aggs(tagged, specs, ["lo", "hi"], "_ib", part)
    for name, kind in kinds.items():
        top = F.coalesce(F.col(f"_top_{name}"), F.col("lo"))
        seen = seen.withColumn(name, F.when(kind, F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), top))).otherwise(0))
    return seen


def coverage_report(spans: DataFrame, part: tuple[str, ...] = ("shard",)) -> DataFrame:
    """Unique vs nominal tokens read by windows ``[tok_lo, tok_hi)`` per shard."""
    p = list(part)
    iv = spans.select(*p, F.col("tok_lo").alias("lo"), F.col("tok_hi").alias("hi"))
    out = _covered(iv, p, {"_own": F.lit(True)}).groupBy(*p).agg(
        F.count(F.lit(1)).cast("long").alias("windows"), F.sum(F.col("hi") - F.col("lo")).cast("long").alias("nominal_tokens"),
        F.sum("_own").cast("long").alias("unique_tokens"))
    return out.withColumn("overlap_share", F.round(F.lit(1.0) - F.col("unique_tokens") / F.col("nominal_tokens"), 6))


def leakage_report(spans: DataFrame, part: tuple[str, ...] = ("shard",)) -> DataFrame:
    """Tokens read by both train and dev windows, per shard:
    |train ∪| + |dev ∪| − |all ∪|. No pair join: one pass over the intervals."""
    p = list(part)
    iv = spans.select(*p, "split", F.col("tok_lo").alias("lo"), F.col("tok_hi").alias("hi"))
    got = _covered(iv, p, {"_all": F.lit(True), "_train": F.col("split") == "train", "_dev": F.col("split") == "dev"})
    out = got.groupBy(*p).agg(*(F.sum(f"_{n}").cast("long").alias(f"{n}_tokens") for n in ("all", "train", "dev")))
    return out.withColumn("leaked_tokens",
                          (F.col("train_tokens") + F.col("dev_tokens") - F.col("all_tokens")).cast("long"))
