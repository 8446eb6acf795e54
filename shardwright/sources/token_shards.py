"""Headerless uint16 ``.bin`` token shards as a Spark data source.

Read: ``spark.read.format("token_shards").option("path", dir).option("seq_len",
T).option("stride", s).load()`` yields ``(seq_index, shard, k, window)``; every
input partition covers one shard and a range of its windows, and reads only the
byte range those windows need. ``mode=chunks`` yields ``(shard, chunk, pos,
tokens)`` chunk rows instead.

Write: ``df.write.format("token_shards").mode("append").save(dir)`` takes chunk
rows ``(shard, pos, tokens)``, tokens as arrays or as packed 16-bit numbers; each attempt of a task
writes whole shards to a folder of its own, and the driver's ``commit`` names the files that count
in one small file (``shardwright.sources.commits``). Readers follow the commits; a folder
without any is read by its file names. Use ``write_token_shards`` to get the required
``repartition``/sort first.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual,
                                    In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from shardwright.functions.encoders import PIECE_BYTES, pieces
from shardwright.sources import commits, store

SHARD_GLOB = "shard_*.bin"
BATCH_WINDOWS, BATCH_VALUES = 1024, 1 << 22      # of one Arrow batch
WINDOWS_SCHEMA = "seq_index long, shard int, k long, window array<int>"
CHUNKS_SCHEMA = "shard int, chunk long, pos long, tokens array<int>"


def shard_name(index: int) -> str:
    return f"shard_{index:05d}.bin"


def meta_name(index: int) -> str:
    return f"shard_{index:05d}_meta.json"


def list_shards(path: str) -> list[tuple[str, int]]:
    """S3: ``(uri, bytes)`` of the shards of a folder, a pattern, or several of them with commas
    between, folder by folder and by number in each. A number that is missing is an error."""
    found: dict[str, list[tuple[int, str, int]]] = {}
    for p in path.split(","):
        p = p.strip()
        named = None if "*" in posixpath.basename(p) else commits.committed(p)
        if named is not None:
            found.setdefault(p.rstrip("/"), []).extend((n, store.below(p, f.path), f.bytes) for n, f in named.items())
            continue
        folder, name = (posixpath.dirname(p), posixpath.basename(p)) if "*" in posixpath.basename(p) else (p.rstrip("/"), SHARD_GLOB)
        for uri, size in store.listing(folder, name):
            m = re.search(r"(\d+)\.bin$", uri)
            if m and fnmatch.fnmatch(posixpath.basename(uri), "*.bin"):
                found.setdefault(folder, []).append((int(m[1]), uri, size))
    out = []
    for folder in sorted(found):
        files = sorted(set(found[folder]))
        first = files[0][0]
        gap = next((first + i for i, (n, _, _) in enumerate(files) if n != first + i), None)
        if gap is not None:
            raise FileNotFoundError(f"{folder} has no shard {gap}")
        out += [(uri, size) for _, uri, size in files]
    return out


END = 1 << 62


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans ``[lo, hi)``, those that touch made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def both(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What two sorted lists of disjoint spans have in common."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if lo < hi:
            out.append((lo, hi))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return out


@dataclass
class WindowRanges(InputPartition):
    ranges: list          # (path, shard, seq_start, k0, k1) with k1 exclusive


class TokenShardReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options.get("path")
        self.mode = options.get("mode", "windows")
        self.T = int(options.get("seq_len", "1024"))
        self.stride = int(options.get("stride", str(self.T)))
        self.per_part = int(options.get("windowsPerPartition", "65536"))
        self.n_parts = int(options.get("numPartitions", "16"))
        self.chunk = int(options.get("chunkTokens", "65536"))
        self.bounds: dict[str, list[tuple[int, int]]] = {}
        if self.T <= 0 or self.stride <= 0:
            raise ValueError(f"no windows of length {self.T} at stride {self.stride}: both must be positive")

    def pushFilters(self, filters):
        """Comparisons of ``shard``, ``seq_index`` and ``k`` (``chunk``) with numbers decide which byte
        ranges are read at all; Spark keeps the others."""
        for f in filters:
            span = None
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in ("shard", "seq_index", "k", "chunk"):
                whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
                if isinstance(f, In) and all(map(whole, f.value)):
                    span = joined(sorted((v, v + 1) for v in f.value))
                elif whole(getattr(f, "value", None)):
                    v = f.value
                    span = {EqualTo: [(v, v + 1)], GreaterThan: [(v + 1, END)], GreaterThanOrEqual: [(v, END)],
                            LessThan: [(0, v)], LessThanOrEqual: [(0, v + 1)]}.get(type(f))
            if span is None:
                yield f
                continue
            name = "k" if f.attribute[0] == "chunk" else f.attribute[0]
            self.bounds[name] = both(self.bounds.get(name, [(0, END)]), span)

    def _wanted(self, shard: int, start: int, units: int) -> list[tuple[int, int]]:
        """The windows (chunks) of a shard that the pushed filters leave."""
        if not any(lo <= shard < hi for lo, hi in self.bounds.get("shard", [(0, END)])):
            return []
        own = both([(0, units)], self.bounds.get("k", [(0, END)]))
        return both(own, [(lo - start, hi - start) for lo, hi in self.bounds["seq_index"]]) if "seq_index" in self.bounds else own

    def partitions(self):
        """Window ranges of all files, packed into about ``numPartitions``
        partitions of at most ``windowsPerPartition`` units each. Only file
        sizes are read here."""
        files = list_shards(self.path)
        if not files:
            raise FileNotFoundError(f"no token shards under {self.path}")
        units_of, start = [], 0
        for idx, (f, size) in enumerate(files):
            n = size // 2                        # an odd trailing byte is ignored
            units = -(-n // self.chunk) if self.mode == "chunks" else max(0, (n - (self.T + 1)) // self.stride + 1)
            units_of += [(f, idx, start, k0, k1) for k0, k1 in self._wanted(idx, start, units)]
            start += units if self.mode != "chunks" else 0
        total = sum(k1 - k0 for *_, k0, k1 in units_of)
        target = max(1, min(self.per_part, -(-total // max(1, self.n_parts))))
        parts, cur, room = [], [], target
        for f, idx, base, k, end in units_of:
            while k < end:
                take = min(room, end - k)
                cur.append((f, idx, base, k, k + take))
                k += take
                room -= take
                if room == 0:
                    parts.append(WindowRanges(cur))
                    cur, room = [], target
        if cur:
            parts.append(WindowRanges(cur))
        return parts or [WindowRanges([])]

    def read(self, part: WindowRanges):
        """A range of bytes at a time: never more than a batch is held."""
        many = max(1, BATCH_VALUES // (self.chunk if self.mode == "chunks" else self.T + 1))
        step = min(many, BATCH_WINDOWS)
        for path, shard, seq_start, k0, k1 in part.ranges:
            for k in range(k0, k1, step):
                yield from (self._chunks if self.mode == "chunks" else self._windows)(path, shard, seq_start, k, min(k1, k + step))

    def _chunks(self, path, shard, _start, k0, k1):
        C = self.chunk
        data = np.frombuffer(store.read(path, k0 * C * 2, (k1 - k0) * C * 2 & ~1), np.uint8)
        data = data[:len(data) & ~1].view("<u2").astype(np.int32)
        offs = np.minimum(np.arange(k1 - k0 + 1, dtype=np.int64) * C, len(data))
        ks = np.arange(k0, k1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ks), shard, np.int32)), pa.array(ks.astype(np.int64)),
             pa.array((ks * C).astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(data))],
            names=["shard", "chunk", "pos", "tokens"])

    def _windows(self, path, shard, seq_start, k0, k1):
        L, s = self.T + 1, self.stride
        data = np.frombuffer(store.read(path, k0 * s * 2, ((k1 - k0 - 1) * s + L) * 2), "<u2").astype(np.int32)
        nwin = k1 - k0
        view = np.lib.stride_tricks.sliding_window_view(data, L)[::s][:nwin]
        flat = np.ascontiguousarray(view).reshape(-1)
        offs = np.arange(0, (nwin + 1) * L, L, dtype=np.int32)
        ks = np.arange(k0, k1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seq_start + ks), pa.array(np.full(nwin, shard, np.int32)), pa.array(ks),
             pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
            names=["seq_index", "shard", "k", "window"])


@dataclass
class Written(WriterCommitMessage):
    files: list           # commits.ShardFile


class TokenShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options.get("path")
        self.size = int(options["shard_size"]) if "shard_size" in options else None

    def write(self, batches):
        """Rows arrive sorted by (shard, pos) as Arrow batches; tokens of a slice of a
        batch at a time are flattened once and cut by shard with NumPy."""
        folder = commits.attempt_folder()
        where, path = store.place(store.below(self.path, folder))
        done, fh, cur, expect, crc = [], None, None, 0, 0

        def close():
            fh.close()
            if self.size is not None and expect != self.size:
                raise ValueError(f"shard {cur} has {expect} tokens, expected {self.size}")
            done.append(commits.ShardFile(cur, 2 * expect, crc, f"{folder}/{shard_name(cur)}"))

        for rb in pieces(batches, "tokens", PIECE_BYTES):
            shards = rb.column("shard").to_numpy(zero_copy_only=False)
            poss = rb.column("pos").to_numpy(zero_copy_only=False)
            tokens = rb.column("tokens")
            if pa.types.is_list(tokens.type) or pa.types.is_large_list(tokens.type):
                offs = np.asarray(tokens.offsets)
                flat = tokens.flatten().to_numpy(zero_copy_only=False)
                if flat.size and (flat.min() < 0 or flat.max() > 65535):
                    raise ValueError("token id outside 0..65535")
                flat = flat.astype("<u2")
            else:                                       # packed by the encoder
                packed = tokens.cast(pa.large_binary())
                offs = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1] // 2
                flat = np.frombuffer(packed.buffers()[2], "<u2")[offs[0]:offs[-1]] if offs[-1] > offs[0] else np.zeros(0, "<u2")
            base = offs[0]
            for i in range(len(shards)):
                shard = int(shards[i])
                if shard != cur:
                    if fh is not None:
                        close()
                    else:
                        where.create_dir(path, recursive=True)
                    cur, expect, crc = shard, 0, 0
                    fh = where.open_output_stream(f"{path}/{shard_name(shard)}")
                if int(poss[i]) != expect:
                    raise ValueError(f"shard {shard}: chunk at {poss[i]} but {expect} expected (sort by shard, pos)")
                piece = flat[offs[i] - base: offs[i + 1] - base].tobytes()
                fh.write(piece)
                crc = zlib.crc32(piece, crc)
                expect += len(piece) // 2
        if fh is not None:
            close()
        return Written(done)

    def commit(self, messages):
        commits.commit(self.path, [f for m in messages if m for f in m.files])

    def abort(self, messages):
        """Nothing names the files of these attempts; they are only in the way."""
        for m in messages:
            for f in (m.files if m else []):
                store.remove(store.below(self.path, f.path))


class TokenShardSource(DataSource):
    @classmethod
    def name(cls):
        return "token_shards"

    def schema(self):
        return CHUNKS_SCHEMA if self.options.get("mode") == "chunks" else WINDOWS_SCHEMA

    def reader(self, schema):
        return TokenShardReader(self.options, schema)

    def writer(self, schema, overwrite):
        return TokenShardWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShardSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")     # filters reach the reader


READ_GAP = 1 << 16          # bytes between two windows that are read along rather than sought
FETCH_SPAN = 4096           # windows of a shard that one task may fetch together


def fetch_windows(requests: DataFrame, path: str, seq_len: int, stride: int | None = None, idx_col: str = "idx") -> DataFrame:
    """The requests with ``shard``, ``k``, ``error`` and ``window``: windows by their global index (G6),
    negative ones from the end. Only the byte ranges of the windows asked for are read, each once however
    often it is asked for; a request out of range has an ``error`` and no window."""
    from shardwright.operators.packing import lookup_windows, shard_dim

    spark, step, L = requests.sparkSession, stride or seq_len, seq_len + 1
    files = spark.createDataFrame([(n, uri, size // 2) for n, (uri, size) in enumerate(list_shards(path))], "shard int, uri string, n_tokens long")
    dim = shard_dim(files, seq_len, step)
    found = lookup_windows(requests.select(idx_col).distinct(), dim, idx_col)

    def run(batches):
        for b in batches:
            uris, ks = b.column("uri").to_pylist(), b.column("k").to_pylist()
            windows, at = [], 0
            while at < len(ks):
                to = at + 1
                while to < len(ks) and uris[to] == uris[at] and 2 * step * (ks[to] - ks[to - 1]) - 2 * L <= READ_GAP \
                        and (ks[to] - ks[at]) * step < BATCH_VALUES:
                    to += 1
                data = np.frombuffer(store.read(uris[at], 2 * step * ks[at], 2 * (step * (ks[to - 1] - ks[at]) + L)), "<u2").astype(np.int32)
                windows += [data[(k - ks[at]) * step:(k - ks[at]) * step + L] for k in ks[at:to]]
                at = to
            yield pa.RecordBatch.from_arrays([b.column("idx"), pa.array(windows, pa.list_(pa.int32()))], ["idx", "window"])

    wanted = (found.where(F.col("error").isNull()).select(F.col(idx_col).cast("long").alias("idx"), "shard", "k").join(files.select("shard", "uri"), "shard")
              .repartition("shard", F.floor(F.col("k") / FETCH_SPAN)).sortWithinPartitions("shard", "k"))
    got = wanted.select("idx", "uri", "k").mapInArrow(run, "idx long, window array<int>")
    places = found.select(F.col(idx_col).alias("_i"), "shard", "k", "error").join(got.withColumnRenamed("idx", "_w"), F.col("_i") == F.col("_w"), "left").drop("_w")
    return requests.join(places, F.col(idx_col).eqNullSafe(F.col("_i")), "left").drop("_i")


def read_windows(spark: SparkSession, path: str, seq_len: int, stride: int | None = None,
                 windows_per_partition: int = 65536, partitions: int | None = None) -> DataFrame:
    register(spark)
    n = partitions or 2 * spark.sparkContext.defaultParallelism
    return (spark.read.format("token_shards").option("path", path).option("seq_len", seq_len)
            .option("stride", stride or seq_len).option("windowsPerPartition", windows_per_partition)
            .option("numPartitions", n).load())


def read_chunks(spark: SparkSession, path: str, chunk_tokens: int = 65536, partitions: int | None = None) -> DataFrame:
    register(spark)
    n = partitions or 2 * spark.sparkContext.defaultParallelism
    return (spark.read.format("token_shards").option("path", path).option("mode", "chunks")
            .option("chunkTokens", chunk_tokens).option("numPartitions", n).load())


TASK_TOKENS = 1 << 26       # tokens that one task writes, about


def write_token_shards(chunks: DataFrame, path: str, shard_size: int | None = None, shards: int | None = None) -> None:
    """Chunk rows → one ``.bin`` per shard, all of them there at once or not at all.

    Rows of one shard go to one task (hash by shard, sorted by position); a
    shard is bounded by ``shard_size`` tokens, written chunk by chunk. The number of
    tasks follows from the number of ``shards``: large shards get a task each, small
    ones share it, on every core at least."""
    spark = chunks.sparkSession
    register(spark)
    n = spark.sparkContext.defaultParallelism
    if shards is not None:
        n = max(1, min(shards, max(n, -(-shards * (shard_size or 0) // TASK_TOKENS))))
    kind = "binary" if chunks.schema["tokens"].dataType.simpleString() == "binary" else "array<int>"
    w = (chunks.select(F.col("shard").cast("int").alias("shard"), F.col("pos").cast("long").alias("pos"),
                       F.col("tokens").cast(kind).alias("tokens"))
         .repartition(n, "shard").sortWithinPartitions("shard", "pos")
         .write.format("token_shards").mode("append"))
    if shard_size:
        w = w.option("shard_size", shard_size)
    w.save(path)
