"""Artifact tables around a corpus build.

Everything a build leaves on disk is read as a table: shard files (paths and
sizes only), shard metadata (JSON with a fixed schema), the build ledger (one
row per commit; the latest row is the state) and the pending buffer. Audits in
``shardwright.operators.audit`` join these tables.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardwright.config import CONFIG_COLUMNS, SHARD_DTYPE, STATE_SCHEMA_VERSION, BuildIdentity, PackingConfig, TrainConfig
from shardwright.sources import commits, store

# Fixed names and types: the metadata of a shard and the state of a build.
META_SCHEMA = T.StructType([
    T.StructField("shard_index", T.LongType()), T.StructField("tokens", T.LongType()),
    T.StructField("vocab_size", T.LongType()), T.StructField("dtype", T.StringType()),
    T.StructField("dataset_revision", T.StringType()), T.StructField("tokenizer_revision", T.StringType()),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("commit_id", T.LongType()), T.StructField("batch_id", T.LongType()),
    T.StructField("schema_version", T.IntegerType()), T.StructField("dataset_id", T.StringType()),
    T.StructField("dataset_config", T.StringType()), T.StructField("dataset_split", T.StringType()),
    T.StructField("dataset_revision", T.StringType()), T.StructField("tokenizer_name", T.StringType()),
    T.StructField("tokenizer_revision", T.StringType()), T.StructField("shard_size_tokens", T.LongType()),
    T.StructField("max_shards", T.IntegerType()), T.StructField("next_shard", T.IntegerType()),
    T.StructField("source_documents_consumed", T.LongType()), T.StructField("committed_tokens", T.LongType()),
    T.StructField("pending_tokens", T.LongType()), T.StructField("pending_path", T.StringType()),
    T.StructField("last_doc_id", T.LongType()), T.StructField("stream_id", T.StringType()),
    T.StructField("audited_shards", T.LongType()), T.StructField("audit_digest", T.StringType()),
])

SHARD_FILE_RE = r"shard_(\d+)\.bin$"


# S3
def discover_shards(spark: SparkSession, globs: list[str], fallback: str | None = None) -> DataFrame:
    """``(path, shard, length)`` for every shard file, by folder and number; only
    ``path`` and ``length`` are read (the content column is pruned)."""
    frames = []
    for g in globs:
        folder, name = posixpath.dirname(g), posixpath.basename(g)
        if "*" not in folder and commits.committed(folder) is not None:       # the files that count
            own = F.regexp_extract("path", "([^/]+)$", 1).rlike(fnmatch.translate(name))
            frames.append(shard_files(spark, folder).where(own).select("path", "length", F.lit(folder).alias("_folder")))
            continue
        try:
            frames.append(spark.read.format("binaryFile").load(g).select("path", "length", F.regexp_extract("path", r"^(.*)/", 1).alias("_folder")))
        except Exception as e:  # noqa: BLE001 - an empty glob is not an error yet
            if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
                raise
    files = None
    for f in frames:
        files = f if files is None else files.unionByName(f)
    if files is None or files.limit(1).count() == 0:
        if fallback and store.exists(fallback):
            files = spark.read.format("binaryFile").load(fallback).select("path", "length", F.lit("").alias("_folder"))
        else:
            raise FileNotFoundError(f"no shard file under {', '.join(globs)}")
    number = F.regexp_extract("path", r"(\d+)\.bin$", 1).try_cast("long")
    w = Window.orderBy("_folder", number, "path")                   # one row per file: a small table
    return files.withColumn("shard", (F.row_number().over(w) - 1).cast("int")).select("path", "shard", "length")


def _found(spark: SparkSession, directory: str, pattern: str, regex: str) -> DataFrame:
    """``(path, shard, length, modified)`` of the files below a folder; none of them is opened."""
    try:
        f = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], "path string, shard int, length long, modified timestamp")
        raise
    return f.select("path", F.regexp_extract("path", regex, 1).cast("int").alias("shard"), "length", F.col("modificationTime").alias("modified"))


def shard_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, shard, length, modified)`` of the shards that commits name, as they lie there; of a
    folder without commits all its shard files. ``shard`` is parsed from the file name."""
    found = _found(spark, directory, "shard_*.bin", SHARD_FILE_RE)
    named = commits.committed(directory)
    if named is None:
        return found
    # one row for each shard, as the driver's commit wrote them
    rows = spark.createDataFrame([(f.path,) for f in named.values()], "_below string")
    return found.withColumn("_below", F.regexp_extract("path", f"({commits.DATA}/[^/]+/[^/]+)$", 1)).join(rows, "_below", "left_semi").drop("_below")


# S5
def write_shard_meta(meta: DataFrame, directory: str) -> None:
    """One JSON object per shard file (``shard_XXXXX_meta.json``), written by
    the executors next to the shards, each by temp name + rename."""
    def put(rows):
        for r in rows:
            d = r.asDict()
            store.put(store.below(directory, f"shard_{int(d['shard_index']):05d}_meta.json"), json.dumps(d).encode())

    meta.select(*[F.col(f.name).cast(f.dataType) for f in META_SCHEMA.fields]).foreachPartition(put)


META_FILE_RE = r"shard_(\d+)_meta\.json$"


def meta_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, shard, length, modified)`` of the metadata files, none of them opened."""
    return _found(spark, directory, "shard_*_meta.json", META_FILE_RE)


def read_shard_meta(spark: SparkSession, directory: str, first: int = 0, end: int | None = None) -> DataFrame:
    """Metadata of all shards, or of those from ``first`` to before ``end``: only their files are opened."""
    if end is not None:
        # as many paths as a batch has committed shards; a missing file is a missing row
        paths = [p for n in range(first, end) if store.exists(p := store.below(directory, f"shard_{n:05d}_meta.json"))]
        if not paths:
            return spark.createDataFrame([], META_SCHEMA).withColumn("meta_path", F.lit(""))
        return spark.read.schema(META_SCHEMA).json(paths).withColumn("meta_path", F.input_file_name())
    try:
        m = spark.read.schema(META_SCHEMA).json(store.below(directory, "shard_*_meta.json"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], META_SCHEMA)
        raise
    return m.withColumn("meta_path", F.input_file_name())


def shard_meta_rows(shards: DataFrame, identity: BuildIdentity, vocab_size: int) -> DataFrame:
    """Metadata rows for committed shards ``(shard, n_tokens)``."""
    return shards.select(F.col("shard").cast("long").alias("shard_index"), F.col("n_tokens").cast("long").alias("tokens"),
                         F.lit(vocab_size).cast("long").alias("vocab_size"), F.lit(SHARD_DTYPE).alias("dtype"),
                         F.lit(identity.dataset_revision).alias("dataset_revision"),
                         F.lit(identity.tokenizer_revision).alias("tokenizer_revision"))


# S6–S8
def read_state(directory: str) -> dict | None:
    """The last state of a build, without a session; none if there is no build."""
    names = store.listing(store.below(directory, "_ledger"), "*.json")
    if not names:
        return None
    got = json.loads(store.read(names[-1][0], 0, names[-1][1]))
    return {f.name: got.get(f.name) for f in LEDGER_SCHEMA.fields}


class Ledger:
    """Build state as an append-only table, one row per commit.

    A commit is one file named by its number. Data (shards, metadata, pending chunks under
    ``pending/commit=N``) is written first; the ledger row last. The state is the row with the largest
    ``commit_id``; a replayed micro-batch finds its stream and ``batch_id`` and does
    nothing. ``load`` is the only way to go on from a state: it audits it first.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.dir = directory
        self.path = store.below(directory, "_ledger")

    def exists(self) -> bool:
        return bool(store.listing(self.path, "*.json"))

    def table(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).json(self.path)

    def latest(self) -> dict | None:
        """The state of the last commit: one file is opened, whatever their number."""
        return read_state(self.dir)

    def load(self, identity: BuildIdentity, cfg: PackingConfig) -> dict:
        """The state to go on from, or a new one; raises on the first violation of A1, A3, A4 or A5.

        Outputs without a state, another dataset, tokenizer or geometry, a committed shard
        that is missing or wrong, and a pending buffer that is missing or wrong all refuse. What
        earlier loads have audited is compared by the digest of its listing alone."""
        from shardwright.operators import audit as A

        state = self.latest()
        if state is None:
            if store.listing(self.dir, "shard_*.bin") or commits.committed(self.dir):
                A.raise_first(A.audit_orphans(shard_files(self.spark, self.dir), self.table()))
            return Ledger.new(identity, cfg.shard_size, cfg.max_shards)
        want = Ledger.new(identity, cfg.shard_size, cfg.max_shards)
        pinned = ["schema_version", *identity.as_dict(), "shard_size_tokens", "max_shards"]
        A.raise_first(A.config_drift(self.spark, state, {k: want[k] for k in pinned}))
        self.audit(state)
        kept = not state["pending_path"] or store.exists(state["pending_path"])
        A.raise_first(A.audit_pending(self.spark, state, self.pending(state) if kept else None))
        return state

    def audit(self, state: dict) -> None:
        """A1 over the committed shards. Files, lengths and times of those audited before give the
        digest that the state holds, or else all are audited anew; then only the metadata of
        newer shards is opened. Notes in the state what is audited now."""
        from shardwright.operators import audit as A

        files, end, done = shard_files(self.spark, self.dir), int(state["next_shard"]), int(state.get("audited_shards") or 0)
        digests = self.digests(files, [done, end])
        first = done if done and digests[0] == state.get("audit_digest") else 0
        A.raise_first(A.audit_committed(self.spark, files.where(F.col("shard") >= first),
                                        read_shard_meta(self.spark, self.dir, first, end) if first else read_shard_meta(self.spark, self.dir),
                                        end, int(state["shard_size_tokens"]),
                                        (state["dataset_revision"], state["tokenizer_revision"]), first))
        state["audited_shards"], state["audit_digest"] = end, digests[1]

    def digests(self, files: DataFrame, ends: list[int]) -> list[str]:
        """For each end, number and summed hash of the listing (file, length, time) of the shards before it."""
        rows = files.unionByName(meta_files(self.spark, self.dir))
        h = F.xxhash64(F.regexp_extract("path", "([^/]+)$", 1), "length", "modified").cast("decimal(38,0)")
        before = [F.col("shard") < e for e in ends]
        got = rows.agg(*[F.count(F.when(b, 1)).alias(f"n{i}") for i, b in enumerate(before)],
                       *[F.coalesce(F.sum(F.when(b, h)), F.lit(0)).cast("string").alias(f"h{i}") for i, b in enumerate(before)]).first()
        return [f"{got[f'n{i}']}:{got[f'h{i}']}" for i in range(len(ends))]

    def retire(self, state: dict) -> None:
        """Removes pending buffers that ``state``, once committed, has superseded."""
        where, path = store.place(store.below(self.dir, "_pending"))
        for f in where.get_file_info(store.fs.FileSelector(path, allow_not_found=True)):
            number = f.base_name.removeprefix("commit=")
            if number.isdigit() and int(number) < int(state["commit_id"]):
                store.remove(store.below(self.dir, "_pending", f.base_name))

    @staticmethod
    def new(identity: BuildIdentity, shard_size: int, max_shards: int | None) -> dict:
        return {"commit_id": 0, "batch_id": None, "stream_id": None, "schema_version": STATE_SCHEMA_VERSION,
                **identity.as_dict(), "shard_size_tokens": shard_size, "max_shards": max_shards,
                "next_shard": 0, "source_documents_consumed": 0, "committed_tokens": 0, "pending_tokens": 0,
                "pending_path": None, "last_doc_id": None, "audited_shards": 0, "audit_digest": None}

    def commit(self, state: dict) -> None:
        """Appends the state; a commit of this number by someone else is an error."""
        path = store.below(self.path, f"{int(state['commit_id']):012d}.json")
        if store.exists(path):
            raise RuntimeError(f"commit {state['commit_id']} is there already: another build writes to {self.dir}")
        store.put(path, json.dumps({f.name: state.get(f.name) for f in LEDGER_SCHEMA.fields}).encode())

    def pending_path(self, commit_id: int) -> str:
        return store.below(self.dir, "_pending", f"commit={commit_id}")

    def pending(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(state["pending_path"]) if state.get("pending_path") else \
            self.spark.createDataFrame([], "doc_id long, pos long, tokens array<int>")


# S13
def config_to_row(spark: SparkSession, cfg: TrainConfig, extra: dict | None = None) -> DataFrame:
    return spark.createDataFrame([{**(extra or {}), "model_config": cfg.to_json()}])


CONFIG_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in CONFIG_COLUMNS.items())


def config_from_row(df: DataFrame, col: str = "model_config") -> DataFrame:
    """Parse the JSON config column with a fixed schema (no inference)."""
    return df.withColumn("cfg", F.from_json(col, CONFIG_SCHEMA))


def config_keys(df: DataFrame, col: str = "model_config") -> DataFrame:
    """All keys present in the stored JSON (to find unknown fields)."""
    return df.select(F.explode(F.json_object_keys(col)).alias("key"))


# S11
def publish_corpus(files: DataFrame, target: str, allow: list[str], directory: str | None = None) -> DataFrame:
    """Copy only files whose path matches an allow-list pattern to ``target``.

    With ``directory`` the build there is audited first (A2) and a violation stops the
    publication. The copy runs on the executors, each file whole or not at all, so a retried
    task is harmless; returns the table of published files. Private buffers such as the
    ledger and pending chunks never match the allow-list."""
    if directory is not None:
        from shardwright.operators import audit as A

        spark = files.sparkSession
        A.raise_first(A.audit_complete(spark, Ledger(spark, directory).table(), shard_files(spark, directory), read_shard_meta(spark, directory)))
    pattern = "|".join(f"(?:{p})" for p in allow)
    chosen = files.filter(F.col("path").rlike(pattern)).select("path")

    def copy(rows):
        for r in rows:
            store.copy(r["path"], store.below(target, r["path"].rsplit("/", 1)[1]))

    chosen.foreachPartition(copy)
    return chosen


PUBLISHED = "published.json"
PUBLISHED_SCHEMA = "file string, bytes long, crc32 long"


def published(spark: SparkSession, target: str) -> DataFrame:
    """``(file, bytes, crc32)`` of what a publication consists of; empty before its manifest is there."""
    uri = store.below(target, PUBLISHED)
    return spark.read.schema(PUBLISHED_SCHEMA).json(uri) if store.exists(uri) else spark.createDataFrame([], PUBLISHED_SCHEMA)


def publish_build(spark: SparkSession, directory: str, target: str) -> DataFrame:
    """Publishes the committed shards of a build and their metadata, flat, to ``target``: ``(file, bytes, crc32,
    copied)``. The build is audited first (A1). A file is copied if the target's copy is missing or differs in size or
    checksum from the source, and read back; the manifest with a digest of each file comes last, so a publication
    that was stopped goes on where it stood and one without a manifest is none."""
    ledger = Ledger(spark, directory)
    state = ledger.latest()
    if state is None:
        raise RuntimeError(f"state_missing: no build in {directory}")
    ledger.audit(state)
    sources = shard_files(spark, directory).where(F.col("shard") < state["next_shard"]).select("path").unionByName(
        meta_files(spark, directory).where(F.col("shard") < state["next_shard"]).select("path"))
    known = {f"{directory.rstrip('/')}/{f.path}": f.crc32 for f in (commits.committed(directory) or {}).values()}
    crcs = spark.createDataFrame([(k.rsplit("/", 1)[1], c) for k, c in known.items()], "file string, expected long")

    def copy(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, name, expected in zip(pdf["path"], pdf["file"], pdf["expected"]):
                size, crc = store.checksum(path)
                if expected == expected and expected is not None and int(expected) != crc:
                    raise RuntimeError(f"content: {path} is not what its commit says")
                to = store.below(target, name)
                there = store.exists(to) and store.size(to) == size and store.checksum(to)[1] == crc
                if not there:
                    store.copy(path, to)
                    if store.checksum(to) != (size, crc):
                        raise RuntimeError(f"content: the copy {to} differs from its source")
                out.append((name, size, crc, not there))
            yield pd.DataFrame(out, columns=["file", "bytes", "crc32", "copied"])

    named = sources.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1)).join(crcs, "file", "left")
    n = max(2 * spark.sparkContext.defaultParallelism, int(state["next_shard"]) // 64)
    path = store.below(directory, "_published", f"{state['commit_id']:012d}-{uuid.uuid4().hex}")
    named.repartition(n, "file").select("path", "file", "expected").mapInPandas(copy, "file string, bytes long, crc32 long, copied boolean").write.parquet(path)
    done = spark.read.parquet(path)
    rows = done.select("file", "bytes", "crc32").orderBy("file").toLocalIterator(prefetchPartitions=True)     # a line for each file
    store.put(store.below(target, PUBLISHED), "".join(json.dumps(r.asDict()) + "\n" for r in rows).encode())
    return done


def verify_published(spark: SparkSession, target: str) -> DataFrame:
    """``(file, bytes, status)``: every file of the manifest read again: ok, missing, size or damaged."""
    def check(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, size, crc in zip(pdf["file"], pdf["bytes"], pdf["crc32"]):
                uri = store.below(target, name)
                found = store.size(uri) if store.exists(uri) else None
                status = "missing" if found is None else "size" if found != size else "ok" if store.checksum(uri)[1] == crc else "damaged"
                out.append((name, size, status))
            yield pd.DataFrame(out, columns=["file", "bytes", "status"])

    return published(spark, target).repartition(2 * spark.sparkContext.defaultParallelism, "file").mapInPandas(check, "file string, bytes long, status string")
