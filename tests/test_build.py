"""Corpus build on disk: round trip, incremental = batch, audits with planted faults."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwright.config import BuildIdentity, PackingConfig
from shardwright.operators import audit as A
from shardwright.plans import corpus
from shardwright.sources import manifests as M
from shardwright.sources import commits
from shardwright.sources.token_shards import TokenShardWriter, list_shards, read_chunks, read_windows
from shardwright.streaming.corpus_build import build_batch


def docs(spark, n=120, seed=0):
    rnd = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "délta", "ε", "zeta", "eta!", ""]
    rows = [(i, " ".join(rnd.choice(words, size=int(rnd.integers(0, 40))))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


CFG = PackingConfig(shard_size=500, seq_len=16, stride=16, max_shards=1000, chunk_tokens=64)
ID = BuildIdentity(dataset_revision="dataset-sha", tokenizer_revision="utf-8", tokenizer_name="bytes")


def test_bin_round_trip_equals_in_memory_windows(spark, tmpdir_path):
    d = docs(spark)
    state = corpus.write_corpus(d, tmpdir_path, CFG, identity=ID)
    assert state["next_shard"] > 1
    from_disk = sorted(map(tuple, read_windows(spark, tmpdir_path, 16, 16).select("shard", "k", "window").collect()))
    direct = sorted(map(tuple, corpus.build_windows(d, CFG).select("shard", "k", "window").collect()))
    assert from_disk == direct
    chunks = read_chunks(spark, tmpdir_path, 64)
    assert chunks.agg(F.sum(F.size("tokens"))).first()[0] == state["committed_tokens"]


def shard_path(d, name):
    """Where the file of a shard lies: in the folder of the attempt that wrote it."""
    return next(uri for uri, _ in list_shards(d) if uri.endswith(name))


def _shard_bytes(d):
    return {os.path.basename(uri): open(uri, "rb").read() for uri, _ in list_shards(d)}


def test_incremental_equals_batch(spark, tmpdir_path):
    d = docs(spark, 150, seed=3)
    batch_dir, inc_dir = f"{tmpdir_path}/batch", f"{tmpdir_path}/inc"
    st_b = corpus.write_corpus(d, batch_dir, CFG, identity=ID)
    for b, (lo, hi) in enumerate([(0, 7), (7, 60), (60, 61), (61, 150)]):
        build_batch(d.filter((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)), b, inc_dir, CFG, identity=ID)
    st_i = M.Ledger(spark, inc_dir).latest()
    assert _shard_bytes(batch_dir) == _shard_bytes(inc_dir)
    assert (st_i["next_shard"], st_i["committed_tokens"], st_i["pending_tokens"]) == \
           (st_b["next_shard"], st_b["committed_tokens"], st_b["pending_tokens"])
    # a replayed batch is a no-op, an out-of-order batch is refused
    assert build_batch(d.filter(F.col("doc_id") < 7), 0, inc_dir, CFG, identity=ID) is None
    with pytest.raises(RuntimeError):
        build_batch(d.filter(F.col("doc_id") < 7), 9, inc_dir, CFG, identity=ID)


def batches(d, bounds):
    return [d.filter((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)) for lo, hi in zip(bounds, bounds[1:])]


def pending(spark, directory):
    led = M.Ledger(spark, directory)
    return sorted(map(tuple, led.pending(led.latest()).collect()))


@pytest.mark.parametrize("limit", [None, 2, 5])
def test_batch_then_stream_loses_nothing(spark, tmpdir_path, limit):
    """A batch build resumed by a stream, whose batch numbers start at 0 again, twice."""
    cfg = PackingConfig(shard_size=500, seq_len=16, max_shards=limit, chunk_tokens=64)
    d = docs(spark, 90, seed=7)
    whole = corpus.write_corpus(d, f"{tmpdir_path}/whole", cfg, identity=ID)
    parts = batches(d, [0, 10, 20, 60, 90])
    corpus.write_corpus(parts[0], f"{tmpdir_path}/steps", cfg, identity=ID)
    for stream, batch, part in (("one", 0, parts[1]), ("one", 1, parts[2]), ("two", 0, parts[3])):
        build_batch(part, batch, f"{tmpdir_path}/steps", cfg, identity=ID, stream_id=stream)
    got = M.Ledger(spark, f"{tmpdir_path}/steps").latest()
    keys = ("next_shard", "committed_tokens", "pending_tokens", "source_documents_consumed", "last_doc_id")
    assert [got[k] for k in keys] == [whole[k] for k in keys]
    assert pending(spark, f"{tmpdir_path}/steps") == pending(spark, f"{tmpdir_path}/whole")
    assert _shard_bytes(f"{tmpdir_path}/steps") == _shard_bytes(f"{tmpdir_path}/whole")
    assert len(os.listdir(f"{tmpdir_path}/steps/_pending")) == 1          # superseded buffers are gone


@pytest.mark.parametrize("change", ["dataset_id", "dataset_config", "dataset_split", "dataset_revision", "tokenizer_name", "tokenizer_revision"])
def test_resume_refuses_another_identity(spark, tmpdir_path, change):
    import dataclasses

    parts = batches(docs(spark, 20, seed=2), [0, 10, 20])
    corpus.write_corpus(parts[0], tmpdir_path, CFG, identity=ID)
    with pytest.raises(RuntimeError, match="config_drift"):
        build_batch(parts[1], 0, tmpdir_path, CFG, identity=dataclasses.replace(ID, **{change: "other"}))


def test_resume_refuses_another_geometry_and_damage(spark, tmpdir_path):
    import dataclasses

    parts = batches(docs(spark, 40, seed=2), [0, 30, 40])
    corpus.write_corpus(parts[0], tmpdir_path, CFG, identity=ID)
    for change in ({"shard_size": 250}, {"max_shards": 3}):
        with pytest.raises(RuntimeError, match="config_drift"):
            build_batch(parts[1], 0, tmpdir_path, dataclasses.replace(CFG, **change), identity=ID)
    shard = shard_path(tmpdir_path, "shard_00000.bin")
    kept = open(shard, "rb").read()
    open(shard, "wb").write(kept[:-2])
    with pytest.raises(RuntimeError, match="file_size"):
        build_batch(parts[1], 0, tmpdir_path, CFG, identity=ID)
    open(shard, "wb").write(kept)
    for f in os.listdir(f"{tmpdir_path}/_pending/commit=1"):
        os.remove(f"{tmpdir_path}/_pending/commit=1/{f}")
    os.rmdir(f"{tmpdir_path}/_pending/commit=1")
    with pytest.raises(RuntimeError, match="pending_missing"):
        build_batch(parts[1], 0, tmpdir_path, CFG, identity=ID)


def test_outputs_without_a_state_are_refused(spark, tmpdir_path):
    np.arange(500, dtype="<u2").tofile(f"{tmpdir_path}/shard_00000.bin")
    with pytest.raises(RuntimeError, match="orphan_outputs"):
        corpus.write_corpus(docs(spark, 5), tmpdir_path, CFG, identity=ID)
    with pytest.raises(RuntimeError, match="orphan_outputs"):
        build_batch(docs(spark, 5), 0, tmpdir_path, CFG, identity=ID)


def test_shard_numbers_beyond_five_digits_and_gaps(spark, tmpdir_path):
    for n in (99_998, 99_999, 100_000):
        np.full(10, n % 1000, dtype="<u2").tofile(f"{tmpdir_path}/shard_{n:05d}.bin")
    rows = read_windows(spark, f"file://{tmpdir_path}", 4).orderBy("seq_index").collect()
    assert [r["window"][0] for r in rows] == [998, 998, 999, 999, 0, 0]
    os.remove(f"{tmpdir_path}/shard_99999.bin")
    with pytest.raises(Exception, match="99999"):
        read_windows(spark, tmpdir_path, 4).count()


def test_publish_audits_first(spark, tmpdir_path):
    good_set(spark, tmpdir_path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tmpdir_path).select("path")
    M.publish_corpus(files, f"{tmpdir_path}_ok", [r"shard_\d+\.bin$"], directory=tmpdir_path)
    assert len(os.listdir(f"{tmpdir_path}_ok")) == 2
    os.remove(f"{tmpdir_path}/shard_00001_meta.json")
    with pytest.raises(RuntimeError, match="meta_missing"):
        M.publish_corpus(files, f"{tmpdir_path}_bad", [r"shard_\d+\.bin$"], directory=tmpdir_path)
    assert not os.path.exists(f"{tmpdir_path}_bad")


def good_set(spark, d):
    cfg = PackingConfig(shard_size=8, seq_len=4, max_shards=2, chunk_tokens=8)
    corpus.write_corpus(docs(spark, 10, seed=5), d, cfg, identity=ID)
    return cfg


def rules(v):
    return sorted({r["rule"] for r in v.collect()})


def audit(spark, d):
    led = M.Ledger(spark, d).table()
    return A.audit_complete(spark, led, M.shard_files(spark, d), M.read_shard_meta(spark, d))


def test_good_set_passes(spark, tmpdir_path):
    good_set(spark, tmpdir_path)
    assert audit(spark, tmpdir_path).count() == 0


def test_state_missing(spark, tmpdir_path):
    assert rules(audit(spark, tmpdir_path)) == ["state_missing"]


def test_file_missing_and_size(spark, tmpdir_path):
    good_set(spark, tmpdir_path)
    os.remove(shard_path(tmpdir_path, "shard_00001.bin"))
    with open(shard_path(tmpdir_path, "shard_00000.bin"), "ab") as fh:
        fh.write(b"\x00\x00")
    assert rules(audit(spark, tmpdir_path)) == ["file_missing", "file_size"]


def test_meta_missing_and_mismatch(spark, tmpdir_path):
    good_set(spark, tmpdir_path)
    os.remove(os.path.join(tmpdir_path, "shard_00001_meta.json"))
    p = os.path.join(tmpdir_path, "shard_00000_meta.json")
    m = json.load(open(p))
    m["tokenizer_revision"] = "other"
    json.dump(m, open(p, "w"))
    assert rules(audit(spark, tmpdir_path)) == ["meta_mismatch", "meta_missing"]
    with pytest.raises(RuntimeError, match="meta_mismatch"):
        A.raise_first(audit(spark, tmpdir_path))


def test_incomplete(spark, tmpdir_path):
    cfg = PackingConfig(shard_size=8, seq_len=4, max_shards=10_000, chunk_tokens=8)
    corpus.write_corpus(docs(spark, 10, seed=5), tmpdir_path, cfg, identity=ID)
    assert "incomplete" in rules(audit(spark, tmpdir_path))


def test_orphans_drift_pending_seed(spark, tmpdir_path):
    good_set(spark, tmpdir_path)
    files = M.shard_files(spark, tmpdir_path)
    empty = spark.createDataFrame([], M.LEDGER_SCHEMA)
    assert rules(A.audit_orphans(files, empty)) == ["orphan_outputs"]
    assert A.audit_orphans(files, M.Ledger(spark, tmpdir_path).table()).count() == 0
    st = M.Ledger(spark, tmpdir_path).latest()
    exp = {k: st[k] for k in ("schema_version", "dataset_id", "dataset_config", "dataset_split",
                              "shard_size_tokens", "max_shards")}
    assert A.config_drift(spark, st, exp).count() == 0
    exp["dataset_config"] = "other"
    assert rules(A.config_drift(spark, st, exp)) == ["config_drift"]
    pend = M.Ledger(spark, tmpdir_path).pending(st)
    assert A.audit_pending(spark, st, pend).count() == 0
    assert rules(A.audit_pending(spark, {**st, "pending_tokens": st["pending_tokens"] + 1}, pend)) == ["pending_mismatch"]
    assert rules(A.audit_pending(spark, st, None)) == ["pending_missing"]
    stored = spark.createDataFrame([(1338, json.dumps({"B": 16, "mystery": 1}))], "data_seed long, model_config string")
    assert rules(A.audit_plan(spark, stored, 1337, ["B", "T"])) == ["seed_drift", "unknown_config"]
    ok = spark.createDataFrame([(None, json.dumps({"B": 16}))], "data_seed long, model_config string")
    assert A.audit_plan(spark, ok, 1337, ["B"]).count() == 0


def test_odd_length_and_totals(spark, tmpdir_path):
    good_set(spark, tmpdir_path)
    with open(shard_path(tmpdir_path, "shard_00001.bin"), "ab") as fh:
        fh.write(b"\x01")
    assert rules(A.odd_lengths(M.shard_files(spark, tmpdir_path))) == ["odd_length"]
    # the reader ignores the odd byte
    assert read_windows(spark, tmpdir_path, 4).count() == 2
    dim = spark.createDataFrame([(0, 8), (1, 8)], "shard int, n_tokens long")
    t = A.corpus_totals(dim).first()
    assert (t["shards"], t["tokens"]) == (2, 16)


def test_publish_only_allowed_files(spark, tmpdir_path):
    good_set(spark, tmpdir_path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tmpdir_path).select("path")
    out = f"{tmpdir_path}_pub"
    M.publish_corpus(files, out, [r"shard_\d+\.bin$", r"shard_\d+_meta\.json$"])
    assert sorted(os.listdir(out)) == ["shard_00000.bin", "shard_00000_meta.json", "shard_00001.bin",
                                       "shard_00001_meta.json"]


def test_discover_shards_path_order(spark, tmpdir_path):
    for sub in ("shards", "shards_edu"):
        os.makedirs(f"{tmpdir_path}/{sub}")
        np.arange(10, dtype="<u2").tofile(f"{tmpdir_path}/{sub}/shard_00000.bin")
    got = M.discover_shards(spark, [f"{tmpdir_path}/shards/*.bin", f"{tmpdir_path}/shards_edu/*.bin"])
    paths = [r["path"] for r in got.orderBy("shard").collect()]
    assert paths[0].endswith("shards/shard_00000.bin") and paths[1].endswith("shards_edu/shard_00000.bin")
    with pytest.raises(FileNotFoundError):
        M.discover_shards(spark, [f"{tmpdir_path}/none/*.bin"])


def test_config_round_trip(spark):
    from shardwright.config import TrainConfig

    cfg = TrainConfig(B=8, max_steps=100)
    row = M.config_from_row(M.config_to_row(spark, cfg)).first()
    back = TrainConfig.from_metadata(**{k: v for k, v in row["cfg"].asDict().items()})
    assert back.to_metadata() == cfg.to_metadata() and back.decay_start_step == 80
    with pytest.raises(ValueError):
        TrainConfig.from_metadata(mystery=1)


# ---------------------------------------------------------------- commits that name their files
def chunk_batches(*shards, size=8):
    import pyarrow as pa

    return [pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "pos": pa.array([0], pa.int64()),
                                        "tokens": pa.array([[s] * size], pa.list_(pa.int32()))}) for s in shards]


def writer(d, size=8):
    return TokenShardWriter({"path": d, "shard_size": str(size)}, False)


def test_doubled_and_aborted_attempts_leave_nothing_to_read(tmpdir_path):
    w = writer(tmpdir_path)
    first, second = w.write(iter(chunk_batches(0, 1))), w.write(iter(chunk_batches(0, 1)))   # a speculative twin
    assert commits.committed(tmpdir_path) is None and list_shards(tmpdir_path) == []
    w.commit([second])
    assert [os.path.basename(p) for p, _ in list_shards(tmpdir_path)] == ["shard_00000.bin", "shard_00001.bin"]
    before = list_shards(tmpdir_path)
    late = w.write(iter(chunk_batches(0)))                        # a late attempt changes nothing
    assert list_shards(tmpdir_path) == before
    assert sorted(commits.unnamed(tmpdir_path)) == sorted(f"{tmpdir_path}/{f.path}" for f in first.files + late.files)
    w.abort([first, late, None])
    assert list_shards(tmpdir_path) == before and commits.unnamed(tmpdir_path) == []
    with pytest.raises(ValueError, match="expected 8"):
        w.write(iter(chunk_batches(2, size=7)))
    assert list_shards(tmpdir_path) == before


def test_commits_are_whole_or_not_there_and_stay_few_to_read(tmpdir_path, monkeypatch):
    w, opened = writer(tmpdir_path), []
    for n in range(40):
        w.commit([w.write(iter(chunk_batches(n)))])
    whole = commits.committed(tmpdir_path)
    assert sorted(whole) == list(range(40)) and [n for n in whole if whole[n].bytes != 16] == []
    names = sorted(os.listdir(f"{tmpdir_path}/{commits.FOLDER}"))
    read = commits._read
    monkeypatch.setattr(commits, "_read", lambda *a: opened.append(a) or read(*a))
    commits.committed(tmpdir_path)
    assert len(opened) <= commits.SNAPSHOT + 1
    last = f"{tmpdir_path}/{commits.FOLDER}/{names[-1]}"
    text = open(last).read()
    open(last, "w").write(text[:-4])                              # torn while being written
    assert sorted(commits.committed(tmpdir_path)) == list(range(39))
    open(last, "w").write(text)
    again = w.write(iter(chunk_batches(3)))
    w.commit([again])
    assert commits.committed(tmpdir_path)[3] == again.files[0]    # the last commit counts


def test_audit_opens_only_what_is_new(spark, tmpdir_path, monkeypatch):
    parts = batches(docs(spark, 120, seed=4), [0, 30, 60, 90, 120])
    corpus.write_corpus(parts[0], tmpdir_path, CFG, identity=ID)
    opened, exists = [], M.store.exists
    monkeypatch.setattr(M.store, "exists", lambda p: (opened.append(p) if "_meta" in p else None) or exists(p))
    counts = []
    for n, part in enumerate(parts[1:]):
        opened.clear()
        build_batch(part, n, tmpdir_path, CFG, identity=ID, stream_id="s")
        counts.append(len(opened))
    ledger = M.Ledger(spark, tmpdir_path)
    steps = [r["next_shard"] for r in ledger.table().orderBy("commit_id").collect()]
    assert counts == [0, *(b - a for a, b in zip(steps[:-2], steps[1:-1]))]   # the first load audits all, later ones what is new
    state = ledger.load(ID, CFG)
    assert state["audited_shards"] == steps[-1] > state["next_shard"] - 1
    shard = shard_path(tmpdir_path, "shard_00000.bin")
    kept = open(shard, "rb").read()
    open(shard, "ab").write(b"\0\0")                              # an old shard, audited long ago
    with pytest.raises(RuntimeError, match="file_size: shard 0"):
        ledger.load(ID, CFG)
    open(shard, "wb").write(kept)                                 # another time, the same content: audited anew and taken
    assert ledger.load(ID, CFG)["audit_digest"] != ledger.latest()["audit_digest"]
    meta = f"{tmpdir_path}/shard_00001_meta.json"
    m = json.load(open(meta))
    json.dump({**m, "tokens": 7}, open(meta, "w"))
    with pytest.raises(RuntimeError, match="meta_mismatch: shard 1"):
        ledger.load(ID, CFG)


def test_a_commit_number_is_taken_once(spark, tmpdir_path):
    state = corpus.write_corpus(docs(spark, 20), tmpdir_path, CFG, identity=ID)
    with pytest.raises(RuntimeError, match="another build"):
        M.Ledger(spark, tmpdir_path).commit(state)


@pytest.mark.parametrize("ids, what", [([1, 2, 2, 3], "two documents have the doc_id 2"), ([1, None, 3], "no doc_id")])
def test_a_build_refuses_ids_it_cannot_go_on_from(spark, tmpdir_path, ids, what):
    d = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    with pytest.raises(Exception, match=what):
        corpus.write_corpus(d, f"{tmpdir_path}/batch", CFG, identity=ID)
    with pytest.raises(Exception, match=what if "two" in what else "have no doc_id"):
        build_batch(d, 0, f"{tmpdir_path}/stream", CFG, identity=ID)


# ---------------------------------------------------------------- lookups that read only what they need
def counted_reads(monkeypatch):
    from shardwright.sources import store

    read, seen = store.read, []
    monkeypatch.setattr(store, "read", lambda uri, at, n: seen.append((os.path.basename(uri), at, n)) or read(uri, at, n))
    return seen


def test_pushed_filters_read_byte_ranges(spark, tmpdir_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

    from shardwright.sources.token_shards import TokenShardReader

    for n in range(4):
        (np.arange(1000, dtype="<u2") + 1000 * n).tofile(f"{tmpdir_path}/shard_{n:05d}.bin")
    seen = counted_reads(monkeypatch)

    def rows(*filters, **options):
        r = TokenShardReader({"path": tmpdir_path, "seq_len": "9", "stride": "10", **options}, None)
        kept = list(r.pushFilters(list(filters)))
        seen.clear()
        got = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
        return kept, got, sum(n for _, _, n in seen)

    kept, got, size = rows(EqualTo(("seq_index",), 205))
    assert not kept and size == 20 and [(r["shard"], r["k"], r["window"][0]) for r in got] == [(2, 5, 2050)]
    kept, got, size = rows(In(("seq_index",), (3, 4, 399, 10_000)), IsNotNull(("seq_index",)))
    assert len(kept) == 1 and [r["seq_index"] for r in got] == [3, 4, 399] and size == 60
    kept, got, size = rows(EqualTo(("shard",), 1), GreaterThanOrEqual(("k",), 10), LessThan(("k",), 12))
    assert [(r["shard"], r["k"]) for r in got] == [(1, 10), (1, 11)] and size == 40
    kept, got, size = rows(EqualTo(("chunk",), 1), EqualTo(("shard",), 3), mode="chunks", chunkTokens="100")
    assert [(r["shard"], r["chunk"], r["tokens"][0]) for r in got] == [(3, 1, 3100)] and size == 200
    assert rows(EqualTo(("seq_index",), "5"))[0] and rows(EqualTo(("window", "x"), 5))[0]
    assert rows(LessThan(("seq_index",), 0))[1:] == ([], 0)
    df = read_windows(spark, tmpdir_path, 9, 10).where("seq_index in (7, 205) or seq_index = 8").where("shard < 2")
    assert sorted(r["seq_index"] for r in df.collect()) == [7, 8]
    plan = read_windows(spark, tmpdir_path, 9, 10).where("seq_index = 205").collect()
    assert len(plan) == 1 and plan[0]["window"] == list(range(2050, 2060))


def test_fetch_by_index(spark, tmpdir_path):
    from shardwright.sources.token_shards import fetch_windows

    for n, size in enumerate((100, 57, 9, 300)):                    # the third is too short for a window
        (np.arange(size, dtype="<u2") + 1000 * n).tofile(f"{tmpdir_path}/shard_{n:05d}.bin")
    whole = {r["seq_index"]: r["window"] for r in read_windows(spark, tmpdir_path, 9, 4).collect()}
    ask = [0, 5, 5, 5, len(whole) - 1, -1, -len(whole), len(whole), -len(whole) - 1, None, 30]
    got = fetch_windows(spark.createDataFrame([(i, x) for i, x in enumerate(ask)], "r int, idx long"), tmpdir_path, 9, 4).collect()
    assert sorted(r["r"] for r in got) == list(range(len(ask)))
    for r in got:
        i = ask[r["r"]]
        want = None if i is None else whole.get(i if i >= 0 else i + len(whole))
        assert r["window"] == want and (r["error"] is None) == (want is not None or i is None), r


# ---------------------------------------------------------------- publications
def test_publish_goes_on_and_finds_damage(spark, tmpdir_path, monkeypatch):
    d, target = f"{tmpdir_path}/build", f"{tmpdir_path}/out"
    state = corpus.write_corpus(docs(spark, 60, seed=9), d, CFG, identity=ID)
    n = state["next_shard"]
    put = M.store.put
    monkeypatch.setattr(M.store, "put", lambda uri, data: 1 / 0 if uri.endswith(M.PUBLISHED) else put(uri, data))
    with pytest.raises(ZeroDivisionError):                        # stopped before the manifest: nothing is published
        M.publish_build(spark, d, target)
    assert M.published(spark, target).count() == 0
    monkeypatch.setattr(M.store, "put", put)
    again = M.publish_build(spark, d, target).collect()
    assert len(again) == 2 * n and not any(r["copied"] for r in again)                 # what was there already is not copied again
    assert sorted(os.listdir(target)) == sorted([f"shard_{i:05d}{x}" for i in range(n) for x in (".bin", "_meta.json")] + [M.PUBLISHED])
    assert {r["status"] for r in M.verify_published(spark, target).collect()} == {"ok"}
    shard = f"{target}/shard_00000.bin"
    data = open(shard, "rb").read()
    open(shard, "wb").write(data[:-1] + bytes([data[-1] ^ 1]))
    os.remove(f"{target}/shard_00001_meta.json")
    assert sorted((r["file"], r["status"]) for r in M.verify_published(spark, target).collect() if r["status"] != "ok") == [
        ("shard_00000.bin", "damaged"), ("shard_00001_meta.json", "missing")]
    assert sorted(r["file"] for r in M.publish_build(spark, d, target).collect() if r["copied"]) == ["shard_00000.bin", "shard_00001_meta.json"]
    source = shard_path(d, "shard_00000.bin")
    open(source, "wb").write(data[:-1] + bytes([data[-1] ^ 1]))     # same size: only the checksum of the commit tells
    with pytest.raises(Exception, match="not what its commit says"):
        M.publish_build(spark, d, target)
    with pytest.raises(RuntimeError, match="state_missing"):
        M.publish_build(spark, f"{tmpdir_path}/none", target)
