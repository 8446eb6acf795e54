"""Resume inside the source: a stream over the whole table that starts where the build has come to."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shardwright.config import BuildIdentity, PackingConfig
from shardwright.plans import corpus
from shardwright.sources import document_stream as D
from shardwright.sources import manifests as M
from shardwright.sources.token_shards import list_shards
from shardwright.streaming import corpus_build

CFG = PackingConfig(shard_size=500, seq_len=16, stride=16, chunk_tokens=64)
ID = BuildIdentity(tokenizer_name="bytes", tokenizer_revision="utf-8")
KEYS = ("next_shard", "committed_tokens", "pending_tokens", "source_documents_consumed", "last_doc_id")


def table(path, ids, per_file=40, per_group=10, seed=1):
    rng = np.random.default_rng(seed)
    os.makedirs(path, exist_ok=True)
    for n, at in enumerate(range(0, len(ids), per_file)):
        part = ids[at:at + per_file]
        text = ["".join(rng.choice(list("abc é\n"), size=int(rng.integers(0, 60)))) for _ in part]
        pq.write_table(pa.table({"extra": part, "doc_id": pa.array(part, pa.int64()), "text": text}), f"{path}/part-{n}.parquet", row_group_size=per_group)


def shard_bytes(d):
    return {os.path.basename(p): open(p, "rb").read() for p, _ in list_shards(d)}


def third(spark, path, d, cfg=CFG, below=40):
    corpus.write_corpus(spark.read.parquet(path).where(f"doc_id < {below}").select("doc_id", "text"), d, cfg, identity=ID)


@pytest.mark.parametrize("most", [None, 25])
@pytest.mark.parametrize("order", ["sorted", "mixed"])
def test_goes_on_over_the_whole_table(spark, tmpdir_path, most, order):
    ids = list(range(0, 240, 2))
    if order == "mixed":
        np.random.default_rng(3).shuffle(ids)
    path = f"{tmpdir_path}/docs"
    table(path, ids)
    whole = corpus.write_corpus(spark.read.parquet(path).select("doc_id", "text"), f"{tmpdir_path}/whole", CFG, identity=ID)
    third(spark, path, f"{tmpdir_path}/steps", below=75)
    got = corpus_build.resume_build(spark, path, f"{tmpdir_path}/steps", CFG, f"{tmpdir_path}/check", identity=ID, max_documents=most)
    assert [got[k] for k in KEYS] == [whole[k] for k in KEYS]
    assert shard_bytes(f"{tmpdir_path}/steps") == shard_bytes(f"{tmpdir_path}/whole")
    commits = got["commit_id"]
    assert commits == (2 if most is None else 1 + -(-(120 - 38) // 25))
    # started again with its checkpoint, and with another one: nothing is left to do
    for check in ("check", "other"):
        again = corpus_build.resume_build(spark, path, f"{tmpdir_path}/steps", CFG, f"{tmpdir_path}/{check}", identity=ID, max_documents=most)
        assert again["commit_id"] == commits
    # documents that come later are taken up by the old checkpoint
    pq.write_table(pa.table({"doc_id": pa.array([300, 301], pa.int64()), "text": ["new", "newer"]}), f"{path}/part-z.parquet")
    more = corpus_build.resume_build(spark, path, f"{tmpdir_path}/steps", CFG, f"{tmpdir_path}/check", identity=ID, max_documents=most)
    assert (more["source_documents_consumed"], more["last_doc_id"]) == (122, 301)


def test_the_limit_of_a_build_stops_the_stream(spark, tmpdir_path):
    path = f"{tmpdir_path}/docs"
    table(path, list(range(120)))
    cfg = PackingConfig(shard_size=500, seq_len=16, max_shards=4, chunk_tokens=64)
    third(spark, path, f"{tmpdir_path}/b", cfg, below=20)
    assert not corpus_build.completion(spark, f"{tmpdir_path}/b")
    corpus_build.resume_build(spark, path, f"{tmpdir_path}/b", cfg, f"{tmpdir_path}/check", identity=ID, max_documents=10)
    assert corpus_build.completion(spark, f"{tmpdir_path}/b")
    whole = corpus.write_corpus(spark.read.parquet(path).select("doc_id", "text"), f"{tmpdir_path}/whole", cfg, identity=ID)
    assert [M.read_state(f"{tmpdir_path}/b")[k] for k in KEYS] == [whole[k] for k in KEYS]


def reader(path, **options):
    return D.OrderedDocumentReader({"path": path, **options})


def test_offsets_are_exact_and_batches_disjoint(tmpdir_path):
    ids = list(range(100))
    np.random.default_rng(0).shuffle(ids)
    table(tmpdir_path, ids, per_file=50, per_group=7)
    r, seen, at = reader(tmpdir_path, maxDocuments="13"), [], {"last_doc_id": None, "consumed": 0}
    while (end := r.latestOffset()) != at:
        got = [i for p in r.partitions(at, end) for b in r.read(p) for i in b.column("doc_id").to_pylist()]
        assert end == {"last_doc_id": max(got), "consumed": len(seen) + len(got)} and len(got) <= 13
        seen += sorted(got)
        at = end
    assert seen == list(range(100))


def test_runs_are_disjoint_and_in_order():
    g = lambda lo, hi, rows=1: D.RowGroup("u", 0, lo, hi, rows)
    got = D.runs_of([g(50, 60), g(0, 9, 5), g(5, 20, 7), g(20, 21), g(22, 49, 3)])
    assert [(r.lo, r.hi, r.rows, r.before) for r in got] == [(0, 21, 13, 0), (22, 49, 3, 13), (50, 60, 1, 16)]
    assert D.runs_of([]) == []


def test_refusals(spark, tmpdir_path):
    path = f"{tmpdir_path}/docs"
    table(path, list(range(120)))
    third(spark, path, f"{tmpdir_path}/b")
    table(f"{tmpdir_path}/other", [i for i in range(120) if i != 7])               # a document less among those consumed
    with pytest.raises(ValueError, match="40 documents up to 39 were consumed"):
        reader(f"{tmpdir_path}/other", build=f"{tmpdir_path}/b").latestOffset()
    pq.write_table(pa.table({"doc_id": pa.array([1, None], pa.int64()), "text": ["a", "b"]}), f"{tmpdir_path}/null.parquet")
    with pytest.raises(ValueError, match="without doc_id"):
        reader(f"{tmpdir_path}/null.parquet").latestOffset()
    pq.write_table(pa.table({"doc_id": [1], "text": ["a"]}), f"{tmpdir_path}/plain.parquet", write_statistics=False)
    with pytest.raises(ValueError, match="no range"):
        reader(f"{tmpdir_path}/plain.parquet").latestOffset()
    os.makedirs(f"{tmpdir_path}/empty")
    assert reader(f"{tmpdir_path}/empty").latestOffset() == {"last_doc_id": None, "consumed": 0}
