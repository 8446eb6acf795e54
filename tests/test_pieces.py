"""A Python worker holds slices of Arrow batches: what it makes of one does not grow with the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardwright.config import PackingConfig
from shardwright.functions import encoders as E
from shardwright.sources.token_shards import TokenShardWriter, list_shards, read_windows

MB = 1 << 20


@pytest.fixture
def runs(spark, monkeypatch):
    """What an encoder gives to ``mapInArrow``, by which a test feeds it batches of its own."""
    got = []
    frame = type(spark.range(1))
    old = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a, **b: got.append(f) or old(self, f, schema, *a, **b))
    return got


def texts(n=3000, words=400):
    some = ["ab " * (words + i % 7) for i in range(n)]
    some[5], some[6] = "", "é" * (3 * MB)                           # an empty one, and one longer than a slice
    return some


def batch(**cols):
    rb = pa.RecordBatch.from_pydict(cols)
    return pa.concat_batches([rb.slice(0, 2), rb]).slice(2)          # offsets that do not begin at 0


def check(out, col, most, long=1):
    """The slices are of bounded size, but those of one row; their number follows the input."""
    sizes = [(b.num_rows, b.column(col).nbytes) for b in out]
    assert all(n == 1 or size <= most for n, size in sizes), sizes
    assert sum(size > most for _, size in sizes) <= long
    return pa.Table.from_batches(out)


def test_slices_follow_bytes_and_lose_no_row():
    rb = batch(doc_id=list(range(8)), text=["aaaa", None, "", "bbbbbbbbb", "c", "dd", "eee", ""])
    got = [s.column("doc_id").to_pylist() for s in E.pieces([rb, rb.slice(0, 0)], "text", 4)]
    assert got == [[0, 1, 2], [3], [4, 5], [6, 7]]
    lists = batch(ids=[[1, 2], [], [3], None, [4, 5, 6]])
    assert [s.column("ids").to_pylist() for s in E.pieces([lists], "ids", 3)] == [[[1, 2], [], [3], None], [[4, 5, 6]]]


def test_byte_encoder_works_in_slices(spark, runs):
    E.ByteEncoder().encode(spark.createDataFrame([(0, "a")], "doc_id long, text string"))
    some = texts()
    t = check(list(runs[0](iter([batch(doc_id=list(range(len(some))), text=some)]))), "ids", 5 * MB)
    assert t["doc_id"].to_pylist() == list(range(len(some))) and t["text"].to_pylist() == some
    assert all(bytes(np.asarray(x.values, dtype=np.uint8)) == s.encode() for x, s in zip(t["ids"], some))


def test_packed_bytes_are_made_in_slices(spark, runs):
    E.ByteEncoder().encode_packed(spark.createDataFrame([(0, "a")], "doc_id long, text string"), out="ids")
    some = texts()
    t = check(list(runs[0](iter([batch(doc_id=list(range(len(some))), text=some)]))), "ids", 3 * MB)
    assert t["doc_id"].to_pylist() == list(range(len(some)))
    assert all(np.frombuffer(x.as_py(), "<u2").tolist() == [*s.encode(), 256] for x, s in zip(t["ids"][:300], some))


def test_ids_are_packed_in_slices(spark, runs):
    E.pack_ids(spark.createDataFrame([(0, [1])], "doc_id long, ids array<int>"), out="ids")
    some = [[i % 60000] * 700 for i in range(3000)]
    t = check(list(runs[0](iter([batch(doc_id=list(range(3000)), ids=pa.array(some, pa.list_(pa.int32())))]))), "ids", MB, 0)
    assert [np.frombuffer(x.as_py(), "<u2").tolist() for x in t["ids"]] == some


def test_words_are_looked_up_in_slices(spark, runs):
    vocab = spark.createDataFrame([("ab", 2, 3), ("cd", 3, 1)], "word string, id int, count long")
    E.WordEncoder(vocab, 4).encode(spark.createDataFrame([(0, "a")], "doc_id long, text string"))
    words = [["ab", "zz", "cd"] * (100 + i % 5) for i in range(3000)]
    words[3] = []
    rb = batch(doc_id=list(range(3000)), text=[""] * 3000, _words=words)
    t = check(list(runs[0](iter([rb]))), "ids", 2 * MB, 0)
    assert t["ids"].to_pylist() == [[{"ab": 2, "cd": 3}.get(w, 1) for w in row] for row in words]


def test_writer_holds_a_slice_of_a_batch(tmpdir_path):
    n, size = 4000, 2000
    flat = (np.arange(n * size, dtype=np.int64) % 50000).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size), pa.int32()), pa.array(flat))
    pos = np.arange(n, dtype=np.int64) * size % 50000
    rb = pa.RecordBatch.from_arrays([pa.array((np.arange(n) // 25).astype(np.int32)), pa.array(pos), lists], names=["shard", "pos", "tokens"])
    w = TokenShardWriter({"path": tmpdir_path, "shard_size": "50000"}, False)
    tracemalloc.start()
    done = w.write(iter([rb]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    w.commit([done])
    assert peak < 6 * MB, peak                                        # the batch has 31 MB, as 16-bit numbers 15 MB
    assert len(list_shards(tmpdir_path)) == n // 25
    assert all(open(p, "rb").read() == flat[i * 50000:(i + 1) * 50000].astype("<u2").tobytes() for i, (p, _) in enumerate(list_shards(tmpdir_path)))


def test_build_of_texts_longer_than_a_slice(spark, tmpdir_path):
    from shardwright.plans import corpus

    rows = [(i, "xé" * (i * 37 % 400)) for i in range(60)] + [(60, "y" * (2 * MB))]
    corpus.write_corpus(spark.createDataFrame(rows, "doc_id long, text string"), tmpdir_path, PackingConfig(shard_size=50_000, seq_len=256, stride=256))
    stream = [x for _, t in rows for x in [*t.encode(), 256]]
    got = read_windows(spark, tmpdir_path, 256, 256).where(F.col("k") == 0).select("shard", "window").collect()
    assert len(got) == len(stream) // 50_000
    assert all(r["window"] == stream[r["shard"] * 50_000:][:257] for r in got)
