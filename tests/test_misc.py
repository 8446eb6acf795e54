"""Encoders, sinks, composed plans, the streaming build and the driver entry."""

import json
import os
import glob

import pytest
from pyspark.sql import functions as F

from shardwright.config import PackingConfig, TrainConfig, check_vocab
from shardwright.functions.encoders import ByteEncoder, TokenizerEncoder, WordEncoder, assert_ids, decode_bytes


def word_level_json():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {"<eos>": 0, "[UNK]": 1, "hello": 2, "world": 3, "!": 4}
    tok = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.add_special_tokens(["<eos>"])
    return tok.to_str()


def test_tokenizer_encoder_and_decode(spark):
    enc = TokenizerEncoder(word_level_json(), "<eos>")
    assert enc.eos_id == 0 and len(enc.revision) == 64
    df = spark.createDataFrame([(0, "hello world !"), (1, "world zzz")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in enc.encode(df).collect()}
    assert got == {0: [2, 3, 4], 1: [3, 1]}
    back = enc.decode(spark.createDataFrame([([2, 3, 0],)], "ids array<int>"), "ids").first()["text"]
    assert back == "hello world"


def test_byte_encoder_round_trip(spark):
    df = spark.createDataFrame([(0, "héllo"), (1, "")], "doc_id long, text string")
    enc = ByteEncoder().encode(df)
    rows = {r["doc_id"]: r["ids"] for r in enc.collect()}
    assert rows[0] == list("héllo".encode()) and rows[1] == []
    txt = decode_bytes(enc.withColumn("ids", F.concat("ids", F.array(F.lit(256)))), "ids").orderBy("doc_id")
    assert [r["text"] for r in txt.collect()] == ["héllo", ""]


def test_null_text_is_an_error(spark, tmpdir_path):
    from shardwright.sources.documents import read_documents

    spark.createDataFrame([(0, None)], "doc_id long, text string").write.parquet(f"{tmpdir_path}/d")
    with pytest.raises(Exception):
        ByteEncoder().encode(read_documents(spark, f"{tmpdir_path}/d")).collect()
    assert read_documents(spark, f"{tmpdir_path}/d", on_null="skip").count() == 0


def test_vocab_checks(spark):
    check_vocab(65535, 0)
    with pytest.raises(ValueError):
        check_vocab(65536, 0)
    with pytest.raises(ValueError):
        check_vocab(100, None)
    bad = spark.createDataFrame([([1, 70000],)], "ids array<int>")
    with pytest.raises(Exception):
        assert_ids(bad).collect()


def test_word_encoder(spark):
    df = spark.createDataFrame([(0, "a b a, c"), (1, "b a")], "doc_id long, text string")
    enc = WordEncoder.fit(df, 4)
    vocab = {r["word"]: r["id"] for r in enc.vocab.collect()}
    assert vocab == {"a": 2, "b": 3}
    got = {r["doc_id"]: r["ids"] for r in enc.encode(df).collect()}
    assert got == {0: [2, 3, 2, 1, 1], 1: [3, 2]}


def test_summary_and_metrics_sinks(spark, tmpdir_path):
    from shardwright.sources.sinks import append_metrics, write_summary

    s = spark.createDataFrame([(2.5, float("nan"), 7)], "loss double, other double, n long")
    write_summary(s, f"{tmpdir_path}/sum")
    line = open(glob.glob(f"{tmpdir_path}/sum/part-*.json")[0]).read()
    assert json.loads(line) == {"loss": "2.5", "other": "NaN", "n": 7}
    m = spark.createDataFrame([("r", 1, 10, {"train/loss": 3.0, "train/lr": 0.1})],
                              "run_id string, step long, us long, metrics map<string,double>")
    append_metrics(m, f"{tmpdir_path}/m")
    append_metrics(m, f"{tmpdir_path}/m")
    assert spark.read.parquet(f"{tmpdir_path}/m").count() == 4


def test_training_plan_and_export(spark, tmpdir_path):
    from shardwright.operators import packing
    from shardwright.plans import training
    from shardwright.sources.sinks import export_batches

    dim = packing.uniform_shard_dim(spark, 20, 1000, 16)
    spans = packing.window_spans(spark, dim, 16)
    cfg = TrainConfig(B=4, grad_accum_steps=2, T=16, max_steps=30, eval_interval=10, eval_batches=3, data_seed=7)
    plan = training.split_plan(spans, dim.collect(), cfg)
    assert plan.n_train == 19 * 62 and plan.n_dev == 62
    rest = training.resume_plan(plan, cfg, 10)
    assert rest.count() == (30 - 10) * 2 * 4
    assert [r["step"] for r in training.evaluation_steps(spark, cfg).orderBy("step").collect()] == [10, 20, 30]
    samples = training.dev_samples(spark, plan, cfg, 2)
    assert samples.select("eval_no", "dev_batch").distinct().count() == 6
    export_batches(rest, f"{tmpdir_path}/plan", 8)
    back = spark.read.parquet(f"{tmpdir_path}/plan/batches")
    assert back.count() == rest.count()


def test_a_rank_opens_only_its_files(spark, tmpdir_path):
    from shardwright.operators import packing
    from shardwright.sources.sinks import export_batches, read_batches

    plan = packing.assign_ranks(packing.remaining_plan(spark, 3, 4, 1, 203, 0, 60), 3)       # 50 batches an epoch
    index = export_batches(plan, tmpdir_path, 5).collect()
    assert all(r["last_batch"] - r["first_batch"] < 5 and r["rows"] <= 20 for r in index)
    assert sum(r["rows"] for r in index) == 240
    rows = sorted((r["batch"], r["position"], r["local_index"]) for r in plan.where("epoch = 0 and rank = 2").collect())
    mine = read_batches(spark, tmpdir_path, 2, 0)
    assert [(r["batch"], r["position"], r["local_index"]) for r in mine.orderBy("batch", "position").collect()] == rows
    assert len(mine.inputFiles()) == len([r for r in index if (r["rank"], r["epoch"]) == (2, 0)]) == 10
    few = read_batches(spark, tmpdir_path, 2, 0, 11, 18)
    assert sorted(few.select("batch").distinct().toPandas()["batch"]) == [11, 14, 17] and len(few.inputFiles()) == 2
    assert read_batches(spark, tmpdir_path, 2, 9).count() == 0
    with pytest.raises(ValueError):
        export_batches(plan, tmpdir_path, 0)


def test_pinned_vocabulary(spark, tmpdir_path):
    from shardwright.functions.encoders import WordEncoder

    d = spark.createDataFrame([(0, "a b a c"), (1, "b a")], "doc_id long, text string")
    enc = WordEncoder.fit(d, 4)
    path = enc.save(tmpdir_path)
    assert path == WordEncoder.pinned(spark, path).save(tmpdir_path)
    got = WordEncoder.pinned(spark, path)
    assert (got.revision, got.vocab_size) == (enc.revision, 4)
    assert [r["ids"] for r in got.encode(d).orderBy("doc_id").collect()] == [r["ids"] for r in enc.encode(d).orderBy("doc_id").collect()]
    enc.vocab.where("id > 2").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="holds the vocabulary"):
        WordEncoder.pinned(spark, path)


def test_config_faults(spark):
    from shardwright.functions.columns import config_faults
    from shardwright.sources.manifests import config_from_row

    rows = [({},), ({"B": 0, "min_lr": -1.0},), ({"T": 5, "warmup_steps": -1, "learning_rate": 0.0},)]
    df = config_from_row(spark.createDataFrame([(json.dumps(r[0]),) for r in rows], "model_config string"))
    assert [r[0] for r in df.select(config_faults("cfg")).collect()] == [[], ["B", "min_lr"], ["learning_rate", "warmup_steps"]]


def test_validation_plan(spark, tmpdir_path):
    from shardwright.plans.validation import validate

    df = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [0.0, 0.0], 1)], "seq_index long, logits array<double>, target int")
    v = validate(df, 1, out=f"{tmpdir_path}/v").first()
    assert v["loss"] == pytest.approx(0.6931471805599453) and v["sequences"] == 2


def test_long_form_cross_entropy(spark):
    from shardwright.operators.evaluate import cross_entropy, cross_entropy_long

    dense = spark.createDataFrame([(0, [1.0, 2.0, 0.5], 1)], "ctx_id long, logits array<double>, target int")
    ref = cross_entropy(dense).first()["loss"]
    sc = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 2.0, 0.5])], "ctx_id long, cand_id long, score double")
    tg = spark.createDataFrame([(0, 1)], "ctx_id long, target int")
    assert cross_entropy_long(sc, tg, ["ctx_id"]).first()["loss"] == pytest.approx(ref)


def test_streaming_corpus_build(spark, tmpdir_path):
    from shardwright.plans import corpus
    from shardwright.sources.documents import stream_documents
    from shardwright.streaming.corpus_build import completion, start_corpus_build

    rows = [(i, "word " * (i % 13)) for i in range(60)]
    src = f"{tmpdir_path}/docs"
    for lo in range(0, 60, 20):
        spark.createDataFrame(rows[lo:lo + 20], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        for f in glob.glob(f"{src}/part-*.parquet"):
            if not os.path.exists(f + ".seen"):
                os.utime(f, (2_000_000 + lo, 2_000_000 + lo))
                open(f + ".seen", "w").close()
    cfg = PackingConfig(shard_size=64, seq_len=8, max_shards=5, chunk_tokens=16)
    stream = stream_documents(spark, src + "/*.parquet", max_files_per_trigger=1,
                              schema=spark.read.parquet(src).schema)
    q = start_corpus_build(stream, f"{tmpdir_path}/out", cfg, f"{tmpdir_path}/ck")
    q.awaitTermination(120)
    batch = corpus.write_corpus(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmpdir_path}/b", cfg)
    files = sorted(f for f in os.listdir(f"{tmpdir_path}/out") if f.endswith(".bin"))
    assert files == sorted(f for f in os.listdir(f"{tmpdir_path}/b") if f.endswith(".bin"))
    for f in files:
        assert open(f"{tmpdir_path}/out/{f}", "rb").read() == open(f"{tmpdir_path}/b/{f}", "rb").read()
    assert completion(spark, f"{tmpdir_path}/out") == (batch["next_shard"] == 5)


def test_driver_entry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["shard", "n_windows", "first_token", "token_sum"] and df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
