"""Every stage of the pipeline on its own input, against plain Python; then all of them."""

from collections import Counter

import pytest

import corpus_pipeline as P
from shardwright.llm import decontaminate, language
from shardwright.llm.common import staged
from test_jaccard import brute as duplicates
from test_jaccard import runs_of
from test_tokens import expected as encoded


@pytest.fixture(scope="module")
def chain(spark, small):
    docs = P.table(spark, small, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(staged(stage(spark, out[-1], small), name))
    return [d.collect() for d in out]


def pairs(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_stage_names_and_columns(chain):
    assert [n for n, _ in P.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "token_binary"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(rows[0].asDict()) == columns for rows in chain[:-1])


def test_language_stage_keeps_all_that_has_a_language(spark, small, chain):
    assert pairs(chain[1]) == pairs(r for r in chain[0] if any(c.isalpha() for c in r["text"] or ""))
    odd = spark.createDataFrame([(1, "123 456 !!", "en", "s", 9), (2, None, None, None, None), (3, "The words of that and the tion", "en", "s", 30)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.language_id(spark, P.table(spark, small, "documents").unionByName(odd.withColumn("doc_id", odd.doc_id + 10 ** 6)), small)
    assert {r["doc_id"] - 10 ** 6 for r in kept.where("doc_id > 1000000").collect()} == {3}


def test_duplicates_stage(chain):
    rows = [(r["doc_id"], r["text"]) for r in chain[1]]
    assert pairs(chain[2]) == Counter((i, t) for (i, t), (_, c, _) in zip(rows, duplicates(rows)) if i == c or not runs_of(t))


def test_decontamination_stage(spark, small, chain):
    items = [decontaminate.normal(r["text"]) for r in P.table(spark, small, "benchmark").collect()]
    clean = [r for r in chain[2] if not any(x in decontaminate.normal(r["text"]) for x in items)]
    assert pairs(chain[3]) == pairs(clean) and len(clean) < len(chain[2])


def test_mixing_stage_fills_its_budget(chain):
    size = lambda rows: sum(len(r["text"].encode()) + 1 for r in rows)
    have, got = size(chain[3]), size(chain[4])
    leaves = len({(r["lang"], r["source"]) for r in chain[3]})
    assert 0 <= have // 2 - got <= leaves * max(len(r["text"].encode()) for r in chain[3])
    assert set(pairs(chain[4])) <= set(pairs(chain[3])) and max(pairs(chain[4]).values()) <= 2


def test_token_stage(chain):
    from tokenizers import Tokenizer

    import public_tokenizers

    want, total = encoded(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [(r["doc_id"], r["text"]) for r in chain[4]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in chain[5]) == want
    assert sum(r["n_tokens"] for r in chain[5]) == total


def test_run_is_the_chain(spark, small, chain):
    assert Counter(map(tuple, P.run(spark, small).drop("shard").collect())) == Counter(tuple(r)[:4] for r in chain[5])


def test_empty_documents(spark, small):
    none = P.table(spark, small, "documents").where("false")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, none, small)
        assert out.columns == none.columns and out.count() == 0
    assert P.token_binary(spark, none, small).count() == 0
    assert language.train(none, language.learnable()) == {}
