"""Word counts, rules and the three classifiers against plain Python and held-out rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shardwright.llm import language, quality_rules, quality_trees, texts
from shardwright.llm.queries import QUERIES, table

ODD = ["", " \n\t ", None, "a", "a a a a", "x y\n\nx y\nx y \n", "é b \x1c c\x0bd", "one two three four one two three", "\n", "a\n",
       "#*$% &|<> plain", "w " * 3000, "line\r\nline\r\nline", "𝒳 ü\nü", "the end\nthe end"]


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_rule_counts(make):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "a")]
    got = quality_rules.judge(make(rows, "doc_id long, text string"), {}).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[c] for c in COLUMNS)) for r in got) == sorted(
        (-1 if i is None else i, *plain(t)) for i, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])


def test_slices_do_not_change_anything():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for t in ODD], pa.string())})
    for limit in (1, 7, 1 << 20):
        got = []
        for part, t in texts.slices([batch.slice(0, 4), batch.slice(4)], "text", limit):
            t.split()
            got += list(zip(t.count.tolist(), t.repeated_lines().tolist(), t.repeated_words(3).tolist()))
        assert got == [(a, d, e) for a, _, _, d, e in map(plain, ODD)]


def test_spans_hash_alike_wherever_they_stand():
    t = texts.Texts(pa.array(["alpha beta alpha", "beta", "alphabeta"])).split()
    h = t.word_hash()
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_query_counts_on_the_table(spark, small):
    text = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    for r in QUERIES["op2_quality_rules"](spark, small).collect():
        assert tuple(r[c] for c in COLUMNS) == plain(text[r["doc_id"]])


def held(i, k):
    return zlib.crc32(str(i).encode()) % k


@pytest.mark.parametrize("name,passed", [("op2_quality_rules", "kept"), ("op3_quality_classifier", "predicted")])
def test_quality_on_held_out_rows(spark, sf, name, passed):
    big = sf.replace("sf0.001", "sf0.01")
    label = {r["doc_id"]: r["quality"] for r in table(spark, big, "labels").collect()}
    rows = [r for r in QUERIES[name](spark, big).collect() if held(r["doc_id"], 5) == 0 and r["doc_id"] in label]
    judged = [(label[r["doc_id"]], int(r[passed])) for r in rows if name[2] == "3" or not r["base_failed"]]
    bad = [p for y, p in judged if y == 0]
    assert np.mean([p == y for y, p in judged]) > 0.95 and bad and np.mean(bad) < 0.3
    if name[2] == "3":
        assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_language_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in table(spark, big, "documents").collect()}
    rows = QUERIES["op6_language_id"](spark, big).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (held(r["doc_id"], 4) == 2) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97


def test_language_odd_texts_and_no_training(spark, make):
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD + ["123 456", "!!!", "ß", None])]
    df = make(rows, "doc_id long, text string, lang string")
    for model in ({}, language.train(df, language.learnable())):
        got = {r["doc_id"]: r for r in language.predict(df, model, ("doc_id", "shard")).collect()}
        for i, t, _ in rows:
            letter = any(c.isalpha() for c in t or "")
            assert got[i]["lang_pred"] == ("en" if letter and model else "und")
            assert 0 <= got[i]["score"] <= 1 and (got[i]["score"] > 0) == (letter and bool(model))
    assert language.predict(make([], "doc_id long, text string, lang string"), {}).collect() == []
    assert language.train(make([], "doc_id long, text string, lang string"), language.learnable()) == {}


def test_language_weights_are_sparse(spark, small):
    model = language.train(table(spark, small, "documents"), language.learnable())
    assert 0 < (model["weights"] != 0).mean() < 0.6 and model["temperature"][0] > 0


def test_classifiers_without_labels_or_with_one_class(spark, make):
    docs = make([(i, f"text {i} " * 60) for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert quality_rules.train(docs, none) == {} and quality_rules.train(docs, one) == {}
    assert quality_trees.train(docs, none) == {}
    scores = {r["score"] for r in quality_trees.classify(docs, quality_trees.train(docs, one)).collect()}
    assert min(scores) > 0.99
    assert {r["score"] for r in quality_trees.classify(docs, {}).collect()} == {0.5}
    assert quality_trees.classify(make([], "doc_id long, text string"), {}).collect() == []


def test_tree_arrays_agree_with_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality_trees.grow(x, y)
    p = quality_trees.descend(x, model)
    assert ((p > 0.5) == y).mean() > 0.95
    for row, got in zip(x[:50], p):
        s = model["base"][0]
        for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            s += value[node - len(feature)]
        assert abs(1 / (1 + np.exp(-s)) - got) < 1e-6


def test_a_sample_holds_one_row_for_each_id(make):
    from shardwright.llm.labelled import labelled_ids, with_labels

    docs = make([(5, f"text {i % 7}") for i in range(3000)] + [(6, None), (6, "x"), (7, "y")], "doc_id long, text string")
    labels = make([(5, 1), (6, 0), (7, 1)], "doc_id long, quality int", extra=False)
    ids = labelled_ids(labels, "quality", 2, language.F.lit(True))
    got = with_labels(docs.select("doc_id", "text"), ids).collect()
    assert len(got) == 2 and len({r["doc_id"] for r in got}) == 2
    again = with_labels(docs.repartition(5).select("doc_id", "text"), ids).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_features_are_runs_of_characters():
    """Character n-grams by definition: as many as the characters allow, equal where the characters are equal."""
    body = ["äöü€𝒳äöü", "", "ab", "xxäöüxx"]
    t = texts.Texts(pa.array(body)).split()
    c, off = quality_rules.code_points(t)
    assert [("".join(map(chr, c[a:b]))) for a, b in zip(off, off[1:])] == body
    for n, (index, at) in zip(quality_rules.GRAMS, quality_rules.buckets(t)[2:]):
        lo, hi = quality_rules.bounds(at)
        grams = [[x[i:i + n] for i in range(max(0, len(x) - n + 1))] for x in body]
        assert (hi - lo).tolist() == [len(g) for g in grams]
        seen = {}
        for g, a, b in zip(grams, lo, hi):
            for name, bucket in zip(g, index[a:b].tolist()):
                assert seen.setdefault(name, bucket) == bucket
        assert len(set(seen.values())) == len(seen)


def buckets(text):
    """Buckets of all runs of one to three characters, by definition."""
    held, t = set(), (text or "").lower()
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            g = n
            for c in t[i:i + n]:
                g = (g + ord(c)) * 0x9E3779B97F4A7C15 % 2 ** 64
                g ^= g >> 31
            held.add(g >> 64 - language.BITS)
    return held


def test_document_frequencies_are_counted_over_all_rows(make):
    rows = ["", None, "Ab", "abab", "ß日", "x" * 50_000, "the end"] * 9 + [f"w{i} {i % 7}" for i in range(300)]
    df, n = language.document_frequency(make(list(enumerate(rows)), "doc_id long, text string").repartition(7))
    want = Counter(b for text in rows for b in buckets(text))
    assert n == len(rows) and {i: int(df[i]) for i in np.flatnonzero(df)} == want
    df, n = language.document_frequency(make([], "doc_id long, text string"))
    assert n == 0 and not df.any()
