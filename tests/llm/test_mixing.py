import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from shardwright.llm import mixing
from shardwright.llm.mixing import mix

SCHEMA = "doc_id long, domain string, lang string, source string, text string"
LEVELS = ["domain", "lang", "source"]


def run(spark, make, rows, weights=(), **options):
    w = spark.createDataFrame(list(weights), "level string, name string, weight long")
    return mix(make(rows, SCHEMA), LEVELS, w, **options)


def shares(caps, weights, total):
    """Water-filling by definition: deal again and again among those not yet full."""
    got = {k: Fraction(0) for k in caps}
    left = min(Fraction(total), Fraction(sum(caps[k] for k in caps if weights[k] > 0)))
    while left > 0:
        live = [k for k in caps if weights[k] > 0 and got[k] < caps[k]]
        w = sum(weights[k] for k in live)
        part = {k: min(caps[k] - got[k], left * weights[k] / w) for k in live}
        for k, v in part.items():
            got[k] += v
        left -= sum(part.values())
        if left < Fraction(1, 1000):
            break
    return got


def brute(rows, weights, budget_share, max_epochs):
    size = defaultdict(int)
    for _, *path, text in rows:
        size[tuple(p or "(none)" for p in path)] += len((text or "").encode()) + 1
    weight = {(lv, n): w for lv, n, w in weights}
    budget = {(): Fraction(sum(size.values()) * budget_share[0] // budget_share[1])}
    for k, level in enumerate(LEVELS, 1):
        nodes = defaultdict(int)
        for path, n in size.items():
            nodes[path[:k]] += n * max_epochs
        for parent in {p[:k - 1] for p in nodes}:
            kids = {p: c for p, c in nodes.items() if p[:k - 1] == parent}
            budget |= shares(kids, {p: weight.get((level, p[-1]), 1) for p in kids}, budget[parent])
    return size, {p: budget[p] for p in size}


def check(spark, make, rows, weights=(), budget_share=(1, 2), max_epochs=2):
    got = run(spark, make, rows, weights, budget_share=budget_share, max_epochs=max_epochs).collect()
    size, budget = brute(rows, weights, budget_share, max_epochs)
    taken, epochs = Counter(), defaultdict(Counter)
    for r in got:
        path = tuple(r[c] or "(none)" for c in LEVELS)
        taken[path] += r["n_tokens"]
        epochs[path, r["epoch"]][r["doc_id"]] += 1
    by = defaultdict(list)
    for i, *path, text in rows:
        by[tuple(p or "(none)" for p in path)].append((i, len((text or "").encode()) + 1))
    for path, docs in by.items():
        full, rest = divmod(int(budget[path]), size[path])
        slack = max(n for _, n in docs) * max(Counter(i for i, _ in docs).values()) + 3
        assert budget[path] - slack <= taken[path] <= budget[path] + 1, path
        for e in range(full):
            if budget[path] - full * size[path] > 3 or e < full - 1:
                assert epochs[path, e] == Counter(i for i, _ in docs)
        key = lambda i, e=full: hashlib.md5(f"11:{e}:{'(none)' if i is None else i}".encode()).hexdigest()
        part = epochs[path, full]
        if part:                                            # a prefix of the epoch's order
            last = max(map(key, part))
            assert part == Counter(i for i, _ in docs if key(i) <= last)
    return got


def docs(n, width=lambda i: 40 + i * 7 % 100):
    return [(i, f"d{i % 2}", ("en", "de", "fr")[i % 3], f"s{i % 5}", "x" * width(i)) for i in range(n)]


def test_weights_shortages_and_epochs(spark, make):
    w = [("domain", "d0", 9), ("lang", "en", 5), ("source", "s1", 7), ("source", "s2", 0)]
    check(spark, make, docs(300), w)
    check(spark, make, docs(300), w, budget_share=(7, 4), max_epochs=3)


def test_budget_beyond_all_capacity_takes_everything(spark, make):
    got = check(spark, make, docs(60), budget_share=(5, 1), max_epochs=2)
    assert len(got) == 120


def test_hot_source_nulls_repeats_empty_and_long_texts(spark, make):
    rows = [(i, "d0", "en", "hot", "y" * 50) for i in range(400)] + docs(100)
    rows += [(None, None, None, None, None)] * 3 + [(7, "d1", "en", "s7", "")] * 5 + [(9000, "d1", "de", "s1", "z" * 200_000)]
    check(spark, make, rows)


def test_empty_table_and_columns(spark, make):
    df = run(spark, make, [])
    assert df.collect() == [] and df.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "shard", "n_tokens", "epoch", "epoch_key"]


def test_one_row_for_each_document_without_repeats(spark, make):
    got = run(spark, make, docs(200), max_epochs=1).select("doc_id").collect()
    assert max(Counter(r[0] for r in got).values()) == 1


def test_a_leaf_is_parted_by_its_own_rows(spark, make, monkeypatch):
    rows = [(i, "d0", "en", "hot", "y" * (i % 90)) for i in range(700)] + docs(60)
    whole = sorted((r["doc_id"], r["source"], r["epoch"]) for r in check(spark, make, rows))
    for digits in (0, 4):
        monkeypatch.setattr(mixing, "stretch_digits", lambda rows, n=digits: F.least(rows, F.lit(n)).cast("int"))
        assert sorted((r["doc_id"], r["source"], r["epoch"]) for r in check(spark, make, rows)) == whole


def test_stretches_grow_with_the_root(spark):
    n = [1, 255, 256, 65_535, 65_536, 10 ** 9, 3 * 10 ** 10]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").orderBy("n").select(mixing.stretch_digits(F.col("n"))).collect()]
    assert got == [1, 1, 2, 2, 3, 4, 5]
    assert all(x / 16 ** d < 16 ** d <= 16 * x ** 0.5 * (1 if x > 1 else 16) for x, d in zip(n, got))


def test_one_parent_with_many_children(spark):
    """Ties, close ratios, full and open children, a parent that all fill and one without budget."""
    nodes, want = [], {}
    for parent, budget in (("a", 40_000), ("b", 10 ** 9), ("c", 0), ("d", 123_457)):
        caps = {f"{parent}{i}": (100 if i % 3 == 0 else 1 + i * i % 977) for i in range(600)}
        weights = {k: (0 if i % 50 == 7 else 1 + i % 4) for i, k in enumerate(caps)}
        nodes += [(parent, k, budget, caps[k], weights[k]) for k in caps]
        want |= {k: v for k, v in shares(caps, weights, budget).items() if weights[k]}
    got = mixing.water_fill(spark.createDataFrame(nodes, "parent string, node string, budget long, cap long, weight long")).collect()
    assert {r["node"] for r in got} == set(want)
    for r in got:
        assert want[r["node"]] - 1 <= r["share"] <= want[r["node"]] + Fraction(1, 1000), r


def test_plan_is_native(spark, make):
    p = run(spark, make, docs(5))._jdf.queryExecution().toString()
    assert "Python" not in p and "Arrow" not in p
