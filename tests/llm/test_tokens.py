import random
import zlib
from collections import Counter

import numpy as np
import pytest

from shardwright.llm import token_shards as S
from shardwright.llm import wavelet as W

TOKENIZERS = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZERS.path("byte_bpe_50k.json"))


def expected(library, rows):
    """Rows in id order (nulls first, equal ids by text), encoded whole by the library."""
    out, at = Counter(), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for e, (i, _) in zip(library.encode_batch([t or "" for _, t in order], add_special_tokens=False), order):
        ids = np.array([*e.ids, 2], "<u4")
        out[i, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    return out, at


def check(make, library, rows, **options):
    got = S.encode_and_read(make(rows, SCHEMA), **options).collect()
    want, total = expected(library, rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert at == total
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)
    return got


ODD = ["", None, " ", "\n\n", "  two  spaces ", "don't DON'T 'sx ''re", "a1b22 c³ Ⅷ x", "naïve Ñandú straße ſ", "日本 текст", "<|endoftext|>", "x<|y",
       "tab\tnbsp z\x0b\x1c", "!!! ### end.\r\nnext", "é" * 50, "_under_score_", "１２ full", "áb", "trailing   ", " x"]


def test_odd_texts_as_the_library_says(make, library):
    check(make, library, list(enumerate(ODD)))


def test_random_strings(make, library):
    rng = random.Random(3)
    alphabet = list("abcXYZ 019'.,!#\n\t\r_-éßÑſ×÷") + ["'s", " the", "  ", " ", "²", "中"]
    check(make, library, [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for i in range(400)])


def test_repeats_nulls_many_shards_and_a_long_text(make, library):
    rows = [(5, "same words")] * 40 + [(None, f"n{i}") for i in range(9)] + [(9, "long words here " * 20_000)] + [(i, f"text {i}") for i in range(100, 160)]
    got = check(make, library, rows, shard_bytes=20_000)
    assert len({r["shard"] for r in got}) > 3


def test_empty_table(make, library):
    assert check(make, library, []) == []


def encode(texts):
    import pyarrow as pa

    e = S.Encoder(TOKENIZERS.path("byte_bpe_50k.json"))
    ids, n = e.encode(pa.array(texts, pa.string()), 2)
    ends = np.cumsum(n)
    return [ids[a:b].tolist() for a, b in zip(ends - n, ends)]


def test_random_plain_strings(library):
    rng = random.Random(11)
    alphabet = ["a", "Bc", "é", "zz", "7", ".", ",", "'", "'s", "***", "|", "<", "-"]
    texts = []
    for _ in range(3000):
        t = ""
        for _ in range(rng.randint(0, 12)):
            t += "".join(rng.choices(alphabet, k=rng.randint(1, 4))) + rng.choice([" ", "\n", " ", ""])
        texts.append(t)
    assert encode(texts) == [[*x.ids, 2] for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encode([]) == [] and encode([None, "x\ty"]) == [[2], [*library.encode("x\ty").ids, 2]]


@pytest.mark.parametrize("known_bytes", [0, 600, 32 << 20])
def test_words_met_in_earlier_shards(library, monkeypatch, known_bytes):
    import pyarrow as pa

    monkeypatch.setattr(S, "KNOWN_BYTES", known_bytes)
    rng, e = random.Random(5), S.Encoder(TOKENIZERS.path("byte_bpe_50k.json"))
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(80)] + ["x" * 5000, "a1", "b2!"]
    for _ in range(6):                                                   # shards of one worker
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", ".", "!!\n"]) for _ in range(40)]
        ids, n = e.encode(pa.array(texts, pa.string()), 2)
        assert ids.tolist() == [i for x in library.encode_batch(texts, add_special_tokens=False) for i in [*x.ids, 2]]
        assert sum(held.nbytes + pool.nbytes for held, pool, _, _ in e.met.values()) <= 2 * known_bytes


def test_a_repeated_task_leaves_the_same_file(tmpdir_path):
    ids = np.random.default_rng(0).integers(0, 900, 5000).astype("<u2")
    docs = np.arange(3), np.zeros(3, bool), np.array([1000, 3000, 1000])
    blobs = []
    for _ in range(2):
        W.write(f"file://{tmpdir_path}/x.wm", ids, *docs, 2)
        blobs.append(open(f"{tmpdir_path}/x.wm", "rb").read())
    import os

    assert blobs[0] == blobs[1] and os.listdir(tmpdir_path) == ["x.wm"]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 50_000), (700, 2), (5000, 37), (3000, 50_257), (2000, 100_000)])
def test_wavelet_matrix_answers_like_the_sequence(tmpdir_path, monkeypatch, n, top):
    monkeypatch.setattr(W, "CHUNK", 512)
    monkeypatch.setattr(W, "STEP", 200)
    rng = np.random.default_rng(n)
    seq = (rng.zipf(1.4, n) % top).astype("<u2" if top < 1 << 16 else "<u4")
    W.write(f"{tmpdir_path}/s.wm", seq, np.array([7, 0]), np.array([False, True]), np.array([n, 0]), 2)
    f = W.Wavelet(f"{tmpdir_path}/s.wm")
    assert (f.sequence() == seq).all() and f.n == n and f.end_id == 2
    ids, null, counts = f.documents()
    assert ids.tolist() == [7, 0] and null.tolist() == [False, True] and counts.tolist() == [n, 0]
    for i in rng.integers(0, n, 40).tolist() if n else []:
        assert f.access(i) == seq[i]
    for token in {*seq[:15].tolist(), top + 1, 1 << 20}:
        places = np.flatnonzero(seq == token)
        assert f.occurrences(token).tolist() == places.tolist() and f.count(token) == len(places)
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert f.count(token, lo, hi) == int((seq[lo:hi] == token).sum())
        for k in range(0, len(places), max(1, len(places) // 5)):
            assert f.locate(token, k) == places[k]
        with pytest.raises(IndexError):
            f.locate(token, len(places))
    with pytest.raises(IndexError):
        f.access(n)


def test_compressed_below_plain_ids(tmpdir_path, library):
    text = " ".join(random.Random(2).choices(["the", "of", "and", "tion", "data"], k=40_000))
    ids = np.array(library.encode(text).ids, "<u2")
    assert W.write(f"{tmpdir_path}/c.wm", ids, np.zeros(1, int), np.zeros(1, bool), np.array([len(ids)]), 2) < ids.nbytes / 2
