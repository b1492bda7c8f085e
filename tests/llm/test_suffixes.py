from __future__ import annotations

import random
from collections import Counter

import corpus
import numpy as np
import pytest

from tidemark.llm import suffixes


def plain(texts, length):
    """(spans, kept) of every text, from a count of all strings of that length."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        ends = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False].astype(np.int8))).reshape(-1, 2).tolist()
        out.append((len(d), [tuple(e) for e in ends], bytes(np.frombuffer(d, np.uint8)[~gone[:-1]].tobytes())))
    return out


def run(spark, texts, length):
    docs = corpus.simple(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.suffix_dedup(docs, length).collect()}
    return [got[i] for i in range(len(texts))]


def family(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(150))
    texts = []
    for i in range(n):
        own = " ".join(word() for _ in range(rng.choice([0, 3, 60, 200])))
        kind = i % 6
        if kind == 0:
            a = rng.randrange(len(passage) // 2)
            own = own + passage[a : a + rng.choice([90, 410, 399, 401, 600])] + own[::-1]
        if kind == 1 and texts:
            own = texts[rng.randrange(len(texts))]
        if kind == 2 and texts:
            b = list(texts[rng.randrange(len(texts))])
            for _ in range(3):
                if b:
                    b[rng.randrange(len(b))] = "X"
            own = "".join(b)
        texts.append(own)
    return [*texts, None, "", "z" * 1_000, "xy" * 300, "Q" * 399, "Q" * 399]


@pytest.mark.parametrize("length, per_bucket", [(400, 300_000), (400, 50), (40, 300_000), (40, 200), (100, 300), (16, 400)])
def test_equals_count_of_all_strings(spark, monkeypatch, length, per_bucket):
    monkeypatch.setattr(suffixes, "ROWS_PER_BUCKET", per_bucket)
    monkeypatch.setattr(suffixes, "SEGMENT", 1_000)
    texts = family(length + per_bucket, 36)
    assert run(spark, texts, length) == plain(texts, length)


def test_crowd_fills_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "ROWS_PER_BUCKET", 60)
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = [f"{rng.random()} " * rng.randint(1, 30) + passage + f"{rng.random()}" * rng.randint(1, 30) for _ in range(80)] + [passage] * 40
    assert run(spark, texts, 400) == plain(texts, 400)


def test_two_long_equal_runs_only(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3_000)) for _ in range(4)]
    texts[1] = texts[1][:500] + texts[0][100:500] + texts[1][500:]  # exactly 400 bytes
    texts[3] = texts[3][:500] + texts[2][100:499] + texts[3][500:]  # one less
    got = run(spark, texts, 400)
    assert got == plain(texts, 400)
    assert [len(s) for _, s, _ in got] == [1, 1, 0, 0]


@pytest.mark.parametrize("length", range(16, 600, 7))
def test_blocks_cover_what_they_name(length):
    f = suffixes.shape(length)
    assert 1 <= f.window <= f.block + 1 and f.block <= length - f.window + 1 <= 2 * f.block and f.block <= length <= 3 * f.block


def test_multikey_sort():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-5, 5, 50_000), rng.integers(-(2**62), 2**62, 50_000)
    a[:20_000] = 2
    b[:7_000] = 9
    order = suffixes.multikey_sort([a, b])
    assert (np.stack([a, b])[:, order] == np.stack([a, b])[:, np.lexsort([b, a])]).all()


def test_odd_rows_and_empty_table(spark):
    docs = corpus.documents(spark)
    want = plain([r[1] for r in corpus.rows()], 400)
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.suffix_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *w) for r, w in zip(corpus.rows(), want, strict=True)], key=str)
    assert suffixes.suffix_dedup(corpus.documents(spark, [])).count() == 0
