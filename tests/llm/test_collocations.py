from __future__ import annotations

import random
import re
from collections import Counter

import corpus
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as c


def counts(texts):
    """Counter of word tuples of up to three words, and the number of words."""
    f = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", corpus.lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, sum(v for k, v in f.items() if len(k) == 1)


def plain(texts, least=10, contained=50, top=2000):
    f, n = counts(texts)
    rows = []
    for p, a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and b >= least and 100 * b >= contained * a for q, b in f.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
        rows.append((" ".join(p), a, f[p[:k]], f[p[k:]], n, score))
    rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
    return [(i + 1, *r) for i, r in enumerate(rows[:top])]


def texts(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Été", "x|y", "O K", "A"]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 30, 200]))]
        out.append("".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "  "]) for w in words))
    return [*out, out[3], out[3], None, "", "...", "the the the the the the the the the the the the", "  a  ", "y" * 5_000 + " end"]


@pytest.mark.parametrize("seed, least, top, size", [(1, 10, 2000, 1 << 23), (2, 3, 40, 300), (3, 2, 7, 5_000)])
def test_equals_plain_counts(spark, monkeypatch, seed, least, top, size):
    monkeypatch.setattr(c, "DICTIONARY_BYTES", size)
    data = texts(seed)
    docs = corpus.simple(spark, list(enumerate(data)))
    got = sorted(tuple(r)[1:] for r in c.collocations(docs, least=least, top=top).collect())
    assert got == plain(data, least, top=top) and got


def test_chunks_own_every_phrase_once(spark):
    data = texts(7)
    f, _ = counts(data)
    got = Counter()
    for r in c.chunks(corpus.simple(spark, list(enumerate(data)))).collect():
        w = re.findall(r"[^\x20\x09]+", r.chunk)
        assert 0 < r.own <= len(w) <= r.own + c.LONGEST - 1 and r.own <= c.MOST_WORDS
        for i in range(r.own):
            for k in (1, 2, 3):
                if i + k <= len(w):
                    got[tuple(w[i : i + k])] += r.times
    assert got == f


def test_languages_are_apart_and_null_is_und(spark):
    a, b = texts(4), texts(5)
    docs = corpus.simple(spark, list(enumerate(a))).unionByName(corpus.simple(spark, list(enumerate(b))).withColumn("lang", F.lit(None).cast("string")))
    got = {}
    for r in c.collocations(docs).collect():
        got.setdefault(r.lang, []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {"en": plain(a), "und": plain(b)}


def test_words_that_are_names_of_languages(spark):
    docs = corpus.simple(spark, [(i, "es en es en de " * 20) for i in range(3)])
    both = docs.unionByName(docs.withColumn("lang", F.lit("es"))).unionByName(docs.withColumn("lang", F.lit("de")))
    want = plain(["es en es en de " * 20] * 3)
    got = {}
    for r in c.collocations(both).collect():
        got.setdefault(r.lang, []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == dict.fromkeys(("de", "en", "es"), want)


def test_exact_arithmetic(spark):
    rows = [(3_000_000_019, 3_000_000_021, 9_000_000_011), (10**12 + 7, 10**12 + 9, 10**12 + 11)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", c._exact(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in df.collect())


def test_odd_rows_and_empty_table(spark):
    assert c.collocations(corpus.documents(spark)).count() == len(plain([r[1] for r in corpus.rows()]))
    assert c.collocations(corpus.documents(spark, [])).count() == 0
