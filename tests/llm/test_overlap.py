from __future__ import annotations

import hashlib
import random

import corpus
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate, jaccard, words

WORDS = [f"w{i}" for i in range(400)]


def family(seed=3):
    """Random texts with near copies, shared passages and a crowd of texts that differ in one word."""
    rng = random.Random(seed)
    out, passage = [], [rng.choice(WORDS) for _ in range(60)]
    for i in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 8, 40, 120]))]
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(copy)
        if i % 3 == 0:
            out.append([rng.choice(WORDS) for _ in range(30)] + passage + [rng.choice(WORDS) for _ in range(20)])
    crowd = [rng.choice(WORDS) for _ in range(50)]
    for i in range(60):
        copy = list(crowd)
        copy[i % 50] = f"only{i}"
        copy[(i * 7) % 50] = f"also{i}"
        out.append(copy)
    return [(10 * i + 1, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("tile, nearest", [(2_000, 4), (5, 1)])
def test_components_equal_all_pairs(spark, monkeypatch, tile, nearest):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "NEAREST", nearest)
    docs = family()
    want = corpus.components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(corpus.simple(spark, docs)).collect()}
    assert {i: c for i, (_, c) in got.items()} == want
    assert all(got[i][0] == len(corpus.shingles(t)) for i, t in docs)


def test_spanning_links_of_a_tile():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 60 - k], rng.integers(0, 2**62, k)])) for k in rng.integers(0, 14, 40)]
    rows = sorted(sets, key=len)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 40, pa.int64()), pa.array([0] * 40, pa.int32()), pa.array([0] * 40, pa.int64()), pa.array([-1] * 40, pa.int32()), pa.array([False] * 40),
         pa.array(range(40), pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array(range(40), pa.int64()), pa.array(rows, pa.list_(pa.int64()))],
        names=["shingle", "band", "tile", "side", "guest", "rid", "n", "component", "shingles"],
    )
    found = [(r["a"], r["b"]) for out in jaccard._spanning(75, block=64)([batch]) for r in out.to_pylist()]
    links = {(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(rows[i], rows[j])) >= 75 * len(np.union1d(rows[i], rows[j]))}
    assert len(found) < 40 and {(max(p), min(p)) for p in found} <= links

    def groups(pairs):
        root = list(range(40))
        for _ in range(40):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(found) == groups(links) and len(set(groups(links))) < 40


def test_jaccard_edges(spark):
    got = [(r.doc_id, r.component_id) for r in jaccard.near_duplicates(corpus.documents(spark)).collect()]
    want = corpus.components([(r[0], r[1]) for r in corpus.rows()])
    assert len(got) == len(corpus.rows())
    assert all(c == want.get(i) for i, c in got)
    assert jaccard.near_duplicates(corpus.documents(spark, [])).count() == 0
    kept = jaccard.one_per_group(corpus.documents(spark))
    assert kept.columns == corpus.documents(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, c in want.items()}) and ids.count(None) == 2


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n in (1, 20, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64)]))
        u, v = (np.frombuffer(jaccard.bitmap(x), np.uint64) for x in (a, b))
        width = min(len(u), len(v))
        differ = int(np.bitwise_count(jaccard.fold(u, width) ^ jaccard.fold(v, width)).sum())
        assert (len(a) + len(b) - differ) / 2 >= len(np.intersect1d(a, b))


def test_words_are_those_of_the_patterns():
    texts = ["", None, "Aé-b\tC  d\x0be", " x", "y ", "\x1f z\x7f1", "日本語 ABC9", "a" * 100 + " " + "a" * 100 + "b"]
    for inside, plain in ((words.BLANK, corpus.blank_words), (words.ALNUM, corpus.alnum_words)):
        hashes, offsets = words.hashed_words(pa.array(texts, pa.string()), inside)
        flat = [w for t in texts for w in plain(t)]
        assert len(hashes) == len(flat) and [len(plain(t)) for t in texts] == np.diff(offsets).tolist()
        assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist(), strict=True)))


def test_every_shared_window_is_found(spark):
    rng = random.Random(5)
    items = {str(i): " ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 7, 9, 10, 11, 30]))) for i in range(12)} | {"e": "", "dup": ""}
    items["dup"] = items["3"]
    docs = []
    for i in range(80):
        body = [rng.choice(WORDS) for _ in range(rng.choice([0, 5, 40]))]
        if i % 2:
            x = corpus.alnum_words(items[str(rng.randrange(12))])
            a = rng.randrange(len(x))
            body[len(body) // 2 : len(body) // 2] = x[a:] if i % 4 == 1 else x
        docs.append((i, ", ".join(body).upper()))
    bench = spark.createDataFrame(list(items.items()), "item_id string, text string")
    for r in decontaminate.overlap(corpus.simple(spark, docs), bench).collect():
        w, hit, found = corpus.hits(dict(docs)[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert {p for s in r.spans for p in range(s.start if hasattr(s, "start") else s["first"], s["end"])} == hit


def test_decontaminate_edges(spark):
    bench = spark.createDataFrame([(1, BODY), (2, None), (None, "short one"), (3, ""), (1, BODY)], "item_id long, text string")
    docs = corpus.documents(spark)
    got = decontaminate.overlap(docs, bench).collect()
    assert len(got) == len(corpus.rows())
    by = {r.doc_id: r for r in got}
    assert by[8].contaminated and by[8].n_items == 1 and not by[4].contaminated and by[4].n_words == 0
    assert by[7].contaminated and by[10].contaminated
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {8, 7} & {r.doc_id for r in clean.collect()} == set()
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == len(corpus.rows())
    assert decontaminate.overlap(corpus.documents(spark, []), bench).count() == 0


BODY = " ".join(corpus.LONG.split()[500:520])


def test_one_per_group_without_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "own words only")], "doc_id long, text string")
    kept = jaccard.one_per_group(docs)
    assert kept.columns == ["doc_id", "text"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]
