from __future__ import annotations

import itertools

import corpus
import numpy as np
import pyarrow as pa

from tidemark.llm import labelled, quality, toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    scores, trans = rng.normal(0, 2, 9), rng.normal(0, 1, (2, 2))
    starts = np.array([True, False, False, False, True, True, False, False, False])
    got, pairs = toxicity.marginals(scores, starts, trans)
    weight = {}
    for y in itertools.product((0, 1), repeat=9):
        s = sum(scores[i] * y[i] for i in range(9)) + sum(trans[y[i - 1], y[i]] for i in range(1, 9) if not starts[i])
        weight[y] = np.exp(s)
    z = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[i]) / z for i in range(9)]
    assert np.allclose(got, want)
    moves = np.zeros((2, 2))
    for y, w in weight.items():
        for i in range(1, 9):
            if not starts[i]:
                moves[y[i - 1], y[i]] += w / z
    assert np.allclose(pairs, moves)


def test_moebius_equals_a_loop():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 1001):
        a, b, c, d = rng.random((4, n)) + 0.01
        r, want = 1.0, []
        for t in range(n):
            r = (a[t] + b[t] * r) / (c[t] + d[t] * r)
            want.append(r)
        assert np.allclose(toxicity.moebius(a, b, c, d), want)


def toxic_corpus(n=400):
    rng = np.random.default_rng(9)
    plain = [f"calm{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, 30))
        bad = i % 4 == 0
        if bad:
            for at in rng.choice(30, 3, replace=False):
                w[at] = rng.choice(["vileword", "foulword", "nastyword"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad), int(not bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(corpus.simple(spark, docs), lab).collect()
    held = [r for r in got if r.held_out]
    assert 80 < len(held) < 200 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    text = dict(docs)
    for r in got:
        assert {text[r.doc_id][s["start"] : s["end"]] for s in r.spans} <= {"vileword", "foulword", "nastyword"}
    kept = toxicity.acceptable_documents(corpus.simple(spark, docs), lab)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs if i % 4}


def test_scorers_ignore_held_out_labels(spark):
    docs, labels = toxic_corpus(200)
    frame = corpus.simple(spark, docs)
    fold = {r.doc_id: (r.a, r.b) for r in frame.select("doc_id", labelled.fold(frame.doc_id, 3).alias("a"), labelled.fold(frame.doc_id, 5).alias("b")).collect()}
    turned = [(i, 1 - t if fold[i][0] == 1 else t, 1 - q if fold[i][1] == 0 else q) for i, t, q in labels]
    one, two = (spark.createDataFrame(x, "doc_id long, toxic int, quality int") for x in (labels, turned))
    for fn in (toxicity.toxicity, quality.quality):
        assert sorted((r.doc_id, r.score) for r in fn(frame, one).collect()) == sorted((r.doc_id, r.score) for r in fn(frame, two).collect())


def test_convolution_equals_a_loop():
    rng = np.random.default_rng(3)
    filters = rng.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS))
    net = quality.Network(filters, rng.normal(0, 1, quality.FILTERS + 1), np.zeros(4))
    texts = ["", None, "ab", "x" * 127, "hello " * 60, "é" * 300]
    got = quality.chunk_values(pa.array(texts, pa.string()), net, quality._pairs(filters))
    for t, row in zip(texts, got, strict=True):
        data = (t or "").encode() + b"\0" * quality.WIDTH
        seen = [sum(filters[j][data[i + j]] for j in range(quality.WIDTH)) for i in range(len(data) - quality.WIDTH + 1)]
        starts = list(range(0, len(seen), quality.STRIDE))
        blocks = [np.max(seen[a : a + quality.STRIDE], axis=0) for a in starts]
        chunks = [np.maximum(a, b) for a, b in itertools.pairwise(blocks)] or blocks
        z = [np.maximum(c, 0) @ net.out[:-1] + net.out[-1] for c in chunks]
        assert np.allclose(row, [np.mean(z), max(z), min(z)], atol=1e-4)


def test_quality_on_held_out_rows(spark):
    docs = [(i, ("good plain words here " * 12) if i % 3 else ("b@d $$ #%& " * 20)) for i in range(300)]
    lab = spark.createDataFrame([(i, 0, int(i % 3 > 0)) for i, _ in docs], "doc_id long, toxic int, quality int")
    got = quality.quality(corpus.simple(spark, docs), lab).collect()
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.held_out)


def test_scorer_edges(spark):
    docs, labels = toxic_corpus(60)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id long, toxic int, quality int")
    for fn in (toxicity.toxicity, quality.quality):
        got = fn(corpus.documents(spark), lab).collect()
        assert len(got) == len(corpus.rows()) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
        assert fn(corpus.documents(spark, []), lab).count() == 0
        assert all(r.score == 0.5 for r in fn(corpus.documents(spark), lab.limit(0)).collect())


def test_sample_is_bounded_in_rows(spark):
    from tidemark.llm import labelled

    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(400)] + [(7, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    got = labelled.labelled_sample(docs, labels, "quality", 1000, 999, 4).collect()
    assert 0 < len(got) <= 4 and len({r.doc_id for r in got}) == len(got)
    again = labelled.labelled_sample(docs.repartition(7), labels, "quality", 1000, 999, 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
