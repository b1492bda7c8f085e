"""Toxicity: a linear-chain conditional random field over words; marginals give document scores and spans."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, text_key, without
from tidemark.llm.labelled import fold, labelled_sample, logistic, sigmoid
from tidemark.llm.words import ALNUM, located_words, mix

FOLDS, HELD_OUT = 3, 1
#: most labelled rows that are fitted on
MOST_LABELLED = 4_000
#: most documents of either label whose words train the chain
MOST_CHAINS = 700
#: words of the training chains whose marginals are computed at once
WORDS_AT_ONCE = 250_000
#: bytes of the word beginnings that are features beside the word
PREFIXES = (6, 4)
#: a word or beginning is tagged in documents labelled 1 if it has so many different left neighbours there and this share of them
LEAST_CONTEXTS, LEAST_SHARE = 5, 0.9
THRESHOLD = 0.7
ROUNDS = 60
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])
_U = np.uint64


class Chain(NamedTuple):
    """A trained field: weights by hash (own word, its beginnings, left and right neighbour), transitions, and the document model."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    document: np.ndarray


def moebius(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, first: float = 1.0) -> np.ndarray:
    """All r[t] = (a[t] + b[t]·r[t-1]) / (c[t] + d[t]·r[t-1]), from r[-1] = first.

    Cut into blocks: each block's map is a 2×2 product, the products chain to every block's entry value, and all blocks then
    run at once.
    """
    n = len(a)
    if not n:
        return np.zeros(0)
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)

    def shaped(x, fill):
        out = np.full(blocks * length, fill)
        out[:n] = x
        return np.ascontiguousarray(out.reshape(blocks, length).T)

    a, b, c, d = shaped(a, 0.0), shaped(b, 1.0), shaped(c, 1.0), shaped(d, 0.0)
    pb, pa_, pd, pc = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(length):
        pb, pa_, pd, pc = b[t] * pb + a[t] * pd, b[t] * pa_ + a[t] * pc, d[t] * pb + c[t] * pd, d[t] * pa_ + c[t] * pc
        scale = pb + pa_ + pd + pc
        pb, pa_, pd, pc = pb / scale, pa_ / scale, pd / scale, pc / scale
    entry = np.empty(blocks)
    r = first
    for i in range(blocks):
        entry[i] = r
        r = (pa_[i] + pb[i] * r) / (pc[i] + pd[i] * r)
    out = np.empty((length, blocks))
    r = entry
    for t in range(length):
        r = (a[t] + b[t] * r) / (c[t] + d[t] * r)
        out[t] = r
    return out.T.ravel()[:n]


def marginals(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of tag 1 per word, expected transitions) of chains laid end to end.

    ``scores``: log weight of tag 1 over tag 0; ``starts``: whether a chain begins; ``transitions``: log weights [from, to].
    """
    e, t = np.exp(np.clip(scores, -25, 25)), np.exp(transitions)
    c00, c01, c10, c11 = (np.where(starts, 1.0, t[i, j]) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)))
    forward = moebius(e * c01, e * c11, c00, c10)
    back = np.ones(len(e))
    if len(e) > 1:
        back[:-1] = moebius(c10[:0:-1], (c11 * e)[:0:-1], c00[:0:-1], (c01 * e)[:0:-1])[::-1]
    odds = forward * back
    expected = np.zeros((2, 2))
    inner = np.flatnonzero(~starts[1:]) + 1
    if len(inner):
        left, q = forward[inner - 1], back[inner]
        cells = [np.full(len(inner), t[0, 0]), t[0, 1] * e[inner] * q, left * t[1, 0], left * t[1, 1] * e[inner] * q]
        total = cells[0] + cells[1] + cells[2] + cells[3]
        expected = np.array([(x / total).sum() for x in cells]).reshape(2, 2)
    return odds / (1 + odds), expected


def _keys(words: np.ndarray, heads: list[np.ndarray]) -> np.ndarray:
    """Row 0: words; then their beginnings, told apart from words."""
    return np.stack([words, *[h ^ _U(n * 0x9E3779B97F4A7C15 & 2**64 - 1) for n, h in zip(PREFIXES, heads, strict=True)]])


def _places(keys: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    unknown = len(vocabulary)
    if not unknown:
        return np.zeros(len(keys), np.int32)
    at = np.searchsorted(vocabulary, keys)
    at[at == unknown] = 0
    return np.where(vocabulary[at] == keys, at, unknown).astype(np.int32)


def _features(keys: np.ndarray, starts: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Per word the vocabulary places of itself, its beginnings and its neighbours; behind the last: "unknown or none"."""
    own = [_places(k, vocabulary) for k in keys]
    left, right = np.full_like(own[0], len(vocabulary)), np.full_like(own[0], len(vocabulary))
    left[1:] = np.where(starts[1:], len(vocabulary), own[0][:-1])
    right[:-1] = np.where(starts[1:], len(vocabulary), own[0][1:])
    return np.stack([*own, left, right])


def _starts(offsets: np.ndarray, n: int) -> np.ndarray:
    starts = np.zeros(n, bool)
    starts[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return starts


def _summary(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document: largest marginal and log(1 + expected tagged words)."""
    out = np.zeros((len(offsets) - 1, 2))
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full, 0] = np.maximum.reduceat(p, offsets[full])
        out[full, 1] = np.log1p(np.add.reduceat(p, offsets[full]))
    return out


def tag_words(keys: np.ndarray, starts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Word tags from document labels: words and beginnings that go with label 1 (by distinct left neighbours) are tagged where it is 1."""
    left = np.zeros_like(keys[0])
    left[1:] = np.where(starts[1:], 0, keys[0][:-1])
    left = mix(left)
    tags = np.zeros(len(left), bool)
    for own in keys if len(left) else []:
        seen = np.unique(own[toxic])
        contexts = []
        for side in (toxic, ~toxic):
            at = _places(own[side], seen)
            known = np.flatnonzero(side)[at < len(seen)]
            at = at[at < len(seen)]
            _, first = np.unique(own[known] * _U(0x9E3779B97F4A7C15) ^ left[known], return_index=True)
            contexts.append(np.bincount(at[first], minlength=len(seen)))
        ones, total = contexts[0], contexts[0] + contexts[1]
        marked = seen[(ones >= LEAST_CONTEXTS) & (ones >= LEAST_SHARE * total)]
        tags |= _places(own, marked) < len(marked)
    return tags & toxic


def fit(keys: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS) -> Chain:
    """Train the chain by Adam on the exact gradient, then the document model on the marginals of the same rows.

    ``keys``: hashes of words and beginnings of all texts end to end; ``toxic``: 0 or 1 per document.
    """
    n = keys.shape[1]
    starts, owner = _starts(offsets, n), np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(offsets))
    tags = tag_words(keys, starts, toxic.astype(bool)[owner])
    tagged = np.bincount(owner, tags, len(toxic)) > 0
    chosen = np.concatenate([np.flatnonzero(tagged)[:MOST_CHAINS], np.flatnonzero((toxic == 0) & ~tagged)[:MOST_CHAINS]])
    use = np.isin(np.arange(len(toxic)), chosen)[owner]
    w, s, y = keys[:, use], starts[use], tags[use].astype(float)
    vocabulary = np.unique(w)
    f = _features(w, s, vocabulary)
    del owner, use, tags, w
    cuts = np.flatnonzero(s)
    cuts = [*cuts[np.unique(np.searchsorted(cuts, np.arange(0, len(s), WORDS_AT_ONCE), side="right") - 1)], len(s)]  # whole chains
    weights, bias, trans = np.zeros((len(f), len(vocabulary) + 1)), -3.0, np.zeros((2, 2))
    inner = np.flatnonzero(~s[1:]) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    m, v = np.zeros(weights.size + 5), np.zeros(weights.size + 5)
    for k in range(1, rounds + 1 if len(y) else 1):
        parts = [marginals(_score(f[:, a:b], weights, bias), s[a:b], trans) for a, b in zip(cuts, cuts[1:], strict=False)]
        p, expected = np.concatenate([x for x, _ in parts]), sum(x for _, x in parts)
        g = np.stack([np.bincount(x, y - p, len(vocabulary) + 1) for x in f])
        g[:, -1] = 0
        g = np.concatenate([(g - 0.02 * weights).ravel(), [(y - p).sum()], (seen - expected).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-3)
        weights += step[:-5].reshape(weights.shape)
        bias += step[-5]
        trans += step[-4:].reshape(2, 2)
    found = [np.zeros((0, 2))]
    for i in range(0, len(toxic), 200):
        a, b = offsets[i], offsets[min(i + 200, len(toxic))]
        p, _ = marginals(_score(_features(keys[:, a:b], starts[a:b], vocabulary), weights, bias), starts[a:b], trans)
        found.append(_summary(p, offsets[i : i + 201] - a))
    return Chain(vocabulary, weights, bias, trans, logistic(np.concatenate(found), toxic.astype(float)))


def _score(features: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return sum(w[f] for w, f in zip(weights, features, strict=True)) + bias


def _scorer(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, offsets, first, last, *heads = located_words(part.texts, ALNUM, PREFIXES)
            starts = _starts(offsets, len(words))
            features = _features(_keys(words, heads), starts, chain.vocabulary)
            p, _ = marginals(_score(features, chain.weights, chain.bias), starts, chain.transitions)
            score = sigmoid(_summary(p, offsets) @ chain.document[:-1] + chain.document[-1])
            spans: list[list[dict]] = [[] for _ in range(len(score))]
            hits = np.flatnonzero(p >= 0.5)
            owners = np.searchsorted(offsets, hits, side="right") - 1
            texts = {int(d): part.texts[int(d)].as_py().encode() for d in np.unique(owners)}
            begin = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(part.texts), 0).to_numpy(zero_copy_only=False))])
            for d, at in zip(owners, hits, strict=True):
                a, b = int(first[at] - begin[d]), int(last[at] - begin[d])
                head = len(texts[int(d)][:a].decode())
                spans[d].append({"start": head, "end": head + len(texts[int(d)][a:b].decode()), "marginal": float(p[at])})
            keep = part.rows.select(["doc_id", "__text"]).columns
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "__text", "score", "spans"])

    return run


def _unpacked(rows: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, offsets, labels) for ``fit``, copied column by column; the caller keeps no second copy."""
    sizes = pa.compute.list_value_length(rows.column(names[0])).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    keys = np.empty((len(names), offsets[-1]), _U)
    for out, name in zip(keys, names, strict=True):
        at = 0
        for chunk in rows.column(name).chunks:
            values = chunk.flatten().to_numpy(zero_copy_only=False).view(_U)
            out[at : at + len(values)] = values
            at += len(values)
    return keys, offsets, rows.column("label").to_numpy()


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans (character offsets and marginals of offending words).

    Learned from at most ``most`` labelled rows outside the held-out fold: words that go with label 1 become word tags, a chain field is
    trained on the tagged words of at most ``MOST_CHAINS`` documents of either kind, and a logistic model turns
    the marginals of a document (largest, expected number) into its score. Every text is one chain, scored whole.

    Null and empty texts have the score of a text without marked words. Without labelled rows all scores are 0.5. Repeated rows give repeated rows; other
    columns are ignored.
    """
    return _toxicity(docs, labels, most, threshold).drop("__text")


def _toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """``toxicity`` with the ``text_key`` of each row as __text."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, most)

    names = [f"key{i}" for i in range(len(PREFIXES) + 1)]

    def hashes(batches):
        for part in slices(batches):
            words, offsets, _, _, *heads = located_words(part.texts, ALNUM, PREFIXES)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(k.view(np.int64))) for k in _keys(words, heads)]
            yield pa.RecordBatch.from_arrays([*part.rows.select(["doc_id", "label"]).columns, *lists], names=["doc_id", "label", *names])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, label int, " + ", ".join(f"{n} array<bigint>" for n in names)
    hashed = sample.mapInArrow(hashes, schema).orderBy(F.xxhash64("doc_id"), "doc_id")
    keys, offsets, marks = _unpacked(hashed.toArrow(), names)  # bounded
    chain = spark.sparkContext.broadcast(fit(keys, offsets, marks))

    def score(batches):
        yield from _scorer(chain.value)(batches)

    span = "array<struct<start:int,end:int,marginal:double>>"
    keyed = docs.select("doc_id", text_key().alias("__text"), "text")
    scored = keyed.mapInArrow(score, f"doc_id {kind}, __text bigint, score double, spans {span}")
    return scored.select(
        "doc_id", "__text", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans"
    )


def acceptable_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic; same columns, repeated rows kept.

    Rows are judged by id and text: another text of the same id, or without an id, stays.
    """
    return without(docs, _toxicity(docs, labels, **options).where("predicted = 1"))
