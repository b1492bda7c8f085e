"""Quality: a byte-level convolutional network in numpy over overlapping chunks of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.labelled import fold, labelled_sample, logistic, sigmoid
from tidemark.llm.words import text_bytes

FOLDS, HELD_OUT = 5, 0
#: most labelled rows that are fitted on
MOST_LABELLED = 6_000
#: bytes a filter sees, filters, bytes between chunk starts (a chunk is two strides long)
WIDTH, FILTERS, STRIDE = 4, 8, 128
THRESHOLD = 0.3
EPOCHS = 6


class Network(NamedTuple):
    filters: np.ndarray  # WIDTH × 256 × FILTERS
    out: np.ndarray  # FILTERS + 1: weights of a chunk's pooled values and intercept
    document: np.ndarray  # mean, largest and smallest chunk value, intercept


def _chunks(pooled: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk values, offsets per document): every block with its successor in the same document, one chunk at least."""
    offsets = np.concatenate([[0], np.cumsum(np.maximum(np.diff(blocks) - 1, 1))])
    last = np.zeros(len(pooled), bool)
    last[blocks[1:] - 1] = True
    both = pooled.copy()
    both[:-1] = np.where(last[:-1, None], pooled[:-1], np.maximum(pooled[:-1], pooled[1:]))
    single = np.zeros(len(pooled), bool)
    single[blocks[:-1][np.diff(blocks) == 1]] = True
    return both[~last | single], offsets


class Bytes(NamedTuple):
    """Texts end to end, each with ``WIDTH`` zero bytes behind it; a text of n bytes has n + 1 filter positions."""

    data: np.ndarray
    starts: np.ndarray  # first position of each block
    blocks: np.ndarray  # offsets of each text's blocks, one at least
    void: np.ndarray  # positions at which a filter would reach into the next text


def padded(texts: pa.Array) -> Bytes:
    raw, offsets = text_bytes(texts)
    lengths, places = np.diff(offsets), np.arange(len(offsets) - 1)
    data = np.zeros(len(raw) + WIDTH * len(lengths), np.uint8)
    data[np.arange(len(raw)) + WIDTH * np.repeat(places, lengths)] = raw
    begin = offsets[:-1] + WIDTH * places
    count = lengths // STRIDE + 1
    blocks = np.concatenate([[0], np.cumsum(count)])
    starts = np.repeat(begin, count) + STRIDE * (np.arange(blocks[-1]) - np.repeat(blocks[:-1], count))
    void = ((begin + lengths)[:, None] + np.arange(1, WIDTH)).ravel()
    return Bytes(data, starts, blocks, void)


def pooled_blocks(text: Bytes, pairs: tuple[np.ndarray, np.ndarray], step: int = 512) -> np.ndarray:
    """Largest response of each filter in each block; ``pairs`` hold the responses to two bytes at a time."""
    data, starts = text.data, text.starts
    two = np.zeros(len(data) + WIDTH, np.uint8)
    two[: len(data)] = data
    code = two[:-1].astype(np.uint16) << 8 | two[1:]
    out = np.empty((len(starts), FILTERS), np.float32)
    for i in range(0, len(starts), step):
        a = starts[i]
        b = starts[i + step] if i + step < len(starts) else len(data)
        seen = pairs[0][code[a:b]]
        seen += pairs[1][code[a + 2 : b + 2]]
        seen[text.void[np.searchsorted(text.void, a) : np.searchsorted(text.void, b)] - a] = -1e9
        out[i : i + step] = np.maximum.reduceat(seen, starts[i : i + step] - a, axis=0)
    return out


def _pairs(filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((filters[j][:, None, :] + filters[j + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for j in (0, 2))


def chunk_values(texts: pa.Array, net: Network, pairs) -> np.ndarray:
    """Per document: mean, largest and smallest value of its chunks."""
    if not len(texts):
        return np.zeros((0, 3))
    text = padded(texts)
    chunks, offsets = _chunks(pooled_blocks(text, pairs), text.blocks)
    z = np.maximum(chunks, 0) @ net.out[:-1] + net.out[-1]
    at = offsets[:-1]
    return np.column_stack([np.add.reduceat(z, at) / np.diff(offsets), np.maximum.reduceat(z, at), np.minimum.reduceat(z, at)])


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Backpropagation through pooling and filters with Adam, classes balanced; then a logistic model over all rows.

    A document's training output is the mean of its chunks' values.
    """
    rng = np.random.default_rng(seed)
    filters, out = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)), np.append(rng.normal(0, 0.3, FILTERS), 0.0)
    sizes = [filters.size, out.size]
    m, v, k = np.zeros(sum(sizes)), np.zeros(sum(sizes)), 0
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    half = min(len(good), max(4 * len(bad), 1)) if len(bad) else 0
    for _ in range(epochs if half else 0):
        rows = np.concatenate([rng.choice(good, half, replace=False), rng.choice(bad, half, replace=len(bad) < half)])
        rng.shuffle(rows)
        for i in range(0, len(rows), 32):
            batch = rows[i : i + 32]
            data, starts, blocks, void = padded(texts.take(pa.array(batch)))
            ahead = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
            seen = sum(filters[j][ahead[j : j + len(data)]] for j in range(WIDTH))
            fine = np.ones(len(data), bool)
            fine[void] = False
            at = np.flatnonzero(fine)
            row = np.searchsorted(starts, at, side="right") - 1
            whole = np.full((len(starts), STRIDE, FILTERS), -1e9)
            whole[row, at - starts[row]] = seen[at]
            best = whole.argmax(axis=1)
            pooled = np.take_along_axis(whole, best[:, None, :], 1)[:, 0]
            hit = np.maximum(pooled, 0)
            z = hit @ out[:-1] + out[-1]
            owner = np.repeat(np.arange(len(batch)), np.diff(blocks))
            share = 1 / np.diff(blocks)[owner]
            p = sigmoid(np.bincount(owner, z * share, len(batch)))
            gz = ((p - labels[batch]) / len(batch))[owner] * share
            g_out = np.append(hit.T @ gz, gz.sum())
            g_hit = gz[:, None] * out[:-1] * (pooled > 0)
            g_filters = np.zeros_like(filters)
            for j in range(WIDTH):
                np.add.at(g_filters[j], (ahead[starts[:, None] + best + j], np.arange(FILTERS)[None, :]), g_hit)
            g, k = np.concatenate([g_filters.ravel(), g_out]), k + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.02 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            filters -= step[: sizes[0]].reshape(filters.shape)
            out -= step[sizes[0] :]
    net = Network(filters, out, np.zeros(4))
    pairs = _pairs(filters)
    values = np.concatenate([chunk_values(texts.slice(i, 256), net, pairs) for i in range(0, len(texts), 256)]) if len(texts) else np.zeros((0, 3))
    return net._replace(document=logistic(values, labels.astype(float)))


def _scorer(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(net.filters)
        for part in slices(batches):
            score = sigmoid(chunk_values(part.texts, net, pairs) @ net.document[:-1] + net.document[-1])
            yield pa.RecordBatch.from_arrays([part.rows.column(part.rows.schema.get_field_index("doc_id")), pa.array(score)], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The network is trained on at most ``most`` labelled rows outside the held-out fold. Scoring reads every byte: filters of ``WIDTH``
    bytes, the largest response of each in chunks of two strides that overlap by one, a value per chunk, and a probability from their mean,
    largest and smallest.

    Null and empty texts are scored as the empty text. Without labelled rows all scores are 0.5. Repeated rows give repeated rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, most)
    rows = sample.select("label", "text").orderBy(F.xxhash64("text"), "label").toArrow()  # bounded
    net = fit(rows.column("text").combine_chunks(), rows.column("label").to_numpy())
    shared = spark.sparkContext.broadcast(net)

    def score(batches):
        yield from _scorer(shared.value)(batches)

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
