"""Phrase collocations by prefix-free parsing: texts become chunks that their words trigger, phrases are counted once per distinct chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import FILTER_BITS, bit_filter, cut, in_filter, slices
from tidemark.llm.words import _LOWER, _table, gram_hashes, hash_runs, mix, text_bytes

#: words of a phrase at most; a chunk overlaps the next by one word less
LONGEST = 3
#: one word in so many opens a chunk, and a chunk without such a word ends after so many
TRIGGER, MOST_WORDS = 16, 64
LEAST, CONTAINED, SCALE, TOP = 10, 50, 1_000_000, 2_000
#: parts in which the first rows of a language are ranked before they meet
SALTS = 64
#: bytes of chunks whose phrases are added up in a task before they are sent on
DICTIONARY_BYTES = 1 << 23
#: words of the dictionary per task that adds up counts of hashes
WORDS_PER_TASK = 2_000_000
_STOPS = [*b".,;:!?", *range(0x0A, 0x0E)]
#: byte → is part of a piece; byte → is part of a word
PIECE, WORD = _table(_STOPS), _table([0x20, 0x09, *_STOPS])


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte behind, number of the piece) of every word; pieces end at stops and at the ends of texts."""
    inside = WORD[raw]
    opens = np.zeros(len(raw) + 1, bool)
    opens[offsets] = True
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]] | inside & opens[:-1])
    ends = np.flatnonzero(inside & np.r_[~inside[1:], True] | inside & opens[1:]) + 1
    cuts = np.cumsum(~PIECE[raw] | opens[:-1])
    return starts, ends, cuts[starts]


def _gather(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of bytes as strings."""
    offsets = np.r_[0, np.cumsum(lengths)]
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[at]))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (lang, text) → (lang, chunk, own, times), equal chunks of a slice as one row.

    A chunk starts at the first word of a piece, at a word whose hash triggers, or ``MOST_WORDS`` behind the start before. It owns the
    phrases that start before the next chunk's start, and reaches ``LONGEST - 1`` words into it, so it holds them whole.
    """
    for rows, texts in slices(batches):
        langs = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
        raw, offsets = text_bytes(texts)
        if not len(raw):
            continue
        raw = _LOWER[raw]
        starts, ends, piece = _words(raw, offsets)
        if not len(starts):
            continue
        words = hash_runs(raw, starts, ends - starts)
        n = len(starts)
        fresh = np.r_[True, piece[1:] != piece[:-1]]
        opens = fresh | (words % np.uint64(TRIGGER) == 0)
        first = np.flatnonzero(opens)
        run = np.cumsum(opens) - 1
        opens |= (np.arange(n) - first[run]) % MOST_WORDS == 0
        first = np.flatnonzero(opens)
        behind = np.r_[first[1:], n]
        piece_end = np.r_[np.flatnonzero(fresh)[1:], n][np.cumsum(fresh) - 1][first]
        last = np.minimum(behind + LONGEST - 1, piece_end) - 1
        lang = langs.indices.to_numpy()[np.searchsorted(offsets, starts[first], side="right") - 1]
        begin, length, own = starts[first], ends[last] - starts[first], behind - first
        name = hash_runs(raw, begin, length)
        order = np.lexsort([own, lang, name])
        same = np.r_[False, (name[order][1:] == name[order][:-1]) & (lang[order][1:] == lang[order][:-1]) & (own[order][1:] == own[order][:-1])]
        heads = order[~same]
        times = np.diff(np.r_[np.flatnonzero(~same), len(order)])
        chunk = _gather(raw, begin[heads], length[heads])
        out = [langs.dictionary.take(pa.array(lang[heads])), chunk.cast(pa.string()), pa.array(own[heads].astype(np.int32)), pa.array(times.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(out, names=["lang", "chunk", "own", "times"])


class _Grams:
    """The phrases that the chunks of some dictionary rows own."""

    def __init__(self, rows: pa.RecordBatch, texts: pa.Array):
        self.langs = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
        self.own, self.times = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("own", "times"))
        self.lang = self.langs.indices.to_numpy()
        self.salts = np.array([_salt(x) for x in self.langs.dictionary.to_pylist()], np.uint64)
        self.raw, offsets = text_bytes(texts)
        self.starts, self.ends, _ = _words(self.raw, offsets)
        self.words = hash_runs(self.raw, self.starts, self.ends - self.starts)
        self.chunk = np.searchsorted(offsets, self.starts, side="right") - 1
        first = np.searchsorted(self.starts, offsets)
        at = np.arange(len(self.starts))
        self.owned = at - first[self.chunk] < self.own[self.chunk]
        self.left = first[self.chunk + 1] - at

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hash of (lang, ``k`` words) at each place."""
        return mix(gram_hashes(self.words, k)[at] + self.salts[self.lang[self.chunk[at]]])

    def counted(self, k: int, known: np.ndarray | None, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a place, key, times) of each different phrase of ``k`` words whose parts of ``below`` words are all in the filter ``known``."""
        at = np.flatnonzero(self.owned & (self.left >= k))
        if known is not None and len(at):
            for j in range(k - below + 1):
                at = at[in_filter(known, self.keys(below, at + j))] if len(at) else at
        if not len(at):
            return at, np.zeros(0, np.uint64), at
        key, head, group = np.unique(self.keys(k, at), return_index=True, return_inverse=True)
        return at[head], key, np.bincount(group, self.times[self.chunk[at]]).astype(np.int64)


def _hashed(sizes: tuple[int, ...], known: np.ndarray | None, parts: int):
    """Arrow batches (lang, chunk, own, times) → (part, keys, times): counts by hash, packed per receiving task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "chunk", DICTIONARY_BYTES):
            grams = _Grams(rows, texts)
            for k in sizes:
                _, key, times = grams.counted(k, known, k - 1)
                part = (key % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                full = np.flatnonzero(np.diff(ends))
                packed = [[x[order[ends[i] : ends[i + 1]]].tobytes() for i in full] for x in (key, times)]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(x, pa.binary()) for x in packed]], names=["part", "keys", "times"])

    return run


def _frequent(least: int):
    """Arrow batches (part, keys, times) of one task → keys whose times add up to ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for k, t in zip(batch.column(1), batch.column(2), strict=True):
                keys.append(np.frombuffer(k.as_buffer(), np.uint64))
                times.append(np.frombuffer(t.as_buffer(), np.int64))
        key, group = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, group, np.concatenate(times))
        yield pa.RecordBatch.from_arrays([pa.array(key[total >= least].view(np.int64))], names=["key"])

    return run


def _phrases(known: np.ndarray):
    """Arrow batches (lang, chunk, own, times) → (lang, phrase, k, a) of the phrases whose key is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "chunk", DICTIONARY_BYTES):
            grams = _Grams(rows, texts)
            for k in range(1, LONGEST + 1):
                at, _, times = grams.counted(k, known, k)
                if len(at):
                    phrase = _joined(grams.raw, grams.starts, grams.ends, at, k)
                    lang = grams.langs.dictionary.take(pa.array(grams.lang[grams.chunk[at]]))
                    yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(at), k, np.int32)), pa.array(times)], names=["lang", "phrase", "k", "a"])

    return run


def _salt(lang: str) -> int:
    """A number for a language that is not the hash of any of its words."""
    data = np.frombuffer(b"lang:" + lang.encode(), np.uint8)
    return int(mix(hash_runs(data, np.zeros(1, np.int64), np.array([len(data)])))[0])


def _joined(raw, starts, ends, at, k: int) -> pa.Array:
    """The ``k`` words from each place on, with one blank between them."""
    words = [_gather(raw, starts[at + j], ends[at + j] - starts[at + j]) for j in range(k)]
    return (words[0] if k == 1 else pa.compute.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))).cast(pa.string())


def chunks(docs: DataFrame) -> DataFrame:
    """The dictionary of the parse: (lang, chunk, own, times), one row per distinct chunk of a language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    parsed = texts.mapInArrow(_parse, "lang string, chunk string, own int, times long")
    return parsed.groupBy("lang", "chunk", "own").agg(F.sum("times").alias("times"))


def phrase_counts(dictionary: DataFrame, least: int = LEAST) -> DataFrame:
    """Words and phrases of up to ``LONGEST`` words that occur ``least`` times: lang, phrase, k, a.

    A phrase occurs no more often than its parts. So words and pairs are first counted by hash, then longer phrases whose pairs may
    be frequent; what may be frequent is held in a filter of fixed size, which may let more pass but never less. Only those are then
    counted by their text, which decides.
    """
    spark = dictionary.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (dictionary.agg(F.sum("own")).first()[0] or 0) // WORDS_PER_TASK)
    known = None
    for sizes in ((1, 2), *[(k,) for k in range(3, LONGEST + 1)]):
        packed = dictionary.mapInArrow(_hashed(sizes, known, parts), "part int, keys binary, times binary").repartitionById(parts, "part")
        keys = packed.mapInArrow(_frequent(least), "key long")
        found = bit_filter(keys, "key", FILTER_BITS)
        known = found if known is None else known | found
    rows = dictionary.mapInArrow(_phrases(known), "lang string, phrase string, k int, a long")
    return cut(rows.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= least), light=True)


def _exact(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    small = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(small(a) * small(a)) * F.lit(SCALE).cast("decimal(7,0)"), wide(small(left) * small(right)))


def collocations(docs: DataFrame, least: int = LEAST, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """The phrases of 2 and 3 words whose words go together most, per language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. ``a`` counts a phrase
    within pieces, overlaps included, ``n`` all words of the language. A phrase that occurs ``least`` times is cut in two where
    floor(10^6 a a / (l r)) is least (ties: the shorter first part); l and r count the two parts. Phrases inside a longer one that
    has at least ``contained`` percent of their count go. The first ``top`` by score, a (descending) and phrase.

    Null and empty texts have no words, a null lang is ``und``, equal rows count each. A language without such phrases has no rows,
    as has an empty table. Other columns are ignored.
    """
    dictionary = cut(chunks(docs), codec="zstd")
    total = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    counts = phrase_counts(dictionary, least)
    phrases = counts.where("k > 1")
    part = lambda name: counts.where(F.col("k") < LONGEST).select("lang", F.col("phrase").alias(f"{name}_part"), F.col("a").alias(name))
    tokens = F.split("phrase", " ")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"l_part": F.array_join(F.slice(tokens, 1, F.col("cut")), " "), "r_part": F.array_join(F.slice(tokens, F.col("cut") + 1, F.col("k")), " ")})
    cuts = cuts.join(part("l"), ["lang", "l_part"]).join(part("r"), ["lang", "r_part"]).withColumn("score", _exact(F.col("a"), F.col("l"), F.col("r")).cast("long"))
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "k", "a", "best.*")
    wider = phrases.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    wider = wider.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inner = wider.select("lang", F.array_join(F.slice(tokens, F.col("from"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
