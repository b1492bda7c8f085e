"""Benchmark decontamination by winnowing: shared fingerprints first, then the exact windows around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FILTER_BITS, bit_filter, cut, in_filter, null_safe, slices, text_key, without
from tidemark.llm.words import ALNUM, gram_hashes, hashed_words

WINDOW = 10
GRAM = 4
_HIT = pa.struct([("fingerprint", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("windows", pa.list_(pa.int64()))])
_HIT_SQL = "struct<fingerprint:bigint,at:int,words:int,windows:array<bigint>>"


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """For every window of ``span`` consecutive k-grams the position of its smallest hash, the last of equal ones."""
    n = len(grams) - span + 1
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        other = grams[j : j + n]
        less = other <= best
        best = np.where(less, other, best)
        at = np.where(less, np.arange(j, j + n), at)
    return at


def _runs(words: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, window hash, window start) for every window of ``width`` words."""
    windows = gram_hashes(words, width, salt=1)
    k = min(gram, width)
    grams = gram_hashes(words, k, salt=width)
    at = winnow(grams, width - k + 1) if len(windows) else np.zeros(0, np.int64)
    return grams[at], windows, at


def _item_windows(width: int, gram: int):
    """Distinct windows of the benchmark: item_id, fingerprint, window, words. An item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, offsets = hashed_words(part.texts, ALNUM)
            ids = part.rows.column(part.rows.schema.get_field_index("item_id"))
            for i in range(len(ids)):
                own = words[offsets[i] : offsets[i + 1]]
                if not len(own):
                    continue
                size = min(width, len(own))
                prints, windows, _ = _runs(own, size, gram)
                windows, first = np.unique(windows, return_index=True)
                n = len(windows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i].as_py()] * n, pa.string()), pa.array(prints[first].view(np.int64)), pa.array(windows.view(np.int64)), pa.array(np.full(n, size, np.int32))],
                    names=["item_id", "fingerprint", "window", "words"],
                )

    return run


def _candidates(width: int, gram: int, sizes: list[int], bits: np.ndarray):
    """Per document its word count and the runs of windows whose fingerprint is in the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, offsets = hashed_words(part.texts, ALNUM)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            found: list[tuple[int, dict]] = []
            for size in sizes:
                if len(words) < size:
                    continue
                prints, windows, at = _runs(words, size, gram)
                whole = owner[: len(windows)] == owner[size - 1 :]
                maybe = np.flatnonzero(in_filter(bits, prints.view(np.int64)) & whole)
                if not len(maybe):
                    continue
                # consecutive windows with one fingerprint at one place are one run
                new = np.ones(len(maybe), bool)
                new[1:] = (np.diff(maybe) != 1) | (at[maybe[1:]] != at[maybe[:-1]]) | (owner[maybe[1:]] != owner[maybe[:-1]])
                bounds = [*np.flatnonzero(new), len(maybe)]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    doc = int(owner[maybe[a]])
                    run_windows = windows[maybe[a:b]].view(np.int64)
                    found.append((doc, {"fingerprint": int(prints[maybe[a]].view(np.int64)), "at": int(maybe[a] - offsets[doc]), "words": size, "windows": run_windows}))
            lists: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
            for doc, hit in found:
                lists[doc].append(hit)
            keep = part.rows.select(["doc_id", "__text"])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(np.diff(offsets), pa.int64()), pa.array(lists, pa.list_(_HIT))], names=["doc_id", "__text", "n_words", "hits"]
            )

    return run


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A window is ``window``
    consecutive words of an item, or a shorter item as a whole. Of the k-grams in a window the one with the smallest hash is its
    fingerprint, on both sides, so every shared window shares a fingerprint at the same place in it. Document fingerprints
    pass a bit filter of fixed size, join the benchmark's, and the windows around a match join the benchmark's windows.
    Matching windows are merged to ``spans`` (first word, one past the last).

    Null and empty texts have no words. Null item ids count as items named by the empty string. Repeated rows give repeated rows; equal items
    with different ids count apart. With an empty benchmark nothing is hit. Other columns are ignored.
    """
    return _overlap(docs, benchmark, window, gram).drop("__text")


def _overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``overlap`` with the ``text_key`` of each row as __text."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    known = cut(items.mapInArrow(_item_windows(window, gram), "item_id string, fingerprint bigint, window bigint, words int").distinct())
    sizes = [r["words"] for r in known.select("words").distinct().collect()]  # at most ``window`` numbers
    shared = spark.sparkContext.broadcast(bit_filter(known, "fingerprint", FILTER_BITS))

    def scan(batches):
        yield from _candidates(window, gram, sizes, shared.value)(batches)

    keyed = docs.select("doc_id", text_key().alias("__text"), "text")
    schema = f"doc_id {dict(keyed.dtypes)['doc_id']}, __text bigint, n_words bigint, hits array<{_HIT_SQL}>"
    scanned = cut(keyed.mapInArrow(scan, schema))

    prints = known.select("fingerprint", "words").distinct()
    hits = scanned.where(F.size("hits") > 0).select("doc_id", "__text", F.explode("hits").alias("h")).select("doc_id", "__text", "h.*").distinct()
    hits = hits.join(prints, ["fingerprint", "words"], "left_semi")
    extended = hits.select("doc_id", "__text", "words", "at", F.posexplode("windows").alias("step", "window"))
    # windows that occur in the same items are one class: a window shared by many items stays one row per occurrence
    classes = known.groupBy("window", "words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    classes = cut(classes.withColumn("class", F.xxhash64("items")))
    extended = extended.join(classes.select("window", "words", "class"), ["window", "words"])
    places = extended.select("doc_id", "__text", "class", (F.col("at") + F.col("step")).alias("first"), "words")
    places = cut(places)
    spans = places.groupBy("doc_id", "__text").agg(F.sort_array(F.collect_set(F.struct("first", (F.col("first") + F.col("words")).alias("end")))).alias("s"))
    merged = F.aggregate(
        "s",
        F.expr("cast(array() as array<struct<first:int,end:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["first"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["first"].alias("first"), x["end"].alias("end"))))),
    )
    spans = spans.select("doc_id", "__text", merged.alias("spans"))
    members = classes.select("class", F.explode("items").alias("item_id")).distinct()
    by_item = places.select("doc_id", "__text", "class").distinct().join(members, "class").groupBy("doc_id", "__text")
    by_item = by_item.agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = null_safe(null_safe(scanned.drop("hits"), spans, ["doc_id", "__text"]), by_item, ["doc_id", "__text"])
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["first"]), F.lit(0)).cast("long")
    found = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.select(
        "doc_id",
        "__text",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,end:int>>)")).alias("spans"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no window with the benchmark; same columns, repeated rows kept.

    Rows are judged by id and text: another text of the same id, or without an id, stays.
    """
    return without(docs, _overlap(docs, benchmark, **options).where("contaminated"))
