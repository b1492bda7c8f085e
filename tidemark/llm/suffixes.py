"""Repeated passages by sorted suffixes: sampled splitters deal them into buckets, which sort by multikey quicksort and compare neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, slices
from tidemark.llm.words import mix, text_bytes

_U = np.uint64
_A, _B, _C, _D = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: bytes of the passages that count
LENGTH = 400
#: suffixes that one bucket holds, and sampled ones per bucket that place the splitters
ROWS_PER_BUCKET, SAMPLED_PER_BUCKET = 300_000, 100
#: bytes that are named at a time
SEGMENT = 1 << 17
#: hash cells of texts; a table of those in use is broadcast (8 MB of numbers at most), beyond that many texts the joins behind it do the work
CELLS = 1 << 20
#: below this many suffixes the quicksort hands over to a sort of the columns
SMALL = 2_048


class Shape(NamedTuple):
    """How a length is told by names of blocks."""

    length: int
    block: int  # a power of two; a token is the name of so many bytes
    window: int  # every run of so many bytes has an anchor


def shape(length: int) -> Shape:
    """Blocks so large that two of them cover what follows an anchor, and three a passage; anchors as sparse as that allows."""
    if length < 16:
        raise ValueError("a passage has 16 bytes or more")
    block = 8
    while 3 * 2 * block <= 2 * length:
        block *= 2
    return Shape(length, block, min(length - block + 1, block, max(128, length - 2 * block + 1)))


def _names(raw: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of the 8 bytes, and name of the ``block`` bytes) that start at each byte; names are composed of two of half the size."""
    lanes = np.zeros(len(raw) + 8, np.uint8)
    lanes[: len(raw)] = raw
    grams = np.ascontiguousarray(np.lib.stride_tricks.as_strided(lanes, (len(raw), 8), (1, 1))).view(_U).ravel()
    name = grams = mix(grams * _A + _U(1))
    size = 8
    while size < block:
        both = name * _B
        if len(name) > size:
            both[:-size] ^= name[size:] * _C
        both ^= both >> _U(29)
        both *= _D
        both ^= both >> _U(32)
        name, size = both, size * 2
    return grams, name


def _pair(a: np.ndarray, b: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    return mix(a * _A + b * _C + np.asarray(salt, dtype=_U))


def _least(key: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every run of ``window`` values, told at its first; the last runs are short."""
    size = 1
    while size < window:
        step = min(size, window - size)
        wider = key.copy()
        np.minimum(key[:-step], key[step:], out=wider[:-step])
        key, size = wider, size + step
    return key


def _chunks(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes with those that follow, text of each byte, its place in the text, whether a passage starts there), ``SEGMENT`` bytes at a time."""
    raw, offsets = text_bytes(texts)
    for first in range(0, len(raw), SEGMENT):
        last = min(first + SEGMENT, len(raw))
        at = np.arange(first, last)
        text = np.searchsorted(offsets, at, side="right") - 1
        yield raw[first : last + length + 8], text, at - offsets[text], at + length <= offsets[text + 1]


def _anchored(form: Shape):
    """Arrow batches (rid, text) → sampled suffixes (core, wide, rid, low, high).

    The anchor of a passage is the first of the least 8-byte hashes in its first ``window`` places, so equal passages have it at the
    same place. One row tells of all passages in a row, from place ``low`` to ``high``, with the same anchor. ``core`` names the bytes
    behind the anchor that all passages with this anchor hold, ``wide`` all bytes of the row's passages.
    """
    length, block, window = form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            rid = rows.column(rows.schema.get_field_index("rid")).to_numpy()
            for raw, text, place, starts in _chunks(texts, length):
                p = np.flatnonzero(starts)
                if not len(p):
                    continue
                grams, name = _names(raw, block)
                key = (grams & ~_U(0xFFFFFFFF)) | np.arange(len(raw), dtype=_U)
                anchor = (_least(key, window)[p] & _U(0xFFFFFFFF)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1) | (text[p[1:]] != text[p[:-1]])])
                low, high, a = p[first], p[np.r_[first[1:] - 1, len(p) - 1]], anchor[first]
                core = _pair(name[a], name[a + length - window + 1 - block])
                wide = _pair(name[low], name[high + length - block], (high - low) * 65_536 + a - low)
                yield _suffixes(core, wide, rid[text[low]], place[low], place[high])

    return run


def _windows(form: Shape):
    """Arrow batches (rid, text, open) → one suffix per passage that starts in the open places (low, high)."""
    length, block, _ = form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            rid = rows.column(rows.schema.get_field_index("rid")).to_numpy()
            spans = rows.column(rows.schema.get_field_index("open"))
            owner = np.repeat(np.arange(len(rid)), np.diff(spans.offsets.to_numpy()))
            pairs = spans.flatten()
            low, high = (pairs.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            _, offsets = text_bytes(texts)
            edge = np.zeros(offsets[-1] + 1, np.int32)
            np.add.at(edge, offsets[owner] + low, 1)
            np.add.at(edge, offsets[owner] + high + 1, -1)
            wanted = np.cumsum(edge) > 0
            done = 0
            for raw, text, place, starts in _chunks(texts, length):
                p = np.flatnonzero(starts & wanted[done : done + len(text)])
                done += len(text)
                if len(p):
                    _, name = _names(raw, block)
                    tail = _pair(name[p + length - block], name[p + (length - block) // 2])
                    yield _suffixes(name[p], tail, rid[text[p]], place[p], place[p])

    return run


_SUFFIX = "core long, wide long, rid long, low int, high int"


def _suffixes(core, wide, rid, low, high) -> pa.RecordBatch:
    arrays = [core.view(np.int64), wide.view(np.int64), rid, low.astype(np.int32), high.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["core", "wide", "rid", "low", "high"])


def multikey_sort(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes by their tokens: three-way quicksort on one token, whose equals go on with the next token."""
    out, todo = [], [(np.arange(len(tokens[0])), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= SMALL or depth == len(tokens) - 1:
            out.append(rows[np.lexsort([t[rows] for t in reversed(tokens[depth:])])])
            continue
        values = tokens[depth][rows]
        pivot = np.sort(values[:: max(1, len(values) // 255)])[len(values[:: max(1, len(values) // 255)]) // 2]
        below, same = values < pivot, values == pivot
        todo += [(rows[~(below | same)], depth), (rows[same], depth + 1), (rows[below], depth)]  # the last is taken first
    return np.concatenate(out)


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's run, size of its run) from the places where a run starts."""
    run = np.cumsum(breaks) - 1
    return run, np.bincount(run)[run]


_VERDICT = "rid long, low int, high int, whole boolean, open boolean, core long, wide long, n long, n_core long"


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort a bucket and compare neighbours: ``whole`` where both tokens repeat, ``open`` where their passages have to be looked at one by one.

    Those are the rows whose core only repeats, and one row for each wide token beside them. The first and the last run of
    a bucket may go on in the next: they also come as rows with core, wide and their numbers, to be compared across buckets.
    """
    got = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], schema=_ARROW)])
    if not got.num_rows:
        return
    core, wide, rid, low, high = (got.column(c).to_numpy() for c in ("core", "wide", "rid", "low", "high"))
    order = multikey_sort([core, wide])
    core, wide, rid, low, high = core[order], wide[order], rid[order], low[order], high[order]
    new_core = np.r_[True, core[1:] != core[:-1]]
    new_wide = new_core | np.r_[True, wide[1:] != wide[:-1]]
    run, n = _runs(new_wide)
    kin, n_core = _runs(new_core)
    whole = n > 1
    mixed = n_core > n  # other wide tokens have the same core
    at_edge = (kin == 0) | (kin == kin[-1])
    opens = new_wide & (mixed | (at_edge & whole))
    edge = np.zeros(len(core), bool)
    edge[0] = True
    edge[np.flatnonzero(run == run[-1])[0]] = True
    pending = edge & ~whole
    keep = np.flatnonzero((whole | opens) & ~pending)
    null = [pa.nulls(len(keep), pa.int64())] * 4
    yield _verdicts(rid[keep], low[keep], high[keep], whole[keep], opens[keep], null)
    e = np.flatnonzero(edge)
    yield _verdicts(rid[e], low[e], high[e], whole[e], opens[e], [pa.array(x[e].astype(np.int64)) for x in (core, wide, n, n_core)])


_ARROW = pa.schema([("core", pa.int64()), ("wide", pa.int64()), ("rid", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _verdicts(rid, low, high, whole, opens, rest) -> pa.RecordBatch:
    arrays = [pa.array(rid), pa.array(low), pa.array(high), pa.array(whole), pa.array(opens), *rest]
    return pa.RecordBatch.from_arrays(arrays, names=["rid", "low", "high", "whole", "open", "core", "wide", "n", "n_core"])


def _dealt(splitters: list[tuple]):
    """Number each suffix's bucket among the sorted splitters (core, wide, rid, low); equal tokens are parted by place."""
    order = np.array(splitters, dtype=[("core", "<i8"), ("wide", "<i8"), ("rid", "<i8"), ("low", "<i8")]).reshape(-1)
    cores = np.ascontiguousarray(order["core"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = batch.column(0).to_numpy()
            bucket, behind = np.searchsorted(cores, core, "left"), np.searchsorted(cores, core, "right")
            hot = np.flatnonzero(behind > bucket)
            if len(hot):
                rows = np.empty(len(hot), order.dtype)
                for i, c in enumerate(order.dtype.names):
                    rows[c] = batch.column(i).to_numpy()[hot]
                bucket[hot] = np.searchsorted(order, rows, "right")
            yield batch.append_column("bucket", pa.array(bucket.astype(np.int32)))

    return run


def repeated(suffixes, rows: int) -> DataFrame:
    """Verdicts (rid, low, high, whole, open) on suffixes, sorted over all buckets.

    ``suffixes(share)`` gives them for that share of the texts; about ``rows`` for all. The splitters come from a sample of
    ``SAMPLED_PER_BUCKET`` per bucket. The total order is (core, wide, rid, low), so that equal suffixes fill as many buckets as they need.
    """
    spark = (whole := suffixes(1.0)).sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BUCKET))
    share = min(1.0, 2 * SAMPLED_PER_BUCKET * parts / max(1, rows))
    sample = suffixes(share).withColumn("key", F.xxhash64("rid", "low")).orderBy("key", "rid", "low").limit(SAMPLED_PER_BUCKET * parts)
    taken = sorted((r.core, r.wide, r.rid, r.low) for r in sample.select("core", "wide", "rid", "low").toLocalIterator())
    splitters = [taken[i * len(taken) // parts] for i in range(1, parts)] if taken else []
    buckets = whole.mapInArrow(_dealt(splitters), f"{_SUFFIX}, bucket int").repartitionById(parts, "bucket")
    found = cut(buckets.drop("bucket").mapInArrow(_bucket, _VERDICT))
    edges = found.where("core IS NOT NULL")  # two per bucket at most
    edges = edges.withColumn("same", F.sum("n").over(Window.partitionBy("core", "wide"))).withColumn("near", F.count(F.lit(1)).over(Window.partitionBy("core")))
    edges = edges.where("n = 1").withColumn("whole", F.col("same") > 1).withColumn("open", F.expr("whole OR near > 1 OR n_core > 1"))
    columns = ["rid", "low", "high", "whole", "open"]
    return found.where("core IS NULL").select(*columns).unionByName(edges.where("open").select(*columns))


def _cut_out(length: int):
    """Arrow batches (doc_id, text, spans of places where a repeated passage starts) → doc_id, n_bytes, spans removed, kept."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            raw, offsets = text_bytes(texts)
            found = rows.column(rows.schema.get_field_index("spans"))
            spans, kept = [], []
            for i, pairs in enumerate(found):
                own = raw[offsets[i] : offsets[i + 1]]
                if not pairs.is_valid or not len(pairs.values):
                    spans.append([])
                    kept.append(own.tobytes())
                    continue
                low, high = (np.asarray(pairs.values.field(k), dtype=np.int64) for k in (0, 1))
                edge = np.zeros(len(own) + 1, np.int32)
                np.add.at(edge, low, 1)
                np.add.at(edge, high + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                ends = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                spans.append([{"start": int(a), "end": int(b)} for a, b in ends])
                kept.append(own[~gone].tobytes())
            n_bytes = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([rows.column(0), n_bytes, pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def _maybe_in(texts: DataFrame, rids: DataFrame, how: str) -> DataFrame:
    """Texts whose cell holds one of the ids (``left_semi``), or none (``left_anti``), without a shuffle of texts."""
    cell = F.pmod(F.xxhash64("rid", F.lit("cell")), F.lit(CELLS))
    cells = rids.select(cell.alias("cell")).distinct()
    return texts.withColumn("cell", cell).join(F.broadcast(cells), "cell", how).drop("cell")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts at another place of any text.

    One row per row of ``docs``: doc_id, n_bytes, ``spans`` (start, end: the maximal runs of bytes removed) and ``kept`` (the bytes left, as
    binary: a run may end inside a character). Texts are judged as they came, so all occurrences go, overlapping ones included.

    Suffixes are sampled at anchors that the passages themselves determine: one row per about ``window / 2`` bytes. Buckets of the
    sorted suffixes tell which rows repeat as a whole, which are unique, and which repeat in part (where a repeated stretch begins
    or ends); only the passages of the last kind are sorted one by one, in the same way. Names of blocks are 64-bit hashes, two of which decide.

    Null texts are empty. Texts under ``length`` bytes are kept whole. Equal rows count as copies of each other. An empty table gives no rows;
    other columns are ignored. A task holds one text's bytes, and work arrays for ``SEGMENT`` of them.
    """
    form = shape(length)
    texts = cut(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")), codec="zstd")
    long = texts.where(F.octet_length("text") >= length).select("rid", "text")
    some = lambda df, share: df if share >= 1 else df.where(F.pmod(F.xxhash64("rid", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    total = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchored = lambda share: some(long, share).mapInArrow(_anchored(form), _SUFFIX)
    by_anchor = cut(repeated(anchored, 2 * total // form.window))
    pair = F.struct("low", "high")
    left = by_anchor.where("open").groupBy("rid").agg(F.collect_list(pair).alias("open"))  # at most one per byte of the text
    n_open = by_anchor.where("open").agg(F.sum(F.col("high") - F.col("low") + 1)).first()[0] or 0
    near = _maybe_in(long, by_anchor.where("open"), "left_semi")
    single = lambda share: some(near, share).join(some(left, share), "rid").mapInArrow(_windows(form), _SUFFIX)
    by_place = repeated(single, n_open)
    gone = by_anchor.where("whole").select("rid", "low", "high").unionByName(by_place.where("whole").select("rid", "low", "high"))
    spans = gone.groupBy("rid").agg(F.collect_list(pair).alias("spans"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start: int, end: int>>, kept binary"
    none = F.lit(None).cast("array<struct<low: int, high: int>>").alias("spans")
    found = cut(gone.select("rid").distinct(), light=True)
    hit = _maybe_in(texts, found, "left_semi").join(spans, "rid", "left").select("doc_id", "text", "spans")
    rest = _maybe_in(texts, found, "left_anti").select("doc_id", "text", none)
    return hit.unionByName(rest).mapInArrow(_cut_out(length), schema)
