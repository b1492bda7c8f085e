"""N-gram Jaccard join: size-banded tiles, bitmap signatures that bound the overlap, exact intersections last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import FILTER_BITS, bit_filter, connected, cut, in_filter, slices, text_key
from tidemark.llm.words import BLANK, gram_hashes, hashed_words, mix

GRAM = 5
PERCENT = 75
#: documents (chosen by hash) whose shingles are counted to find frequent ones; only the order of prefixes depends on it
SAMPLE = 20_000
#: a shingle in so many different sampled texts is frequent
FREQUENT = 2
#: pairs of two components that a tile hands on for verification; if they stay apart, all their pairs are intersected in the tile
NEAREST = 1
#: rows of a tile side
TILE = 2_000
_TILE = ("shingle", "band", "tile")
_U = np.uint64


def shingle_sets(texts: pa.Array, gram: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``gram`` are one shingle."""
    words, offsets = hashed_words(texts, BLANK)
    grams = gram_hashes(words, gram)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= gram:
            out.append(np.unique(grams[a : b - gram + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], int(b - a), salt=7))
        else:
            out.append(np.zeros(0, _U))
    return out


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles per hash cell, four to eight cells per shingle, as a power of two of 64-bit words.

    Two sets differ in at least as many shingles as their parities differ in cells: that bounds the overlap from above. A bitmap folds
    to a shorter one by exclusive or of its halves.
    """
    words = 1
    while words * 64 < 4 * len(shingles):
        words *= 2
    cells = mix(shingles ^ _U(0x5851F42D4C957F2D)) & _U(64 * words - 1)
    flips = np.bincount(cells.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _counted(gram: int):
    """Shingles of the rows of this task with the number of texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=8_000_000):
            found = [s for s in shingle_sets(part.texts, gram) if len(s)]
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["shingle", "n"])

    return run


def _signatures(gram: int, percent: int, frequent: np.ndarray):
    """Per document: size and two sums that stand for the set, bitmap, prefix.

    The prefix are the first members in the order (frequent last, then by hash). Two sets with Jaccard >= t overlap in at
    least ceil(t·n) members of either, so their first n - ceil(t·n) + 1 members in any common order have one in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = shingle_sets(part.texts, gram)
            # sums of scrambled members: equal for equal sets, in any order
            high = np.array([mix(s).sum(dtype=_U) for s in found], dtype=_U).view(np.int64)
            low = np.array([mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U) for s in found], dtype=_U).view(np.int64)
            keys = []
            for s in found:
                take = len(s) + 1 - -(-percent * len(s) // 100) if len(s) else 0
                hot = in_filter(frequent, s.view(np.int64))
                s = np.concatenate([s[~hot], s[hot]])
                keys.append(s[:take].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.rows.select(["doc_id", "__text"]).columns,
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array(high),
                    pa.array(low),
                    pa.array([bitmap(s) for s in found], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "__text", "n", "high", "low", "bits", "prefix"],
            )

    return run


def _bounded(percent: int):
    """Keep the pairs whose bitmaps allow the wanted overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ba, bb = (batch.column(i) for i in range(6))
            keep = []
            for x, y, p, q in zip(na.to_numpy(), nb.to_numpy(), ba.to_pylist(), bb.to_pylist(), strict=True):
                u, v = np.frombuffer(p, _U), np.frombuffer(q, _U)
                words = min(len(u), len(v))
                differ = int(np.bitwise_count(fold(u, words) ^ fold(v, words)).sum())
                keep.append(200 * x + 200 * y - 200 * differ >= 2 * percent * (x + y + differ))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _chosen_sets(gram: int, chosen: np.ndarray | None):
    """rid and sorted shingles of the rows whose id is in the bit filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if chosen is not None:
                batch = batch.filter(pa.array(in_filter(chosen, batch.column(0).to_numpy(zero_copy_only=False))))
            for part in slices([batch]):
                found = [s.view(np.int64) for s in shingle_sets(part.texts, gram)]
                yield pa.RecordBatch.from_arrays([part.rows.column(0), part.rows.column(1), pa.array(found, pa.list_(pa.int64()))], names=["rid", "__text", "shingles"])

    return run


def _exact(percent: int):
    """Keep the pairs whose sorted arrays intersect enough: 100·|A∩B| >= percent·|A∪B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                u, v = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = np.concatenate([u, v])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


class _Pairs:
    """Pairs that the bitmaps allow, per tile and pair of components at most ``most``, nearest bounds first."""

    def __init__(self, most: int):
        self.most, self.parts, self.rows = most, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])
        if self.rows > 500_000:
            self.trim()

    def trim(self) -> None:
        if not self.parts:
            return
        tile, ca, cb, differ, a, b, more = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((differ, cb, ca, tile))
        tile, ca, cb, differ, a, b, more = (c[order] for c in (tile, ca, cb, differ, a, b, more))
        new = np.ones(len(tile), bool)
        new[1:] = (np.diff(tile) != 0) | (np.diff(ca) != 0) | (np.diff(cb) != 0)
        group = np.cumsum(new) - 1
        place = np.arange(len(tile)) - np.flatnonzero(new)[group]
        held = (np.bincount(group) > self.most) | (np.bincount(group, more) > 0)
        keep = place < self.most
        self.parts = [(tile[keep], ca[keep], cb[keep], differ[keep], a[keep], b[keep], held[group][keep])]
        self.rows = int(keep.sum())

    def batch(self, shingles: np.ndarray) -> pa.RecordBatch | None:
        self.trim()
        if not self.rows:
            return None
        tile, ca, cb, _, a, b, more = self.parts[0]
        columns = [shingles[tile], np.minimum(a, b), np.maximum(a, b), ca, cb]
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in columns], pa.array(more)], names=["shingle", "a", "b", "ca", "cb", "more"])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit words of all bitmaps, first word and number of words of each)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(_U)
    return flat, (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8


def _differences(flat: np.ndarray, first: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cells in which the bitmaps of rows i and j differ, the wider one folded."""
    out = np.zeros(len(i), np.int64)
    low, high = np.minimum(width[i], width[j]), np.maximum(width[i], width[j])
    for w, v in np.unique(np.stack([low, high]), axis=1).T.tolist():
        at = np.flatnonzero((low == w) & (high == v))
        for k in range(0, len(at), max(1, 4_000_000 // v)):
            part = at[k : k + max(1, 4_000_000 // v)]
            bits = []
            for rows in (i[part], j[part]):
                own = width[rows]
                cells = flat[first[rows][:, None] + np.arange(w)]
                for step in range(w, v, w):  # fold: further stretches of the wider bitmap
                    wide = np.flatnonzero(own > step)
                    cells[wide] ^= flat[first[rows[wide]][:, None] + step + np.arange(w)]
                bits.append(cells)
            out[part] = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1)
    return out


def _tiles(percent: int, most: int):
    """Pairs of different components that a tile's bitmaps allow; input sorted by tile, then by size.

    Rows are compared with the rows 1, 2, 3 … places behind them in their tile, all tiles of a batch at once, as long as the sizes fit.
    Per tile and pair of components at most ``most`` pairs, nearest bounds first, and whether more were held back.
    """
    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        n, rid, comp, side, guest = (rows.column(k).to_numpy() for k in ("n", "rid", "component", "side", "guest"))
        keys = [rows.column(k).to_numpy() for k in _TILE]
        tile = np.concatenate([[0], np.cumsum(sum(np.diff(k) != 0 for k in keys) > 0)])
        flat, first, width = _words(rows.column("bits").combine_chunks() if rows.column("bits").num_chunks != 1 else rows.column("bits").chunk(0))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(tile) != 0]))
        pairs, live, d = _Pairs(most), np.arange(len(n)), 0
        while True:
            d += 1
            live = live[live + d < len(n)]
            live = live[(tile[live] == tile[np.minimum(live + d, len(n) - 1)])]
            live = live[n[live + d] * percent <= 100 * n[live]]
            if not len(live):
                break
            j = live + d
            can = (comp[live] != comp[j]) & ((side[live] != side[j]) | (side[live] < 0)) & ~(guest[live] & guest[j])
            i, j = live[can], j[can]
            if len(i):
                differ = _differences(flat, first, width, i, j)
                ok = 200 * (n[i] + n[j] - differ) >= 2 * percent * (n[i] + n[j] + differ)
                i, j, differ = i[ok], j[ok], differ[ok]
                pairs.add(tile[i], np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j]), differ, rid[i], rid[j], np.zeros(len(i), bool))
        return pairs.batch(keys[0][starts])

    return lambda batches: _by_tile(batches, compare)


def _by_tile(batches: Iterator[pa.RecordBatch], compare, alone: bool = False) -> Iterator[pa.RecordBatch]:
    """Call ``compare`` with complete tiles of a stream sorted by tile: many at a time, or each ``alone``."""
    held: list[pa.RecordBatch] = []  # ends with the tile that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in _TILE]
        change = (np.flatnonzero(sum(np.diff(k) != 0 for k in keys)) + 1).tolist()
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(last.column(last.schema.get_field_index(k))[0].as_py() != v[0] for k, v in zip(_TILE, keys, strict=True)):
                change = [0, *change]
        start = 0
        for stop in change if alone else change[-1:]:
            if stop > start:
                held.append(batch.slice(start, stop - start))
            if (found := compare(pa.Table.from_batches(held))) is not None:
                yield found
            held, start = [], stop
        held.append(batch.slice(start))
    if held and (found := compare(pa.Table.from_batches(held))) is not None:
        yield found


def _spanning(percent: int, block: int = 8192):
    """Links between different components of a tile, found by exact intersections, no more than it takes to join them up.

    Shingles that only one row of the tile has cannot be shared and are left out; the others are bits of a row, a block of them at a time.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        n, rid, comp, side, guest = (rows.column(k).to_numpy() for k in ("n", "rid", "component", "side", "guest"))
        if len(n) < 2 or comp.min() == comp.max():
            return None
        lists = rows.column("shingles").combine_chunks() if rows.column("shingles").num_chunks != 1 else rows.column("shingles").chunk(0)
        values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
        _, code, count = np.unique(values, return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        keep = count[code] > 1
        code, owner = place[code[keep]], owner[keep]
        common = np.zeros((len(n), len(n)), np.int32)
        for lo in range(0, int(place[-1]) + 1, block):
            here = (code >= lo) & (code < lo + block)
            dense = np.zeros((len(n), block), bool)
            dense[owner[here], code[here] - lo] = True
            bits = np.packbits(dense, axis=1).view(_U)
            for i in range(len(n) - 1):
                common[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int32)
        i, j = np.nonzero(np.triu(100 * common.astype(np.int64) >= percent * (n[:, None] + n[None, :] - common), 1) & (comp[:, None] != comp[None, :]))
        fine = ((side[i] != side[j]) | (side[i] < 0)) & ~(guest[i] & guest[j])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for u, v in zip(i[fine].tolist(), j[fine].tolist(), strict=True):
            x, y = find(int(comp[u])), find(int(comp[v]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(comp[u]), int(comp[v])))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return lambda batches: _by_tile(batches, compare, alone=True)


def near_duplicates(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    1. Equal shingle sets are one representative (the smallest doc_id of the class).
    2. Each representative emits its prefix shingles. A tile is a prefix shingle and a band of set sizes: sizes that may link lie in
       one band or two neighbouring ones. The prefix order puts shingles last that are frequent in a bounded sample of documents.
       That only makes tiles small; any order finds all links.
    3. Neighbours by size in a tile are checked first: bitmaps bound their overlap, then the sorted arrays are intersected. Groups of near copies
       become components here, at a cost linear in their rows.
    4. What is left of a tile are pairs of different components. Their bitmaps are compared inside tiles of bounded size (large ones
       are banded and salted); for two components the nearest few pairs of a tile are verified. Where a tile held pairs back and the
       components are still apart, their rows meet in that tile once more with their whole sets, and every pair is intersected. So
       no link between components is lost.

    Null and blank texts have empty sets and link to nothing. Repeated rows are copies. A null doc_id is never a link; it gets
    a null component. Texts that share an id link apart from each other. Other columns are ignored. An empty table gives no rows.
    """
    return _near_duplicates(docs, gram, percent, sample).drop("__text", "first")


def _near_duplicates(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, sample: int = SAMPLE) -> DataFrame:
    """``near_duplicates`` with the ``text_key`` of each row as __text, and whether the row is the one its component is named after."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("__text"), "text")
    chance = min(1.0, sample / max(1, docs.count()))
    picked = keyed.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.lit(int(chance * 1_000_000)))
    seen = picked.dropDuplicates(["__text"]).select("text").mapInArrow(_counted(gram), "shingle bigint, n bigint")
    common = cut(seen.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).select("shingle"))
    # membership in a filter of fixed size depends on the shingle alone, so it gives one order for all documents
    shared = spark.sparkContext.broadcast(bit_filter(common, "shingle", FILTER_BITS))

    def signatures(batches):
        yield from _signatures(gram, percent, shared.value)(batches)

    schema = "doc_id bigint, __text bigint, n bigint, high bigint, low bigint, bits binary, prefix array<bigint>"
    sets = cut(keyed.mapInArrow(signatures, schema))
    full = sets.where("n > 0 and doc_id is not null").select("doc_id", "__text", "n", "high", "low")
    classes = full.groupBy("n", "high", "low").agg(F.min(F.struct("doc_id", "__text")).alias("head"))
    # a number per id and text: one id may head several classes
    rid = F.xxhash64("doc_id", "__text")
    classes = cut(classes.select("n", "high", "low", F.xxhash64("head.doc_id", "head.__text").alias("rid"), F.col("head.doc_id").alias("head_id"), F.col("head.__text").alias("__text")))
    heads = classes.select("rid", "__text")
    signed = sets.where("doc_id is not null").withColumn("rid", rid).join(heads, ["rid", "__text"], "left_semi")
    rows = signed.select("rid", "n", F.explode("prefix").alias("shingle"))
    signed = cut(signed.select("rid", "n", "bits").dropDuplicates(["rid"]))
    tile = Window.partitionBy("shingle").orderBy("n", "rid")
    before, after = (lambda c: F.lag(c).over(tile)), (lambda c: F.lead(c).over(tile))
    head = lambda c: F.first(c).over(tile)
    near = rows.select(
        "shingle", "rid", "n", before("rid").alias("p"), before("n").alias("pn"), after("rid").alias("q"), after("n").alias("qn"), head("rid").alias("h"), head("n").alias("hn")
    )
    # without a neighbour of a fitting size a row has no partner in its tile; an equal neighbour is a repeated row
    fits_p = F.col("p").isNotNull() & (F.col("pn") * 100 >= F.col("n") * percent) & (F.col("p") != F.col("rid"))
    fits_q = F.col("q").isNotNull() & (F.col("n") * 100 >= F.col("qn") * percent) & (F.col("q") != F.col("rid"))
    fits_h = (F.col("hn") * 100 >= F.col("n") * percent) & (F.col("h") != F.col("rid"))
    near = near.where(F.coalesce(fits_p, F.lit(False)) | F.coalesce(fits_q, F.lit(False)))
    # the first row of a tile is the partner where its size fits: links then form stars, which are joined up in few steps
    live = cut(near.select("shingle", "rid", "n", F.when(fits_h, F.col("h")).when(fits_p, F.col("p")).alias("p")))
    pairs = live.where("p is not null").select(F.least("p", "rid").alias("a"), F.greatest("p", "rid").alias("b")).distinct()

    def sets_of(wanted_ids: DataFrame) -> DataFrame:
        """rid and sorted shingles of some representatives, from their texts."""
        ids = cut(wanted_ids.join(heads, "rid"))
        wanted = bit_filter(ids, "rid")
        sent = spark.sparkContext.broadcast(wanted)

        def chosen(batches):
            yield from _chosen_sets(gram, sent.value)(batches)

        source = keyed.where("doc_id is not null").select(rid.alias("rid"), "__text", "text")
        if wanted is None:  # too many for a filter: the texts themselves are joined
            source = source.join(ids, ["rid", "__text"], "left_semi")
        arrays = source.mapInArrow(chosen, "rid bigint, __text bigint, shingles array<bigint>")
        return cut(arrays.join(ids, ["rid", "__text"], "left_semi").drop("__text").dropDuplicates(["rid"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link."""
        left = signed.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
        right = signed.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ba", "bb")
        maybe = cut(both.mapInArrow(_bounded(percent), "a bigint, b bigint"))
        arrays = sets_of(maybe.select(F.col("a").alias("rid")).union(maybe.select("b")).distinct())
        both = maybe.join(arrays.select(F.col("rid").alias("a"), F.col("shingles").alias("sa")), "a")
        both = both.join(arrays.select(F.col("rid").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
        return cut(both.mapInArrow(_exact(percent), "a bigint, b bigint"))

    links = verified(pairs)
    labels = connected(links)
    width = float(np.log(100 / percent))

    def dealt(labelled: DataFrame, extra: DataFrame) -> DataFrame:
        """Rows of the tiles that hold several components, with the columns of ``extra``, sorted by tile and size.

        Large tiles are banded by size (a band meets itself and the next one: every row is at home in its band and a guest in the band
        below) and salted (two salts in one tile: only pairs across them are new there).
        """
        split = labelled.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi")
        crossed = labelled.join(split.select("shingle", "rows"), "shingle")
        large = F.col("rows") > TILE
        band = F.when(large, F.floor(F.log(F.col("n").cast("double")) / F.lit(width))).otherwise(F.lit(0)).cast("int")
        bands = F.when(large, F.array(F.col("home"), F.col("home") - 1)).otherwise(F.array(F.col("home")))
        banded = crossed.withColumn("home", band).withColumn("band", F.explode(bands)).withColumn("guest", F.col("band") < F.col("home"))
        banded = banded.withColumn("salts", F.ceil(F.col("rows") / F.lit(TILE)).cast("int"))
        banded = banded.withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts").cast("long")).cast("int"))
        banded = banded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        lower, upper = F.least("salt", "other"), F.greatest("salt", "other")
        side = F.when(lower == upper, F.lit(-1)).otherwise(F.col("salt"))
        banded = banded.select("shingle", "band", (lower * 1_000_000 + upper).alias("tile"), side.alias("side"), "guest", "rid", "n", "component")
        return banded.join(extra, "rid").repartition(*_TILE).sortWithinPartitions(*_TILE, "n", "rid")

    def labelled(rows: DataFrame) -> DataFrame:
        out = rows.select("shingle", "rid", "n").join(labels.withColumnRenamed("id", "rid"), "rid", "left")
        return out.withColumn("component", F.coalesce("component", "rid"))

    def relabelled(labels: DataFrame, between: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links between components join the components up; labels follow."""
        merged = connected(between)
        moved = merged.select(F.col("id").alias("component"), F.col("component").alias("__new"))
        now = labels.join(moved, "component", "left").select("id", F.coalesce("__new", "component").alias("component"))
        return cut(now.unionByName(merged.join(labels, "id", "left_anti")), light=True), merged

    tiles = dealt(labelled(live), signed.select("rid", "bits"))
    found = cut(tiles.mapInArrow(_tiles(percent, NEAREST), "shingle bigint, a bigint, b bigint, ca bigint, cb bigint, more boolean"))
    new = verified(found.select("a", "b").distinct())
    labels, merged = relabelled(labels, found.select("a", "b", "ca", "cb").distinct().join(new, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    # components that a tile held pairs of back and that are still apart: their rows meet there again, with their whole sets
    now_a = merged.select(F.col("id").alias("ca"), F.col("component").alias("la"))
    now_b = merged.select(F.col("id").alias("cb"), F.col("component").alias("lb"))
    held = found.where("more").select("shingle", "ca", "cb").join(now_a, "ca", "left").join(now_b, "cb", "left")
    held = held.select("shingle", F.coalesce("la", "ca").alias("la"), F.coalesce("lb", "cb").alias("lb")).where("la <> lb")
    held = cut(held.select("shingle", F.explode(F.array("la", "lb")).alias("component")).distinct(), light=True)
    if held.limit(1).count():
        rows = cut(labelled(live).join(held, ["shingle", "component"], "left_semi"))
        spanning = cut(dealt(rows, sets_of(rows.select("rid").distinct())).mapInArrow(_spanning(percent), "a bigint, b bigint"), light=True)
        labels, _ = relabelled(labels, spanning)
    named = classes.join(labels.withColumnRenamed("id", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = cut(named.select("n", "high", "low", "component", F.struct(F.col("head_id").alias("doc_id"), "__text").alias("head")), light=True)
    names = named.groupBy("component").agg(F.min("head").alias("name"))
    named = named.join(names, "component").select("n", "high", "low", "name")
    out = sets.select("doc_id", "__text", "n", "high", "low").join(named, ["n", "high", "low"], "left")
    component = F.when(F.col("n") > 0, F.col("name.doc_id")).otherwise(F.col("doc_id"))
    first = (F.col("doc_id") == F.col("name.doc_id")) & (F.col("__text") == F.col("name.__text"))
    return out.select(
        "doc_id", "__text", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(first, F.lit(False)).alias("first")
    )


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id, once; documents without words stay. Same columns.

    Texts are shuffled once, by the join with the kept ids and texts. Rows that repeat an id and text are thinned out only where there are any.
    """
    near = cut(_near_duplicates(docs, **options))
    keep = near.where("doc_id is null or n_shingles = 0 or first").select(F.col("doc_id").alias("__keep"), F.col("__text").alias("__kept")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__keep")) & (text_key() == F.col("__kept"))
    kept = docs.join(keep, same, "left_semi")
    again = near.where("first").groupBy("doc_id", "__text").count().where("count > 1")
    again = cut(again.select(F.col("doc_id").alias("__again"), F.col("__text").alias("__same")), light=True)
    if not again.limit(1).count():
        return kept
    same = (F.col("doc_id").cast("long") == F.col("__again")) & (text_key() == F.col("__same"))
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(once)
