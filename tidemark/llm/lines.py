"""Line dedup: a deletion-neighbourhood join that keeps the earliest of lines within one edit of each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bit_filter, cut, in_filter, slices
from tidemark.llm.words import mix

#: lines of fewer characters are only compared for equality
LEAST_CHARS = 20
#: parts of a line; lines within one edit agree outside one part
PARTS = 4
_U = np.uint64
_PRIMES = (_U(2147483647), _U(2147483629))
_BASES = (_U(1103515245), _U(1664525317))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime, at least ``n`` of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        p = int(_PRIMES[which])
        both = []
        for base in (int(_BASES[which]) % p, pow(int(_BASES[which]), p - 2, p)):
            out = np.ones(1, _U)
            while len(out) < n:
                out = np.concatenate([out, out * _U(pow(base, len(out), p)) % _PRIMES[which]])
            both.append(out)
        _powers[which] = have = (both[0], both[1])
    return have


class Hashes:
    """Hashes of any stretch of a run of characters in constant time, also with one character left out."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.tables = [_power_tables(w, self.n + 2) for w in range(2)]
        self.sums = []
        for w, p in enumerate(_PRIMES):
            terms = (codes.astype(_U) * _U(40503) + _U(1)) % p * self.tables[w][0][: self.n] % p
            self.sums.append(np.concatenate([[_U(0)], np.cumsum(terms) % p]))

    def _raw(self, w: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = _PRIMES[w]
        return (self.sums[w][b] + p - self.sums[w][a]) % p * self.tables[w][1][a] % p

    @staticmethod
    def _joined(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(mix(high << _U(31) ^ low) ^ n.astype(_U))

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._joined(self._raw(0, a, b), self._raw(1, a, b), b - a)

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Hash of the stretch [a, b) without position i: equal to ``stretch`` of the shorter characters."""
        out = []
        for w, p in enumerate(_PRIMES):
            tail = self._raw(w, i + 1, b) * self.tables[w][0][i - a] % p
            out.append((self._raw(w, a, i) + tail) % p)
        return self._joined(out[0], out[1], b - a - 1)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(character codes, first and end of each line, its document, lines) of all texts."""
    split = [(t or "").split("\n") for t in texts.to_pylist()]
    flat = [x for t in split for x in t]
    owner = np.repeat(np.arange(len(split)), [len(t) for t in split])
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) for x in flat]).astype(np.int64)
    starts = ends - np.array([len(x) for x in flat], np.int64)
    return codes, starts, ends, owner, flat


def _bounds(start: np.ndarray, end: np.ndarray, shorter: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a part begins and ends in lines that are 0 or 1 longer than the line whose length counts."""
    m = end - start - shorter
    return start + m * part // PARTS, end - (m - m * (part + 1) // PARTS)


def _keys(h: Hashes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows: for lines as the shorter or equal (0) and as the longer (1) of a pair, and each part, the hash of all but the part."""
    out = []
    for shorter in (0, 1):
        for part in range(PARTS):
            lo, hi = _bounds(a, b, shorter, part)
            out.append(mix(h.stretch(a, lo) ^ mix(h.stretch(hi, b) + (b - a - shorter).astype(_U) * _U(PARTS) + _U(part))))
    return np.stack(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        codes, a, b, owner, flat = _lines(part.texts)
        h = Hashes(codes)
        hashes = h.stretch(a, b).view(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1]) if len(owner) else np.zeros(0, np.int64)
        numbers = np.arange(len(owner)) - first[owner]
        keys = _keys(h, a, b).T
        blank = np.array([not x.strip() for x in flat], bool)
        offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * keys.shape[1])
        ids = part.rows.select(["doc_id", "__text"])
        yield pa.RecordBatch.from_arrays(
            [
                *[c.take(pa.array(owner)) for c in ids.columns],
                pa.array(numbers.astype(np.int32)),
                pa.array(hashes),
                pa.array((b - a).astype(np.int32)),
                pa.array(blank),
                pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))),
            ],
            names=["doc_id", "__text", "line_no", "line", "chars", "blank", "keys"],
        )


def _variants(chosen: np.ndarray, keys_met: np.ndarray):
    """The chosen lines: text and the hashes of every deletion in the parts outside which they meet another line, by role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            codes, a, b, owner, flat = _lines(part.texts)
            h = Hashes(codes)
            hashes = h.stretch(a, b)
            pick = np.flatnonzero(in_filter(chosen, hashes.view(np.int64)) & (b - a >= LEAST_CHARS - 1))
            if not len(pick):
                continue
            _, once = np.unique(hashes[pick], return_index=True)
            pick = pick[once]
            keys = _keys(h, a[pick], b[pick])
            rows, variants = [], []
            for role in (0, 1):
                for p in range(PARTS):
                    lo, hi = _bounds(a[pick], b[pick], role, p)
                    for k in np.flatnonzero(in_filter(keys_met, keys[role * PARTS + p].view(np.int64))):
                        i = np.arange(lo[k], hi[k])
                        gone = h.without(np.full(len(i), a[pick[k]]), np.full(len(i), b[pick[k]]), i)
                        if role == 0:  # one character replaced: equal after deleting the same place; and the line as it is
                            gone = np.append(mix(gone + (i - a[pick[k]] + 1).astype(_U)), hashes[pick[k]])
                        rows.append((pick[k], int(keys[role * PARTS + p, k].view(np.int64)), role))
                        variants.append(gone.view(np.int64))
            if not rows:
                continue
            at = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[at].view(np.int64)),
                    pa.array([flat[x] for x in at]),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array(variants, pa.list_(pa.int64())),
                ],
                names=["line", "content", "key", "role", "variants"],
            )

    return run


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, line_no (from 0), line (hash), verdict: kept, blank, equal (an earlier line is equal) or near.

    Lines end at line feeds and are compared as they are. Order is by doc_id (null last), then line number. A line goes if an
    earlier line is equal, or if an earlier line lies within one edit (a character replaced, inserted or left out) and both have at least
    ``LEAST_CHARS`` characters. Blank lines stay.

    Lines within one edit agree outside one of ``PARTS`` parts, so only lines that share all but a part with another line emit their
    deletion variants in that part. Equal variants are joined by aggregation: of a group only its earliest line counts, so crowded groups
    cost one row per line. The pair that decides is verified by its edit distance.

    Null and empty texts have one blank line. Repeated (doc_id, text) rows are one document. Other columns are ignored.
    """
    keyed = docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("__text"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    rows = keyed.mapInArrow(_scan, f"doc_id {kind}, __text bigint, line_no int, line bigint, chars int, blank boolean, keys array<bigint>")
    rows = cut(rows)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col("__text").alias("text"), F.col("line_no").alias("no"))
    distinct = cut(rows.where("not blank").groupBy("line").agg(F.min(order).alias("first"), F.min_by("keys", order).alias("keys"), F.min("chars").alias("chars")))
    long = distinct.where(F.col("chars") >= LEAST_CHARS)
    keys = long.select("line", F.explode(F.array_distinct("keys")).alias("key"))
    keys = cut(keys)
    shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    candidates = cut(keys.join(shared, "key", "left_semi").select("line").distinct())
    everything = np.full(1, 2**64 - 1, _U)  # where a filter of bounded size does not pay, the joins below do all the work
    filters = [f if f is not None else everything for f in (bit_filter(candidates, "line"), bit_filter(shared, "key"))]
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def variants(batches):
        yield from _variants(*sent.value)(batches)

    schema = "line bigint, content string, key bigint, role int, variants array<bigint>"
    emitted = keyed.mapInArrow(variants, schema).dropDuplicates(["line", "key", "role"]).join(shared, "key", "left_semi")
    emitted = cut(emitted.join(long.select("line", "first"), "line"))
    flat = emitted.select("line", "first", "role", F.posexplode("variants").alias("place", "variant"), F.size("variants").alias("n"))
    # role 0: the last entry is the line itself, which meets deletions of longer lines; the others meet deletions at the same place
    flat = flat.withColumn("side", F.when(F.col("role") == 1, F.lit("longer")).when(F.col("place") == F.col("n") - 1, F.lit("self")).otherwise(F.lit("same")))
    me = F.struct("first", "line")
    groups = flat.groupBy("variant", F.col("side") == "same").agg(
        F.min(F.when(F.col("side") == "same", me)).alias("same"),
        F.min(F.when(F.col("side") == "longer", me)).alias("longer"),
        F.min(F.when(F.col("side") == "self", me)).alias("self"),
        F.count(F.lit(1)).alias("rows"),
    )
    groups = groups.where("rows > 1").drop("(side = same)")
    near = flat.join(groups, "variant")
    met = F.when(F.col("side") == "same", F.col("same")).when(F.col("side") == "longer", F.col("self")).otherwise(F.col("longer"))
    near = near.select("line", "first", met.alias("earlier")).where(F.col("earlier").isNotNull() & (F.col("earlier.first") < F.col("first")))
    pairs = near.groupBy("line").agg(F.min("earlier").alias("earlier")).select("line", F.col("earlier.line").alias("other"))
    contents = emitted.select("line", "content").dropDuplicates(["line"])
    pairs = pairs.join(contents, "line").join(contents.select(F.col("line").alias("other"), F.col("content").alias("kept")), "other")
    gone = cut(pairs.where((F.length("content") >= LEAST_CHARS) & (F.length("kept") >= LEAST_CHARS) & (F.levenshtein("content", "kept", 1) >= 0)).select("line").distinct())
    judged = rows.where("not blank").join(distinct.select("line", "first"), "line", "left")
    judged = judged.join(gone.withColumn("near", F.lit(True)), "line", "left")
    verdict = F.when(order != F.col("first"), "equal").when(F.col("near"), "near").otherwise("kept")
    columns = ["doc_id", "__text", "line_no", "line"]
    return judged.select(*columns, verdict.alias("verdict")).unionByName(rows.where("blank").select(*columns, F.lit("blank").alias("verdict")))


def line_report(docs: DataFrame) -> DataFrame:
    """One row per (doc_id, text): doc_id, n_lines, n_equal, n_near, dropped_lines (numbers, comma-joined)."""
    rows = line_dedup(docs).dropDuplicates(["doc_id", "__text", "line_no"])
    dropped = F.when(F.col("verdict").isin("equal", "near"), F.col("line_no"))
    return rows.groupBy("doc_id", "__text").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("verdict") == "equal", 1)).alias("n_equal"),
        F.count(F.when(F.col("verdict") == "near", 1)).alias("n_near"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(dropped)), lambda x: x.cast("string"))).alias("dropped_lines"),
    ).drop("__text")


LINES_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS no, unnest(ls) AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS ls FROM documents)),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, no) AS ord, trim(s, E' \t\r\f\x0b\u001c\u001d\u001e\u001f\u0085\u00a0') = '' AS blank FROM l),
d AS (SELECT s, min(ord) AS ord, length(s) AS n FROM o WHERE NOT blank GROUP BY s),
h AS (SELECT s, ord, n, n AS m, 'p' || substring(s, 1, (n // 2)::INTEGER) AS k FROM d WHERE n >= 20
 UNION ALL SELECT s, ord, n, n, 's' || substring(s, (n // 2 + 1)::INTEGER) FROM d WHERE n >= 20
 UNION ALL SELECT s, ord, n, n - 1, 'p' || substring(s, 1, ((n - 1) // 2)::INTEGER) FROM d WHERE n >= 20
 UNION ALL SELECT s, ord, n, n - 1, 's' || substring(s, ((n - 1) // 2 + 2)::INTEGER) FROM d WHERE n >= 20),
c AS (SELECT DISTINCT a.s AS a, b.s AS b, a.n AS na, b.n AS nb FROM h a JOIN h b ON a.m = b.m AND a.k = b.k AND a.ord > b.ord),
e AS (SELECT DISTINCT a FROM c WHERE
 CASE WHEN na = nb THEN len(list_filter(range(1, na + 1), lambda i: substring(a, 1, (i - 1)::INTEGER) = substring(b, 1, (i - 1)::INTEGER) AND substring(a, (i + 1)::INTEGER) = substring(b, (i + 1)::INTEGER))) > 0
  WHEN na = nb + 1 THEN len(list_filter(range(1, na + 1), lambda i: substring(a, 1, (i - 1)::INTEGER) || substring(a, (i + 1)::INTEGER) = b)) > 0
  WHEN nb = na + 1 THEN len(list_filter(range(1, nb + 1), lambda i: substring(b, 1, (i - 1)::INTEGER) || substring(b, (i + 1)::INTEGER) = a)) > 0 ELSE false END),
v AS (SELECT o.doc_id, o.no, CASE WHEN o.blank THEN 'blank' WHEN d.ord <> o.ord THEN 'equal' WHEN e.a IS NOT NULL THEN 'near' ELSE 'kept' END AS verdict
 FROM o LEFT JOIN d ON d.s = o.s LEFT JOIN e ON e.a = o.s)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (verdict = 'equal') AS n_equal, count(*) FILTER (verdict = 'near') AS n_near,
 coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (verdict IN ('equal', 'near')), '') AS dropped_lines FROM v GROUP BY doc_id"""
