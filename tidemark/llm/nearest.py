"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by a relaxed triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
EVERY = 20
#: vectors of a shard; a task holds one shard and its tree
SHARD_ROWS = 16_384
LEAF = 128
#: part of the triangle inequality's bound that must be exceeded before a subtree is left out; 1 is exact
FACTOR = 1.0
#: queries that go through a tree together
BLOCK = 512


class Tree:
    """Median splits by distance to a vantage point; leaves hold runs of the reordered vectors."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(points), leaf)

    def _build(self, a: int, b: int, leaf: int) -> int:
        rows = self.order[a:b]
        here = len(self.nodes)
        self.nodes.append(())
        if b - a <= leaf:
            self.nodes[here] = (a, b)
            return here
        vantage = rows[0]
        distance = np.sqrt(np.maximum(((self.points[rows] - self.points[vantage]) ** 2).sum(axis=1), 0))
        half = len(rows) // 2
        near = np.argpartition(distance, half)
        self.order[a:b] = rows[near]
        inner, outer = distance[near[:half]], distance[near[half:]]
        if inner.max() == outer.min() == distance.min() == distance.max():  # all equally far: no split can prune
            self.nodes[here] = (a, b)
            return here
        left, right = self._build(a, a + half, leaf), self._build(a + half, b, leaf)
        # the range of distances on both sides bounds every distance to a query
        self.nodes[here] = (vantage, left, inner.min(), inner.max(), right, outer.min(), outer.max())
        return here

    def search(self, queries: np.ndarray, k: int, factor: float, skip: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (rows, squared distances) of its nearest k rows; ``skip``: the query's own row or -1."""
        best_d = np.full((len(queries), k), np.inf)
        best_i = np.full((len(queries), k), -1)
        norms, square = (self.points**2).sum(axis=1), (queries**2).sum(axis=1)

        def visit(node: int, who: np.ndarray) -> None:
            entry = self.nodes[node]
            if len(entry) == 2:
                rows = self.order[entry[0] : entry[1]]
                d = norms[rows][None, :] + square[who][:, None] - 2 * queries[who] @ self.points[rows].T
                d[skip[who][:, None] == rows[None, :]] = np.inf
                all_d = np.concatenate([best_d[who], d], axis=1)
                all_i = np.concatenate([best_i[who], np.broadcast_to(rows, d.shape)], axis=1)
                top = np.argpartition(all_d, k - 1, axis=1)[:, :k]
                best_d[who], best_i[who] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_i, top, 1)
                return
            vantage, left, l0, l1, right, r0, r1 = entry
            d = np.sqrt(np.maximum(norms[vantage] + square[who] - 2 * queries[who] @ self.points[vantage], 0))
            near_left = np.maximum(np.maximum(l0 - d, d - l1), 0)
            near_right = np.maximum(np.maximum(r0 - d, d - r1), 0)
            first_left = near_left <= near_right

            def within(bound, rows):
                return rows[bound <= factor * np.sqrt(np.maximum(best_d[who[rows]].max(axis=1), 0)) + 1e-6]

            for left_turn in (True, False):  # every query sees its nearer side first
                rows = np.flatnonzero(first_left == left_turn)
                go = within(near_left[rows] if left_turn else near_right[rows], rows)
                if len(go):
                    visit(left if left_turn else right, who[go])
            for left_turn in (True, False):
                rows = np.flatnonzero(first_left != left_turn)
                go = within(near_left[rows] if left_turn else near_right[rows], rows)
                if len(go):
                    visit(left if left_turn else right, who[go])

        if len(self.points):
            visit(self.root, np.arange(len(queries)))
        return [(i[i >= 0], d[i >= 0]) for i, d in zip(best_i, best_d, strict=True)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added in their order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _search(k: int, factor: float, largest: float, leaf: int):
    """Input: sorted by shard; a shard's vectors (kind 0) come before the queries (kind 1) that visit it."""
    names = ["query_id", "vec_id", "score"]

    def lifted(vectors: np.ndarray) -> np.ndarray:
        """One more component makes all vectors equally long: the nearest are those with the largest inner product."""
        rest = np.sqrt(np.maximum(largest - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def answers(tree, ids, vectors, query_ids, queries) -> pa.RecordBatch:
        out_q, out_v, out_s = [], [], []
        flat = np.column_stack([queries, np.zeros(len(queries))])
        # the tree ranks by rounded distances: k + 4 are kept, ties at the edge are looked up in full
        own = {int(v): i for i, v in enumerate(ids)} if len(set(query_ids.tolist()) & set(ids.tolist())) else {}
        skip = np.array([own.get(int(q), -1) for q in query_ids])
        # rows that share an id beyond the one that is skipped are found as well, and left out here
        more = max(np.unique(ids[np.isin(ids, query_ids)], return_counts=True)[1], default=1) - 1 if own else 0
        found = tree.search(flat, min(k + 4 + int(more), len(ids)), factor, skip)
        for q, vector, (rows, _) in zip(query_ids, queries, found, strict=True):
            rows = np.asarray(rows)
            rows = rows[ids[rows] != q]
            score = exact_products(vectors[rows], np.broadcast_to(vector, (len(rows), len(vector))))
            if len(rows) > k:
                edge = np.sort(score)[::-1][k - 1]
                if (score >= edge - 1e-12).all():  # a run of ties may go on outside
                    every = exact_products(vectors, np.broadcast_to(vector, vectors.shape))
                    rows = np.flatnonzero((every >= edge - 1e-12) & (ids != q))
                    score = every[rows]
            order = np.lexsort((ids[rows], -score))[:k]
            out_q.append(np.full(len(order), q))
            out_v.append(ids[rows][order])
            out_s.append(score[order])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree, waiting = None, [], None, []

        def asked():
            ids, vectors = held[0]
            q = np.array([w[0] for w in waiting])
            return answers(tree, ids, vectors, q, np.stack([w[1] for w in waiting]))

        for batch in batches:
            shards, kinds, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            column = batch.column(3)
            lists = [np.asarray(column[i].values.to_numpy(zero_copy_only=False), np.float64) for i in range(len(column))]
            for s, kind, i, vector in zip(shards, kinds, ids, lists, strict=True):
                if s != shard:
                    if waiting:
                        yield asked()
                    shard, held, tree, waiting = s, [], None, []
                if kind == 0:
                    held.append((i, vector))
                    continue
                if not held:
                    continue
                if tree is None:
                    matrix = np.stack([v for _, v in held])
                    held = [(np.array([x for x, _ in held], np.int64), matrix)]
                    tree = Tree(lifted(matrix), leaf)
                waiting.append((i, vector))
                if len(waiting) == BLOCK:
                    yield asked()
                    waiting = []
        if waiting:
            yield asked()

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, leaf: int = LEAF
) -> DataFrame:
    """The ``k`` vectors with the largest inner product for each query: query_id, rank, vec_id, score.

    Both inputs have vec_id and embedding. Vectors are dealt by a hash to shards of about ``shard_rows``; every shard builds a
    vantage-point tree over its vectors, lifted by one component so that inner products become distances. Queries are dealt to all shards
    of their dimension and stream through the tree in blocks; a subtree is left out when the triangle inequality puts it farther away than ``factor``
    times the k-th distance so far (1: exact; below 1: faster, with misses). A task holds one shard. The shards' answers are ranked per query,
    ties to the smaller vec_id.

    Rows with the query's vec_id are no answers; a query id on several rows is asked once, with the least of its vectors. Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do null ids; vectors of other dimensions are never compared. Repeated ids are answers once per row. Empty tables give no rows.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        fine = v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull()
        fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        wide = F.transform(v, lambda x: x.cast("double"))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, wide).alias("embedding")).where("embedding is not null").withColumn("dim", F.size("embedding"))

    data, asked = usable(vectors), usable(queries)
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    whole = data.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"), F.max(square).alias("largest")).collect()  # one row per dimension
    largest = max([r["largest"] for r in whole], default=0.0)
    shards = {r["dim"]: max(1, -(-r["rows"] // shard_rows)) for r in whole}
    count = F.coalesce(F.create_map(*[F.lit(x) for p in shards.items() for x in p])[F.col("dim")], F.lit(0)) if shards else F.lit(0)
    first = dict(zip(sorted(shards), np.cumsum([0, *[shards[d] for d in sorted(shards)]]).tolist(), strict=False))
    base = F.create_map(*[F.lit(x) for p in first.items() for x in p])[F.col("dim")] if shards else F.lit(0)
    parts = max(1, min(sum(shards.values()), 20_000))
    task = F.pmod(base + F.col("part"), F.lit(parts)).cast("int").alias("task")  # a shard has a task of its own
    name = F.concat_ws("/", "dim", "part")
    stored = data.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("shard")), count)).select(name.alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding", task)
    visits = asked.where(count > 0).withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)))
    visits = visits.select(name.alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding", task)
    dealt = stored.unionByName(visits).repartitionById(parts, "task").drop("task").sortWithinPartitions("shard", "kind", "vec_id")

    found = dealt.mapInArrow(lambda b: _search(k, factor, largest, leaf)(b), "query_id bigint, vec_id bigint, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
