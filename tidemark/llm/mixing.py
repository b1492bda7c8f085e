"""Mixing sources to target weights: how many words of each document a training mix takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, doc_text, hashed_prefix_sums, n_words, null_safe, ranged_prefix_sums

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, source_size).

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` times all sizes in their proportion; a
    target stops at ``cap`` times its source's size and the excess goes to the others by weight until none is above. That
    fixed point is a water level: sources sorted by cap / weight are capped up to the first whose cap lies above the level
    that remains. Both orders are range-partitioned prefix sums, so the number of sources is not bounded by a task.
    """
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    ranked = ranged_prefix_sums(sizes.withColumn("__one", F.lit(1)), [F.col("source").asc_nulls_last()], {"__rank": "__one"}, parts)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked.withColumn("__w", F.get(turn, (F.col("__rank") % len(weights)).cast("int")))
    weighted = weighted.withColumn("__cap", F.lit(float(cap)) * F.col("source_size"))
    weighted = weighted.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    level = ranged_prefix_sums(weighted, [F.col("__ratio"), F.col("__rank")], {"__caps": "__cap", "__ws": "__w"}, parts)
    whole = level.agg(F.sum("source_size").alias("__all"), F.sum("__w").alias("__allw"))  # one row
    level = level.join(F.broadcast(whole)).withColumn("__pool", F.lit(float(share)) * F.col("__all") - F.col("__caps"))
    level = level.withColumn("__rest", F.col("__allw") - F.col("__ws"))
    free = F.col("__cap") * F.col("__rest") > F.col("__pool") * F.col("__w")
    first = level.where(free).agg(F.min_by(F.struct("__pool", "__rest"), F.struct("__ratio", "__rank")).alias("__level"))  # one row
    shared = F.col("__level.__pool") * F.col("__w") / F.col("__level.__rest")
    level = level.join(F.broadcast(first)).withColumn("target", F.coalesce(F.least(F.col("__cap"), shared), F.col("__cap")))
    return level.select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken, copies.

    Every document has a hash-random key. Within a source, documents in key order are taken ``epochs`` times in full and then
    once more up to the source's rounded target exactly: the document on the edge counts the words that still fit.
    ``copies`` is the number of times a document enters a mix of whole documents (the one on the edge enters whole).

    Words are blank-separated; a null or empty text has none and is never taken. A null source is a source. Rows that are equal
    in every respect take part one by one, in an order that does not matter. An empty table gives no rows. Other
    columns are ignored. Runs agree: keys depend on ``seed`` and doc_id only.
    """
    light = docs.select("doc_id", "source", n_words("text").alias("size"), F.md5(doc_text(F.lit(seed), F.col("doc_id"))).alias("__key"))
    light = cut(light)
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sizes, weights, share, cap))
    rows = hashed_prefix_sums(light, ["source"], "__key", ["doc_id", "size"], "size", "__before", light.count())
    rows = null_safe(rows, goal, ["source"])
    budget = F.floor(F.col("target") + 0.5)
    none = F.col("source_size") == 0
    rows = rows.withColumn("epochs", F.when(none, F.lit(0)).otherwise(F.expr("floor(target + 0.5) div source_size")).cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__before")))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("epochs") + (part > 0).cast("long")).otherwise(F.lit(0)).cast("long").alias("copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole, each as often as ``mix`` takes it; same columns as ``docs``.

    Documents without words, which weigh nothing, stay once. Repeated (doc_id, source, size) rows share one fate: the mean of
    their copies, rounded up.
    """
    keys = ["doc_id", "source", "__size"]
    taken = mix(docs, **options).withColumnRenamed("size", "__size").groupBy(*keys).agg(F.ceil(F.avg("copies")).alias("__copies"))
    rows = null_safe(docs.withColumn("__size", n_words("text")), taken, keys)
    often = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.col("__copies")).cast("int")
    return rows.withColumn("__n", F.explode(F.array_repeat(F.lit(1), often))).select(*docs.columns)
