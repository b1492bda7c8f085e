"""Sharding: vector bin packing of groups of equal texts by bytes, tokens and rows at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, doc_text, hashed_prefix_sums, n_words

SHARDS = 24
#: hash cells per shard for the groups that are small
CELLS_PER_SHARD = 96
#: a group above this part of a shard, in any dimension, is an item of its own
LARGE = 1 / 48
#: a group above this part of a shard, in any dimension, is split into pieces of at most about that part
WHOLE = 1 / 2
DIMENSIONS = ("bytes", "tokens", "rows")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Bin of each item (rows: demands in every dimension as shares of the total).

    Large items first; each goes where the dot product of its demand with the residual capacities is highest among the bins in
    which it fits, or, if it fits nowhere, among all.
    """
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), dtype=np.int32)
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1))):
        need = items[i]
        score = left @ need
        fits = (left >= need - 1e-12).all(axis=1)
        if fits.any():
            score = np.where(fits, score, -np.inf)
        out[i] = best = int(score.argmax())
        left[best] -= need
    return out


def pack(docs: DataFrame, shards: int = SHARDS, cells_per_shard: int = CELLS_PER_SHARD, large: float = LARGE, whole: float = WHOLE) -> DataFrame:
    """One row per document: doc_id, size, tokens, text_crc32, shard, slot.

    Size is the text's UTF-8 bytes plus 8. Groups are equal texts (null is one group). A group up to ``whole`` of a shard in bytes, tokens and
    rows lies in one shard, at every table size. A larger one is cut by a hash of its rows into pieces of about that part. Groups above ``large``
    of a shard in any dimension are packed one by one; the others share ``cells_per_shard`` × ``shards`` hash cells, which are
    packed like groups. So the number of items has a bound that does not depend on the data: the cells, and at most
    3 × shards / ``large`` groups and 6 × shards / ``whole`` pieces. Only their sums pass through the driver, where each, the largest first, goes to the
    bin with the highest dot product of demand and residual capacity.
    Slots count from 0 without gaps in every shard, in the order of a hash of doc_id and text.

    Null and empty texts have size 8 and no tokens; the crc of null is null. Equal rows get slots of their own. An empty table
    gives no rows. Other columns are ignored.
    """
    text = F.col("text")
    light = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        n_words("text").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.length(text)).alias("__group"),
        F.md5(doc_text(F.lit("slot"), F.col("doc_id"), F.xxhash64(text))).alias("__key"),
        F.monotonically_increasing_id().alias("__row"),
    )
    light = cut(light)
    groups = cut(light.groupBy("__group").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first()
    share = F.greatest(*[F.col(d) / F.lit(max(1, total[d]) / shards) for d in DIMENSIONS])
    pieces = F.when(share > whole, F.ceil(share / whole)).otherwise(1)
    big = groups.withColumn("__share", share).where(F.col("__share") > large).select("__group", F.least(pieces, F.col("rows")).cast("int").alias("__pieces"))
    rows = light.join(big, "__group", "left")
    part = F.pmod(F.xxhash64("doc_id", "__row"), F.col("__pieces")).cast("string")
    cell = F.pmod(F.xxhash64("__group", F.lit("cell")), F.lit(shards * cells_per_shard)).cast("string")
    item = F.when(F.col("__pieces").isNull(), cell).otherwise(F.concat_ws("/", F.col("__group").cast("string"), part))
    rows = cut(rows.withColumn("__item", item).drop("__pieces", "__group", "__row"))
    items = rows.groupBy("__item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    found = sorted(items.collect(), key=lambda r: r["__item"])  # bounded: see above
    demand = np.array([[r[d] / max(1, total[d]) for d in DIMENSIONS] for r in found]).reshape(-1, len(DIMENSIONS))
    chosen = place(demand, shards)
    spark = docs.sparkSession
    bins = spark.createDataFrame([(r["__item"], int(b)) for r, b in zip(found, chosen, strict=True)], "__item string, shard int")
    rows = cut(rows.join(F.broadcast(bins), "__item").drop("__item").withColumn("__one", F.lit(1)))
    rows = hashed_prefix_sums(rows, ["shard"], "__key", ["doc_id", "size", "text_crc32"], "__one", "slot", total["rows"])
    return rows.select("doc_id", "size", "tokens", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
