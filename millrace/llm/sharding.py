"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows go from each input partition to each shard is drawn first, from
the distribution that a uniform permutation of all rows would give. Then each
partition permutes its rows and cuts them by its counts, the rows are
exchanged, and each shard permutes what it got.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import stored

SHARDS = 8
BLOCK = 8192  # rows of a shard that are numbered in one task
SEED = 20_240_607


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One hypergeometric number. Beyond numpy's range it is inverted outward from the mode."""
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample))
    left = rng.random() - at
    down, up, p_down, p_up = mode, mode, at, at
    while left > 0 and (down > low or up < high):
        if down > low:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if up < high:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """matrix[i][j]: how many rows partition i sends to shard j. Shard sizes differ by one at most."""
    rng, total = np.random.default_rng(seed), sum(rows)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in rows:
        left, others, drawn = n, sum(room), []
        for j in range(shards):
            others -= room[j]
            got = _draw(rng, room[j], others, left) if others else left
            drawn.append(got)
            left -= got
        room = [r - d for r, d in zip(room, drawn, strict=True)]
        matrix.append(drawn)
    return matrix


def _random(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in cols))


def shuffle_into_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot; counts of shards are at most one apart, slots have no gap.

    size is the text's UTF-8 bytes plus one; null counts as the empty text.
    Every row is one ball, whatever its id or text: repeated rows and null ids
    are spread like others. The driver holds one row of ``shards`` counts per
    input partition, nothing per document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit(""))
    balls = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(raw).cast("long") + 1).alias("size"),
            F.crc32(raw.cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("ball"),
        ),
        "balls",
    )
    counts = balls.groupBy("part").count().orderBy("part").collect()  # a row per partition
    matrix = communication_matrix([r["count"] for r in counts], shards, seed)
    total = sum(r["count"] for r in counts)
    bounds = [(r["part"], [int(x) for x in np.cumsum(row)]) for r, row in zip(counts, matrix, strict=True)]
    sent = F.broadcast(spark.createDataFrame(bounds, "part int, upto array<long>"))  # partitions x shards numbers

    # Permute locally, and cut by the counts.
    local = Window.partitionBy("part").orderBy(_random(seed, "ball"), "ball")
    cut = balls.withColumn("rank", F.row_number().over(local)).join(sent, "part")
    shard = F.size(F.filter("upto", lambda x: x < F.col("rank")))
    # Exchange by blocks of a shard, and permute again: a block holds a random range of the shard's new order.
    blocks = max(1, math.ceil(total / shards / BLOCK))
    key = _random(seed + 1, "ball")
    block = F.floor(F.shiftrightunsigned(key, 1) / F.lit(float(2**63)) * blocks).cast("int")
    moved = stored(cut.select("doc_id", "size", "text_crc32", "ball", shard.alias("shard"), key.alias("key"), F.least(block, F.lit(blocks - 1)).alias("block")), "moved")
    sizes = moved.groupBy("shard", "block").count()  # shards x blocks rows
    before = sizes.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("before"))
    second = Window.partitionBy("shard", "block").orderBy(F.shiftrightunsigned("key", 1), "ball")
    placed = moved.withColumn("at", F.row_number().over(second)).join(stored(before, "before"), ["shard", "block"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))
