"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has many virtual nodes on a ring of 64-bit hashes, and a key belongs to the first node clockwise of its own
hash. A shard takes no more rows than its bound; the rows beyond it continue clockwise to the next shard with room.
Keys that are at home come first, in ring order, and then the overflow, in ring order; so the result depends only on
the keys. With the bounds ``rows / shards``, rounded up for as many shards as there are rows over, all shards fill up
and their counts are at most one apart.

Only the number of rows of each node reaches the driver: the ring is a parameter and doesn't grow with the rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import ship


def ring(shards: int, virtual: int) -> tuple[list[int], list[int]]:
    """Places of all virtual nodes, rising as signed 64-bit numbers, and the shard of each."""
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(shards)
        for v in range(virtual)
    )
    return [p for p, _ in nodes], [s for _, s in nodes]


def bounds(rows: int, shards: int) -> list[int]:
    """The most rows of each shard: all equal, but one more in the first ``rows % shards``."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def allot(counts: dict[int, int], owner: list[int], limit: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(node, first rank, end rank, shard, first slot): which rows of each node, by rank, go to which shard."""
    free, used, out, over = list(limit), [0] * len(limit), [], []

    def put(node: int, low: int, high: int, shard: int) -> None:
        out.append((node, low, high, shard, used[shard]))
        free[shard] -= high - low
        used[shard] += high - low

    for node in sorted(counts):
        take = min(counts[node], free[owner[node]])
        if take:
            put(node, 0, take, owner[node])
        if take < counts[node]:
            over.append((node, take, counts[node]))
    nodes = len(owner)
    follow = list(range(nodes))  # leads clockwise to a node that may have room

    def with_room(node: int) -> int:
        path = []
        while True:
            if follow[node] != node:
                path.append(node)
                node = follow[node]
            elif free[owner[node]]:
                break
            else:
                follow[node] = (node + 1) % nodes
        for p in path:
            follow[p] = node
        return node

    for node, low, high in over:
        while low < high:
            shard = owner[with_room(node)]
            take = min(high - low, free[shard])
            put(node, low, low + take, shard)
            low += take
    return out


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, virtual: int = 256) -> DataFrame:
    """Rows (``key``, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the text's UTF-8 bytes plus 16, nothing for a null text. A null key is a key like any other. Rows that
    share a key are told apart by text checksum and size; where these are equal too, they are alike, and which of them
    gets which slot makes no difference. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    places, owner = ring(shards, virtual)
    at = np.array(places, np.int64)

    @F.pandas_udf("int")
    def node_of(hashed: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, hashed.to_numpy(np.int64), side="left") % len(at), dtype="int32")

    hashed = F.xxhash64(F.col(key))
    counts = {r[0]: r[1] for r in df.select(node_of(hashed).alias("node")).groupBy("node").count().collect()}
    starts, total = {}, 0
    for node in sorted(counts):
        starts[node], total = total, total + counts[node]
    parts = [(node, starts[node] + low, starts[node] + high, shard, base) for node, low, high, shard, base in allot(counts, owner, bounds(total, shards))]
    parts = spark.createDataFrame(parts, "node int, low long, high long, shard int, base long")
    rows = df.select(
        F.col(key).alias("k"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        hashed.alias("hashed"),
    ).withColumn("node", node_of("hashed"))
    # Places in the order of all nodes: a key that most rows have is dealt over ranges like any other.
    rows = ranked(rows, ["node", "hashed", "k", "crc", "size"], "rank").withColumn("rank", F.col("rank") - 1)
    # At most two entries a node and shard: a size that the ring bounds.
    joined = rows.join(F.broadcast(parts), (rows.node == parts.node) & (rows["rank"] >= parts.low) & (rows["rank"] < parts.high))
    return joined.select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - F.col("low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def brute_force(keys: list[int], places: list[int], owner: list[int], limit: list[int]) -> dict[int, int]:
    """The shard of each distinct key (given as hashes), one after the other; for tests."""
    free, out, wait = list(limit), {}, []
    for k in sorted(keys, key=lambda k: (bisect_left(places, k) % len(places), k)):
        node = bisect_left(places, k) % len(places)
        if free[owner[node]]:
            free[owner[node]] -= 1
            out[k] = owner[node]
        else:
            wait.append((node, k))
    for node, k in wait:
        while not free[owner[node]]:
            node = (node + 1) % len(places)
        free[owner[node]] -= 1
        out[k] = owner[node]
    return out
