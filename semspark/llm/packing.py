"""Best-fit-decreasing packing of items into containers of fixed capacity.

Items above the capacity are cut into full containers and a rest; nothing else is ever cut. All other items are dealt
into shards of about ``shard_items`` by a hash; in each shard they are laid, largest first, into the open container
with the least room that suffices, found in logarithmic time by a segment tree over remaining capacities. Containers
that stay emptier than ``slack`` are dissolved and their items packed again, with those of all shards, in the next
round; the last round keeps what it makes. So no task holds more than a shard, and little room is lost to sharding.

Defined results: items of no size need no room and get no container (null); null sizes count as none; an empty table
gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: how many open containers have that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, size: int) -> int:
        """The least room of at least ``size`` that some container has, or -1."""
        i = self.leaves + size
        if self.count[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container (from 0) of each item; the sizes come in falling order."""
    tree, open_, made, out = RoomTree(capacity), {}, 0, []
    for size in sizes:
        room = tree.tightest(size)
        if room < 0:
            container, room = made, capacity
            made += 1
        else:
            container = open_[room].pop()
            tree.add(room, -1)
        out.append(container)
        open_.setdefault(room - size, []).append(container)
        tree.add(room - size, 1)
    return out


def _layer(capacity: int, slack: float, turn: int, last: bool):  # noqa: ANN202
    def lay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "key", "piece_no"], ascending=[False, True, True], kind="stable")
        rows["bin"] = best_fit_decreasing(rows["n_tokens"].tolist(), capacity)
        used = rows.groupby("bin")["n_tokens"].transform("sum")
        rows["kept"] = last | (used >= capacity * (1 - slack))
        rows["container"] = f"{turn}-" + rows["shard"].astype(str) + "-" + rows["bin"].astype(str)
        return rows[["key", "piece_no", "n_tokens", "container", "kept"]]

    return lay


def pack(df: DataFrame, key: str, size: str, capacity: int, shard_items: int = 20_000, slack: float = 0.02, rounds: int = 3) -> DataFrame:
    """(key, piece_no, n_tokens, container): each piece of each item with its container."""
    items = df.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("size"))
    full = F.floor(F.col("size") / capacity).cast("int")
    items = items.withColumn("full", full).withColumn("rest", F.col("size") - F.col("full") * capacity)
    cut = items.filter("full > 0").select("key", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece_no"), F.lit(capacity).alias("n_tokens"))
    out = cut.withColumn("container", F.concat(F.lit("whole-"), F.col("key").cast("string"), F.lit("-"), F.col("piece_no").cast("string")))
    out = out.unionByName(items.filter("size = 0").select("key", F.lit(1).alias("piece_no"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container")))
    left = materialise(items.filter("rest > 0").select("key", (F.col("full") + 1).alias("piece_no"), F.col("rest").alias("n_tokens")), "items")
    kind = dict(left.dtypes)["key"]

    for turn in range(1, rounds + 1):
        n = left.count()
        if not n:
            break
        shards = -(-n // shard_items)
        last = turn == rounds or shards == 1

        sharded = left.withColumn("shard", F.pmod(F.xxhash64(F.lit(turn), "key", "piece_no"), F.lit(shards)).cast("int"))
        laid = materialise(sharded.groupBy("shard").applyInPandas(_layer(capacity, slack, turn, last), f"key {kind}, piece_no int, n_tokens int, container string, kept boolean"), "laid")
        out = out.unionByName(laid.filter("kept").drop("kept"))
        left = laid.filter("NOT kept").select("key", "piece_no", "n_tokens")
    return out
