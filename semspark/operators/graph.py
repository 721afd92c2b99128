"""Graphs as edge tables: connected components, hops, and the knowledge graph of a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reached, by large-star and small-star contraction.

    Both steps keep connectivity and shrink the graph to stars in about log rounds; each round is written to the shared
    folder. Self loops and edges with a null end are left out; nodes without an edge to another node give no row.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of a node go to the least node around it
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # small star: a node and its smaller neighbours go to the least of them
        near = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        e = materialise(small.filter("u <> v").distinct(), "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def hops(edges: DataFrame, start: DataFrame, src: str, dst: str, most: int) -> DataFrame:
    """(root, node, hops): what is reached from each start node (column node) over 1..most edges, at the fewest hops."""
    step = edges.select(F.col(src).alias("at"), F.col(dst).alias("to")).filter("at IS NOT NULL AND to IS NOT NULL").distinct()
    front = start.select(F.col("node").alias("root"), "node").filter("node IS NOT NULL").distinct()
    seen = front.withColumn("hops", F.lit(0))
    for n in range(1, most + 1):
        nxt = front.join(step, front["node"] == step["at"]).select("root", F.col("to").alias("node")).distinct()
        front = materialise(nxt.join(seen, ["root", "node"], "left_anti"), "front")
        seen = seen.unionByName(front.withColumn("hops", F.lit(n)))
    return seen.filter("hops > 0")


def knowledge_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type, usage_count): authored (user to query) and uses (query to table), joins (tables used together, first by name)."""
    q = nodes.filter("node_type = 'example_query'").select("node_id", "user_name", "table_names").distinct()
    used = q.select("node_id", F.explode(F.array_distinct("table_names")).alias("table")).filter("table IS NOT NULL AND table <> ''")
    authored = q.filter("user_name IS NOT NULL").groupBy(F.col("user_name").alias("src"), F.col("node_id").alias("dst")).agg(F.count("*").alias("usage_count"))
    uses = used.groupBy(F.col("node_id").alias("src"), F.col("table").alias("dst")).agg(F.count("*").alias("usage_count"))
    t = F.array_sort(F.array_distinct(F.filter("table_names", lambda x: x.isNotNull() & (x != ""))))
    # the tables of one statement are few; pairs are made inside its row
    pairs = q.select(F.explode(F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda y: F.struct(x.alias("src"), y.alias("dst")))))).alias("p"))
    joins = pairs.groupBy("p.src", "p.dst").agg(F.count("*").alias("usage_count"))
    kinds = (("authored", authored), ("uses", uses), ("joins", joins))
    frames = [f.select("src", "dst", F.lit(k).alias("edge_type"), "usage_count") for k, f in kinds]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
