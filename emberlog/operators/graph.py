"""The entity graph as two tables: ``nodes(node, kind, label)`` and ``edges(src, dst, kind, weight)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.storage import stage
from emberlog.operators.components import connected_components
from emberlog.operators.scoring import mapped


def group_edges(entities: DataFrame) -> DataFrame:
    """Edges of correlated groups, from ``component, kind, value`` rows: addresses and users trigger the group's alert, the
    alert attacks its hosts. Other kinds have no edges."""
    alert = F.concat(F.lit("alert:"), F.col("component"))
    prefix = mapped(F.col("kind"), {"source_ips": "ip:", "users": "user:", "hosts": "host:"}, "")
    own = entities.filter(F.col("kind").isin("source_ips", "users", "hosts")).select("kind", alert.alias("alert"), F.concat(prefix, "value").alias("node"))
    attacked = F.col("kind") == "hosts"
    ends = [F.when(attacked, F.col("alert")).otherwise(F.col("node")).alias("src"), F.when(attacked, F.col("node")).otherwise(F.col("alert")).alias("dst")]
    return own.select(*ends, F.when(attacked, "attacked").otherwise("triggered").alias("kind"), F.lit(1.0).alias("weight"))


def alert_edges(alerts: DataFrame) -> DataFrame:
    """Edges of alerts: address and user trigger the alert; severity rides on the edge."""
    alert = F.concat(F.lit("alert:"), F.col("id"))
    ends = F.array_compact(F.array(F.when(F.coalesce("ip_address", F.lit("")) != "", F.concat(F.lit("ip:"), "ip_address")), F.when(F.coalesce("user_id", F.lit("")) != "", F.concat(F.lit("user:"), "user_id"))))
    return alerts.select(F.explode(ends).alias("src"), alert.alias("dst"), F.lit("triggered").alias("kind"), F.lit(1.0).alias("weight"), "severity")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind) with its weights summed; self-loops and null ends go."""
    return edges.filter("src <> dst").groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def merge_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node, kind, label, seq)`` once each, the first by ``seq`` kept, and the edges' other ends as hosts."""
    first = Window.partitionBy("node").orderBy("seq", "kind", "label")
    own = nodes.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").select("node", "kind", "label")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return own.unionByName(ends.join(own, "node", "left_anti").select("node", F.lit("host").alias("kind"), F.col("node").alias("label")))


def neighbours(edges: DataFrame, node: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    """Distinct nodes one edge away, ``out``, ``in`` or ``both``."""
    own = edges if kind is None else edges.filter(F.col("kind") == kind)
    out, into = own.filter(F.col("src") == node).select(F.col("dst").alias("node")), own.filter(F.col("dst") == node).select(F.col("src").alias("node"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone(node)``, and the edges left between them."""
    left = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node", "left_anti"), left.select(edges.columns)


def distances(edges: DataFrame, start: str, depth: int = 10, kind: str | None = None) -> DataFrame:
    """``node, hops, parent`` of all that ``start`` reaches in ``depth`` edges: breadth first, the least parent of equals."""
    own = (edges if kind is None else edges.filter(F.col("kind") == kind)).select("src", "dst").distinct()
    seen = front = edges.sparkSession.createDataFrame([(start, 0, None)], "node string, hops int, parent string")
    for hop in range(1, depth + 1):
        step = own.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = stage(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "parent"), "frontier")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str, depth: int = 10, kind: str | None = None) -> list[str]:
    """The nodes of one shortest path, or none. The driver holds the path alone, ``depth + 1`` nodes at most."""
    reached = stage(distances(edges, start, depth, kind), "reached")
    path, node = [], goal
    while node is not None:
        row = reached.filter(F.col("node") == node).first()
        if row is None:
            return []
        path.append(node)
        node = row.parent
    return path[::-1]


def hops_to(edges: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """``node, hops``: the least number of edges, ``most`` at most, from each node to any of ``goals(node)``."""
    own = edges.select("src", "dst").distinct()
    seen = front = stage(goals.select("node", F.lit(0).alias("hops")).distinct(), "goals")
    for hop in range(1, most + 1):
        step = own.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        front = stage(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops")), "towards-goals")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def simple_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, most_nodes: int = 6) -> DataFrame:
    """``path`` from any of ``starts(node)`` to any of ``goals(node)`` without repeated nodes, of ``most_nodes`` at most.

    All paths grow one edge a round, to all goals at once, and only to nodes from which some goal is near enough for what is
    left of ``most_nodes`` (:func:`hops_to`): branches that lead nowhere cost no row. The number of paths can grow
    exponentially; ``most_nodes`` bounds it.
    """
    own = edges.select("src", "dst").distinct()
    useful = stage(own.join(hops_to(own, goals, most_nodes - 2).withColumnRenamed("node", "dst"), "dst").select("src", "dst", "hops"), "useful-edges")
    paths = starts.select(F.array("node").alias("path"), F.col("node").alias("last"))
    found = None
    for nodes in range(2, most_nodes + 1):
        grown = paths.join(useful.filter(F.col("hops") <= most_nodes - nodes), F.col("last") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        paths = stage(grown.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("last"), (F.col("hops") == 0).alias("ended")), "paths")
        ended = paths.filter("ended").select("path")
        found = ended if found is None else found.union(ended)
        if paths.isEmpty():
            break
    return found if found is not None else paths.select("path").limit(0)


def degrees(edges: DataFrame) -> DataFrame:
    """``node, outgoing, incoming, total``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("outgoing"), F.sum("e.i").alias("incoming")).withColumn("total", F.col("outgoing") + F.col("incoming"))


def top_pivots(edges: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` nodes with most edges, the least of equals first."""
    return degrees(edges).orderBy(F.desc("total"), "node").limit(n)


def communities(edges: DataFrame) -> DataFrame:
    """``component, n``: weakly connected components by their least node, with their sizes."""
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("n"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, kind, n``: nodes and edges by kind, number of communities and size of the largest."""
    by = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    groups = communities(edges).agg(F.count("*").alias("all"), F.max("n").alias("most")).select(F.lit("communities").alias("what"), F.inline(F.array(F.struct(F.lit("all").alias("kind"), F.col("all").alias("n")), F.struct(F.lit("largest").alias("kind"), F.coalesce("most", F.lit(0)).alias("n")))))
    return by(nodes, "nodes").unionByName(by(edges, "edges")).unionByName(groups)


def export_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per node and edge."""
    return nodes.select(F.lit("node").alias("what"), F.to_json(F.struct("*")).alias("json")).union(edges.select(F.lit("edge"), F.to_json(F.struct("*"))))
