"""Dependency graphs as edge tables (parent, child): closures, levels, blast radius."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut

#: Edges up to which a graph is sent to the tasks (a few MB) instead of being joined round by round.
LOCAL_EDGES = 200_000


def edges_of(nodes: DataFrame) -> DataFrame:
    """Edges from nodes with (unique_id, depends_on array)."""
    return nodes.select(F.explode("depends_on").alias("parent"), F.col("unique_id").alias("child")).distinct()


def edges_of_maps(parent_map: DataFrame, child_map: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of both maps (node, others array) when neither is empty, else of the nodes."""
    if parent_map.isEmpty() or child_map.isEmpty():
        return edges_of(nodes)
    up = parent_map.select(F.explode("others").alias("parent"), F.col("node").alias("child"))
    down = child_map.select(F.col("node").alias("parent"), F.explode("others").alias("child"))
    return up.unionByName(down).distinct()


def downstream(edges: DataFrame, starts: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(start, node, depth): all that is reached from each start's node, with the least number of steps.

    ``starts`` has one column, ``start``. A start is in its own result only if it lies on a cycle. A graph of at most
    ``local_edges`` edges is broadcast, and each task searches from its own starts. A larger one is joined with the
    frontier in rounds, each cut once, so the plan stays as small as one round.
    """
    edges, starts = edges.select("parent", "child").distinct(), starts.select("start").distinct()
    small = edges.limit(local_edges + 1).toArrow()
    if small.num_rows <= local_edges:
        return _searched(small, starts, dict(edges.dtypes)["child"])
    edges, frontier = cut(edges), cut(starts.select("start", F.col("start").alias("node")))
    seen, depth = None, 0
    while True:
        depth += 1
        met = frontier.join(edges, F.col("node") == F.col("parent")).select("start", F.col("child").alias("node")).distinct()
        if seen is not None:
            met = met.join(seen, ["start", "node"], "left_anti")
        frontier = cut(met.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen if seen is not None else frontier
        seen = frontier if seen is None else cut(seen.unionByName(frontier))
        frontier = frontier.select("start", "node")


def _children(edges: pa.Table) -> dict:
    out = defaultdict(list)
    for parent, child in zip(edges.column("parent").to_pylist(), edges.column("child").to_pylist()):
        out[parent].append(child)
    return out


def _searched(edges: pa.Table, starts: DataFrame, kind: str) -> DataFrame:
    held = starts.sparkSession.sparkContext.broadcast(_children(edges))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        children = held.value
        for batch in batches:
            form = pa.schema([("start", batch.schema.field("start").type), ("node", batch.schema.field("start").type), ("depth", pa.int32())])
            for start in batch.column("start").to_pylist():
                depth, frontier, found = 0, [start], {}
                while frontier:
                    depth += 1
                    frontier = [c for c in dict.fromkeys(c for n in frontier for c in children.get(n, ())) if c not in found]
                    found |= dict.fromkeys(frontier, depth)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([start] * len(found), form.types[0]), pa.array(list(found), form.types[1]), pa.array(list(found.values()), pa.int32())], schema=form)

    return starts.select(F.col("start").cast(kind).alias("start")).mapInArrow(search, f"start {kind}, node {kind}, depth int")


def upstream(edges: DataFrame, starts: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """The same against the edges' direction."""
    return downstream(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), starts, local_edges)


def has_path(edges: DataFrame, pairs: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``pairs`` (start, node) with whether a path leads from one to the other."""
    reached = downstream(edges, pairs.select("start"), local_edges).select("start", "node", F.lit(True).alias("hit"))
    return pairs.join(reached, ["start", "node"], "left").select("start", "node", F.coalesce("hit", F.lit(False)).alias("path"))


def levels(edges: DataFrame, nodes: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, level): the longest path from a node without parents; null for nodes on or behind a cycle.

    Small graphs are ordered on the driver, larger ones in rounds that take the nodes without open parents.
    """
    edges = edges.select("parent", "child").distinct()
    small = edges.limit(local_edges + 1).toArrow()
    if small.num_rows <= local_edges:
        return _ordered(small, nodes.select("node").distinct())
    left, open_nodes, done, level = cut(edges), cut(nodes.select("node").distinct()), None, 0
    while True:
        free = cut(open_nodes.join(left, F.col("node") == F.col("child"), "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            rest = open_nodes.withColumn("level", F.lit(None).cast("int"))
            return rest if done is None else done.unionByName(rest)
        done = free if done is None else cut(done.unionByName(free))
        names = free.select("node")
        left = cut(left.join(names, F.col("parent") == F.col("node"), "left_anti"))
        open_nodes = cut(open_nodes.join(names, "node", "left_anti"))
        level += 1


def _ordered(edges: pa.Table, nodes: DataFrame) -> DataFrame:
    """Levels of the nodes that have an edge, beside which any other node has level 0 and needs no place on the driver."""
    children, waits, level = _children(edges), defaultdict(int), {}
    for child in edges.column("child").to_pylist():
        waits[child] += 1
    ready = [n for n in children if not waits[n]]
    level = dict.fromkeys(ready, 0)
    while ready:
        after = []
        for n in ready:
            for c in children.get(n, ()):
                level[c] = max(level.get(c, 0), level[n] + 1)
                waits[c] -= 1
                if not waits[c]:
                    after.append(c)
        ready = after
    known = list(dict.fromkeys([*children, *waits]))
    values = [level.get(n) if not waits[n] else None for n in known]
    kind = edges.schema.field("child").type
    table = nodes.sparkSession.createDataFrame(pa.table({"node": pa.array(known, kind), "level": pa.array(values, pa.int32()), "edge": pa.array([True] * len(known))}))
    both = nodes.join(table, "node", "left")
    return both.select("node", F.when(F.col("edge"), F.col("level")).otherwise(0).alias("level"))


def find_node(nodes: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """(name, unique_id): a unique id itself, else a model's name, else a source's; ties go to the least id."""
    keys = nodes.select(F.col("unique_id").alias("name"), "unique_id", F.lit(0).alias("rank"))
    keys = keys.unionByName(nodes.filter("resource_type = 'model'").select("name", "unique_id", F.lit(1).alias("rank")))
    keys = keys.unionByName(sources.select("name", "unique_id", F.lit(2).alias("rank")))
    return names.join(keys, "name").groupBy("name").agg(F.min_by("unique_id", F.struct("rank", "unique_id")).alias("unique_id"))


def with_impact(diagnostics: DataFrame, edges: DataFrame) -> DataFrame:
    """Diagnostics (with ``node``) and the sorted nodes downstream of theirs."""
    reached = downstream(edges, diagnostics.select(F.col("node").alias("start")).distinct())
    impact = reached.groupBy("start").agg(F.array_sort(F.collect_list("node")).alias("impact"))
    none = F.array().cast(dict(impact.dtypes)["impact"])
    return diagnostics.join(impact, F.col("node") == F.col("start"), "left").drop("start").withColumn("impact", F.coalesce("impact", none))
