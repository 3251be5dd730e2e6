"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges of a partition in the rounds.
EDGES = 50_000


def _towards_least(pairs: DataFrame) -> DataFrame:
    """(u, v): each u with the least of itself and its v, beside every v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(id, root): the smallest id that is reachable, for each id that occurs in an edge with another id.

    Large stars join each vertex's larger neighbours to its least one, small stars its smaller neighbours, until no
    edge changes: a number of rounds logarithmic in the longest path. Minima are summed up before each shuffle and the
    joins are plain ones, which adaptive execution splits where a vertex has very many edges.
    """
    edges = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u > v").distinct()
    edges, mark = cut(edges), None
    parts = lambda df: df.coalesce(now[0] // EDGES + 1)  # noqa: E731  few edges make few small files
    now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while now != mark:
        edges = parts(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = parts(large.filter("u > v").distinct())
        small = parts(_towards_least(large))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges, mark = cut(parts(small.filter("u > v").distinct())), now
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
