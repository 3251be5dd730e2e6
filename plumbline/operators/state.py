"""Comparison of two project states: new, deleted and modified models, and how far changes reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import downstream

#: Compared fields of a model and the reason a difference gives, in the order in which reasons are told.
REASONS = {"path": "SqlChanged", "columns": "ColumnsChanged", "depends_on": "DependenciesChanged", "contract": "ContractChanged", "materialized": "MaterializationChanged"}


def compare(current: DataFrame, before: DataFrame, content: bool = False) -> DataFrame:
    """(unique_id, status, reasons) of all models that are new, deleted or modified.

    Models have unique_id, path, columns (map of name to type), depends_on (array), contract (boolean), materialized,
    and with ``content`` a checksum that counts as SQL beside the path. Dependencies are compared as sets and columns
    by name and type.
    """
    a, b = current.alias("a"), before.alias("b")
    both = a.join(b, F.col("a.unique_id") == F.col("b.unique_id"), "full_outer")

    def form(side: str, field: str) -> Column:
        value = F.col(f"{side}.{field}")
        if field == "depends_on":
            return F.array_sort(F.array_distinct(value))
        if field == "columns":
            return F.array_sort(F.map_entries(value))
        return value

    def differs(field: str) -> Column:
        out = ~form("a", field).eqNullSafe(form("b", field))
        return out | ~F.col("a.checksum").eqNullSafe(F.col("b.checksum")) if content and field == "path" else out

    found = F.array_compact(F.array(*[F.when(differs(f), F.lit(r)) for f, r in REASONS.items()]))
    status = F.when(F.col("b.unique_id").isNull(), "new").when(F.col("a.unique_id").isNull(), "deleted").when(F.size(found) > 0, "modified")
    reasons = F.when(status == "new", F.array(F.lit("New"))).when(status == "deleted", F.array(F.lit("Deleted"))).otherwise(found)
    return both.select(F.coalesce("a.unique_id", "b.unique_id").alias("unique_id"), status.alias("status"), reasons.alias("reasons")).filter("status is not null")


def fingerprint(text: Column) -> Column:
    """A hash of a text that white space has no say in."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), 256)


def affected(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, direct): changed nodes and all downstream of new and modified ones."""
    starts = changes.filter("status <> 'deleted'").select(F.col("unique_id").alias("start"))
    reached = downstream(edges, starts).select("node", F.lit(False).alias("direct"))
    return changes.select(F.col("unique_id").alias("node"), F.lit(True).alias("direct")).unionByName(reached).groupBy("node").agg(F.max("direct").alias("direct"))
