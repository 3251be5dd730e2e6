"""Which models are supported, and rates of parsing and inference."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def model_type(resource_type: Column, materialized: Column) -> Column:
    """sql_model, or why a node isn't one."""
    return (
        F.when(resource_type == "model", F.when(F.lower(materialized) == "ephemeral", "ephemeral").otherwise("sql_model"))
        .when(resource_type == "seed", "seed")
        .when(resource_type == "snapshot", "snapshot")
        .when(resource_type == "source", "Sources are not models")
        .when(resource_type == "test", "Tests are not models")
        .when(resource_type == "analysis", "Analyses are not models")
        .otherwise(F.concat(F.lit("Unsupported resource type: "), resource_type))
    )


def rates(results: DataFrame, by: str) -> DataFrame:
    """Of rows (by, model, outcome, code): totals, rates in percent of supported models, and three failed samples."""
    supported = F.count_if(F.col("outcome") != "unsupported")
    parsed, inferred = F.count_if(F.col("outcome").isin("parsed", "inferred")), F.count_if(F.col("outcome") == "inferred")
    rate = lambda n: F.when(supported > 0, F.round(100.0 * n / supported, 4)).otherwise(0.0)
    counts = results.groupBy(by).agg(F.count("*").alias("total"), supported.alias("supported"), parsed.alias("parsed"), inferred.alias("inferred"), rate(parsed).alias("parse_rate"), rate(inferred).alias("inference_rate"))
    # the first three failures of a project by name, ranked before they are gathered
    place = F.row_number().over(Window.partitionBy(by).orderBy("model"))
    few = results.filter("outcome = 'failed'").withColumn("place", place).filter("place <= 3").groupBy(by).agg(F.array_sort(F.collect_list("model")).alias("samples"))
    return counts.join(few, by, "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def aggregate(projects: DataFrame) -> DataFrame:
    """One row over all projects of :func:`rates`' columns total, supported, parsed, inferred: sums, and rates of the sums."""
    sums = projects.agg(F.count("*").alias("projects"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "supported", "parsed", "inferred")])
    rate = lambda c: F.when(F.col("supported") > 0, F.round(100.0 * F.col(c) / F.col("supported"), 4)).otherwise(0.0)
    return sums.withColumns({"parse_rate": rate("parsed"), "inference_rate": rate("inferred")})


def report(rows: list[dict], total: dict) -> tuple[str, str]:
    """The compatibility report of a few projects and their aggregate as JSON and as lines for a terminal."""
    lines = [f"{r['project']}: {r['total']} models, parsed {r['parse_rate']:.1f} %, inferred {r['inference_rate']:.1f} %" + (f" (failed: {', '.join(r['samples'])})" if r.get("samples") else "") for r in rows]
    lines.append(f"all {total['projects']}: {total['total']} models, parsed {total['parse_rate']:.1f} %, inferred {total['inference_rate']:.1f} %")
    return json.dumps({"projects": rows, "aggregate": total}, indent=2, sort_keys=True), "\n".join(lines)


def grade(rate: Column, excellent: float, good: float) -> Column:
    return F.when(rate >= excellent, "excellent").when(rate >= good, "good").otherwise("poor")
