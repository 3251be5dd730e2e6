"""Contract diff and drift detection as outer joins on normalised types.

Both sides have rows (relation, ordinal, name, type, nullable); ``type`` is the struct of functions.types and
``nullable`` is null where it isn't known. Diagnostics have (relation, code, severity, message, column_name, expected,
actual). Names match in exact case; of equal names in one relation the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import types as L


def _first(columns: DataFrame, side: str) -> DataFrame:
    row = F.struct("ordinal", "type", "nullable")
    return columns.groupBy("relation", "name").agg(F.min_by(row, "ordinal").alias(side))


def _joined(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Only relations of the expected side are judged."""
    known = expected.select("relation").distinct()
    return _first(expected, "e").join(_first(actual.join(known, "relation", "left_semi"), "a"), ["relation", "name"], "full_outer")


def _finding(code: str, severity: Column, message: Column, expected: Column, actual: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), severity.alias("severity"), message.alias("message"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def _rows(both: DataFrame, *found: Column) -> DataFrame:
    each = both.select("relation", F.col("name").alias("column_name"), F.explode(F.array_compact(F.array(*found))).alias("d"))
    return each.select("relation", "d.code", "d.severity", "d.message", "column_name", "d.expected", "d.actual")


def contract_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing columns and incompatible types are errors, columns beyond the contract warnings."""
    both, none = _joined(expected, actual), F.lit(None)
    want, got, name = L.display(F.col("e.type")), L.display(F.col("a.type")), F.col("name")
    missing = F.when(F.col("a").isNull(), _finding("CONTRACT_MISSING_COLUMN", F.lit("error"), F.concat(F.lit("Column '"), name, F.lit("' required by contract but missing from inferred schema")), none, none))
    wrong = F.when(F.col("e").isNotNull() & F.col("a").isNotNull() & ~L.compatible(F.col("e.type"), F.col("a.type")), _finding("CONTRACT_TYPE_MISMATCH", F.lit("error"), F.concat(F.lit("Column '"), name, F.lit("' type mismatch: expected "), want, F.lit(", got "), got), none, none))
    extra = F.when(F.col("e").isNull(), _finding("CONTRACT_EXTRA_COLUMN", F.lit("warn"), F.concat(F.lit("Column '"), name, F.lit("' present in inferred schema but not declared in contract")), none, none))
    return _rows(both, missing, wrong, extra)


def drift(expected: DataFrame, actual: DataFrame, parity: bool = False) -> DataFrame:
    """Dropped columns and changed types are errors, new ones are told; nullability counts where both sides know it."""
    both, none = _joined(expected, actual), F.lit(None)
    want, got, name = L.display(F.col("e.type")), L.display(F.col("a.type")), F.col("name")
    matched = F.col("e").isNotNull() & F.col("a").isNotNull()
    word = lambda c: F.when(c, F.lit("NULL")).otherwise(F.lit("NOT NULL"))
    was, now = F.col("e.nullable"), F.col("a.nullable")
    dropped = F.when(F.col("a").isNull(), _finding("DRIFT_COLUMN_DROPPED", F.lit("error"), F.concat(F.lit("Column '"), name, F.lit("' was dropped from warehouse table (expected type: "), want, F.lit(")")), name, none))
    changed = F.when(matched & ~L.same(F.col("e.type"), F.col("a.type"), parity), _finding("DRIFT_TYPE_CHANGE", F.lit("error"), F.concat(F.lit("Column '"), name, F.lit("' type changed: was "), want, F.lit(", now "), got), want, got))
    looser = F.when(now, F.lit("warn")).otherwise(F.lit("error"))
    nulls = F.when(matched & was.isNotNull() & now.isNotNull() & (was != now), _finding("DRIFT_NULLABILITY_CHANGE", looser, F.concat(F.lit("Column '"), name, F.lit("' nullability changed: was "), word(was), F.lit(", now "), word(now)), word(was), word(now)))
    added = F.when(F.col("e").isNull(), _finding("DRIFT_COLUMN_ADDED", F.lit("info"), F.concat(F.lit("New column '"), name, F.lit("' added to warehouse table (type: "), got, F.lit(")")), none, name))
    return _rows(both, dropped, changed, nulls, added)


def skipped(models: DataFrame, expected: DataFrame, fetched: DataFrame) -> DataFrame:
    """Models (relation, database, schema) whose drift can't be told, with the reason."""
    typed, seen = expected.select("relation").distinct(), fetched.select("relation").distinct()
    flags = models.join(typed.withColumn("typed", F.lit(True)), "relation", "left").join(seen.withColumn("seen", F.lit(True)), "relation", "left")
    reason = F.when(F.col("typed").isNull(), "contract has no typed columns").when(F.col("database").isNull() | F.col("schema").isNull(), "no database or schema").when(F.col("seen").isNull(), "schema could not be fetched")
    found = flags.withColumn("reason", reason).filter("reason is not null")
    return found.select("relation", F.lit("DRIFT_MODEL_SKIPPED").alias("code"), F.lit("warn").alias("severity"), F.concat(F.lit("Model '"), "relation", F.lit("' skipped: "), "reason").alias("message"))


def counts(diagnostics: DataFrame) -> DataFrame:
    """Errors, warnings and infos of each relation."""
    return diagnostics.groupBy("relation").agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warn", "warnings"), ("info", "infos"))])
