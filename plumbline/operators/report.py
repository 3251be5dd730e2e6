"""Diagnostics as rows: order, redaction, hash, summary, overrides, allowlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities from grave to slight.
SEVERITIES = ("error", "warn", "info")
REDACTED = "<REDACTED>"


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def sort_keys() -> list[Column]:
    """Severity, code, place (none first), and the message, so ties have one order."""
    return [rank(F.col("severity")), F.col("code"), *[F.col(c).asc_nulls_first() for c in ("file", "line", "column")], F.col("message")]


def ordered(diagnostics: DataFrame, by: str | None = None) -> DataFrame:
    """With ``ord``, the place in the report, or in that of ``by``'s value: a report is the unit that one reader sees."""
    window = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    return diagnostics.withColumn("ord", F.row_number().over(window.orderBy(*sort_keys())))


def redact_text(text: Column) -> Column:
    quoted = F.regexp_replace(text, "'([a-zA-Z_][a-zA-Z0-9_]*)'", f"'{REDACTED}'")
    return F.regexp_replace(quoted, r"`([a-zA-Z_][a-zA-Z0-9_\.]*)`", f"`{REDACTED}`")


def redact_value(value: Column) -> Column:
    return F.when(value.isNull() | value.rlike(r"^[\p{Lu}\p{N}]*$"), value).otherwise(REDACTED)


def redacted(diagnostics: DataFrame) -> DataFrame:
    """Names in quotes and values go; type names in capitals stay, impacts keep their number."""
    return diagnostics.withColumns({"message": redact_text(F.col("message")), "expected": redact_value(F.col("expected")), "actual": redact_value(F.col("actual")), "impact": F.transform("impact", lambda _: F.lit(REDACTED))})


def line_of(diagnostics: DataFrame) -> Column:
    names = ["severity", "code", "message", "file", "line", "column", "expected", "actual", "impact"]
    return F.to_json(F.struct(*[F.col(c) for c in names if c in diagnostics.columns]), {"ignoreNullFields": "false"})


def content_hash(diagnostics: DataFrame, by: str) -> DataFrame:
    """SHA-256 of each report's diagnostics as canonical lines in report order."""
    rows = diagnostics.select(by, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_plain_keys())], line_of(diagnostics).alias("text")).alias("r"))
    lines = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"])
    return rows.groupBy(by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("content_hash"))


def _plain_keys() -> list[Column]:
    return [rank(F.col("severity")), F.col("code"), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(-1)), F.coalesce("column", F.lit(-1)), F.col("message")]


def summary(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(n) for s, n in zip(SEVERITIES, ("errors", "warnings", "infos"))])


def overridden(diagnostics: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Severities that settings give for a code take the place of its own; ``off`` drops the row."""
    if not overrides:
        return diagnostics
    given = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])[F.col("code")]
    return diagnostics.withColumn("severity", F.coalesce(given, "severity")).filter("severity <> 'off'")


def matches(name: Column, pattern: str) -> Column:
    """A name or a pattern whose first star stands for anything; what follows it is taken literally."""
    if pattern in ("*", "**"):
        return F.lit(True)
    if "*" not in pattern:
        return name == pattern
    before, after = pattern.split("*", 1)
    return name.startswith(before) & name.endswith(after)


def matches_any(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(name, p)
    return out


def allowed(diagnostics: DataFrame, skip_models: list[str] = (), extra_columns: list[str] = (), widening: list[str] = ()) -> DataFrame:
    """Without diagnostics of skipped models, of extra columns where they are allowed, and of widened types."""
    name = F.col("model")
    extra = (F.col("code") == "CONTRACT_EXTRA_COLUMN") & matches_any(name, list(extra_columns))
    wide = (F.col("code") == "CONTRACT_TYPE_MISMATCH") & F.col("message").rlike("expected INT, got (FLOAT|DECIMAL)|expected FLOAT, got DECIMAL") & matches_any(name, list(widening))
    return diagnostics.filter(~(matches_any(name, list(skip_models)) | extra | wide))


def top_codes(diagnostics: DataFrame, n: int) -> DataFrame:
    """The ``n`` commonest codes; equal counts by name."""
    return diagnostics.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(n)
