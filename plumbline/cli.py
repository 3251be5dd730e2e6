"""Commands: check, drift, impact, init, init-contracts."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import types as L
from .operators import diff, lineage, report, sinks, state, templates
from .plans.infer import Analyzer
from .sources import adapters
from .sources.manifest import Manifest, catalog_columns, missing_files, sql_files
from .sources.settings import Settings

DIAGNOSTIC = "model string, code string, severity string, message string, file string, line int, column int, expected string, actual string"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    top.add_argument("--config", default="plumbline.toml")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("check", "drift", "impact", "init-contracts"):
        v = verbs.add_parser(verb)
        v.add_argument("--manifest", default="target/manifest.json")
        v.add_argument("--output")
        v.add_argument("--format", choices=("text", "json", "markdown", "comment"), default="text")
        if verb == "check":
            v.add_argument("--sql", default=".")
            v.add_argument("--state")
            v.add_argument("--modified-only", action="store_true")
        elif verb == "drift":
            v.add_argument("--folder", help="parquet tables to compare with instead of a warehouse")
        elif verb == "impact":
            v.add_argument("name")
        else:
            v.add_argument("--catalog")
    verbs.add_parser("init")
    return top


def check(spark: SparkSession, manifest_path: str, sql_folder: str, settings: Settings | None = None, state_path: str | None = None, modified_only: bool = False):
    """Diagnostics of all models with a contract, as a DataFrame."""
    if modified_only and not state_path:
        raise ValueError("--modified-only requires --state")
    settings, manifest = settings or Settings(), Manifest(spark, manifest_path)
    models, edges = manifest.models(), manifest.edges()
    judged = models.select("unique_id", "path", "alias")
    if modified_only:
        changed = state.compare(models, Manifest(spark, state_path).models(), content=True)
        judged = judged.join(state.affected(changed, edges).select(F.col("node").alias("unique_id")), "unique_id", "left_semi")
    files = sql_files(spark, sql_folder)
    lost = missing_files(judged.join(manifest.contracts().select(F.col("relation").alias("unique_id")).distinct(), "unique_id", "left_semi"), files)
    # a project's models and their SQL are metadata that the driver analyses
    texts = {r["path"]: r["sql"] for r in files.collect()}
    of_model = {r["unique_id"]: next((sql for path, sql in texts.items() if path.endswith(r["path"])), None) for r in judged.collect()}
    keys: dict[str, list[str]] = {}
    for r in manifest.relations().collect():
        keys.setdefault(r["unique_id"], []).append(r["key"])
    analyzer = Analyzer(spark, settings.dialect)
    types = {"INT": "bigint", "FLOAT": "double", "STRING": "string", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "DECIMAL": "decimal(38,9)", "JSON": "variant"}
    declared: dict[str, list[str]] = {}
    both = manifest.nodes().select("unique_id", "columns").unionByName(manifest.sources().select("unique_id", "columns"))
    typed = both.select("unique_id", F.explode(F.map_values("columns")).alias("c")).select("unique_id", "c.name", L.normalise(F.col("c.data_type")).alias("t"))
    for r in typed.collect():
        declared.setdefault(r["unique_id"], []).append(f"`{r['name']}` {types.get(r['t']['kind'] if r['t'] else '', 'string')}")
    for unique_id, columns in declared.items():
        for key in keys.get(unique_id, []):
            analyzer.add(key, ", ".join(columns))
    levels = {r["node"]: r["level"] or 0 for r in lineage.levels(edges, models.select(F.col("unique_id").alias("node")).union(edges.select("parent"))).collect()}
    rendered, problems = {}, []
    for unique_id, sql in of_model.items():
        if sql is None:
            continue
        try:
            rendered[unique_id] = templates.render(sql, templates.Context(resolve=lambda *p: ".".join(p)))
        except templates.RenderError as e:
            problems.append((unique_id, e.code, "error", str(e), None, None, None, None, None))
    found = analyzer.propagate(rendered, levels, lambda m: keys.get(m, []))
    schemas = {m: x.schema for m, x in found.items() if x.schema is not None}
    problems += [(m, d["code"], d["severity"], d["message"], None, None, None, None, None) for m, x in found.items() for d in x.diagnostics]
    expected = manifest.contracts()
    actual = adapters.columns_frame(spark, schemas)
    contracts = expected.join(actual.select("relation").distinct(), "relation", "left_semi")
    rows = diff.contract_diff(contracts, actual)
    path = models.select("unique_id", F.col("path").alias("file"))
    shown = rows.join(path, F.col("relation") == F.col("unique_id"), "left").select(F.col("relation").alias("model"), "code", "severity", "message", "file", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), "expected", "actual")
    shown = shown.unionByName(spark.createDataFrame(problems, DIAGNOSTIC))
    shown = shown.unionByName(lost.select(F.col("relation").alias("model"), "code", "severity", "message"), allowMissingColumns=True)
    kept = report.overridden(report.allowed(shown, settings.skip_models, settings.allow_extra_columns, settings.allow_widening), settings.severity)
    told = lineage.with_impact(kept.withColumn("node", F.col("model")), edges).drop("node")
    return report.redacted(told) if settings.redact else told


def drift(spark: SparkSession, manifest_path: str, adapter: adapters.Adapter, settings: Settings | None = None):
    """Drift of all models with a contract against what the adapter sees."""
    settings, manifest = settings or Settings(), Manifest(spark, manifest_path)
    adapter.test_connection()
    models = manifest.models().filter("contract").select(F.col("unique_id").alias("relation"), "database", "schema", "alias")
    names = {r["relation"]: r["alias"] if adapter.name in ("parquet", "mock") else ".".join(filter(None, (r["database"], r["schema"], r["alias"]))) for r in models.collect()}
    schemas = {}
    for relation, table in names.items():
        try:
            schemas[relation] = adapter.fetch_schema(table)
        except adapters.FetchError:
            continue
    actual, expected = adapters.columns_frame(spark, schemas), manifest.contracts()
    seen = actual.select("relation").distinct()
    rows = diff.drift(expected.join(seen, "relation", "left_semi"), actual).drop("column_name").unionByName(diff.skipped(models, expected, seen), allowMissingColumns=True)
    none = F.lit(None)
    shown = rows.select(F.col("relation").alias("model"), "code", "severity", "message", none.cast("string").alias("file"), none.cast("int").alias("line"), none.cast("int").alias("column"), "expected", "actual", F.array().cast("array<string>").alias("impact"))
    return report.overridden(report.allowed(shown, settings.skip_models, settings.allow_extra_columns), settings.severity)


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    settings = Settings.load(given.config) if os.path.exists(given.config) else Settings()
    if given.verb == "init":
        for path, text in (("plumbline.toml", settings.dump()), (".github/workflows/schema.yml", sinks.WORKFLOW)):
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            if not os.path.exists(path):
                with open(path, "w", encoding="utf-8") as f:
                    f.write(text)
        return 0
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if given.verb == "impact":
        manifest = Manifest(spark, given.manifest)
        names = spark.createDataFrame([(given.name,)], "name string")
        hit = lineage.find_node(manifest.nodes(), manifest.sources(), names).first()
        if not hit:
            print(f"unknown node {given.name}", file=sys.stderr)
            return 1
        reached = lineage.downstream(manifest.edges(), spark.createDataFrame([(hit["unique_id"],)], "start string"))
        for r in reached.orderBy("depth", "node").collect():
            print(f"{'  ' * r['depth']}{r['node']}")
        return 0
    if given.verb == "init-contracts":
        columns = catalog_columns(spark, given.catalog) if given.catalog else Manifest(spark, given.manifest).contracts()
        rows = columns.orderBy("relation", "ordinal").select("relation", "name", F.lower(L.display(F.col("type"))).alias("type")).collect()
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r["relation"].split(".")[-1], []).append((r["name"], r["type"]))
        print("\n".join(sinks.contract_yaml(m, c) for m, c in by.items()))
        return 0
    if given.verb == "check":
        try:
            found = check(spark, given.manifest, given.sql, settings, given.state, given.modified_only)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    else:
        adapter = adapters.ParquetAdapter(spark, given.folder) if given.folder else adapters.SparkAdapter(spark)
        found = drift(spark, given.manifest, adapter, settings)
    rows = sinks.collected(found)
    digest = report.content_hash(found.withColumn("report", F.lit(1)), "report").first()
    forms = {"text": lambda: sinks.to_text(rows), "json": lambda: sinks.to_json(rows, digest["content_hash"] if digest else ""), "markdown": lambda: sinks.to_markdown(rows), "comment": lambda: sinks.to_comment(rows)}
    print(forms[given.format]())
    if given.output:
        with open(given.output, "w", encoding="utf-8") as f:
            f.write(forms["json"]())
    return int(any(r["severity"] == "error" for r in rows))
