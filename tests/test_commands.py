import json

from pyspark.sql import functions as F

from plumbline import cli
from plumbline.operators import compat, report
from plumbline.streaming.watch import watch
from test_metadata import project  # noqa: F401  a fixture


def test_init_writes_once(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init"]) == 0
    (tmp_path / "plumbline.toml").write_text('dialect = "postgres"\n')
    assert cli.main(["init"]) == 0 and "postgres" in (tmp_path / "plumbline.toml").read_text()


def test_verbs(spark, project, capsys, monkeypatch):  # noqa: F811
    monkeypatch.chdir(project)
    assert cli.main(["check", "--manifest", str(project / "manifest.json"), "--sql", str(project), "--format", "json", "--output", "out.json"]) == 0
    assert json.loads((project / "out.json").read_text())["summary"]["total"] == 0
    capsys.readouterr()
    assert cli.main(["impact", "users", "--manifest", str(project / "manifest.json")]) == 0
    assert "model.mini.active_users" in capsys.readouterr().out
    assert cli.main(["impact", "nothing", "--manifest", str(project / "manifest.json")]) == 1
    assert cli.main(["check", "--manifest", str(project / "manifest.json"), "--modified-only"]) == 2
    assert cli.main(["init-contracts", "--manifest", str(project / "manifest.json")]) == 0
    assert "data_type: timestamp" in capsys.readouterr().out
    spark.range(1).select(F.col("id"), F.lit("x").alias("name")).write.parquet(str(project / "users.parquet"))
    assert cli.main(["drift", "--manifest", str(project / "manifest.json"), "--folder", str(project), "--format", "markdown"]) == 1
    assert "DRIFT_COLUMN_DROPPED" in capsys.readouterr().out


def test_modified_only(spark, project):  # noqa: F811
    old = project / "old.json"
    raw = json.loads((project / "manifest.json").read_text())
    old.write_text(json.dumps(raw))
    (project / "models/users.sql").write_text("select 1 as id")
    args = (spark, str(project / "manifest.json"), str(project), None, str(old))
    assert cli.check(*args, modified_only=True).isEmpty()
    raw["nodes"]["model.mini.users"]["config"]["materialized"] = "table"
    old.write_text(json.dumps(raw))
    assert {r.model for r in cli.check(*args, modified_only=True).filter("code = 'CONTRACT_MISSING_COLUMN'").collect()} == {"model.mini.users"}


def test_watch_gives_each_manifest_once(spark, project, tmp_path):  # noqa: F811
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text((project / "manifest.json").read_text())
    seen = []
    for _ in range(2):
        watch(spark, str(folder), str(tmp_path / "state"), lambda df, n: seen.append((n, df.selectExpr("size(nodes) as n").first().n))).awaitTermination()
    assert seen == [(0, 2)]


def test_globs_and_rates(spark):
    names = spark.createDataFrame([("stg_users",), ("users_tmp",), ("a*b",)], "model string")
    hits = lambda p: {r.model for r in names.filter(report.matches(F.col("model"), p)).collect()}
    assert hits("stg_*") == {"stg_users"} and hits("*_tmp") == {"users_tmp"} and len(hits("**")) == 3 and hits("users") == set() and hits("a*b") == {"a*b"}
    rows = spark.createDataFrame([("p", "m1", "inferred"), ("p", "m2", "failed"), ("p", "m3", "unsupported")], "project string, model string, outcome string")
    got = compat.rates(rows, "project").withColumn("grade", compat.grade(F.col("parse_rate"), 95, 85)).first()
    assert (got.total, got.supported, got.parse_rate, got.samples, got.grade) == (3, 2, 50.0, ["m2"], "poor")
    assert report.top_codes(spark.createDataFrame([("B",), ("A",), ("A",), ("C",)], "code string"), 2).collect() == [("A", 2), ("B", 1)]
