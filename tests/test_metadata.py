import json
import time

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.functions import types as L
from plumbline.operators import compat, diff, lineage, report, sinks, state, templates
from plumbline.plans.cache import Memo, TimedMemo, downstream_models
from plumbline.plans.infer import Analyzer, alias_map, hover, statements
from plumbline.sources import adapters
from plumbline.sources.adapters import FetchError, MockAdapter, ParquetAdapter, columns_frame, fetch_all
from plumbline.sources.manifest import Manifest
from plumbline.sources.settings import Settings
from pyspark.sql import types as T


def side(spark, ddl, relation="t", nullable=None):
    frame = columns_frame(spark, {relation: T.StructType.fromDDL(ddl)})
    return frame.withColumn("nullable", F.lit(nullable).cast("boolean")) if nullable != "own" else frame


BASE = "id int, name string, amount decimal(10,2)"


@pytest.mark.parametrize(
    "actual, want",
    [
        (BASE, []),
        ("id int, name string", ["CONTRACT_MISSING_COLUMN"]),
        ("id string, name string, amount decimal(10,2)", ["CONTRACT_TYPE_MISMATCH"]),
        (BASE + ", more string", ["CONTRACT_EXTRA_COLUMN"]),
        ("id int, name string, amount double", ["CONTRACT_TYPE_MISMATCH"]),
        ("id double, name string, amount int", []),
    ],
)
def test_contract_diff(spark, actual, want):
    assert [r.code for r in diff.contract_diff(side(spark, BASE), side(spark, actual)).collect()] == want


def test_drift(spark):
    rows = diff.drift(side(spark, BASE), side(spark, "id string, name string, extra int")).collect()
    assert sorted((r.code, r.severity) for r in rows) == [("DRIFT_COLUMN_ADDED", "info"), ("DRIFT_COLUMN_DROPPED", "error"), ("DRIFT_TYPE_CHANGE", "error")]
    lists = side(spark, "xs array<int>")
    assert diff.drift(lists, lists).count() == 0 and diff.drift(lists, lists, parity=True).count() == 1


def test_diff_with_itself_is_empty_for_odd_names(spark):
    odd = side(spark, "`column-with-dashes` string, `名前` string, `CamelCase` boolean, " + ", ".join(f"c{i} int" for i in range(100)))
    assert diff.contract_diff(odd, odd).isEmpty() and diff.drift(odd, odd).isEmpty()
    assert [r.severity for r in diff.contract_diff(side(spark, "id int"), side(spark, "ID int")).orderBy("severity").collect()] == ["error", "warn"]


@pytest.mark.parametrize("raw, want", [("varchar(255)", "UNKNOWN"), ("decimal(10)", "DECIMAL"), ("array<int>", "ARRAY"), ("timestamptz", "UNKNOWN")])
def test_contract_types_of_parity(spark, raw, want):
    row = spark.range(1).select(L.normalise(F.lit(raw), "contract", parity=True).alias("x")).first().x
    assert row.kind == want and (want != "DECIMAL" or (row.precision, row.scale) == (10, None))
    assert spark.range(1).select(L.normalise(F.lit(None).cast("string")).alias("x")).first().x is None


@pytest.mark.parametrize("local", [0, lineage.LOCAL_EDGES])
def test_closures_with_cycles(spark, local):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "parent string, child string")
    starts = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.depth) for r in lineage.downstream(edges, starts, local).collect()} == {("b", 1), ("c", 2), ("a", 3), ("d", 3)}
    assert {r.node for r in lineage.upstream(edges, spark.createDataFrame([("d",)], "start string")).collect()} == {"a", "b", "c"}
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    assert {r.node: r.level for r in lineage.levels(edges, nodes, local).collect()} == {"a": None, "b": None, "c": None, "d": None, "x": 0, "y": 1, "z": 0}
    assert lineage.downstream(edges, starts.limit(0), local).isEmpty()


def test_deep_graph(spark):
    """Each model depends on the two before it."""
    rows = [(f"m{i - d}", f"m{i}") for i in range(1000) for d in (1, 2) if i >= d]
    edges = spark.createDataFrame(rows, "parent string, child string")
    assert lineage.downstream(edges, spark.createDataFrame([("m0",)], "start string")).agg(F.count("*"), F.max("depth")).first() == (999, 500)
    nodes = spark.createDataFrame([(f"m{i}",) for i in range(1000)], "node string")
    assert lineage.levels(edges, nodes).agg(F.max("level")).first()[0] == 999


def test_state_and_blast_radius(spark):
    form = "unique_id string, path string, columns map<string,string>, depends_on array<string>, contract boolean, materialized string"
    before = [("a", "a.sql", {"x": "int"}, [], False, "view"), ("b", "b.sql", {}, ["a"], False, "view"), ("c", "c.sql", {}, ["b"], False, "view"), ("d", "d.sql", {}, ["c"], False, "view"), ("gone", "g.sql", {}, [], False, "view")]
    now = [before[0], ("b", "b.sql", {}, ["a", "a"], True, "view"), before[2], before[3], ("new", "n.sql", {}, [], False, "view")]
    found = state.compare(spark.createDataFrame(now, form), spark.createDataFrame(before, form))
    assert {(r.unique_id, r.status, tuple(r.reasons)) for r in found.collect()} == {("b", "modified", ("ContractChanged",)), ("new", "new", ("New",)), ("gone", "deleted", ("Deleted",))}
    edges = lineage.edges_of(spark.createDataFrame(now, form))
    assert {r.node for r in state.affected(found, edges).collect()} == {"b", "c", "d", "new", "gone"}


def test_hash_does_not_depend_on_row_order(spark):
    form = "model string, code string, severity string, message string, file string, line int, column int"
    rows = [("m", "B", "warn", f"x{i}", None, None, None) for i in range(20)] + [("m", "A", "error", "y", "f", 1, None)]
    one, two = spark.createDataFrame(rows, form), spark.createDataFrame(rows[::-1], form).repartition(5)
    assert report.content_hash(one, "model").first() == report.content_hash(two, "model").first()
    assert report.ordered(one).filter("ord = 1").first().code == "A"


def test_templates():
    context = templates.Context(variables={"v": 3}, resolve=lambda *p: "db." + ".".join(p))
    text = "{{ config(materialized='table') }}select {% for c in ['a', 'b'] %}{{ c }}{% if not loop.last %}, {% endif %}{% endfor %} from {{ ref('users') }}{# no #} where x > {{ var('v') }}{% if is_incremental() %} and y{% endif %}"
    assert templates.render(text, context) == "select a, b from db.users where x > 3"
    assert templates.render("select 1") == "select 1"
    assert templates.render("{{ dbt_utils.star(from=ref('x')) }} {{ money() }} {{ 'yes' | as_bool }} {{ var('no', 7) }}") == "* ::numeric(16,2) true 7"
    for bad, code in (("{{ missing }}", "JINJA_UNDEFINED_VARIABLE"), ("{{ var('no') }}", "JINJA_UNDEFINED_VARIABLE"), ("{% macro x() %}", "JINJA_RENDER_ERROR")):
        with pytest.raises(templates.RenderError) as e:
            templates.render(bad)
        assert e.value.code == code


def test_replace_refs(spark):
    text = F.lit("select * from {{ ref('a') }} join {{source( \"raw\",'t' )}} using (id)")
    out = spark.range(1).select(templates.replace_refs(text, {("a",): "db.s.a", ("raw", "t"): "db.raw.t"}).alias("x")).first().x
    assert out == "select * from db.s.a join db.raw.t using (id)"


def test_inference(spark):
    a = Analyzer(spark)
    a.add("users", "id int, name string, email string, age int")
    a.add("shop.sales.orders", "order_id int, customer_id int, total decimal(10,2)")
    show = lambda sql: [(n, t["kind"]) for _, n, t, _ in a.infer(sql).columns()]
    assert show("WITH x AS (SELECT id, upper(name) AS up FROM users) SELECT * FROM x") == [("id", "INT"), ("up", "STRING")]
    assert show("SELECT u.id, sum(total) AS t FROM users u, shop.sales.orders o WHERE u.id = o.customer_id GROUP BY 1") == [("id", "INT"), ("t", "DECIMAL")]
    code = lambda sql: [d["code"] for d in a.infer(sql).diagnostics]
    assert code("SELEC 1") == ["SQL_PARSE_ERROR"] and code("CREATE TABLE t (x int)") == ["SQL_UNSUPPORTED_SYNTAX"]
    assert code("SELECT nope FROM users") == ["SQL_INFERENCE_ERROR"] and code("SELECT * FROM nowhere") == ["SQL_SELECT_STAR_UNEXPANDABLE"]
    assert code("SELECT id, sum(age) FROM users GROUP BY id") == ["SQL_GROUP_BY_AGGREGATE_UNALIASED"]
    assert a.dependencies("WITH x AS (SELECT * FROM users) SELECT * FROM x JOIN shop.sales.orders ON true") == ["shop.sales.orders", "users"]
    assert a.memo.misses and not a.memo.hits
    a.infer("SELEC 1")
    assert a.memo.hits == 1
    assert "| id | INT | yes |" in hover(a.infer("SELECT id FROM users"))
    assert 'up' in dict(show('SELECT upper("name") AS up FROM users'))


def test_memos():
    memo = Memo()
    assert memo.get("k", lambda: 1) == memo.get("k", lambda: 2) == 1
    now = [0.0]
    timed = TimedMemo(300, lambda: now[0])
    timed.put("a", 1)
    assert timed.get("a") == 1
    now[0] = 300.0
    assert timed.get("a") is None and timed.stats() == {"entries": 1, "live": 0, "expired": 1} and timed.evict() == 1


def test_adapters(spark):
    mock = MockAdapter(errors={"secret": FetchError("permission", "no")}).with_table("users", "id int, email string")
    columns, errors = fetch_all(spark, mock, ["users", "secret", "nowhere"])
    assert columns.count() == 2 and {k: e.kind for k, e in errors.items()} == {"secret": "permission", "nowhere": "not_found"}
    with pytest.raises(FetchError):
        MockAdapter(down=True).test_connection()
    with pytest.raises(FetchError) as e:
        ParquetAdapter(spark, "/nowhere").fetch_schema("x")
    assert e.value.kind == "not_found"


def test_settings():
    text = '[severity.overrides]\ncontract_extra_column = "error"\n[allowlist]\nskip_models = ["tmp_*"]\n[warehouse]\ntype = "postgres"\n[warehouse.settings]\nhost = "h"\n'
    s = Settings.parse(text)
    assert Settings.parse(s.dump()) == s and s.severity == {"CONTRACT_EXTRA_COLUMN": "error"}
    assert s.setting("host", {}) == "h" and s.setting("host", {"PGHOST": "v"}) == "v" and s.setting("host", {"PGHOST": "v", "PLUMBLINE_POSTGRES_HOST": "o"}) == "o"


@pytest.fixture
def project(tmp_path):
    column = lambda n, t: {"name": n, "data_type": t}
    users = {"id": column("id", "integer"), "name": column("name", "varchar"), "email": column("email", "varchar"), "created_at": column("created_at", "timestamp")}
    node = lambda name, path, deps, columns, enforced: {"unique_id": f"model.mini.{name}", "name": name, "resource_type": "model", "original_file_path": path, "database": "analytics", "schema": "public", "config": {"materialized": "view", "contract": {"enforced": enforced}}, "columns": columns, "depends_on": {"nodes": deps}}
    raw = {"unique_id": "source.mini.raw.users", "name": "users", "source_name": "raw", "database": "raw_db", "schema": "raw", "columns": users | {"deleted_at": column("deleted_at", "timestamp")}}
    manifest = {
        "nodes": {"model.mini.users": node("users", "models/users.sql", ["source.mini.raw.users"], users, True), "model.mini.active_users": node("active_users", "models/active_users.sql", ["model.mini.users"], {}, False)},
        "sources": {"source.mini.raw.users": raw},
        "parent_map": {"model.mini.users": ["source.mini.raw.users"], "model.mini.active_users": ["model.mini.users"], "source.mini.raw.users": []},
        "child_map": {"source.mini.raw.users": ["model.mini.users"], "model.mini.users": ["model.mini.active_users"], "model.mini.active_users": []},
    }
    (tmp_path / "models").mkdir()
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    (tmp_path / "models/users.sql").write_text("{{ config(materialized='view') }}\nselect id, name, email, created_at from {{ source('raw', 'users') }} where deleted_at is null")
    (tmp_path / "models/active_users.sql").write_text("select id, name, email, created_at from {{ ref('users') }}")
    return tmp_path


def test_golden_project(spark, project):
    path = str(project / "manifest.json")
    manifest = Manifest(spark, path)
    assert manifest.models().count() == 2 and manifest.edges().count() == 2 and manifest.contracts().count() == 4
    assert cli.check(spark, path, str(project)).collect() == []
    (project / "models/users.sql").write_text("select id, cast(name as int) as name, created_at, 1 as more from {{ source('raw', 'users') }}")
    rows = sinks.collected(cli.check(spark, path, str(project)))
    assert [r["code"] for r in rows] == ["CONTRACT_MISSING_COLUMN", "CONTRACT_TYPE_MISMATCH", "SQL_INFERENCE_ERROR", "CONTRACT_EXTRA_COLUMN"]
    assert rows[0]["impact"] == ["model.mini.active_users"] and rows[0]["file"] == "models/users.sql"
    assert sinks.to_comment(rows).startswith(sinks.MARK) and "3 errors" in sinks.to_markdown(rows) and "4 findings" in sinks.to_text(rows)
    assert json.loads(sinks.to_json(rows, "x"))["summary"]["warnings"] == 1
    (project / "models/users.sql").unlink()
    assert "SQL_PARSE_ERROR" in {r.code for r in cli.check(spark, path, str(project)).collect()}
    with pytest.raises(ValueError):
        cli.check(spark, path, str(project), modified_only=True)


def test_drift_of_project(spark, project):
    mock = MockAdapter().with_table("users", "id int, name string, email string, created_at string, extra int")
    rows = cli.drift(spark, str(project / "manifest.json"), mock).collect()
    assert sorted(r.code for r in rows) == ["DRIFT_COLUMN_ADDED", "DRIFT_TYPE_CHANGE"]
    assert [r.code for r in cli.drift(spark, str(project / "manifest.json"), MockAdapter()).collect()] == ["DRIFT_MODEL_SKIPPED"]


def test_contract_stub():
    assert "      - name: id\n        data_type: int\n" in sinks.contract_yaml("users", [("id", "int")])


def test_inference_degrades(spark):
    a = Analyzer(spark)
    a.add("users", "id int, name string")
    found = a.infer("SELECT id, my_udf(name) AS x, upper(name) AS u FROM users")
    assert [(n, t["kind"]) for _, n, t, _ in found.columns()] == [("id", "INT"), ("x", "UNKNOWN"), ("u", "STRING")]
    assert [(d["code"], d["severity"]) for d in found.diagnostics] == [("SQL_INFERENCE_ERROR", "warn")] and "my_udf" in found.diagnostics[0]["message"]
    assert [n for _, n, t, _ in a.infer("SELECT other(id) + one_more(name) AS y, id FROM users").columns()] == ["y", "id"]
    many = a.infer("SELECT id FROM users;\nSELECT name FROM users;")
    assert [n for _, n, *_ in many.columns()] == ["id"] and "2 statements" in many.diagnostics[0]["message"]
    assert statements("SELECT 1;\n\n;\nSELECT 2") == ["SELECT 1", "SELECT 2"]


def test_default_names_and_aliases(spark):
    a = Analyzer(spark, default_names=True)
    a.add("users", "id int, name string")
    names = lambda sql: [n for _, n, *_ in a.infer(sql).columns()]
    assert names("SELECT id, id + 1, CASE WHEN id > 1 THEN 2 END, 5, NULL, UPPER(name), cast(name AS int), id AS z FROM users") == ["id", "expr", "case_expr", "literal", "null", "upper", "name", "z"]
    assert names("SELECT name, COUNT(id) FROM users GROUP BY name ORDER BY 2 LIMIT 3") == ["name", "count"]
    assert alias_map(spark, "SELECT id + 1 AS x, name, upper(name) u FROM users") == {"x": "(id + 1)", "u": "upper(name)"}


def test_connection_options():
    url, options = adapters.snowflake_options("acme", "me", key_pem="-----BEGIN-----\nAB\nCD\n-----END-----", warehouse="w", role="r", database="d")
    assert url.startswith("jdbc:snowflake://acme.") and options == {"user": "me", "private_key_base64": "ABCD", "warehouse": "w", "role": "r", "db": "d"}
    assert adapters.snowflake_options("acme", "me", password="p")[1] == {"user": "me", "password": "p"}
    assert adapters.bigquery_options("p")[1] == {"OAuthType": "3"} and adapters.bigquery_options("p", key_path="/k.json")[1]["OAuthPvtKeyPath"] == "/k.json"
    assert adapters.bigquery_options("p", key_json='{"client_email": "a@b.c"}')[1]["OAuthServiceAcctEmail"] == "a@b.c"
    assert adapters.postgres_options("h", "d", "u", ssl=True) == ("jdbc:postgresql://h:5432/d", {"user": "u", "ssl": "true", "sslmode": "verify-full"})
    for bad in (lambda: adapters.snowflake_options("acme", "me"), lambda: adapters.bigquery_options("p", key_json="[]"), lambda: adapters.bigquery_options("p", key_json="{"), lambda: adapters.postgres_options("", "d", "u")):
        with pytest.raises(adapters.FetchError) as e:
            bad()
        assert e.value.kind == "authentication"
    slow = adapters.MockAdapter(latency=0.05).with_table("t", "id int")
    began = time.monotonic()
    assert slow.fetch_schema("t").names == ["id"] and time.monotonic() - began >= 0.05


def test_references_of_a_project(spark):
    rows = [(i, f"select * from {{{{ ref('m{i}') }}}} join {{{{source(\"s\", 't')}}}} on {{{{ ref('none') }}}}") for i in range(300)] + [(900, None), (901, ""), (902, "select 1"), (900, "{{ ref('m1') }}{{ref(\"m2\")}}")]
    models = spark.createDataFrame(rows, "model long, sql string")
    relations = spark.createDataFrame([("ref", None, f"m{i}", f"db.m{i}") for i in range(300)] + [("source", "s", "t", "raw.t$1"), ("ref", None, "t", "wrong")], "kind string, source string, name string, target string")
    got = sorted((r.model, r.sql or "", r.sql is None) for r in templates.replace_all_refs(models, relations).collect())
    want = [(i, f"select * from db.m{i} join raw.t$1 on {{{{ ref('none') }}}}", False) for i in range(300)] + [(900, "", True), (901, "", False), (902, "select 1", False), (900, "db.m1db.m2", False)]
    assert got == sorted(want)
    assert templates.replace_all_refs(models.limit(0), relations).count() == 0


def test_compat_report_and_memo():
    rows = [{"project": "a", "total": 3, "parse_rate": 50.0, "inference_rate": 25.0, "samples": ["x", "y"]}]
    text, shown = compat.report(rows, {"projects": 1, "total": 3, "parse_rate": 50.0, "inference_rate": 25.0})
    assert json.loads(text)["aggregate"]["total"] == 3 and shown.splitlines()[0] == "a: 3 models, parsed 50.0 %, inferred 25.0 % (failed: x, y)"
    memo, calls = Memo(), []
    for _ in range(2):
        assert downstream_models(memo, "g1", "m", lambda n: calls.append(n) or ["k"]) == ["k"]
    assert calls == ["m"] and memo.hits == 1 and downstream_models(memo, "g2", "m", lambda n: []) == []
