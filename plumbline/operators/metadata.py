"""Queries of the metadata operators; expected sides are literals, actual ones come from the tables' own schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types as L
from ..sources.adapters import ParquetAdapter, columns_frame
from . import compat, diff, lineage, report, state, templates
from .registry import Tables, query

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
IN_TPCH = ", ".join(f"'{x}'" for x in TPCH)
KIND_SQL = "CASE WHEN data_type LIKE '%[]' THEN 'ARRAY' WHEN data_type = 'BOOLEAN' THEN 'BOOL' WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT') THEN 'INT' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'FLOAT' WHEN data_type = 'VARCHAR' THEN 'STRING' WHEN data_type = 'DATE' THEN 'DATE' WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' WHEN data_type LIKE 'DECIMAL%' THEN 'DECIMAL' ELSE 'UNKNOWN' END"


def actual_columns(t: Tables, *relations: str) -> DataFrame:
    return columns_frame(t.spark, {r: ParquetAdapter(t.spark, t.sf_dir).fetch_schema(r) for r in relations})


@query(f"SELECT table_name AS relation, CAST(ordinal_position AS BIGINT) AS ordinal, column_name AS name, {KIND_SQL} AS kind FROM information_schema.columns WHERE table_name IN ({IN_TPCH})")
def scan_information_schema(t: Tables) -> DataFrame:
    return actual_columns(t, *TPCH).select("relation", F.col("ordinal").cast("bigint").alias("ordinal"), "name", F.col("type.kind").alias("kind"))


# A type's text in a dialect, and what it stands for.
TYPE_CASES = [
    ("contract", "BIGINT", "INT", None, None, None), ("contract", "varchar", "STRING", None, None, None), ("contract", "varchar(255)", "STRING", None, None, None),
    ("contract", "decimal(10,2)", "DECIMAL", 10, 2, None), ("contract", "decimal(10)", "DECIMAL", 10, 0, None), ("contract", "numeric", "DECIMAL", None, None, None),
    ("contract", "array<int>", "ARRAY", None, None, "INT"), ("contract", "struct<a int>", "STRUCT", None, None, None), ("contract", "jsonb", "JSON", None, None, None),
    ("contract", "mystery", "UNKNOWN", None, None, None), ("contract", "double precision", "FLOAT", None, None, None), ("bigquery", "NUMERIC", "DECIMAL", 38, 9, None),
    ("bigquery", "NUMERIC(10)", "DECIMAL", 10, 0, None), ("bigquery", "ARRAY<STRING>", "ARRAY", None, None, "STRING"), ("bigquery", "BYTES", "STRING", None, None, None),
    ("bigquery", "TIME", "TIMESTAMP", None, None, None), ("bigquery", "RECORD", "STRUCT", None, None, None), ("snowflake", "NUMBER(38,0)", "INT", None, None, None),
    ("snowflake", "NUMBER(10,2)", "DECIMAL", 10, 2, None), ("snowflake", "NUMBER", "DECIMAL", 38, 0, None), ("snowflake", "NUMBER(12)", "INT", None, None, None),
    ("snowflake", "VARIANT", "JSON", None, None, None), ("snowflake", "TIMESTAMP_NTZ(9)", "TIMESTAMP", None, None, None), ("postgres", "integer[]", "ARRAY", None, None, "INT"),
    ("postgres", "_int4", "ARRAY", None, None, "INT"), ("postgres", "money", "DECIMAL", 19, 2, None), ("postgres", "interval", "STRING", None, None, None),
    ("postgres", "character varying(20)", "STRING", None, None, None), ("postgres", "timestamp with time zone", "TIMESTAMP", None, None, None), ("postgres", "oid", "INT", None, None, None),
]


def literal_sql(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


@query(f"SELECT dialect, raw, kind, CAST(p AS INTEGER) AS precision, CAST(s AS INTEGER) AS scale, CAST(element AS VARCHAR) AS element FROM (VALUES {literal_sql(TYPE_CASES)}) v(dialect, raw, kind, p, s, element)")
def type_normalize(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([r[:2] for r in TYPE_CASES], "dialect string, raw string")
    found = F.lit(None)
    for d in ("contract", "bigquery", "snowflake", "postgres"):
        found = F.when(F.col("dialect") == d, L.normalise(F.col("raw"), d)).otherwise(found)
    return rows.withColumn("x", found).select("dialect", "raw", "x.*")


# relation, ordinal, name, declared type, its kind, its display, nullable
CONTRACT = [
    ("lineitem", 1, "l_orderkey", "bigint", "INT", "INT", False), ("lineitem", 2, "l_partkey", "int", "INT", "INT", None), ("lineitem", 3, "l_quantity", "decimal(15,2)", "DECIMAL", "DECIMAL(15, 2)", None),
    ("lineitem", 4, "l_extendedprice", "double", "FLOAT", "FLOAT", True), ("lineitem", 5, "l_returnflag", "int", "INT", "INT", False), ("lineitem", 6, "l_shipmode", "varchar", "STRING", "STRING", None),
    ("lineitem", 7, "l_shipdate", "timestamp", "TIMESTAMP", "TIMESTAMP", None), ("orders", 1, "o_orderkey", "bigint", "INT", "INT", False), ("orders", 2, "o_custkey", "float", "FLOAT", "FLOAT", None),
    ("orders", 3, "o_totalprice", "decimal", "DECIMAL", "DECIMAL", None), ("orders", 4, "o_orderdate", "date", "DATE", "DATE", True), ("orders", 5, "o_comment", "string", "STRING", "STRING", None),
    ("orders", 6, "o_orderstatus", "mystery", "UNKNOWN", "UNKNOWN", None),
]


def expected_columns(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(*r[:4], r[6]) for r in CONTRACT], "relation string, ordinal int, name string, raw string, nullable boolean")
    return rows.withColumn("type", L.normalise(F.col("raw"), "contract")).drop("raw")


SIDES = f"""WITH e(relation, ordinal, name, raw, kind, shown, nullable) AS (VALUES {literal_sql(CONTRACT)}),
a AS (SELECT table_name AS relation, column_name AS name, {KIND_SQL} AS kind FROM information_schema.columns WHERE table_name IN ('lineitem', 'orders')),
j AS (SELECT coalesce(e.relation, a.relation) AS relation, coalesce(e.name, a.name) AS column_name, e.kind AS ek, e.shown, e.nullable, a.kind AS ak FROM e FULL JOIN a ON e.relation = a.relation AND e.name = a.name)"""
COMPATIBLE = "(ek = ak OR ek = 'UNKNOWN' OR ak = 'UNKNOWN' OR (ek = 'INT' AND ak IN ('FLOAT', 'DECIMAL')) OR (ak = 'INT' AND ek IN ('FLOAT', 'DECIMAL')))"


@query(f"""{SIDES}
SELECT relation, 'CONTRACT_MISSING_COLUMN' AS code, 'error' AS severity, 'Column ''' || column_name || ''' required by contract but missing from inferred schema' AS message, column_name FROM j WHERE ak IS NULL
UNION ALL SELECT relation, 'CONTRACT_EXTRA_COLUMN', 'warn', 'Column ''' || column_name || ''' present in inferred schema but not declared in contract', column_name FROM j WHERE ek IS NULL
UNION ALL SELECT relation, 'CONTRACT_TYPE_MISMATCH', 'error', 'Column ''' || column_name || ''' type mismatch: expected ' || shown || ', got ' || ak, column_name FROM j WHERE ek IS NOT NULL AND ak IS NOT NULL AND NOT {COMPATIBLE}""")
def contract_diff(t: Tables) -> DataFrame:
    return diff.contract_diff(expected_columns(t), actual_columns(t, "lineitem", "orders")).drop("expected", "actual")


DRIFT = f"""{SIDES}, d AS (
SELECT relation, 'DRIFT_COLUMN_DROPPED' AS code, 'error' AS severity, 'Column ''' || column_name || ''' was dropped from warehouse table (expected type: ' || shown || ')' AS message, column_name, column_name AS expected, NULL AS actual FROM j WHERE ak IS NULL
UNION ALL SELECT relation, 'DRIFT_COLUMN_ADDED', 'info', 'New column ''' || column_name || ''' added to warehouse table (type: ' || ak || ')', column_name, NULL, column_name FROM j WHERE ek IS NULL
UNION ALL SELECT relation, 'DRIFT_TYPE_CHANGE', 'error', 'Column ''' || column_name || ''' type changed: was ' || shown || ', now ' || ak, column_name, shown, ak FROM j WHERE ek <> ak AND ek <> 'UNKNOWN' AND ak <> 'UNKNOWN'
UNION ALL SELECT relation, 'DRIFT_NULLABILITY_CHANGE', 'warn', 'Column ''' || column_name || ''' nullability changed: was NOT NULL, now NULL', column_name, 'NOT NULL', 'NULL' FROM j WHERE ek IS NOT NULL AND ak IS NOT NULL AND nullable = FALSE)"""


@query(f"{DRIFT} SELECT * FROM d")
def drift_detect(t: Tables) -> DataFrame:
    return diff.drift(expected_columns(t), actual_columns(t, "lineitem", "orders"))


@query(f"{DRIFT} SELECT relation, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warn') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM d GROUP BY relation")
def drift_counts(t: Tables) -> DataFrame:
    return diff.counts(diff.drift(expected_columns(t), actual_columns(t, "lineitem", "orders")))


MATRIX = [(k, None, None, None) for k in ("BOOL", "INT", "FLOAT", "STRING", "DATE", "TIMESTAMP", "JSON", "STRUCT", "UNKNOWN")]
MATRIX += [("DECIMAL", 10, 2, None), ("DECIMAL", 12, 2, None), ("DECIMAL", None, None, None), ("ARRAY", None, None, "INT"), ("ARRAY", None, None, "STRING"), ("ARRAY", None, None, "FLOAT")]
PAIRS = f"WITH m(i, kind, p, s, element) AS (VALUES {literal_sql([(i, *m) for i, m in enumerate(MATRIX)])}) SELECT CAST(a.i AS INTEGER) AS a, CAST(b.i AS INTEGER) AS b, "


def matrix(t: Tables) -> DataFrame:
    """All pairs of a fixed list of types."""
    rows = t.spark.createDataFrame([(i, *m) for i, m in enumerate(MATRIX)], "i int, kind string, precision int, scale int, element string")
    typed = rows.select("i", F.struct("kind", "precision", "scale", "element").alias("t"))
    return typed.toDF("a", "ta").crossJoin(typed.toDF("b", "tb"))


def _mixes(x: str, y: str) -> str:
    return f"({x} = {y} OR {x} = 'UNKNOWN' OR {y} = 'UNKNOWN' OR ({x} = 'INT' AND {y} IN ('FLOAT', 'DECIMAL')) OR ({y} = 'INT' AND {x} IN ('FLOAT', 'DECIMAL')))"


@query(f"{PAIRS} CASE WHEN a.kind = 'ARRAY' AND b.kind = 'ARRAY' THEN {_mixes('a.element', 'b.element')} ELSE {_mixes('a.kind', 'b.kind')} END AS compatible FROM m a, m b")
def types_compatible_matrix(t: Tables) -> DataFrame:
    return matrix(t).select("a", "b", L.compatible(F.col("ta"), F.col("tb")).alias("compatible"))


@query(f"{PAIRS} CASE WHEN a.kind = 'UNKNOWN' OR b.kind = 'UNKNOWN' THEN TRUE WHEN a.kind <> b.kind THEN FALSE ELSE a.p IS NOT DISTINCT FROM b.p AND a.s IS NOT DISTINCT FROM b.s AND a.element IS NOT DISTINCT FROM b.element END AS same, CASE WHEN a.kind = 'UNKNOWN' OR b.kind = 'UNKNOWN' THEN TRUE WHEN a.kind <> b.kind OR a.kind IN ('ARRAY', 'STRUCT') THEN FALSE ELSE a.p IS NOT DISTINCT FROM b.p AND a.s IS NOT DISTINCT FROM b.s END AS parity FROM m a, m b")
def drift_types_match(t: Tables) -> DataFrame:
    a, b = F.col("ta"), F.col("tb")
    return matrix(t).select("a", "b", L.same(a, b).alias("same"), L.same(a, b, True).alias("parity"))


@query("WITH n(v) AS (VALUES (TRUE), (FALSE), (NULL)) SELECT a.v AS was, b.v AS now, CASE WHEN a.v = FALSE AND b.v = TRUE THEN 'warn' WHEN a.v = TRUE AND b.v = FALSE THEN 'error' END AS severity FROM n a, n b")
def drift_nullability(t: Tables) -> DataFrame:
    values = t.spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    both = values.toDF("was").crossJoin(values.toDF("now")).withColumn("relation", F.concat_ws("/", F.coalesce(F.col("was").cast("string"), F.lit("?")), F.coalesce(F.col("now").cast("string"), F.lit("?"))))
    side = lambda c: both.select("relation", F.lit(1).alias("ordinal"), F.lit("id").alias("name"), L.struct(F.lit("INT")).alias("type"), F.col(c).alias("nullable"))
    found = diff.drift(side("was"), side("now")).select("relation", "severity")
    return both.join(found, "relation", "left").select("was", "now", "severity")


@query("SELECT n_name AS relation, 'DRIFT_MODEL_SKIPPED' AS code, 'warn' AS severity, 'Model ''' || n_name || ''' skipped: ' || CASE WHEN n_nationkey % 3 = 0 THEN 'contract has no typed columns' WHEN n_nationkey % 5 = 0 THEN 'no database or schema' ELSE 'schema could not be fetched' END AS message FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 = 0 OR n_nationkey % 7 = 0")
def drift_skipped(t: Tables) -> DataFrame:
    n, key = t.nation, F.col("n_nationkey")
    models = n.select(F.col("n_name").alias("relation"), F.when(key % 5 != 0, "db").alias("database"), F.lit("s").alias("schema"))
    return diff.skipped(models, n.filter(key % 3 != 0).select(F.col("n_name").alias("relation")), n.filter(key % 7 != 0).select(F.col("n_name").alias("relation")))


# Lineage: part p depends on part p / 2, so the graph is a tree whose depth grows with the logarithm of its size.
def part_edges(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("unique_id"), F.when(F.col("p_partkey") >= 2, F.array(F.expr("p_partkey div 2"))).alias("depends_on"))
    return lineage.edges_of(nodes)


EDGES_SQL = "e AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey >= 2)"


@query(f"WITH {EDGES_SQL} SELECT parent, child FROM e")
def dag_edges(t: Tables) -> DataFrame:
    return part_edges(t)


@query(f"WITH {EDGES_SQL} SELECT parent, string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS children FROM e GROUP BY parent")
def dag_children(t: Tables) -> DataFrame:
    return part_edges(t).groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("child")).cast("array<string>"), ",").alias("children"))


BLAST_SQL = f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT parent AS start, child AS node, 1 AS depth FROM e UNION ALL SELECT r.start, e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.node) SELECT start, node, CAST(depth AS INTEGER) AS depth FROM r"


@query(BLAST_SQL)
def blast_radius(t: Tables) -> DataFrame:
    return lineage.downstream(part_edges(t), t.part.select(F.col("p_partkey").alias("start")))


@query(BLAST_SQL)
def blast_radius_rounds(t: Tables) -> DataFrame:
    """The same by rounds of joins, as a graph of any size is searched."""
    return lineage.downstream(part_edges(t), t.part.select(F.col("p_partkey").alias("start")), local_edges=0)


UPSTREAM_SQL = f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT child AS start, parent AS node FROM e WHERE child % 50 = 0 UNION ALL SELECT r.start, e.parent FROM r JOIN e ON e.child = r.node) SELECT start, node FROM r"


@query(UPSTREAM_SQL)
def upstream_closure(t: Tables) -> DataFrame:
    return lineage.upstream(part_edges(t), t.part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("start"))).select("start", "node")


@query(UPSTREAM_SQL)
def upstream_closure_rounds(t: Tables) -> DataFrame:
    return lineage.upstream(part_edges(t), t.part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("start")), local_edges=0).select("start", "node")


@query(f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT parent AS start, child AS node FROM e WHERE parent = 3 UNION ALL SELECT r.start, e.child FROM r JOIN e ON e.parent = r.node) SELECT CAST(3 AS BIGINT) AS start, p_partkey AS node, p_partkey IN (SELECT node FROM r) AS path FROM part")
def has_path(t: Tables) -> DataFrame:
    return lineage.has_path(part_edges(t), t.part.select(F.lit(3).cast("bigint").alias("start"), F.col("p_partkey").alias("node")))


LEVELS_SQL = f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, r.level + 1 FROM r JOIN e ON e.parent = r.node) SELECT node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY node"


@query(LEVELS_SQL)
def topo_levels(t: Tables) -> DataFrame:
    return lineage.levels(part_edges(t), t.part.select(F.col("p_partkey").alias("node")))


@query(LEVELS_SQL)
def topo_levels_rounds(t: Tables) -> DataFrame:
    return lineage.levels(part_edges(t), t.part.select(F.col("p_partkey").alias("node")), local_edges=0)


@query("SELECT p_name AS name, min(p_partkey) AS unique_id FROM part GROUP BY p_name UNION ALL SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0'), p_partkey FROM part")
def find_node(t: Tables) -> DataFrame:
    """All names and all ids of the parts, whose ids as text are models' unique ids."""
    nodes = t.part.select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("unique_id"), F.lit("model").alias("resource_type"), F.col("p_name").alias("name"))
    names = nodes.select("name").union(nodes.select("unique_id")).distinct()
    found = lineage.find_node(nodes, nodes.limit(0).select("name", "unique_id"), names)
    return found.select("name", F.col("unique_id").cast("bigint").alias("unique_id"))


@query(f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT parent AS start, child AS node FROM e UNION ALL SELECT r.start, e.child FROM r JOIN e ON e.parent = r.node), i AS (SELECT start, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS impact FROM r GROUP BY start) SELECT p_partkey AS node, 'CONTRACT_TYPE_MISMATCH' AS code, coalesce(impact, '') AS impact FROM part LEFT JOIN i ON start = p_partkey")
def impact_attach(t: Tables) -> DataFrame:
    found = t.part.select(F.col("p_partkey").alias("node"), F.lit("CONTRACT_TYPE_MISMATCH").alias("code"))
    return lineage.with_impact(found, part_edges(t)).select("node", "code", F.array_join(F.col("impact").cast("array<string>"), ",").alias("impact"))


# States: orders as models, changed by rules on the key.
def states(t: Tables) -> tuple[DataFrame, DataFrame]:
    def side(now: bool) -> DataFrame:
        k = F.col("o_orderkey")
        hit = lambda n: (k % n == 0) & F.lit(now)
        deps = F.when(hit(7), F.array(F.lit(0).cast("bigint"), "o_custkey", "o_custkey")).when(hit(17), F.array("o_custkey", F.lit(-1).cast("bigint"))).otherwise(F.array("o_custkey", F.lit(0).cast("bigint")))
        rows = t.orders.filter(k % (97 if now else 89) != 0)
        return rows.select(
            k.alias("unique_id"),
            F.concat(F.lit("models/"), k.cast("string"), F.when(hit(11), "_v2").otherwise(""), F.lit(".sql")).alias("path"),
            F.create_map(F.lit("id"), F.when(hit(13), "bigint").otherwise("int"), F.lit("name"), F.lit("string")).alias("columns"),
            deps.alias("depends_on"),
            hit(19).alias("contract"),
            F.when(hit(23), "table").otherwise("view").alias("materialized"),
        )

    return side(True), side(False)


STATE_SQL = "s AS (SELECT o_orderkey AS k, o_orderkey % 97 <> 0 AS now, o_orderkey % 89 <> 0 AS before FROM orders), c AS (SELECT k, CASE WHEN now AND NOT before THEN 'new' WHEN before AND NOT now THEN 'deleted' WHEN k % 11 = 0 OR k % 13 = 0 OR (k % 17 = 0 AND k % 7 <> 0) OR k % 19 = 0 OR k % 23 = 0 THEN 'modified' END AS status FROM s WHERE now OR before)"


@query(f"WITH {STATE_SQL} SELECT k AS unique_id, status, CASE status WHEN 'new' THEN 'New' WHEN 'deleted' THEN 'Deleted' ELSE concat_ws(',', CASE WHEN k % 11 = 0 THEN 'SqlChanged' END, CASE WHEN k % 13 = 0 THEN 'ColumnsChanged' END, CASE WHEN k % 17 = 0 AND k % 7 <> 0 THEN 'DependenciesChanged' END, CASE WHEN k % 19 = 0 THEN 'ContractChanged' END, CASE WHEN k % 23 = 0 THEN 'MaterializationChanged' END) END AS reasons FROM c WHERE status IS NOT NULL")
def state_compare(t: Tables) -> DataFrame:
    return state.compare(*states(t)).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g'), ' ')) <> sha256(trim(regexp_replace(CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' x' WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), ' ', chr(10) || '  ') ELSE coalesce(text, '') END, '[ \t-\r]+', ' ', 'g'), ' ')) AS changed FROM documents")
def text_fingerprint_diff(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    other = F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit(" x"))).when(F.col("doc_id") % 3 == 0, F.replace(text, F.lit(" "), F.lit("\n  "))).otherwise(text)
    return t.documents.select("doc_id", (state.fingerprint(F.col("text")) != state.fingerprint(other)).alias("changed"))


CHANGES_SQL = "c AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 31 = 0 THEN 'modified' WHEN p_partkey % 37 = 0 THEN 'new' WHEN p_partkey % 41 = 0 THEN 'deleted' END AS status FROM part)"


@query(f"WITH RECURSIVE {EDGES_SQL}, {CHANGES_SQL}, r AS (SELECT node FROM c WHERE status IN ('modified', 'new') UNION SELECT e.child FROM r JOIN e ON e.parent = r.node) SELECT count(DISTINCT node) AS total FROM (SELECT node FROM r UNION ALL SELECT node FROM c WHERE status = 'deleted')")
def total_blast_radius(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    changes = t.part.select(k.alias("unique_id"), F.when(k % 31 == 0, "modified").when(k % 37 == 0, "new").when(k % 41 == 0, "deleted").alias("status")).filter("status is not null")
    return state.affected(changes, part_edges(t)).agg(F.count("*").alias("total"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {CHANGES_SQL}, r AS (SELECT node FROM c WHERE status IN ('modified', 'new') UNION SELECT e.child FROM r JOIN e ON e.parent = r.node) SELECT p_partkey AS unique_id, p_name AS name FROM part WHERE p_partkey IN (SELECT node FROM r UNION ALL SELECT node FROM c WHERE status = 'deleted')")
def modified_only(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    changes = t.part.select(k.alias("unique_id"), F.when(k % 31 == 0, "modified").when(k % 37 == 0, "new").when(k % 41 == 0, "deleted").alias("status")).filter("status is not null")
    hit = state.affected(changes, part_edges(t)).select(F.col("node").alias("p_partkey"))
    return t.part.join(hit, "p_partkey", "left_semi").select(F.col("p_partkey").alias("unique_id"), F.col("p_name").alias("name"))


# Diagnostics made of events by rules on the id.
def diagnostics(t: Tables) -> DataFrame:
    i = F.col("event_id")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (i % 5 + 1).cast("int"))
    return t.events.select(
        i.alias("event_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("model"),
        code.alias("code"),
        F.element_at(F.array(F.lit("error"), F.lit("error"), F.lit("warn"), F.lit("info"), F.lit("warn")), (i % 5 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("Column 'c"), (i % 7).cast("string"), F.lit("' changed in `s.t"), (i % 3).cast("string"), F.lit("` at "), i.cast("string")).alias("message"),
        F.when(i % 9 != 0, F.concat(F.lit("models/m"), (F.col("user_id") % 20).cast("string"), F.lit(".sql"))).alias("file"),
        F.when(i % 10 != 0, (i % 50).cast("int")).alias("line"),
        F.when(i % 4 != 0, (i % 8).cast("int")).alias("column"),
        F.when(i % 3 == 0, "INT64").when(i % 3 == 1, "my_col").alias("expected"),
        F.when(i % 2 == 0, "STRING").alias("actual"),
    )


CODES = ["CONTRACT_TYPE_MISMATCH", "CONTRACT_MISSING_COLUMN", "CONTRACT_EXTRA_COLUMN", "DRIFT_COLUMN_ADDED", "DRIFT_NULLABILITY_CHANGE"]
DIAG_SQL = f"""d AS (SELECT event_id, 'm' || CAST(user_id % 20 AS VARCHAR) AS model, ([{", ".join(f"'{c}'" for c in CODES)}])[CAST(event_id % 5 + 1 AS INTEGER)] AS code,
(['error', 'error', 'warn', 'info', 'warn'])[CAST(event_id % 5 + 1 AS INTEGER)] AS severity,
'Column ''c' || CAST(event_id % 7 AS VARCHAR) || ''' changed in `s.t' || CAST(event_id % 3 AS VARCHAR) || '` at ' || CAST(event_id AS VARCHAR) AS message,
CASE WHEN event_id % 9 <> 0 THEN 'models/m' || CAST(user_id % 20 AS VARCHAR) || '.sql' END AS file, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 50 AS INTEGER) END AS line,
CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 8 AS INTEGER) END AS "column", CASE event_id % 3 WHEN 0 THEN 'INT64' WHEN 1 THEN 'my_col' END AS expected, CASE WHEN event_id % 2 = 0 THEN 'STRING' END AS actual FROM events)"""
KEYS_SQL = "CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, code, coalesce(file, ''), coalesce(line, -1), coalesce(\"column\", -1), message"


@query(f"WITH {DIAG_SQL} SELECT event_id, model, CAST(row_number() OVER (PARTITION BY model ORDER BY {KEYS_SQL}) AS INTEGER) AS ord FROM d")
def diagnostic_order(t: Tables) -> DataFrame:
    return report.ordered(diagnostics(t), "model").select("event_id", "model", "ord")


@query(f"WITH {DIAG_SQL} SELECT event_id, regexp_replace(regexp_replace(message, '''([a-zA-Z_][a-zA-Z0-9_]*)''', '''<REDACTED>''', 'g'), '`([a-zA-Z_][a-zA-Z0-9_.]*)`', '`<REDACTED>`', 'g') AS message, CASE WHEN expected = 'my_col' THEN '<REDACTED>' ELSE expected END AS expected, actual, '<REDACTED>,<REDACTED>' AS impact FROM d")
def redact(t: Tables) -> DataFrame:
    rows = diagnostics(t).withColumn("impact", F.array("model", "code"))
    return report.redacted(rows).select("event_id", "message", "expected", "actual", F.array_join("impact", ",").alias("impact"))


@query(f"""WITH {DIAG_SQL} SELECT model, sha256(string_agg(CAST(to_json(struct_pack(severity := severity, code := code, message := message, file := file, line := line, "column" := "column", expected := expected, actual := actual)) AS VARCHAR), chr(10) ORDER BY {KEYS_SQL})) AS content_hash FROM d GROUP BY model""")
def content_hash(t: Tables) -> DataFrame:
    return report.content_hash(diagnostics(t), "model")


@query(f"WITH {DIAG_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warn') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM d")
def report_summary(t: Tables) -> DataFrame:
    return report.summary(diagnostics(t))


@query(f"WITH {DIAG_SQL} SELECT event_id, CASE code WHEN 'CONTRACT_EXTRA_COLUMN' THEN 'error' ELSE severity END AS severity FROM d WHERE code <> 'DRIFT_COLUMN_ADDED'")
def severity_override(t: Tables) -> DataFrame:
    return report.overridden(diagnostics(t), {"CONTRACT_EXTRA_COLUMN": "error", "DRIFT_COLUMN_ADDED": "off"}).select("event_id", "severity")


@query(f"WITH {DIAG_SQL} SELECT event_id FROM d WHERE NOT (model LIKE 'm1%' OR model = 'm7') AND NOT (code = 'CONTRACT_EXTRA_COLUMN' AND model LIKE '%2')")
def allowlist_filter(t: Tables) -> DataFrame:
    return report.allowed(diagnostics(t), skip_models=["m1*", "m7"], extra_columns=["*2"]).select("event_id")


@query(f"WITH {DIAG_SQL} SELECT code, count(*) AS n FROM d GROUP BY code ORDER BY n DESC, code LIMIT 3")
def topk_codes(t: Tables) -> DataFrame:
    return report.top_codes(diagnostics(t), 3)


RESULTS_SQL = "r AS (SELECT 'p' || CAST(c_nationkey AS VARCHAR) AS project, c_name AS model, CASE WHEN c_custkey % 11 = 0 THEN 'unsupported' WHEN c_custkey % 7 = 0 THEN 'failed' WHEN c_custkey % 5 = 0 THEN 'parsed' ELSE 'inferred' END AS outcome FROM customer)"


@query(f"WITH {RESULTS_SQL}, g AS (SELECT project, count(*) AS total, count(*) FILTER (WHERE outcome <> 'unsupported') AS supported, count(*) FILTER (WHERE outcome IN ('parsed', 'inferred')) AS ok, count(*) FILTER (WHERE outcome = 'inferred') AS inf, list_sort(list(model) FILTER (WHERE outcome = 'failed'))[1:3] AS f FROM r GROUP BY project) SELECT project, total, supported, CASE WHEN supported > 0 THEN round(100.0 * ok / supported, 4) ELSE 0 END AS parse_rate, CASE WHEN supported > 0 THEN round(100.0 * inf / supported, 4) ELSE 0 END AS inference_rate, coalesce(array_to_string(f, ','), '') AS samples FROM g")
def compat_rates(t: Tables) -> DataFrame:
    return compat.rates(compat_results(t), "project").drop("parsed", "inferred").withColumn("samples", F.array_join("samples", ","))


def compat_results(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    outcome = F.when(k % 11 == 0, "unsupported").when(k % 7 == 0, "failed").when(k % 5 == 0, "parsed").otherwise("inferred")
    return t.customer.select(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("project"), F.col("c_name").alias("model"), outcome.alias("outcome"))


@query(f"WITH {RESULTS_SQL}, g AS (SELECT count(DISTINCT project) AS projects, count(*) AS total, count(*) FILTER (WHERE outcome <> 'unsupported') AS supported, count(*) FILTER (WHERE outcome IN ('parsed', 'inferred')) AS parsed, count(*) FILTER (WHERE outcome = 'inferred') AS inferred FROM r) SELECT *, round(100.0 * parsed / supported, 4) AS parse_rate, round(100.0 * inferred / supported, 4) AS inference_rate FROM g")
def compat_aggregate(t: Tables) -> DataFrame:
    return compat.aggregate(compat.rates(compat_results(t), "project"))


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'seed' WHEN 1 THEN 'snapshot' WHEN 2 THEN 'Sources are not models' WHEN 3 THEN 'Tests are not models' WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'ephemeral' ELSE 'sql_model' END WHEN 5 THEN 'Analyses are not models' ELSE 'Unsupported resource type: exposure' END AS model_type FROM part")
def model_type(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("seed", "snapshot", "source", "test", "model", "analysis", "exposure")])
    kind = F.element_at(kinds, (F.col("p_partkey") % 7 + 1).cast("int"))
    return t.part.select("p_partkey", compat.model_type(kind, F.when(F.col("p_size") % 2 == 0, "Ephemeral").otherwise("view")).alias("model_type"))


@query("SELECT n_nationkey AS model, 0 AS position, 'ref' AS kind, NULL AS source, n_name AS name FROM nation UNION ALL SELECT n_nationkey, 2, 'source', 'raw', 'r' || CAST(n_regionkey AS VARCHAR) FROM nation")
def extract_refs(t: Tables) -> DataFrame:
    text = F.concat(F.lit("select * from {{ ref('"), "n_name", F.lit("') }} a {{ config(x=1) }} join {{source(\"raw\", 'r"), F.col("n_regionkey").cast("string"), F.lit("')}} b on {{ ref('a', 'b') }}"))
    return templates.extract_refs(t.nation.select(F.col("n_nationkey").alias("model"), text.alias("sql")), "model", "sql")


@query("SELECT p_partkey AS model, 'select * from db.' || CAST(p_partkey AS VARCHAR) || ' join src.r' || CAST(p_size AS VARCHAR) || ' on {{ ref(''other'') }}' AS sql FROM part")
def replace_refs(t: Tables) -> DataFrame:
    """A model for each part, whose references are found among as many relations."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("select * from {{ ref(\""), key, F.lit("\")}} join {{source( 'raw','r"), size, F.lit("' ) }} on {{ ref('other') }}"))
    relations = t.part.select(F.lit("ref").alias("kind"), F.lit(None).cast("string").alias("source"), key.alias("name"), F.concat(F.lit("db."), key).alias("target"))
    more = t.part.select(F.lit("source").alias("kind"), F.lit("raw").alias("source"), F.concat(F.lit("r"), size).alias("name"), F.concat(F.lit("src.r"), size).alias("target")).distinct()
    return templates.replace_all_refs(t.part.select(F.col("p_partkey").alias("model"), text.alias("sql")), relations.unionByName(more))


@query("SELECT n_nationkey AS model, n_name AS name, CASE WHEN n_nationkey % 4 <> 0 THEN 'model.p.' || n_name END AS unique_id FROM nation")
def resolve_refs(t: Tables) -> DataFrame:
    text = F.concat(F.lit("select * from {{ ref('"), "n_name", F.lit("') }}"))
    refs = templates.extract_refs(t.nation.select(F.col("n_nationkey").alias("model"), text.alias("sql")), "model", "sql")
    known = t.nation.filter("n_nationkey % 4 <> 0").select(F.lit("ref").alias("kind"), F.lit(None).cast("string").alias("source"), F.col("n_name").alias("name"), F.concat(F.lit("model.p."), "n_name").alias("unique_id"), F.col("n_name").alias("target"))
    return templates.resolve_refs(refs, known).select("model", "name", "unique_id")


# Models whose schemas both engines infer without running them.
MODELS = {
    "orders_by_customer": "WITH o AS (SELECT o_custkey, o_totalprice FROM orders) SELECT c.c_name AS customer, count(*) AS n, max(o.o_totalprice) AS most FROM customer c JOIN o ON c.c_custkey = o.o_custkey GROUP BY c.c_name",
    "flags": "SELECT p_partkey, p_size > 10 AS large, CASE WHEN p_size > 40 THEN 'xl' ELSE 'm' END AS tier, coalesce(p_size, 0) AS size_or_0, upper(p_name) AS up, p_retailprice IS NULL AS odd FROM part",
    "stacked": "SELECT s_suppkey AS id, s_name AS name, s_acctbal / 2 AS half FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer",
    "dates": "SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS day, o.o_orderdate AS at, CAST(o.o_totalprice AS DECIMAL(12, 2)) AS price FROM orders o",
}


@query(" UNION ALL ".join(f"SELECT '{m}' AS model, column_name AS name, {KIND_SQL.replace('data_type', 'column_type')} AS kind FROM (DESCRIBE {sql})" for m, sql in MODELS.items()))
def infer_schema(t: Tables) -> DataFrame:
    """Schemas of SQL models by analysis on empty relations."""
    from ..plans.infer import Analyzer

    analyzer = Analyzer(t.spark)
    for relation in TPCH:
        analyzer.add(relation, getattr(t, relation).schema)
    found = {m: analyzer.infer(sql).schema for m, sql in MODELS.items()}
    return columns_frame(t.spark, found).select(F.col("relation").alias("model"), "name", F.col("type.kind").alias("kind"))
