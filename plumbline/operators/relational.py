"""The analysed SQL constructs as DataFrame operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import Tables, query

big = lambda c: c.cast("bigint")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def projection(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey AS id, c_name AS customer, c_acctbal AS balance FROM customer")
def alias(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("customer"), F.col("c_acctbal").alias("balance"))


@query("SELECT * FROM nation")
def select_star(t: Tables) -> DataFrame:
    return t.nation.select("*")


@query("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def qualified_star(t: Tables) -> DataFrame:
    n, r = t.nation.alias("n"), t.region.alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.*", "r.r_name")


@query("SELECT CAST(1 AS INTEGER) AS one, 'x' AS letter, TRUE AS yes")
def select_no_from(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("letter"), F.lit(True).alias("yes"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS day, TRY_CAST(o_orderpriority AS INTEGER) AS no_number FROM orders")
def cast(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").try_cast("int").alias("no_number"),
    )


@query("SELECT r_regionkey, CAST(7 AS INTEGER) AS int_lit, CAST(1.5 AS DECIMAL(2,1)) AS dec_lit, 'a''b' AS str_lit, FALSE AS bool_lit, CAST(NULL AS INTEGER) AS null_lit FROM region")
def literal(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", F.lit(7).alias("int_lit"), F.lit(1.5).cast("decimal(2,1)").alias("dec_lit"), F.lit("a'b").alias("str_lit"), F.lit(False).alias("bool_lit"), F.lit(None).cast("int").alias("null_lit"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS plus, l_linenumber - 3 AS minus, l_linenumber * 2 AS times, l_quantity / 4 AS ratio, l_orderkey % 7 AS rest, -l_linenumber AS neg FROM lineitem")
def arithmetic(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", (n + 1).alias("plus"), (n - 3).alias("minus"), (n * 2).alias("times"), (F.col("l_quantity") / 4).alias("ratio"), (F.col("l_orderkey") % 7).alias("rest"), (-n).alias("neg"))


@query("SELECT p_partkey, p_size = 5 AS eq, p_size <> 5 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
def comparison(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", (s == 5).alias("eq"), (s != 5).alias("ne"), (s < 10).alias("lt"), (s <= 10).alias("le"), (s > 10).alias("gt"), (s >= 10).alias("ge"))


@query("SELECT p_partkey, (p_size > 10 AND p_retailprice > 1000) AS both, (p_size > 40 OR p_retailprice > 1500) AS either, NOT (p_size > 10) AS neither FROM part")
def logical(t: Tables) -> DataFrame:
    s, p = F.col("p_size"), F.col("p_retailprice")
    return t.part.select("p_partkey", ((s > 10) & (p > 1000)).alias("both"), ((s > 40) | (p > 1500)).alias("either"), (~(s > 10)).alias("neither"))


@query("SELECT p_partkey, p_brand || '/' || p_type AS label FROM part")
def string_concat_op(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status_no FROM orders")
def case_when(t: Tables) -> DataFrame:
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(p > 200000, "high").when(p > 100000, "mid").otherwise("low").alias("tier"), F.when(s == "F", 1).when(s == "O", 2).alias("status_no"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND c_name LIKE '%1%' AND NOT (c_nationkey = 3) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND c_acctbal > (SELECT min(s_acctbal) FROM supplier)")
def predicates(t: Tables) -> DataFrame:
    c = t.customer
    kept = c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").between(0, 5000) & F.col("c_name").like("%1%") & ~(F.col("c_nationkey") == 3))
    least = t.supplier.agg(F.min("s_acctbal").alias("least"))
    kept = kept.join(F.broadcast(least), F.col("c_acctbal") > F.col("least"))  # one row
    return kept.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT e.event_id, c.c_custkey IS NULL AS missing FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey WHERE c.c_custkey IS NULL OR c.c_name IS NOT NULL")
def filter_is_null(t: Tables) -> DataFrame:
    both = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left")
    return both.filter(F.col("c_custkey").isNull() | F.col("c_name").isNotNull()).select("event_id", F.col("c_custkey").isNull().alias("missing"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05 AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")
def filter_compare(t: Tables) -> DataFrame:
    return t.lineitem.filter((F.col("l_quantity") < 10) & (F.col("l_discount") >= 0.05) & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber")


@query("SELECT d.o_custkey, d.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 10")
def derived_table(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 10")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000")
def join_left(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 150000), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = 2 * c_custkey")
def join_full(t: Tables) -> DataFrame:
    return t.supplier.join(t.customer, F.col("s_suppkey") == 2 * F.col("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    """The construct itself, on two dimension tables of fixed size."""
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT k, c_name, o_totalprice FROM (SELECT c_custkey AS k, c_name FROM customer) JOIN (SELECT o_custkey AS k, o_totalprice FROM orders) USING (k)")
def join_using(t: Tables) -> DataFrame:
    c, o = t.customer.select(F.col("c_custkey").alias("k"), "c_name"), t.orders.select(F.col("o_custkey").alias("k"), "o_totalprice")
    return c.join(o, "k").select("k", "c_name", "o_totalprice")


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def join_comma(t: Tables) -> DataFrame:
    return t.nation.crossJoin(t.region).filter("n_regionkey = r_regionkey").select("n_name", "r_name")


@query("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT c_name, o_totalprice FROM customer JOIN big ON c_custkey = o_custkey")
def cte(t: Tables) -> DataFrame:
    large = t.orders.filter("o_totalprice > 100000").select("o_custkey", "o_totalprice")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "o_totalprice")


@query("WITH a AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey), b AS (SELECT o_custkey, q FROM a JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT o_custkey, round(sum(q), 2) AS total FROM b GROUP BY o_custkey) SELECT * FROM c WHERE total > 100")
def cte_chain(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    b = a.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "q")
    return b.groupBy("o_custkey").agg(F.round(F.sum("q"), 2).alias("total")).filter("total > 100")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_by_single(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by_multi(t: Tables) -> DataFrame:
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(revenue, 1).alias("revenue"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def group_by_all(t: Tables) -> DataFrame:
    """GROUP BY ALL in SQL; the keys are the outputs without an aggregate."""
    t.lineitem.createOrReplaceTempView("_plumbline_lineitem")
    return t.spark.sql("SELECT l_returnflag, count(*) AS n FROM _plumbline_lineitem GROUP BY ALL")


@query("SELECT count(*) AS n, count(o_orderpriority) AS known, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done FROM orders")
def agg_count(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("known"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag")
def agg_sum(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(sum(c_acctbal) / count(*), 4) AS ratio FROM customer GROUP BY c_mktsegment")
def agg_avg(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.sum("c_acctbal") / F.count("*"), 4).alias("ratio"))


@query("SELECT p_brand, min(p_size) AS least, max(p_size) AS most, min(p_name) AS first_name, max(p_retailprice) AS price FROM part GROUP BY p_brand")
def agg_min_max(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.min("p_name").alias("first_name"), F.max("p_retailprice").alias("price"))


@query("SELECT event_type, round(stddev_samp(value), 6) AS dev, round(var_samp(value), 4) AS variance FROM events GROUP BY event_type")
def agg_stddev_variance(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("dev"), F.round(F.var_samp("value"), 4).alias("variance"))


@query("SELECT n_regionkey, list_sort(array_agg(n_nationkey)) AS nations FROM nation GROUP BY n_regionkey")
def agg_array(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.array_agg("n_nationkey")).alias("nations"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@query("SELECT o_orderpriority, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 6) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM orders GROUP BY o_orderpriority")
def agg_percentile(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice)"), 6).alias("median"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice)").alias("p90"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50 AND max(l_quantity) >= 40")
def having(t: Tables) -> DataFrame:
    grouped = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"))
    return grouped.filter("n > 50 and most >= 40").drop("most")


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_quantity") > 25).alias("large"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def order_limit(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def except_(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.select("s_nationkey"))


@query("SELECT n, name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(n, name)")
def values_rows(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT n, name FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) v(n, name)")


@query("SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS joined, upper(c_mktsegment) AS up, lower(c_name) AS low, trim('  ' || c_name || ' ') AS trimmed, substring(c_name, 3, 4) AS part FROM customer")
def fn_string(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.concat("c_name", F.lit("-"), "c_mktsegment").alias("joined"), F.upper("c_mktsegment").alias("up"), F.lower("c_name").alias("low"), F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"), F.substring("c_name", 3, 4).alias("part"))


@query("SELECT c_custkey, coalesce(o_orderkey, -1) AS k, ifnull(o_orderstatus, '?') AS s, nullif(c_nationkey, 3) AS nk FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def fn_null(t: Tables) -> DataFrame:
    both = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("k"), F.ifnull("o_orderstatus", F.lit("?")).alias("s"), F.nullif("c_nationkey", F.lit(3)).alias("nk"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate <= now() AND CAST(o_orderdate AS DATE) <= current_date")
def fn_now(t: Tables) -> DataFrame:
    """The clock functions; only a count that doesn't depend on the clock is returned."""
    return t.orders.filter((F.col("o_orderdate") <= F.now()) & (F.col("o_orderdate").cast("date") <= F.current_date())).agg(F.count("*").alias("n"))


# Extensions that Catalyst gives for constructs which are only parsed.


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")
def window_rank(t: Tables) -> DataFrame:
    own = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", "o_custkey", F.row_number().over(own.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"), F.rank().over(own.orderBy("o_orderpriority")).alias("rk"), F.lag("o_orderkey").over(own.orderBy("o_orderkey")).alias("before"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS running FROM events")
def window_sum(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return t.events.select("event_id", F.round(F.sum("value").over(w), 6).alias("running"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def qualify(t: Tables) -> DataFrame:
    """QUALIFY has no grammar here: a filter on the window's column."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("o_custkey", "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t: Tables) -> DataFrame:
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, unnest(list_sort(array_agg(n_nationkey))) AS nation FROM nation GROUP BY n_regionkey")
def unnest(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.array_agg("n_nationkey")).alias("xs")).select("n_regionkey", F.explode("xs").alias("nation"))


@query("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r")
def recursive_cte(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r")


@query("SELECT c_custkey, l.top FROM customer, LATERAL (SELECT max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey) l")
def lateral(t: Tables) -> DataFrame:
    top = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return t.customer.join(top, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "top")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def pivot(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return wide.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation UNION ALL (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)")
def parenthesised_set(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("k")).union(t.supplier.select("s_nationkey").subtract(t.customer.select("c_nationkey")))


@query("SELECT o_orderkey, o_orderkey & 12 AS both, o_orderkey | 5 AS some, xor(o_orderkey, 9) AS one, o_orderkey << 2 AS up, regexp_matches(o_orderpriority, '^[12]-') AS urgent FROM orders")
def bitwise_and_regex(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", k.bitwiseAND(12).alias("both"), k.bitwiseOR(5).alias("some"), k.bitwiseXOR(9).alias("one"), F.shiftleft("o_orderkey", 2).alias("up"), F.col("o_orderpriority").rlike("^[12]-").alias("urgent"))


@query("SELECT n_nationkey, json_extract_string('{\"a\": {\"b\": \"' || n_name || '\"}, \"r\": ' || CAST(n_regionkey AS VARCHAR) || '}', '$.a.b') AS name, CAST(json_extract_string('{\"r\": ' || CAST(n_regionkey AS VARCHAR) || '}', '$.r') AS BIGINT) AS region FROM nation")
def json_operators(t: Tables) -> DataFrame:
    text = F.concat(F.lit('{"a": {"b": "'), "n_name", F.lit('"}, "r": '), F.col("n_regionkey").cast("string"), F.lit("}"))
    return t.nation.select("n_nationkey", F.get_json_object(text, "$.a.b").alias("name"), F.get_json_object(text, "$.r").cast("bigint").alias("region"))


@query("SELECT e.event_id, p.event_id AS before FROM events e ASOF LEFT JOIN events p ON e.user_id = p.user_id AND e.event_id > p.event_id")
def as_of_join(t: Tables) -> DataFrame:
    """Each event with its user's last one before: rows of both sides in one window, so a hot user sorts but never pairs."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", F.lag("event_id").over(by).alias("before"))


@query("SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_partkey * 1000 AND o_totalprice < p_partkey * 1000 + 250")
def interval_join(t: Tables) -> DataFrame:
    """Orders within a part's interval; intervals lie in bins of their own width's order, which make it an equi-join."""
    parts = t.part.select("p_partkey", (F.col("p_partkey") * 1000).alias("lo")).withColumn("bin", F.floor(F.col("lo") / 1000))
    orders = t.orders.select("o_orderkey", "o_totalprice", F.floor(F.col("o_totalprice") / 1000).alias("bin"))
    return orders.join(parts, "bin").filter("o_totalprice >= lo and o_totalprice < lo + 250").select("o_orderkey", "p_partkey")
