"""Queries over the test tables, one per operator, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.engine import Engine
from clausewise.functions import spatial
from clausewise.operators.provenance import P, ProbRelation, weighted_join
from clausewise.operators.relation import Relation, _col, column_function, percentile_threshold
from clausewise.runtime import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rel(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Relation:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Relation(df.select(*columns) if columns else df)


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    e = Engine(spark)
    for t in tables:
        e.add_table(spark.read.parquet(f"{sf_dir}/{t}.parquet"), t)
    return e


def r6(c):
    return F.round(c, 6)


# --- selections, projections, renames


@query("select_constant", "SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3")
def select_constant(spark, d):
    x = rel(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    return x.select_constants({"l_returnflag": "R", "l_linenumber": 3}).project("l_orderkey", "l_linenumber", "l_shipdate").as_set().df


@query("select_columns", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IS NOT DISTINCT FROM l_suppkey")
def select_columns(spark, d):
    return rel(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").select_columns("l_partkey", "l_suppkey").as_set().df


@query("select_expression", "SELECT DISTINCT p_partkey, p_size, p_retailprice FROM part WHERE (p_size * 2 > 60 AND p_retailprice < 1500) OR NOT (p_size <> 7)")
def select_expression(spark, d):
    return rel(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select("(p_size * 2 > 60 AND p_retailprice < 1500) OR NOT (p_size <> 7)").as_set().df


@query("select_callable", "SELECT DISTINCT p_partkey, p_size FROM part WHERE p_size % 7 = 3")
def select_callable(spark, d):
    return rel(spark, d, "part", "p_partkey", "p_size").select(lambda key, size: size % 7 == 3).as_set().df


@query("project_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def project_distinct(spark, d):
    return rel(spark, d, "orders").project("o_orderstatus", "o_orderpriority").as_set().df


@query("rename_swap", "SELECT DISTINCT s_suppkey AS s_nationkey, CAST(s_nationkey AS INTEGER) AS s_suppkey FROM supplier")
def rename_swap(spark, d):
    return rel(spark, d, "supplier", "s_suppkey", "s_nationkey").renames({"s_suppkey": "s_nationkey", "s_nationkey": "s_suppkey"}).as_set().df


@query("extended_projection", "SELECT DISTINCT l_orderkey, round(l_extendedprice * (1 - l_discount), 6) AS revenue, 'x' AS tag, l_orderkey AS again FROM lineitem")
def extended_projection(spark, d):
    x = rel(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    return x.extend({"l_orderkey": "l_orderkey", "revenue": r6(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "tag": "x", "again": "l_orderkey"}).as_set().df


@query("constant_column", "SELECT DISTINCT r_regionkey, r_name, 1 AS one FROM region")
def constant_column(spark, d):
    return rel(spark, d, "region").constant("one", 1).as_set().df


@query("replace_null", "SELECT DISTINCT c_custkey, COALESCE(s_suppkey, -1) AS s_suppkey FROM customer LEFT JOIN (SELECT s_suppkey, s_suppkey * 3 AS c_custkey FROM supplier) s USING (c_custkey)")
def replace_null(spark, d):
    s = rel(spark, d, "supplier", "s_suppkey").extend({"s_suppkey": "s_suppkey", "c_custkey": F.col("s_suppkey") * 3})
    return rel(spark, d, "customer", "c_custkey").left_join(s).replace_null("s_suppkey", -1).as_set().df


@query("explode_array", "SELECT DISTINCT vec_id, u.v AS value FROM embeddings, UNNEST(embedding) AS u(v)")
def explode_array(spark, d):
    return rel(spark, d, "embeddings", "vec_id", "embedding").explode("embedding", "value").project("vec_id", "value").as_set().df


@query("head_constant_repeat", "SELECT DISTINCT n_nationkey AS k, n_nationkey AS _1, 'nation' AS _2 FROM nation WHERE n_regionkey = 1")
def head_constant_repeat(spark, d):
    return engine(spark, d, "nation").execute("ans(k, k, 'nation') :- nation(k, n, 1).").df


# --- joins


@query("rule_asia_customers", "SELECT DISTINCT n_name AS n, c_custkey AS c FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'")
def rule_asia_customers(spark, d):
    return engine(spark, d, "nation", "region", "customer").execute("ans(n, c) :- nation(k, n, r), region(r, 'ASIA'), customer(c, nm, k, bal, seg).").df


@query("natural_join", "SELECT DISTINCT o.o_orderkey AS orderkey, o_custkey, l_partkey FROM orders o JOIN lineitem l ON o.o_orderkey IS NOT DISTINCT FROM l.l_orderkey")
def natural_join(spark, d):
    a = rel(spark, d, "orders", "o_orderkey", "o_custkey").rename("o_orderkey", "orderkey")
    b = rel(spark, d, "lineitem", "l_orderkey", "l_partkey").rename("l_orderkey", "orderkey")
    return a.natural_join(b).as_set().df


@query("equijoin", "SELECT DISTINCT n_nationkey, n_name, s_suppkey, s_nationkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def equijoin(spark, d):
    return rel(spark, d, "nation", "n_nationkey", "n_name").equijoin(rel(spark, d, "supplier", "s_suppkey", "s_nationkey"), [("n_nationkey", "s_nationkey")]).as_set().df


@query("cross_product", "SELECT DISTINCT r_name, n_name FROM region, nation")
def cross_product(spark, d):
    return rel(spark, d, "region", "r_name").product(rel(spark, d, "nation", "n_name")).as_set().df


@query("left_natural_join", "SELECT DISTINCT p_partkey, p_size, n_name FROM part LEFT JOIN (SELECT n_nationkey AS p_size, n_name FROM nation) n USING (p_size)")
def left_natural_join(spark, d):
    return rel(spark, d, "part", "p_partkey", "p_size").left_join(rel(spark, d, "nation", "n_nationkey", "n_name").rename("n_nationkey", "p_size")).as_set().df


@query("full_natural_join", "SELECT DISTINCT COALESCE(a.p_size, b.p_size) AS p_size, a.p_partkey, b.n_name FROM part a FULL JOIN (SELECT n_nationkey * 3 AS p_size, n_name FROM nation) b ON a.p_size = b.p_size")
def full_natural_join(spark, d):
    n = rel(spark, d, "nation", "n_nationkey", "n_name").extend({"p_size": F.col("n_nationkey") * 3, "n_name": "n_name"})
    return rel(spark, d, "part", "p_size", "p_partkey").full_join(n).as_set().df


@query(
    "null_safe_join",
    "WITH x AS (SELECT c_custkey, s_suppkey FROM customer LEFT JOIN (SELECT s_suppkey, s_suppkey * 50 AS c_custkey FROM supplier) s USING (c_custkey)), n AS (SELECT s_suppkey, count(*) AS n FROM x GROUP BY s_suppkey) SELECT DISTINCT x.c_custkey, x.s_suppkey, n.n FROM x JOIN n ON x.s_suppkey IS NOT DISTINCT FROM n.s_suppkey",
)
def null_safe_join(spark, d):
    s = rel(spark, d, "supplier", "s_suppkey").extend({"s_suppkey": "s_suppkey", "c_custkey": F.col("s_suppkey") * 50})
    x = rel(spark, d, "customer", "c_custkey").left_join(s)
    return x.natural_join(x.aggregate(["s_suppkey"], [("n", None, "count")])).as_set().df


@query("anti_join_negation", "SELECT DISTINCT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def anti_join_negation(spark, d):
    return engine(spark, d, "part", "lineitem").execute("returned(p) :- lineitem(o, p, s, n, q, e, di, t, 'R', st, sh), (q > 40). ans(p) :- part(p, a, b, c, si, pr), ~returned(p).").df


@query("semi_join_exists", "SELECT DISTINCT s_suppkey AS s, s_name AS n FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def semi_join_exists(spark, d):
    return engine(spark, d, "supplier", "lineitem").execute("ans(s, n) :- supplier(s, n, k, b), exists(o, p, l, q, e, di, t, r, st, sh; lineitem(o, p, s, l, q, e, di, t, r, st, sh), (q > 49)).").df


@query(
    "forall_division",
    "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_orderstatus s FROM orders WHERE o_totalprice > 300000) q WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = q.s)) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey)",
)
def forall_division(spark, d):
    orders = rel(spark, d, "orders", "o_custkey", "o_orderstatus", "o_totalprice")
    want = orders.select("o_totalprice > 300000").project("o_orderstatus")
    return orders.project("o_custkey", "o_orderstatus").divide(want).rename("o_custkey", "c").df


@query("forall_rule", "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT')")
def forall_rule(spark, d):
    # customers whose finished orders are all urgent
    e = engine(spark, d, "customer", "orders")
    return e.execute("late(c, o) :- orders(o, c, 'F', t, da, pr), (pr != '1-URGENT'). ans(c) :- customer(c, n, k, b, s), forall(o; ~late(c, o)).").df


@query("theta_join", "SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(spark, d):
    return engine(spark, d, "nation").execute("ans(a, b) :- nation(i, a, r), nation(j, b, r), (i < j).").df


@query(
    "range_join_euclid",
    "WITH p AS (SELECT vec_id AS id, CAST(round(embedding[1] * 40) AS BIGINT) AS i, CAST(round(embedding[2] * 40) AS BIGINT) AS j, CAST(round(embedding[3] * 40) AS BIGINT) AS k FROM embeddings) SELECT DISTINCT a.id AS x, b.id AS y, round(sqrt((a.i-b.i)*(a.i-b.i)+(a.j-b.j)*(a.j-b.j)+(a.k-b.k)*(a.k-b.k)), 6) AS dist FROM p a, p b WHERE (a.i-b.i)*(a.i-b.i)+(a.j-b.j)*(a.j-b.j)+(a.k-b.k)*(a.k-b.k) <= 16",
)
def range_join_euclid(spark, d):
    e = Engine(spark)
    at = lambda n: F.round(F.col("embedding")[n] * 40).cast("long")
    e.add_table(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", at(0).alias("i"), at(1).alias("j"), at(2).alias("k")), "point")
    out = e.execute("ans(x, y, dist) :- point(x, i, j, k), point(y, a, b, c), dist == EUCLIDEAN(i, j, k, a, b, c), (dist < 4).")
    return out.df.withColumn("dist", r6("dist"))


@query("direction_join", "SELECT DISTINCT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a, supplier b WHERE a.s_acctbal + 1 <= b.s_acctbal AND a.s_nationkey = b.s_nationkey")
def direction_join(spark, d):
    e = Engine(spark)
    spatial.register(e.functions)
    v = F.col("s_acctbal")
    box = F.struct(F.array(v, F.lit(0.0), F.lit(0.0)).alias("lb"), F.array(v + 1, F.lit(1.0), F.lit(1.0)).alias("ub"), F.array().cast("array<struct<i:int,j:int,k:int>>").alias("voxels"))
    e.add_table(spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey", box), "region")
    return e.execute("ans(x, y) :- region(x, n, r), region(y, n, q), left_of(r, q).").df


# --- aggregation


@query("agg_set_semantics", "SELECT k, count(*) AS count_p, sum(q) AS sum_q, max(q) AS max_q, min(q) AS min_q, avg(q) AS mean_q FROM (SELECT DISTINCT l_suppkey k, l_partkey p, l_quantity q FROM lineitem) GROUP BY k")
def agg_set_semantics(spark, d):
    e = Engine(spark)
    e.add_table(spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_quantity"), "item")
    return e.execute("ans(k, count(p), sum(q), max(q), min(q), mean(q)) :- item(k, p, q).").df


@query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT DISTINCT o_orderkey, o_totalprice FROM orders) HAVING count(*) > 0")
def agg_global(spark, d):
    x = rel(spark, d, "orders", "o_orderkey", "o_totalprice").aggregate([], [("n", None, "count"), ("total", "o_totalprice", "sum")])
    return x.df.withColumn("total", F.round("total", 2))


@query("agg_empty", "SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
def agg_empty(spark, d):
    return rel(spark, d, "orders").select("o_totalprice < 0").aggregate([], [("n", None, "count")]).df


@query("agg_statistics", "SELECT l_returnflag, round(stddev_samp(q), 6) AS std_q, round(var_samp(q), 6) AS var_q, median(q) AS median_q FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_quantity q FROM lineitem) GROUP BY l_returnflag")
def agg_statistics(spark, d):
    x = rel(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_quantity").aggregate(["l_returnflag"], [("std_q", "l_quantity", "std"), ("var_q", "l_quantity", "var"), ("median_q", "l_quantity", "median")])
    return x.df.withColumns({"std_q": r6("std_q"), "var_q": r6("var_q")})


@query("agg_percentile", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS top5 FROM (SELECT DISTINCT event_id, event_type, value FROM events) GROUP BY event_type")
def agg_percentile(spark, d):
    x = rel(spark, d, "events", "event_id", "event_type", "value").aggregate(["event_type"], [("top5", "value", column_function(percentile_threshold(95)))])
    return x.df.withColumn("top5", r6("top5"))


@query("agg_nth", "SELECT event_type, min(value) AS third FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) r FROM events) WHERE r <= 3 GROUP BY event_type")
def agg_nth(spark, d):
    return rel(spark, d, "events", "event_id", "event_type", "value").nth(["event_type"], "value", "third", 3).df


@query("top_threshold", "SELECT DISTINCT e.event_id, e.event_type, e.value FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.99) t FROM events GROUP BY event_type) q ON e.event_type = q.event_type WHERE e.value >= q.t")
def top_threshold(spark, d):
    x = rel(spark, d, "events", "event_id", "event_type", "value")
    t = x.aggregate(["event_type"], [("t", "value", column_function(percentile_threshold(99)))])
    return x.natural_join(t).select("value >= t").project("event_id", "event_type", "value").as_set().df


@query("agg_user", "SELECT k, CAST(max(q) - min(q) AS DOUBLE) AS spread_q FROM (SELECT DISTINCT l_suppkey k, l_quantity q FROM lineitem) GROUP BY k")
def agg_user(spark, d):
    e = Engine(spark)
    e.add_table(spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_quantity"), "item")
    e.add_symbol(lambda v: float(v.max() - v.min()), "spread")
    return e.execute("ans(k, spread(q)) :- item(k, q).").df


@query("aggregate_construct", "SELECT n AS n, count(*) AS m FROM (SELECT DISTINCT n_name n, c_custkey c, n_nationkey, n_regionkey, c_name, c_acctbal, c_mktsegment FROM nation JOIN customer ON n_nationkey = c_nationkey) GROUP BY n")
def aggregate_construct(spark, d):
    return engine(spark, d, "nation", "customer").execute("ans(n, m) :- AGGREGATE[n](nation(k, n, r), customer(c, nm, k, b, sg) @ count(c)) = m.").df


# --- sets


@query("union_rules", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_rules(spark, d):
    return engine(spark, d, "customer", "supplier").execute("both(k) :- customer(c, n, k, b, s). both(k) :- supplier(c, n, k, b). ans(k) :- both(k).").df


@query("intersection", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier")
def intersection(spark, d):
    return rel(spark, d, "customer", "c_custkey").rename("c_custkey", "k").intersection(rel(spark, d, "supplier", "s_suppkey").rename("s_suppkey", "k")).df


@query("difference", "SELECT l_partkey AS k FROM lineitem EXCEPT SELECT l_suppkey FROM lineitem")
def difference(spark, d):
    x = rel(spark, d, "lineitem", "l_partkey", "l_suppkey")
    return x.project("l_partkey").rename("l_partkey", "k").difference(x.project("l_suppkey").rename("l_suppkey", "k")).df


# --- scalar functions


@query("math_functions", "SELECT DISTINCT p_partkey AS k, round(exp(-p_size / 10.0) + ln(p_size) + log10(p_size) + cos(p_size) + sin(p_size) + sqrt(p_size) + p_size ** 2, 6) AS v FROM part")
def math_functions(spark, d):
    out = engine(spark, d, "part").execute("ans(k, v) :- part(k, n, b, t, s, p), v == exp(-s / 10.0) + log(s) + log10(s) + cos(s) + sin(s) + sqrt(s) + s ** 2.")
    return out.df.withColumn("v", r6("v"))


@query("string_prefix", "SELECT DISTINCT p_partkey AS k, p_type AS t FROM part WHERE starts_with(p_type, 'S')")
def string_prefix(spark, d):
    return engine(spark, d, "part").execute("ans(k, t) :- part(k, n, b, t, s, p), startswith('S', t).").df


@query("lambda_and_constants", "SELECT DISTINCT p_partkey AS k, p_size * 2 + 3 AS v FROM part WHERE p_size * 2 + 3 > 50")
def lambda_and_constants(spark, d):
    return engine(spark, d, "part").execute("shift := 3\n twice(x) := x * 2 + shift\n ans(k, v) :- part(k, n, b, t, s, p), v == twice(s), (v > 50).").df


@query("python_function", "SELECT DISTINCT p_partkey AS k, CAST(length(p_brand) * p_size AS BIGINT) AS v FROM part")
def python_function(spark, d):
    e = engine(spark, d, "part")
    e.add_symbol(lambda brand, size: len(brand) * int(size), "weight", int)
    return e.execute("ans(k, v) :- part(k, n, b, t, s, p), v == weight(b, s).").df


@query("python_table_function", "SELECT DISTINCT p_partkey AS k, CAST(p_size % m AS BIGINT) AS v FROM part, (VALUES (2), (3), (5)) t(m)")
def python_table_function(spark, d):
    e = engine(spark, d, "part")
    e.add_symbol(lambda s: [int(s) % m for m in (2, 3, 5)], "residues", list[int])
    return e.execute("ans(k, v) :- part(k, n, b, t, s, p), contains(residues(s), v).").df


# --- recursion

#: A forest over all parts: each 100 successive keys are one tree, in which a place's parent is (place - 1) div 3.
FOREST = "forest AS (SELECT DISTINCT p_partkey AS a, p_partkey - p_partkey % 100 + (p_partkey % 100 - 1) // 3 AS b FROM part WHERE p_partkey % 100 > 0)"
FOREST_TC = f"WITH RECURSIVE {FOREST}, tc AS (SELECT a, b FROM forest UNION SELECT tc.a, e.b FROM tc JOIN forest e ON tc.b = e.a)"


def _forest(spark: SparkSession, d: str) -> Engine:
    k = F.col("p_partkey")
    place = k % 100
    parts = spark.read.parquet(f"{d}/part.parquet").filter(place > 0)
    e = Engine(spark)
    e.add_table(parts.select(k.alias("a"), (k - place + F.floor((place - 1) / 3)).cast("long").alias("b")).distinct(), "edge", distinct=True)
    return e


@query("recursion_closure", f"{FOREST_TC} SELECT a AS x, b AS y FROM tc")
def recursion_closure(spark, d):
    return _forest(spark, d).execute("tc(x, y) :- edge(x, y). tc(x, y) :- tc(x, z), edge(z, y). ans(x, y) :- tc(x, y).").df


@query("recursion_nonlinear", f"{FOREST_TC} SELECT a AS x, b AS y FROM tc")
def recursion_nonlinear(spark, d):
    return _forest(spark, d).execute("tc(x, y) :- edge(x, y). tc(x, y) :- tc(x, z), tc(z, y). ans(x, y) :- tc(x, y).").df


@query("recursion_bound", f"{FOREST_TC} SELECT b AS y FROM tc WHERE a = 199")
def recursion_bound(spark, d):
    return _forest(spark, d).execute("tc(x, y) :- edge(x, y). tc(x, y) :- tc(x, z), edge(z, y). ans(y) :- tc(199, y).").df


@query(
    "recursion_same_generation",
    f"WITH RECURSIVE {FOREST}, sg AS (SELECT l.a AS x, r.a AS y FROM forest l JOIN forest r ON l.b = r.b UNION SELECT l.a, r.a FROM sg JOIN forest l ON l.b = sg.x JOIN forest r ON r.b = sg.y) SELECT x, y FROM sg",
)
def recursion_same_generation(spark, d):
    return _forest(spark, d).execute("sg(x, y) :- edge(x, p), edge(y, p). sg(x, y) :- edge(x, a), sg(a, b), edge(y, b). ans(x, y) :- sg(x, y).").df


@query("recursion_then_aggregate", f"{FOREST_TC} SELECT a AS x, count(*) AS count_y FROM tc GROUP BY a")
def recursion_then_aggregate(spark, d):
    return _forest(spark, d).execute("tc(x, y) :- edge(x, y). tc(x, y) :- tc(x, z), edge(z, y). ans(x, count(y)) :- tc(x, y).").df


@query("ontology_constraints", "SELECT DISTINCT s_suppkey AS x FROM supplier UNION SELECT c_custkey FROM customer")
def ontology_constraints(spark, d):
    e = Engine(spark)
    e.add_table(spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey"), "seller")
    e.add_table(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), "buyer")
    e.load("seller(x) -: party(x)\n buyer(x) -: party(x)\n party(x) -: signs(x, y)")
    return e.execute("ans(x) :- signs(x, y).").df


# --- probability

FACT = "pfact AS (SELECT max(least(greatest(l_discount * 10, 0), 1)) AS p, l_orderkey AS o, l_partkey AS k FROM lineitem GROUP BY ALL), pf AS (SELECT max(p) AS p, o, k FROM pfact GROUP BY o, k)"
SUPP = "ps AS (SELECT s_suppkey AS s, (s_suppkey % 10) / 10.0 AS p, s_nationkey AS n FROM supplier)"
CHOICE = "pc AS (SELECT (c_custkey % 97 + 1) / (SELECT sum(c_custkey % 97 + 1) FROM customer) AS p, c_custkey AS c FROM customer)"


def _pfact(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.least(F.greatest(F.col("l_discount") * 10, F.lit(0.0)), F.lit(1.0)).alias("p"), "l_orderkey", "l_partkey")
    return x.groupBy("l_orderkey", "l_partkey").agg(F.max("p").alias("p")).select("p", "l_orderkey", "l_partkey")


def _prob_engine(spark: SparkSession, d: str) -> Engine:
    e = engine(spark, d, "orders", "nation", "customer")
    e.add_probabilistic_facts(_pfact(spark, d), "sold")
    e.add_probabilistic_facts(spark.read.parquet(f"{d}/supplier.parquet").select(((F.col("s_suppkey") % 10) / 10.0).alias("p"), "s_suppkey", "s_nationkey"), "active")
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 97 + 1).alias("w"))
    total = c.agg(F.sum("w")).first()[0]
    e.add_probabilistic_choice(c.select((F.col("w") / F.lit(total)).alias("p"), "c_custkey"), "picked")
    return e


def _rounded(out: Relation, *names: str) -> DataFrame:
    return out.df.withColumns({n: F.round(n, 6) for n in names})


@query("prob_fact_join", f"WITH {FACT} SELECT o AS x, k AS y, round(p, 6) AS PROB_x FROM pf JOIN orders ON o_orderkey = o WHERE p > 0 AND o_orderstatus = 'F'")
def prob_fact_join(spark, d):
    return _rounded(_prob_engine(spark, d).execute("ans(x, y, PROB(x, y)) :- sold(x, y), orders(x, c, 'F', t, da, pr)."), "PROB_x")


@query("prob_noisy_or", f"WITH {FACT} SELECT k AS y, round(1 - product(1 - p), 6) AS PROB_y FROM pf GROUP BY k HAVING 1 - product(1 - p) > 0")
def prob_noisy_or(spark, d):
    return _rounded(_prob_engine(spark, d).execute("ans(y, PROB(y)) :- sold(x, y)."), "PROB_y")


@query("prob_independent_parts", f"WITH {FACT}, {SUPP}, a AS (SELECT k, 1 - product(1 - p) AS p FROM pf GROUP BY k), b AS (SELECT n, 1 - product(1 - p) AS p FROM ps GROUP BY n) SELECT k AS y, n, round(a.p * b.p, 6) AS PROB_y FROM a, b WHERE a.p * b.p > 0")
def prob_independent_parts(spark, d):
    return _rounded(_prob_engine(spark, d).execute("ans(y, n, PROB(y, n)) :- sold(x, y), active(s, n)."), "PROB_y")


@query("prob_choice_sum", f"WITH {CHOICE} SELECT c_nationkey AS n, round(sum(p), 6) AS PROB_n FROM pc JOIN customer ON c_custkey = c GROUP BY c_nationkey")
def prob_choice_sum(spark, d):
    return _rounded(_prob_engine(spark, d).execute("ans(n, PROB(n)) :- picked(c), customer(c, nm, n, b, s)."), "PROB_n")


@query("prob_uniform_choice", "SELECT n_regionkey AS r, round(count(*) / (SELECT count(*) FROM nation), 6) AS PROB_r FROM nation GROUP BY n_regionkey")
def prob_uniform_choice(spark, d):
    e = engine(spark, d, "nation")
    e.add_uniform_choice(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey"), "chosen")
    return _rounded(e.execute("ans(r, PROB(r)) :- chosen(k), nation(k, n, r)."), "PROB_r")


@query("prob_conditional", f"WITH {CHOICE}, j AS (SELECT c_nationkey n, sum(p) p FROM pc JOIN customer ON c_custkey = c WHERE c_mktsegment = 'BUILDING' GROUP BY 1), e AS (SELECT c_nationkey n, sum(p) p FROM pc JOIN customer ON c_custkey = c GROUP BY 1) SELECT n, round(j.p / e.p, 6) AS PROB_n FROM j JOIN e USING (n)")
def prob_conditional(spark, d):
    e = _prob_engine(spark, d)
    e.load("segment(c, s) :- customer(c, nm, n, b, s). home(c, n) :- customer(c, nm, n, b, s).")
    return _rounded(e.execute("ans(n, PROB(n)) :- segment(c, 'BUILDING') // (picked(c), home(c, n))."), "PROB_n")


@query("prob_body_construct", f"WITH {CHOICE} SELECT n_name AS m, round(sum(p), 6) AS p FROM pc JOIN customer ON c_custkey = c JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING sum(p) > 0.04")
def prob_body_construct(spark, d):
    e = _prob_engine(spark, d)
    e.load("from_nation(n) :- picked(c), customer(c, nm, n, b, s).")
    return _rounded(e.execute("ans(m, p) :- PROB[from_nation(n)] = p, nation(n, m, r), (p > 0.04)."), "p")


@query("prob_union", f"WITH {FACT}, {SUPP}, a AS (SELECT k, 1 - product(1 - p) AS p FROM pf GROUP BY k), u AS (SELECT k, p FROM a UNION ALL SELECT s, p FROM ps) SELECT k AS y, round(1 - product(1 - p), 6) AS PROB_y FROM u GROUP BY k HAVING 1 - product(1 - p) > 0")
def prob_union(spark, d):
    e = _prob_engine(spark, d)
    e.load("seen(y) :- sold(x, y). seen(y) :- active(y, n).")
    return _rounded(e.execute("ans(y, PROB(y)) :- seen(y)."), "PROB_y")


@query("prob_negation", f"WITH {FACT}, {SUPP} SELECT s, round(1 - p, 6) AS PROB_s FROM ps WHERE 1 - p > 0")
def prob_negation(spark, d):
    e = _prob_engine(spark, d)
    e.add_table(spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey"), "supplier")
    return _rounded(e.execute("ans(s, PROB(s)) :- supplier(s, n), ~active(s, n)."), "PROB_s")


@query(
    "prob_inclusion_exclusion",
    f"WITH {FACT}, a AS (SELECT k, 1 - product(1 - p) AS p FROM pf GROUP BY k) SELECT k AS y, round(p * (1 - (1 - p_size / 100.0) * (1 - (p_partkey % 10) / 10.0)), 6) AS PROB_y FROM a JOIN part ON p_partkey = k WHERE p * (1 - (1 - p_size / 100.0) * (1 - (p_partkey % 10) / 10.0)) > 0",
)
def prob_inclusion_exclusion(spark, d):
    e = _prob_engine(spark, d)
    part = spark.read.parquet(f"{d}/part.parquet")
    e.add_probabilistic_facts(part.select((F.col("p_size") / 100.0).alias("p"), "p_partkey"), "liked")
    e.add_probabilistic_facts(part.select(((F.col("p_partkey") % 10) / 10.0).alias("p"), "p_partkey"), "stocked")
    e.load("hit(y) :- sold(x, y), liked(y). hit(y) :- sold(x, y), stocked(y).")
    return _rounded(e.execute("ans(y, PROB(y)) :- hit(y)."), "PROB_y")


@query("prob_contained_disjunct", f"WITH {FACT} SELECT k AS y, round(1 - product(1 - p), 6) AS PROB_y FROM pf GROUP BY k HAVING 1 - product(1 - p) > 0")
def prob_contained_disjunct(spark, d):
    e = _prob_engine(spark, d)
    e.load("hit(y) :- sold(x, y). hit(y) :- sold(x, y), sold(x, z).")
    return _rounded(e.execute("ans(y, PROB(y)) :- hit(y)."), "PROB_y")


@query("prob_self_join_ranked", f"WITH {SUPP} SELECT n, round(1 - product(1 - p) * (1 + sum(p / (1 - p))), 6) AS PROB_n FROM ps GROUP BY n HAVING 1 - product(1 - p) * (1 + sum(p / (1 - p))) > 1e-9")
def prob_self_join_ranked(spark, d):
    # at least two active suppliers, by ranking
    return _rounded(_prob_engine(spark, d).execute("ans(n, PROB(n)) :- active(x, n), active(y, n), (x < y)."), "PROB_n")


@query("prob_query_based_fact", "SELECT p_brand AS b, round(1 - product(1 - p_size / 100.0), 6) AS PROB_b FROM (SELECT DISTINCT p_partkey, p_brand, p_size FROM part) GROUP BY p_brand")
def prob_query_based_fact(spark, d):
    e = engine(spark, d, "part")
    e.load("likely(k, b) :: s / 100.0 :- part(k, n, b, t, s, p).")
    return _rounded(e.execute("ans(b, PROB(b)) :- likely(k, b)."), "PROB_b")


@query("prob_post_aggregate", f"WITH {CHOICE}, q AS (SELECT c_nationkey n, sum(p) p FROM pc JOIN customer ON c_custkey = c GROUP BY 1) SELECT n_regionkey AS r, round(max(p), 6) AS max_p FROM q JOIN nation ON n_nationkey = n GROUP BY 1")
def prob_post_aggregate(spark, d):
    e = _prob_engine(spark, d)
    e.load("share(n, PROB(n)) :- picked(c), customer(c, nm, n, b, s).")
    return _rounded(e.execute("ans(r, max(p)) :- share(n, p), nation(n, m, r)."), "max_p")


@query("prob_universal_projection", f"WITH {FACT} SELECT k, round(product(p), 6) AS _p FROM pf GROUP BY k")
def prob_universal_projection(spark, d):
    x = ProbRelation(Relation(_pfact(spark, d).toDF(P, "o", "k"), True)).project_universal("k")
    return x.rel.df.withColumn(P, F.round(P, 6))


@query("prob_difference", f"WITH {FACT}, a AS (SELECT k, 1 - product(1 - p) p FROM pf GROUP BY k), b AS (SELECT s_suppkey k, (s_suppkey % 10) / 10.0 p FROM supplier) SELECT a.k, round(a.p * (1 - COALESCE(b.p, 0)), 6) AS _p FROM a LEFT JOIN b USING (k)")
def prob_difference(spark, d):
    a = ProbRelation(Relation(_pfact(spark, d).toDF(P, "o", "k"), True)).project_independent("k")
    b = ProbRelation(Relation(spark.read.parquet(f"{d}/supplier.parquet").select(((F.col("s_suppkey") % 10) / 10.0).alias(P), F.col("s_suppkey").alias("k")), True))
    return a.minus(b).rel.df.select("k", F.round(_col(P), 6).alias(P))


@query("prob_weighted_join", "WITH a AS (SELECT n_nationkey k, 0.5 p FROM nation WHERE n_nationkey < 15), b AS (SELECT n_nationkey k, 0.25 p FROM nation WHERE n_nationkey >= 10) SELECT k, round(2 * COALESCE(a.p, 0) - COALESCE(b.p, 0), 6) AS _p FROM a FULL JOIN b USING (k)")
def prob_weighted_join(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    a = ProbRelation(Relation(n.filter("k < 15").withColumn(P, F.lit(0.5)), True))
    b = ProbRelation(Relation(n.filter("k >= 10").withColumn(P, F.lit(0.25)), True))
    return weighted_join([a, b], [2.0, -1.0]).rel.df.withColumn(P, F.round(P, 6))
