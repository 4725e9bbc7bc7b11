"""Queries of whole programs: text facts, commands, probabilistic statements, Python and English rules, regions, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.config import build_engine
from clausewise.dsl import Dsl
from clausewise.engine import Engine
from clausewise.english import execute as english
from clausewise.functions import spatial
from clausewise.operators.provenance import P, ProbRelation
from clausewise.operators.relation import Relation, _col
from clausewise.plans.fixpoint import solve_recursive
from clausewise.queries import CHOICE, FACT, FOREST_TC, SUPP, _forest, _pfact, _prob_engine, _rounded, engine, query, rel
from clausewise.runtime import shared_dir


def frame(spark: SparkSession, sf_dir: str, table: str, *columns) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def values(spark: SparkSession, **named) -> DataFrame:
    """One row of driver-side results."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in named.items()])


# --- facts of text programs


@query("text_facts", "SELECT DISTINCT s_suppkey AS s, t.l AS l FROM supplier JOIN (VALUES (1, 'a'), (2, 'b'), (3, 'c'), (7, 'c')) t(k, l) ON s_nationkey = t.k")
def text_facts(spark, d):
    return engine(spark, d, "supplier").execute("label(1, 'a'). label(2, 'b'). label(3, 'c'). label(7, 'c'). ans(s, l) :- supplier(s, n, k, b), label(k, l).").df


@query("negative_fact", "SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_regionkey = 2")
def negative_fact(spark, d):
    # the program says that no nation has key -1; the engine checks that nothing derives it
    return engine(spark, d, "nation").execute("asian(k) :- nation(k, n, 2).\n~asian(-1)\nans(k) :- asian(k).").df


@query("text_prob_facts", f"WITH {SUPP}, w AS (SELECT * FROM (VALUES (0.9, 1), (0.25, 2), (0.5, 3)) t(q, n)) SELECT s, round(p * q, 6) AS PROB_s FROM ps JOIN w USING (n) WHERE p > 0")
def text_prob_facts(spark, d):
    return _rounded(_prob_engine(spark, d).execute("0.9 :: open(1). 0.25 :: open(2). 0.5 :: open(3). ans(s, PROB(s)) :- active(s, n), open(n)."), "PROB_s")


@query("text_choice_facts", "WITH w AS (SELECT * FROM (VALUES (0.25, 1), (0.25, 2), (0.5, 3)) t(q, r)) SELECT n_nationkey AS k, round(q, 6) AS PROB_k FROM nation JOIN w ON n_regionkey = r")
def text_choice_facts(spark, d):
    return _rounded(engine(spark, d, "nation").execute("0.25 ^ site(1). 0.25 ^ site(2). 0.5 ^ site(3). ans(k, PROB(k)) :- site(r), nation(k, n, r)."), "PROB_k")


# --- sources


def _csv(spark: SparkSession, sf_dir: str, suffix: str, sep: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}{suffix}"
    frame(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").write.option("sep", sep).option("header", True).csv(path, compression="gzip")
    return path


@query("load_csv", "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def load_csv(spark, d):
    return Engine(spark).execute(f".load_csv('{_csv(spark, d, '.csv', ',')}', name='buyer')\nans(c) :- buyer(c, n, 'BUILDING').").df.select(F.col("c").cast("long"))


@query("engine_description", "SELECT DISTINCT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = 3")
def engine_description(spark, d):
    e = build_engine(spark, {"tables": {"buyer": _csv(spark, d, ".tsv", "\t"), "nation": f"{d}/nation.parquet"}, "constants": {"home": 3}, "program": "near(c, n) :- buyer(c, k, s), nation(k, n, r), (k == home)."})
    return e.execute("ans(c, n) :- near(c, n).").df.select(F.col("c").cast("long"), "n")


@query("view_of_relation", "SELECT DISTINCT n_name AS n FROM nation WHERE n_regionkey = 3")
def view_of_relation(spark, d):
    e = engine(spark, d, "nation")
    e.create_view("country", "nation")
    return e.execute("ans(n) :- country(k, n, 3).").df


# --- sinks


@query("sink_scalars", "SELECT count(*) AS n, count(*) > 0 AS some, bool_or(o_orderkey = 1) AS has_one, false AS has_none, true AS same, min(o_orderkey) AS least, min(o_orderkey) AS fetched FROM orders")
def sink_scalars(spark, d):
    x = rel(spark, d, "orders", "o_orderkey")
    least = next(iter(Relation(x.sort(["o_orderkey"]).limit(1), True)))[0]
    return values(spark, n=len(x), some=bool(x), has_one=(1,) in x, has_none=(-1,) in x, same=x.equals(x.union(x)), least=least, fetched=Relation(x.sort(["o_orderkey:asc", "zz"])).fetch_one()[0])


@query("sink_pandas", "SELECT DISTINCT r_regionkey, r_name FROM region")
def sink_pandas(spark, d):
    return spark.createDataFrame(rel(spark, d, "region").to_pandas(), "r_regionkey int, r_name string")


@query("output_sort", "SELECT o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 10")
def output_sort(spark, d):
    # a top-10 report
    top = rel(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderkey").sort(["o_totalprice:desc", "o_orderkey"]).limit(10)
    rows = [(r["o_custkey"], r["o_totalprice"], k + 1) for k, r in enumerate(top.collect())]
    return spark.createDataFrame(rows, "o_custkey long, o_totalprice double, place long")


@query("group_iterator", "SELECT r_name AS k, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_iterator(spark, d):
    x = rel(spark, d, "nation", "n_name", "n_regionkey").rename("n_regionkey", "r_regionkey").natural_join(rel(spark, d, "region"))
    return spark.createDataFrame([(key[0], len(rows)) for key, rows in x.groups("r_name")], "k string, n long")


# --- unnamed relations and sets


@query("unnamed_projection", "SELECT DISTINCT l_suppkey AS _0, l_partkey AS _1, l_suppkey AS _2 FROM lineitem")
def unnamed_projection(spark, d):
    x = rel(spark, d, "lineitem", "l_partkey", "l_suppkey").unnamed()
    return x.extend({"_0": "_1", "_1": "_0", "_2": "_1"}).as_set().df


@query("named_columns", "SELECT DISTINCT s_suppkey AS key, s_nationkey AS home FROM supplier")
def named_columns(spark, d):
    return rel(spark, d, "supplier", "s_suppkey", "s_nationkey").unnamed().named("key", "home").as_set().df


@query("in_place_sets", "(SELECT c_nationkey AS k FROM customer UNION SELECT -1) EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 5 EXCEPT SELECT 24")
def in_place_sets(spark, d):
    x = rel(spark, d, "customer", "c_nationkey").rename("c_nationkey", "k")
    x |= Relation.of(spark, [(-1,)], "k int")
    x -= Relation(frame(spark, d, "supplier", "s_suppkey", F.col("s_nationkey").alias("k")).filter("s_suppkey < 5").select("k"))
    x -= Relation.of(spark, [(24,)], "k int")
    return x.df


# --- aggregation


@query("agg_user_and_native", "SELECT k, sum(q) AS sum_q, CAST(max(q) - min(q) AS DOUBLE) AS spread_q, max(q) AS max_q FROM (SELECT DISTINCT l_suppkey k, l_quantity q FROM lineitem) GROUP BY k")
def agg_user_and_native(spark, d):
    e = Engine(spark)
    e.add_table(frame(spark, d, "lineitem", "l_suppkey", "l_quantity"), "item")
    e.add_symbol(lambda v: float(v.max() - v.min()), "spread")
    return e.execute("ans(k, sum(q), spread(q), max(q)) :- item(k, q).").df


@query("agg_user_columns", "SELECT k, round(sum(q * x), 4) AS dot_q FROM (SELECT DISTINCT l_suppkey k, l_quantity q, l_discount x FROM lineitem) GROUP BY k")
def agg_user_columns(spark, d):
    e = Engine(spark)
    e.add_table(frame(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_discount"), "item")
    e.add_symbol(lambda a, b: float((a * b).sum()), "dot")
    return e.execute("ans(k, dot(q, x)) :- item(k, q, x).").df.withColumn("dot_q", F.round("dot_q", 4))


@query("agg_expression", "SELECT k, round(sum(e * (1 - x)), 4) AS sum FROM (SELECT DISTINCT l_suppkey k, l_extendedprice e, l_discount x FROM lineitem) GROUP BY k")
def agg_expression(spark, d):
    e = Engine(spark)
    e.add_table(frame(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount"), "item")
    out = e.execute("ans(k, sum(e * (1 - x))) :- item(k, e, x).").df
    return out.toDF("k", "sum").withColumn("sum", F.round("sum", 4))


# --- terms


@query("external_value", "SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 45")
def external_value(spark, d):
    e = engine(spark, d, "part")
    e.host["least_size"] = 45
    return e.execute("ans(k) :- part(k, n, b, t, s, p), (s > @least_size).").df


@query("regexp_and_isin", "SELECT DISTINCT p_partkey AS k FROM part WHERE regexp_matches(p_brand, '#[1-3]') OR p_size IN (1, 2, 3)")
def regexp_and_isin(spark, d):
    e = engine(spark, d, "part")
    e.add_symbol([1, 2, 3], "small")
    return e.execute("pick(k) :- part(k, n, b, t, s, p), regexp('#[1-3]', b). pick(k) :- part(k, n, b, t, s, p), isin(s, small). ans(k) :- pick(k).").df


@query("row_wise_functions", "SELECT DISTINCT p_partkey AS k, round(greatest(p_size, 10) + least(p_size, 20) + (p_size + 10 + p_partkey) / 3.0 + (p_size + 10), 6) AS v FROM part")
def row_wise_functions(spark, d):
    out = engine(spark, d, "part").execute("ans(k, v) :- part(k, n, b, t, s, p), v == row_max(s, 10) + row_min(s, 20) + row_mean(s, 10, k) + row_sum(s, 10).")
    return out.df.withColumn("v", F.round("v", 6))


@query("tuple_terms", "SELECT DISTINCT p_partkey AS k, p_size + 1 AS v FROM part WHERE p_size > 25")
def tuple_terms(spark, d):
    return engine(spark, d, "part").execute("ans(k, v) :- part(k, n, b, t, s, p), u == (s, k), v == item(u, 0) + 1, (item(u, 0) > 25).").df


@query("function_as_filter", "SELECT DISTINCT p_partkey AS k FROM part WHERE p_size % 2 = 1")
def function_as_filter(spark, d):
    e = engine(spark, d, "part")
    e.add_symbol(lambda s: int(s) % 2 == 1, "odd", bool)
    return e.execute("ans(k) :- part(k, n, b, t, s, p), odd(s).").df


# --- rules


@query("boolean_query", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F') AS some, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'none') AS none")
def boolean_query(spark, d):
    e = engine(spark, d, "orders")
    return values(spark, some=e.query("orders(o, c, 'F', t, da, pr)"), none=e.query("orders(o, c, 'none', t, da, pr)"))


@query("query_variables", "SELECT DISTINCT n_name AS n FROM nation WHERE n_regionkey = 4")
def query_variables(spark, d):
    return engine(spark, d, "nation").query(("n",), "nation(k, n, 4)").df


@query("solve_all", "SELECT 'rich' AS p, count(*) AS n FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT 'rich_nation', count(*) FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def solve_all(spark, d):
    e = engine(spark, d, "customer")
    e.load("rich(c, k) :- customer(c, n, k, b, s), (b > 9000). rich_nation(k) :- rich(c, k).")
    return spark.createDataFrame([(p, len(r)) for p, r in sorted(e.solve_all().items())], "p string, n long")


@query("disjunction_body", "SELECT DISTINCT p_partkey AS k FROM part WHERE p_size < 3 OR p_size > 48")
def disjunction_body(spark, d):
    e = Dsl(engine(spark, d, "part"))
    return e.query(e.k, e.part[e.k, e.n, e.b, e.t, e.s, e.p] & ((e.s < 3) | (e.s > 48))).df


@query("recursion_naive", f"{FOREST_TC} SELECT a AS x, b AS y FROM tc")
def recursion_naive(spark, d):
    e = _forest(spark, d)
    e.load("tc(x, y) :- edge(x, y). tc(x, y) :- tc(x, z), edge(z, y).")
    return solve_recursive(["tc"], {"tc": e.rules["tc"]}, e._rule_rows, naive=True)["tc"].named("x", "y").df


@query("recursion_bound_negation", f"{FOREST_TC} SELECT b AS y FROM tc WHERE a = 199 AND b NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 0)")
def recursion_bound_negation(spark, d):
    # the bound argument reaches the recursion though a rule above it negates
    e = _forest(spark, d)
    e.add_table(frame(spark, d, "part", "p_partkey").filter("p_partkey % 4 = 0"), "fourth")
    return e.execute("tc(x, y) :- edge(x, y). tc(x, y) :- tc(x, z), edge(z, y). odd(x, y) :- tc(x, y), ~fourth(y). ans(y) :- odd(199, y).").df


@query("recursion_bound_aggregate", f"{FOREST_TC} SELECT count(*) AS n FROM tc WHERE a = 199")
def recursion_bound_aggregate(spark, d):
    e = _forest(spark, d)
    return e.execute("tc(x, y) :- edge(x, y). tc(x, y) :- tc(x, z), edge(z, y). above(x, count(y)) :- tc(x, y). ans(n) :- above(199, n).").df


# --- probability


@query("prob_head_brackets", f"WITH {CHOICE} SELECT c_nationkey AS n, round(sum(p), 6) AS prob FROM pc JOIN customer ON c_custkey = c GROUP BY c_nationkey")
def prob_head_brackets(spark, d):
    out = _prob_engine(spark, d).execute("PROB[home(n)] :- picked(c), customer(c, nm, n, b, s). ans(n, p) :- home(n, p).")
    return out.df.toDF("n", "prob").withColumn("prob", F.round("prob", 6))


@query("prob_succ", f"WITH {CHOICE} SELECT c_nationkey AS n, round(sum(p), 6) AS p FROM pc JOIN customer ON c_custkey = c GROUP BY c_nationkey")
def prob_succ(spark, d):
    e = _prob_engine(spark, d)
    e.load("home(n) :- picked(c), customer(c, nm, n, b, s).")
    return _rounded(e.execute("ans(n, p) :- SUCC[home(n)] = p."), "p")


@query("prob_marg", f"WITH {CHOICE}, j AS (SELECT c_nationkey n, sum(p) p FROM pc JOIN customer ON c_custkey = c WHERE c_mktsegment = 'BUILDING' GROUP BY 1), e AS (SELECT c_nationkey n, sum(p) p FROM pc JOIN customer ON c_custkey = c GROUP BY 1) SELECT n, round(j.p / e.p, 6) AS p FROM j JOIN e USING (n)")
def prob_marg(spark, d):
    e = _prob_engine(spark, d)
    e.load("segment(c, s) :- customer(c, nm, n, b, s). home(c, n) :- customer(c, nm, n, b, s).")
    return _rounded(e.execute("builds(n) :- segment(c, 'BUILDING'), picked(c), home(c, n). lives(n) :- picked(c), home(c, n). ans(n, p) :- MARG[builds(n) | lives(n)] = p."), "p")


@query("prob_choice_rule", "WITH w AS (SELECT c_custkey c, c_nationkey n, (c_custkey % 7 + 1) / (SELECT sum(c_custkey % 7 + 1) FROM customer) AS p FROM customer) SELECT n, round(sum(p), 6) AS PROB_n FROM w GROUP BY n")
def prob_choice_rule(spark, d):
    e = Engine(spark)
    c = frame(spark, d, "customer", "c_custkey", "c_nationkey", (F.col("c_custkey") % 7 + 1).alias("w"))
    e.add_table(c, "weighted")
    e.functions.constants["total"] = c.agg(F.sum("w")).first()[0]
    return _rounded(e.execute("drawn(c, n) ^ w / total :- weighted(c, n, w). ans(n, PROB(n)) :- drawn(c, n)."), "PROB_n")


@query("prob_tuple_unicity", f"WITH {SUPP} SELECT s, round(p, 6) AS PROB_s FROM ps WHERE p > 0")
def prob_tuple_unicity(spark, d):
    e = Engine(spark, check_unicity=True)
    e.add_probabilistic_facts(frame(spark, d, "supplier", (F.col("s_suppkey") % 10 / 10.0).alias("p"), "s_suppkey"), "active")
    return _rounded(e.execute("ans(s, PROB(s)) :- active(s)."), "PROB_s")


@query("prob_choice_self_join", f"WITH {CHOICE} SELECT c AS x, c AS y, round(p, 6) AS PROB_x FROM pc")
def prob_choice_self_join(spark, d):
    # two atoms of one choice hold together only for one alternative
    out = _prob_engine(spark, d).execute("ans(x, y, PROB(x, y)) :- picked(x), picked(y).")
    return _rounded(out, "PROB_x")


@query("prob_lineage_choice", "WITH c AS (SELECT s_nationkey AS n, count(*) / (SELECT count(*) FROM supplier) AS p FROM supplier GROUP BY 1), f AS (SELECT n_nationkey AS n, (n_nationkey % 10) / 10.0 AS q, n_regionkey AS r FROM nation) SELECT r, round(sum(p * q), 6) AS PROB_r FROM c JOIN f USING (n) GROUP BY r HAVING sum(p * q) > 0")
def prob_lineage_choice(spark, d):
    # choices in exact counting
    e = Engine(spark)
    e.methods = ("lineage",)
    e.add_uniform_choice(frame(spark, d, "supplier", "s_suppkey", "s_nationkey"), "drawn")
    e.add_probabilistic_facts(frame(spark, d, "nation", (F.col("n_nationkey") % 10 / 10.0).alias("p"), "n_nationkey", "n_regionkey"), "open")
    return _rounded(e.execute("ans(r, PROB(r)) :- drawn(s, n), open(n, r)."), "PROB_r")


@query("prob_self_join_lineage", "WITH f AS (SELECT n_nationkey n, (n_nationkey % 10) / 10.0 p, n_regionkey r FROM nation) SELECT a.n AS x, b.n AS y, round(CASE WHEN a.n = b.n THEN a.p ELSE a.p * b.p END, 6) AS PROB_x FROM f a JOIN f b USING (r) WHERE a.p * b.p > 0")
def prob_self_join_lineage(spark, d):
    # a self-join over head variables has no lifted plan: each answer's lineage is counted
    e = Engine(spark)
    e.add_probabilistic_facts(frame(spark, d, "nation", (F.col("n_nationkey") % 10 / 10.0).alias("p"), "n_nationkey", "n_regionkey"), "open")
    return _rounded(e.execute("ans(x, y, PROB(x, y)) :- open(x, r), open(y, r)."), "PROB_x")


@query("provenance_algebra", f"WITH {FACT} SELECT k AS part, 'seen' AS tag, round(p, 6) AS {P} FROM pf WHERE o % 2 = 0")
def provenance_algebra(spark, d):
    x = ProbRelation(Relation(_pfact(spark, d).toDF(P, "o", "k"), True))
    out = ProbRelation(x.rel.select("o % 2 = 0").rename("k", "part").constant("tag", "seen"))
    return out.rel.df.select("part", "tag", F.round(_col(P), 6).alias(P))


# --- front ends


@query("python_rules", "SELECT DISTINCT n_name AS n, c_custkey AS c FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'EUROPE' AND c_acctbal > 5000")
def python_rules(spark, d):
    e = Dsl(engine(spark, d, "nation", "region", "customer"))
    e.european[e.k, e.n] = e.nation[e.k, e.n, e.r] & e.region[e.r, "EUROPE"]
    return e.query((e.n, e.c), e.european[e.k, e.n] & e.customer[e.c, e.m, e.k, e.b, e.s] & (e.b > 5000)).df


@query("python_quantifiers", "SELECT DISTINCT n_nationkey AS k FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < -900)")
def python_quantifiers(spark, d):
    e = Dsl(engine(spark, d, "nation", "customer", "supplier"))
    e.poor[e.k, e.s] = e.supplier[e.s, e.n, e.k, e.b] & (e.b < -900)
    return e.query(e.k, e.nation[e.k, e.m, e.r] & e.exists((e.c, e.n, e.b, e.g), e.customer[e.c, e.n, e.k, e.b, e.g]) & e.all(e.s, ~e.poor[e.k, e.s])).df


@query("python_probabilities", f"WITH {SUPP} SELECT n, round(1 - product(1 - p), 6) AS PROB_n FROM ps GROUP BY n HAVING 1 - product(1 - p) > 0")
def python_probabilities(spark, d):
    e = Dsl(_prob_engine(spark, d))
    e.likely[e.n, e.PROB[e.n]] = e.active[e.s, e.n]
    return e.query((e.n, e.PROB_n), e.likely[e.n, e.PROB_n]).df.withColumn("PROB_n", F.round("PROB_n", 6))


def _trade(spark: SparkSession, sf_dir: str) -> Engine:
    """Words for English programs: who spends much, where sellers are, what brands sell."""
    e = Engine(spark)
    e.add_table(frame(spark, sf_dir, "customer", "c_custkey"), "buyer")
    e.add_table(frame(spark, sf_dir, "orders", "o_custkey", "o_totalprice").filter("o_totalprice > 350000").select("o_custkey").distinct(), "splurges")
    e.add_table(frame(spark, sf_dir, "supplier", "s_suppkey"), "seller")
    e.add_table(frame(spark, sf_dir, "nation", "n_nationkey"), "country")
    e.add_table(frame(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey"), "hosts")
    e.add_table(frame(spark, sf_dir, "part", "p_size").distinct(), "dimension")
    e.add_table(frame(spark, sf_dir, "part", "p_brand").distinct(), "brand")
    e.add_table(frame(spark, sf_dir, "part", "p_brand", "p_size").distinct(), "sells_at")
    return e


def english_query(name: str, sql: str, text: str, *names: str):
    @query(name, sql)
    def run(spark, d):
        df = english(_trade(spark, d), text).df.toDF(*names)
        return df.withColumns({n: F.round(n, 6) for n, k in df.dtypes if k == "double"})

    return run


english_query("english_verb", "SELECT DISTINCT c_custkey AS b FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 350000", "obtain every Buyer that splurges.", "b")
english_query("english_negation", "SELECT DISTINCT c_custkey AS b FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)", "obtain every Buyer that does not splurges.", "b")
english_query("english_definition", "SELECT DISTINCT s_nationkey AS k FROM supplier", "define as Base every Country that hosts a Seller. obtain every Base.", "k")
english_query("english_inverse", "SELECT DISTINCT s_suppkey AS s FROM supplier", "obtain every Seller that a Country hosts.", "s")
english_query("english_count", "SELECT count(DISTINCT n_nationkey) AS n FROM nation", "obtain every Count of the Country.", "n")
english_query("english_top", "SELECT min(p_size) AS t FROM (SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 3)", "obtain the Top 3 of the Dimension.", "t")
english_query("english_percent", "SELECT round(quantile_cont(p_size, 0.9), 6) AS t FROM (SELECT DISTINCT p_size FROM part)", "obtain the Top 10% of the Dimension.", "t")
english_query("english_grouped", "SELECT p_brand AS b, max(p_size) AS m FROM part GROUP BY 1", "define as widest for every Brand ?b ; where every Max of the Dimension where ?b sells_at per ?b. obtain every Widest.", "b", "m")
english_query("english_choice", "SELECT s_nationkey AS k, round(count(*) / (SELECT count(*) FROM supplier), 6) AS p FROM supplier GROUP BY 1", "define as Drawn as an equiprobable choice over every Seller. define as Site with probability every Country that hosts a Drawn. obtain every Site.", "k", "p")


# --- space


def _boxes(spark: SparkSession, sf_dir: str) -> Engine:
    """Suppliers as unit boxes along an account axis, a nation axis and a key axis."""
    e = Engine(spark)
    spatial.register(e.functions)
    at = [F.floor(F.col("s_acctbal") / 100).cast("double"), F.col("s_nationkey").cast("double"), F.floor(F.col("s_suppkey") / 10).cast("double")]
    box = F.struct(F.array(*at).alias("lb"), F.array(*[a + 1 for a in at]).alias("ub"), F.array().cast("array<struct<i:int,j:int,k:int>>").alias("voxels"))
    e.add_table(frame(spark, sf_dir, "supplier", "s_suppkey", F.floor(F.col("s_suppkey") / 20).alias("g"), box.alias("r")), "box")
    return e


BOX = "b AS (SELECT s_suppkey AS s, floor(s_suppkey / 20) AS g, floor(s_acctbal / 100) AS x, s_nationkey AS y, floor(s_suppkey / 10) AS z FROM supplier)"
for _name, _test in {
    "right_of": "b.x + 1 <= a.x",
    "posterior_of": "a.y + 1 <= b.y",
    "anterior_of": "b.y + 1 <= a.y",
    "inferior_of": "a.z + 1 <= b.z",
    "superior_of": "b.z + 1 <= a.z",
    "overlapping": "a.x < b.x + 1 AND b.x < a.x + 1 AND a.y < b.y + 1 AND b.y < a.y + 1 AND a.z < b.z + 1 AND b.z < a.z + 1",
    "anatomical_left_of": "a.x + 1 <= b.x AND NOT (b.x + 1 <= a.x)",
}.items():
    query(f"direction_{_name}", f"WITH {BOX} SELECT a.s AS x, b.s AS y FROM b a, b b WHERE a.g = b.g AND {_test}")(lambda spark, d, _name=_name: _boxes(spark, d).execute(f"ans(x, y) :- box(x, g, r), box(y, g, q), {_name}(r, q).").df)


@query("direction_matrix", f"WITH {BOX} SELECT a.s AS x, b.s AS y, CASE WHEN a.x + 1 <= b.x THEN -1 WHEN a.x >= b.x + 1 THEN 1 ELSE 0 END AS dx, CASE WHEN a.y + 1 <= b.y THEN -1 WHEN a.y >= b.y + 1 THEN 1 ELSE 0 END AS dy FROM b a, b b WHERE a.g = b.g")
def direction_matrix(spark, d):
    pairs = _boxes(spark, d).execute("ans(x, y, r, q) :- box(x, g, r), box(y, g, q).").df
    signs = spatial.direction_signs(F.col("r"), F.col("q"))
    return pairs.select("x", "y", signs[0].alias("dx"), signs[1].alias("dy"))


@query("interval_relations", "WITH o AS (SELECT o_custkey c, min(o_orderkey) lo, max(o_orderkey) hi FROM orders GROUP BY 1), j AS (SELECT a.c AS c, a.lo al, a.hi ah, b.lo bl, b.hi bh FROM o a JOIN o b ON b.c = a.c + 1) SELECT c, ah < bl AS before, ah = bl AS meets, al < bl AND bl < ah AND ah < bh AS overlaps, al > bl AND ah < bh AS during, al = bl AND ah < bh AS starts, ah = bh AND al > bl AS finishes, al = bl AND ah = bh AS equals FROM j")
def interval_relations(spark, d):
    spans = frame(spark, d, "orders", "o_custkey", "o_orderkey").groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    later = spans.select((F.col("c") - 1).alias("c"), F.col("lo").alias("bl"), F.col("hi").alias("bh"))
    pairs = spans.join(later, "c")
    a, b = (F.col("lo"), F.col("hi")), (F.col("bl"), F.col("bh"))
    return pairs.select("c", *[r(a, b).alias(n) for n, r in spatial.RELATIONS.items()])


#: Voxels: of each nation, one per supplier.
VOXEL = "v AS (SELECT DISTINCT s_nationkey AS n, s_suppkey % 7 AS i, s_suppkey % 5 AS j, s_suppkey % 3 AS k FROM supplier)"


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return frame(spark, sf_dir, "supplier", F.col("s_nationkey").alias("n"), (s % 7).alias("i"), (s % 5).alias("j"), (s % 3).alias("k"))


@query("region_aggregate", f"WITH {VOXEL} SELECT n, CAST(min(i) AS DOUBLE) AS low, CAST(max(i) + 1 AS DOUBLE) AS high, count(*) AS size FROM v GROUP BY n")
def region_aggregate(spark, d):
    e = Engine(spark)
    spatial.register(e.functions)
    e.add_table(_voxels(spark, d), "vox")
    e.load("reg(n, create_region(i, j, k)) :- vox(n, i, j, k).")
    r = e.relation("reg").df.toDF("n", "r")
    return r.select("n", F.col("r.lb")[0].alias("low"), F.col("r.ub")[0].alias("high"), F.size("r.voxels").cast("long").alias("size"))


@query("region_algebra", f"WITH {VOXEL}, a AS (SELECT n + 1 AS n, i, j, k FROM v), s AS (SELECT n, i, j, k, 1 AS l, 0 AS r FROM v UNION ALL SELECT n, i, j, k, 0, 1 FROM a), m AS (SELECT n, i, j, k, max(l) AS l, max(r) AS r FROM s GROUP BY ALL) SELECT n, count(*) AS both, sum(l * r) AS common, sum(l * (1 - r)) AS only FROM m GROUP BY n HAVING max(l) = 1 AND max(r) = 1")
def region_algebra(spark, d):
    r = spatial.regions_of(_voxels(spark, d), ["n"])
    other = r.select((F.col("n") + 1).alias("n"), F.col("region").alias("other"))
    a, b = F.col("region"), F.col("other")
    made = {"both": spatial.region_union(a, b), "common": spatial.region_intersection(a, b), "only": spatial.region_difference(a, b)}
    return r.join(other, "n").select("n", *[F.size(x["voxels"]).cast("long").alias(n) for n, x in made.items()])


@query("region_voxels", f"WITH {VOXEL} SELECT n, i, j, k FROM v")
def region_voxels(spark, d):
    return spatial.voxels(spatial.regions_of(_voxels(spark, d), ["n"]))


@query("principal_regions", f"WITH {VOXEL} SELECT n, count(*) AS size FROM v GROUP BY n ORDER BY size DESC, n LIMIT 5")
def principal_regions(spark, d):
    # a top-5 report; equal sizes go by key
    r = spatial.regions_of(_voxels(spark, d), ["n"])
    return spatial.principal_regions(r, 5, ties=["n"]).select("n", F.size("region.voxels").cast("long").alias("size"))
