import random

import pytest
from pyspark.sql import functions as F

from clausewise.operators.provenance import P, ProbRelation, weighted_join
from clausewise.operators.relation import Relation, RelationError, column_function, percentile_threshold


@pytest.fixture(scope="module")
def r1(spark):
    return Relation.of(spark, [(i, 2 * i) for i in range(10)], ["a", "b"])


@pytest.fixture(scope="module")
def r2(spark):
    return Relation.of(spark, [(2 * i, 3 * i) for i in range(10)], ["b", "c"])


def test_selection(r1):
    assert r1.select_constants({"a": 3}).rows() == {(3, 6)}
    assert r1.select_constants({"a": 3, "b": 7}).rows() == set()
    assert r1.select_columns("a", "b").rows() == {(0, 0)}
    assert r1.select("a + b > 24").rows() == {(9, 18)}
    assert r1.select(lambda a, b: a % 5 == 4).rows() == {(4, 8), (9, 18)}


def test_projection_removes_duplicates(spark):
    x = Relation.of(spark, [(1, 1), (1, 2), (2, 1)], ["a", "b"])
    assert sorted(x.project("a").as_set().rows()) == [(1,), (2,)]
    assert len(x.project("a")) == 2
    assert x.project("b", "a").columns == ["b", "a"]
    with pytest.raises(RelationError):
        x.project("c")


def test_rename_and_names(r1):
    assert r1.renames({"a": "b", "b": "a"}).select_constants({"b": 1}).rows() == {(1, 2)}
    assert r1.unnamed().columns == ["_0", "_1"] and r1.unnamed().named("x", "y").columns == ["x", "y"]
    with pytest.raises(RelationError):
        r1.rename("a", "b")
    with pytest.raises(RelationError):
        r1.rename("z", "y")
    with pytest.raises(RelationError):
        r1.constant("a", 1)
    with pytest.raises(RelationError):
        Relation(r1.df.select("a", "a"))


def test_extended_projection(r1):
    x = r1.extend({"s": F.col("a") + F.col("b"), "k": "a", "one": 1})
    assert (27, 9, 1) in x.rows() and x.columns == ["s", "k", "one"]


def test_joins(r1, r2, spark):
    assert r1.natural_join(r2).rows() == {(i, 2 * i, 3 * i) for i in range(10)}
    assert len(r1.natural_join(Relation.of(spark, [(1,), (2,)], ["z"]))) == 20
    assert r1.natural_join(Relation.true(spark)).rows() == r1.rows()
    assert r1.natural_join(Relation.false(spark)).rows() == set()
    assert r1.natural_join(r1).rows() == r1.rows()
    e = r1.equijoin(r2, [("a", "b")])
    assert e.columns == ["a", "b", "b'", "c"] and e.rows() == {(2 * i, 4 * i, 2 * i, 3 * i) for i in range(5)}
    left = r1.left_join(Relation.of(spark, [(0, 5)], ["a", "d"]))
    assert (0, 0, 5) in left.rows() and (3, 6, None) in left.rows()
    assert (3, 6, -1) in left.replace_null("d", -1).rows()
    full = Relation.of(spark, [(1, 1)], ["k", "x"]).full_join(Relation.of(spark, [(2, 2)], ["k", "y"]))
    assert full.rows() == {(1, 1, None), (2, None, 2)}
    with pytest.raises(RelationError):
        r1.product(r2)


def test_null_keys_match(spark):
    x = Relation(spark.createDataFrame([(1, None), (2, 3)], "a int, k int"))
    y = Relation(spark.createDataFrame([(None, 7), (3, 8)], "k int, b int"))
    assert x.natural_join(y).rows() == {(1, None, 7), (2, 3, 8)}
    assert x.anti_join(y.project("k")).rows() == set()
    assert x.semi_join(y).rows() == {(1, None), (2, 3)}


def test_set_operations(spark):
    x = Relation.of(spark, [(1, 2), (3, 4), (3, 4)], ["a", "b"])
    y = Relation.of(spark, [(2, 1), (6, 5)], ["b", "a"])
    assert (x | y).rows() == {(1, 2), (3, 4), (5, 6)}
    assert (x & y).rows() == {(1, 2)}
    assert (x - y).rows() == {(3, 4)}
    assert (x - Relation(y.df.limit(0))).rows() == {(1, 2), (3, 4)}
    assert x.equals(Relation(x.df.select("b", "a"))) and not x.equals(y)
    with pytest.raises(RelationError):
        x.union(Relation.of(spark, [(1,)], ["a"]))


def test_truth_values(spark):
    t, f = Relation.true(spark), Relation.false(spark)
    assert (t | f).equals(t) and (t & f).equals(f) and (t - t).equals(f) and (t - f).equals(t)
    assert bool(t) and not f and len(t.union(t)) == 1
    with pytest.raises(RelationError):
        t.aggregate([], [("n", None, "count")])


def test_division_is_universal(spark):
    x = Relation.of(spark, [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "a"), (3, "c")], ["k", "v"])
    assert x.divide(Relation.of(spark, [("a",), ("b",)], ["v"])).rows() == {(1,), (3,)}
    assert x.divide(Relation(x.df.select("v").limit(0))).rows() == {(1,), (2,), (3,)}


def test_aggregates_use_distinct_rows(spark):
    x = Relation.of(spark, [(7, 8, 1), (7, 8, 9), (7, 8, 1)], ["x", "y", "z"])
    out = x.aggregate(["x", "y"], [("s", "z", "sum"), ("n", None, "count"), ("m", "z", "max")])
    assert out.rows() == {(7, 8, 10, 2, 9)}
    user = x.aggregate(["x", "y"], [("m", "z", lambda v: float(max(v) - 1))])
    assert user.rows() == {(7, 8, 8.0)}
    wide = Relation.of(spark, [(1, 7, 8, 1), (2, 7, 8, 9)], ["w", "x", "y", "z"])
    assert wide.aggregate(["x", "y"], [("t", None, lambda g: float((g.w + g.z).sum()))]).rows() == {(7, 8, 13.0)}
    empty = Relation(x.df.limit(0))
    assert empty.aggregate([], [("n", None, "count")]).rows() == set()
    with pytest.raises(RelationError):
        x.aggregate(["x"], [("x", "z", "sum")])


def test_thresholds(spark):
    x = Relation.of(spark, [(i,) for i in range(5)], ["v"])
    q = lambda p: x.aggregate([], [("t", "v", column_function(percentile_threshold(p)))]).fetch_one()[0]
    assert q(95) == pytest.approx(3.8) and q(5) == pytest.approx(0.2)
    assert x.nth([], "v", "t", 2).rows() == {(3,)} and x.nth([], "v", "t", 100).rows() == {(0,)} and x.nth([], "v", "t", 2, False).rows() == {(1,)}
    y = Relation.of(spark, [("s", 0), ("s", 1), ("t", 2)], ["k", "v"])
    assert y.nth(["k"], "v", "m", 2).rows() == {("s", 0), ("t", 2)}
    assert Relation(x.df.limit(0)).nth([], "v", "t", 2).rows() == set()


def test_explode_and_sinks(spark):
    x = Relation(spark.sql("select 1 a, array(1, 2) b union all select 2, array()"))
    assert x.explode("b", "v").project("a", "v").rows() == {(1, 1), (1, 2)}
    y = Relation(spark.sql("select 1 a, array(struct(1 as p, 2 as q)) b"))
    assert y.explode("b", ["i", "j"]).project("a", "i", "j").rows() == {(1, 1, 2)}
    z = Relation.of(spark, [(2, "b"), (1, "a")], ["n", "s"])
    assert (2, "b") in z and (3, "b") not in z and len(z.to_pandas()) == 2
    assert [r[0] for r in z.sort(["n:desc", "nope"]).collect()] == [2, 1]


def test_probability_operators(spark):
    x = ProbRelation(Relation.of(spark, [(0.5, 1, "a"), (1.0, 1, "b"), (0.2, 2, "a")], [P, "k", "v"]))
    rows = lambda r: {tuple(round(v, 9) if isinstance(v, float) else v for v in t) for t in r.rel.rows()}
    assert rows(x.project_independent("k")) == {(1, 1.0), (2, 0.2)}
    assert rows(x.project_universal("k")) == {(1, 0.5), (2, 0.2)}
    assert rows(x.project_disjoint("k")) == {(1, 1.5), (2, 0.2)}
    y = ProbRelation(Relation.of(spark, [(0.5, 1)], [P, "k"]))
    assert (0.25, 1, "a") in rows(x.join(y)) or (1, "a", 0.25) in rows(x.join(y))
    assert {tuple(r) for r in x.minus(y).rel.df.select("k", "v", F.round(P, 6)).collect()} == {(1, "a", 0.25), (1, "b", 0.5), (2, "a", 0.2)}
    z = ProbRelation(Relation.of(spark, [(0.5, 1), (0.3, 3)], [P, "k"]))
    assert {tuple(r) for r in y.union_independent(z).rel.df.select("k", F.round(P, 6)).collect()} == {(1, 0.75), (3, 0.3)}
    assert {tuple(r) for r in weighted_join([y, z], [2.0, -1.0]).rel.df.select("k", F.round(P, 6)).collect()} == {(1, 0.5), (3, -0.3)}
    zero = ProbRelation(Relation.of(spark, [(0.0, 1)], [P, "k"]))
    assert rows(zero.positive()) == set()
    assert y.divide(zero).rel.df.first()[P] is None


def test_random_algebra_against_python(spark):
    rng = random.Random(0)
    for _ in range(3):
        a = {(rng.randrange(6), rng.randrange(6)) for _ in range(12)}
        b = {(rng.randrange(6), rng.randrange(6)) for _ in range(12)}
        x, y = Relation.of(spark, list(a), ["p", "q"]), Relation.of(spark, list(b), ["q", "r"])
        assert x.natural_join(y).rows() == {(p, q, r) for p, q in a for q2, r in b if q == q2}
        assert x.anti_join(y.project("q")).rows() == {t for t in a if t[1] not in {q for q, _ in b}}
        z = y.named("p", "q")
        assert (x | z).rows() == a | b and (x & z).rows() == a & b and (x - z).rows() == a - b
