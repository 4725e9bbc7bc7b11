import io
import json

import pytest
from pyspark.sql import functions as F

from clausewise import cli
from clausewise.config import build_engine, describe
from clausewise.engine import Engine
from clausewise.english import execute
from clausewise.plans.ast import ProgramError


def rows(rel):
    return {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rel.rows()}


@pytest.fixture
def e(spark):
    x = Engine(spark)
    tables = {
        "ship": [("ada",), ("brig",), ("cog",), ("dhow",)],
        "sails": [("ada",), ("dhow",)],
        "cargo_weight": [("ada", 4), ("ada", 9), ("brig", 2), ("cog", 7)],
        "weight": [(w,) for w in (2, 4, 7, 9, 11)],
        "port": [("kiel",), ("lima",), ("oslo",)],
        "logs": [("kiel", 2), ("kiel", 4), ("lima", 9), ("oslo", 11)],
        "captain": [("ada", "jo"), ("brig", "jo"), ("cog", "mia")],
        "crew": [("jo",), ("mia",), ("lu",)],
        "berth": [(1, 1), (1, 2), (3, 1)],
        "offers": [("kiel", 1, 1), ("kiel", 1, 2), ("lima", 3, 1)],
        "trades": [("kiel", "salt"), ("oslo", "tea")],
    }
    for n, r in tables.items():
        x.add_table(r, n)
    return x


ENGLISH = [
    ("obtain every Ship that sails.", {("ada",), ("dhow",)}),
    ("define as Afloat every Ship that sails. define as Seen every Afloat that sails. obtain every Seen.", {("ada",), ("dhow",)}),
    ("define as Heavy every Ship that has a cargo_weight greater equal than 5. obtain every Heavy.", {("ada",), ("cog",)}),
    ("define as fullest for every Ship ?s ; where every Max of the Weight where ?s cargo_weight per ?s. obtain every Fullest.", {("ada", 9), ("brig", 2), ("cog", 7)}),
    ("obtain every Ship that a Crew ~captain.", {("ada",), ("brig",), ("cog",)}),
    ("obtain every Count of the Port.", {(3,)}),
    ("obtain the Top 25% of the Weight.", {(9.0,)}),
    ("obtain the Bottom 25% of the Weight.", {(4.0,)}),
    ("obtain the Top 3 of the Weight.", {(7,)}),
    ("obtain the Top 50 of the Weight.", {(2,)}),
    ("obtain the Bottom 3 of the Weight.", {(7,)}),
    ("define as peak for every Port ; where every Top 50% of the Weight that the Port logs. obtain every Peak.", {("kiel", 3.0), ("lima", 9.0), ("oslo", 11.0)}),
    ("obtain every Berth in 2D that a Port that trades 'salt' offers.", {(1, 1), (1, 2)}),
    ("obtain every Ship (?x) where ?x is 'cog'.", {("cog",)}),
    ("obtain every Ship (?x) where ?x is 'cog' or ?x is 'brig'.", {("cog",), ("brig",)}),
    ("obtain every Ship that does not sails.", {("brig",), ("cog",)}),
    ("obtain every Port that trades 'salt' or that trades 'tea'.", {("kiel",), ("oslo",)}),
    ("define as Pick as an equiprobable choice over every Port that logs a Weight. define as Free with probability every Berth in 2D that a Pick offers. obtain every Free.", {(1, 1, 0.333333), (1, 2, 0.333333), (3, 1, 0.333333)}),
    ("define as Pick as an equiprobable choice over every Port. define as Free with inferred probability every Berth in 2D that a Pick offers conditioned to every Pick that trades 'salt'. obtain every Free.", {(1, 1, 1.0), (1, 2, 1.0)}),
]


@pytest.mark.parametrize("text,want", ENGLISH, ids=[t[:50] for t, _ in ENGLISH])
def test_english(e, text, want):
    assert rows(execute(e, text)) == want


def test_english_results(e):
    assert execute(e, "define as Afloat every ship that sails.") is None
    two = execute(e, "obtain every Ship that sails. obtain every Ship as Whole_fleet.")
    assert set(two) == {"obtain_0", "whole_fleet"} and len(two["whole_fleet"]) == 4
    assert e.is_predicate("whole_fleet")
    for bad in ("obtain Ship.", "define Afloat.", "obtain every Ship that", "ahoy."):
        with pytest.raises(ProgramError):
            execute(e, bad)


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string").write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "f.csv").write_text("p,s\n0.5,a\n0.25,b\n")
    out = io.StringIO()
    args = ["ans(n, s, PROB(n, s)) :- t(n, s), f(s).", "--table", f"t={tmp_path}/t.parquet", "--facts", f"f={tmp_path}/f.csv"]
    assert cli.main([*args, "--format", "json", "--sort", "n:desc", "--sort", "zz"], spark, out) == 0
    assert [json.loads(x) for x in out.getvalue().splitlines()] == [{"n": 2, "s": "b", "PROB_n": 0.25}, {"n": 1, "s": "a", "PROB_n": 0.5}]
    out = io.StringIO()
    assert cli.main(["q(n) :- t(n, s).", *args[1:3], "--format", "csv", "--show-datalog", "--list"], spark, out) == 0
    assert "q(n) :- t(n, s)." in out.getvalue() and "t(n, s)" in out.getvalue()
    out = io.StringIO()
    assert cli.main(["ans(n, s) :- t(n, s).", *args[1:3]], spark, out) == 0 and "n | s" in out.getvalue()
    assert cli.main(["ans(x) :- t(x).", *args[1:3]], spark, io.StringIO()) == 1
    assert cli.main(["ans(x) :- t(x).", *args[1:3], "--dry-run"], spark, io.StringIO()) == 0


def test_config_and_commands(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "s.tsv.gz", "wt") as f:
        f.write("id\tterm\n1\tx\n2\ty\n")
    d = {"tables": {"study": "s.tsv.gz"}, "uniform_choices": {"selected": "study"}, "constants": {"k": 1}, "program": "one(t) :- study(i, t), (i == k).", "directions": True}
    x = build_engine(spark, d, str(tmp_path))
    assert rows(x.execute("ans(t) :- one(t).")) == {("x",)} and describe(d)["tables"] == ["study"]
    assert rows(x.execute("ans(t, PROB(t)) :- selected(i, t).")) == {("x", 0.5), ("y", 0.5)}
    x.execute(f".load_csv('{tmp_path}/s.tsv.gz', name='again')")
    assert rows(x.execute("ans(t) :- again(2, t).")) == {("y",)}


def test_label_images(spark, tmp_path):
    import gzip
    import struct

    import numpy as np

    image = np.zeros((3, 2, 2), "<i2")
    image[0, 1, 1] = 4
    image[2, 0, 1] = 7
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 3, 2, 2, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<f", head, 108, 352.0)
    (tmp_path / "a.nii.gz").write_bytes(gzip.compress(bytes(head) + image.tobytes(order="F")))
    from clausewise.sources.commands import read_labels

    got = {tuple(r) for r in read_labels(spark, str(tmp_path / "a.nii.gz")).select("i", "j", "k", "label").collect()}
    assert got == {(0, 1, 1, 4.0), (2, 0, 1, 7.0)}
    x = Engine(spark)
    x.execute(f".load_atlas('{tmp_path}/a.nii.gz', name='atlas')")
    assert rows(x.execute("ans(a, b) :- atlas(a, r), atlas(b, q), left_of(r, q).")) == {(4.0, 7.0)}


TTL = """
@prefix : <http://x.org/> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
:Dog rdfs:subClassOf :Animal ; rdfs:label "dog"@en .
:Animal rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :hasOwner ; owl:someValuesFrom :Person ] .
:hasPet owl:inverseOf :ownedBy . :hasPet rdfs:domain :Person .
:rex a :Dog . :ann :hasPet :tom .
"""


def test_ontology(spark, tmp_path):
    from clausewise.sources import ontology

    (tmp_path / "o.ttl").write_text(TTL)
    x = Engine(spark)
    ontology.load(x, str(tmp_path / "o.ttl"))
    assert rows(x.execute("ans(x) :- hasOwner(x, y).")) == {("http://x.org/rex",)}
    assert rows(x.execute("ans(x, y) :- ownedBy(x, y).")) == {("http://x.org/tom", "http://x.org/ann")}
    assert rows(x.execute("ans(x) :- Person(x).")) == {("http://x.org/ann",)}
    xml = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#"><owl:Class rdf:about="http://x/C"><rdfs:subClassOf rdf:resource="http://x/D"/></owl:Class></rdf:RDF>'
    assert ("http://x/C", ontology.RDFS + "subClassOf", "http://x/D") in ontology.parse_rdfxml(xml)


def test_streaming_rule(spark, tmp_path):
    from clausewise.streaming.incremental import stream_answer, windowed_counts

    spark.sql("select 1 as k, timestamp '2024-01-01 00:00:00' as t union all select 2, timestamp '2024-01-01 00:07:00'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in"))
    x = Engine(spark)
    x.add_table([(1, "one")], "name_of")
    out = stream_answer(x, stream, "seen", "ans(k, n) :- seen(k, t), name_of(k, n).")
    q = out.writeStream.format("memory").queryName("answers").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("answers").collect()} == {(1, "one")}
    twice = stream_answer(x, stream, "again", "ans('row', k, k) :- again(k, t).")
    assert twice.columns == ["_0", "k", "_2"]
    q = windowed_counts(stream, "t", ["k"], "5 minutes").writeStream.format("memory").outputMode("complete").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 2
