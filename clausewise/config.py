"""Engines from declarative descriptions.

{"tables": {"study": "study.tsv.gz"}, "facts": {...}, "choices": {...}, "uniform_choices": {"selected": "study"},
 "constants": {"limit": 3}, "ontologies": ["x.ttl"], "program": "rules", "directions": true}
"""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from clausewise.engine import Engine
from clausewise.sources.commands import read_delimited


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if ".csv" in path or ".tsv" in path:
        return read_delimited(spark, path)
    return spark.read.parquet(path)


def build_engine(spark: SparkSession, description: dict[str, Any], base: str = "") -> Engine:
    e = Engine(spark, max_rounds=description.get("max_rounds", 10_000))
    at = lambda p: p if "://" in p or not base else os.path.join(base, p)
    for name, path in description.get("tables", {}).items():
        e.add_table(read_table(spark, at(path)), name)
    for name, path in description.get("facts", {}).items():
        e.add_probabilistic_facts(read_table(spark, at(path)), name)
    for name, path in description.get("choices", {}).items():
        e.add_probabilistic_choice(read_table(spark, at(path)), name)
    for name, source in description.get("uniform_choices", {}).items():
        e.add_uniform_choice(e.tables[source], name)
    for name, value in description.get("constants", {}).items():
        e.functions.constants[name] = value
    if description.get("directions"):
        from clausewise.functions.spatial import register

        register(e.functions)
    if description.get("ontologies"):
        from clausewise.sources.ontology import load

        load(e, *map(at, description["ontologies"]))
    if description.get("program"):
        e.load(description["program"])
    return e


def describe(description: dict[str, Any]) -> dict[str, list[str]]:
    """Predicates of a description by kind."""
    return {k: sorted(description.get(k, {})) for k in ("tables", "facts", "choices", "uniform_choices")}
