"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of other than these ASCII white-space characters.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text (null: none), in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores put in front until no column of df has it (case does not count)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row; nulls and maps count."""
    columns = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])
