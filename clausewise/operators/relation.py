"""Relations with set semantics over DataFrames.

A relation knows whether its rows are already distinct, so duplicates are removed once, where a result depends on it.
Join keys match null with null. Relations without columns are the truth values: one row (true) or none (false).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class RelationError(ValueError):
    """Columns are missing, repeated or do not fit the operation."""


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


#: Aggregates by name: a function of the aggregated Column.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": lambda c: F.count(F.lit(1)),
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "mean": F.avg,
    "avg": F.avg,
    "average": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": F.median,
    "first": F.first,
    "last": F.last,
}


def percentile_threshold(q: float) -> Callable[[Column], Column]:
    """Linear percentile, q in 0..100."""
    return lambda c: F.percentile(c, F.lit(q / 100.0))


class Relation:
    """A named relation. Operations return new relations and never run anything."""

    def __init__(self, df: DataFrame, distinct: bool = False):
        names = df.columns
        if len(set(names)) != len(names):
            raise RelationError(f"repeated columns: {names}")
        self.df, self.distinct = df, distinct

    # --- construction
    @staticmethod
    def of(spark: SparkSession, rows: Iterable, columns: list[str] | str) -> Relation:
        """From tuples; columns are names or a DDL schema. Without columns, whether there is any row."""
        rows = [tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows]
        if columns == [] or columns == "":
            return Relation.true(spark) if rows else Relation.false(spark)
        if not rows and not isinstance(columns, str):
            return Relation(spark.createDataFrame([], ", ".join(f"`{c}` long" for c in columns)), True)
        return Relation(spark.createDataFrame(rows, columns))

    @staticmethod
    def true(spark: SparkSession) -> Relation:
        return Relation(spark.range(1).select(), True)

    @staticmethod
    def false(spark: SparkSession) -> Relation:
        return Relation(spark.range(0).select(), True)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def arity(self) -> int:
        return len(self.df.columns)

    def _need(self, *names: str) -> None:
        missing = [n for n in names if n not in self.columns]
        if missing:
            raise RelationError(f"no column {missing} in {self.columns}")

    def as_set(self) -> Relation:
        if self.distinct:
            return self
        return Relation(self.df.distinct() if self.arity else self.df.limit(1), True)

    # --- selection, projection, renaming
    def select_columns(self, a: str, b: str) -> Relation:
        self._need(a, b)
        return Relation(self.df.filter(_col(a).eqNullSafe(_col(b))), self.distinct)

    def select_constants(self, values: dict[str, Any]) -> Relation:
        self._need(*values)
        return Relation(reduce(lambda d, kv: d.filter(_col(kv[0]) == F.lit(kv[1])), values.items(), self.df), self.distinct)

    def select(self, condition: Column | str | Callable) -> Relation:
        """By a boolean Column, an SQL expression or a Python predicate on row tuples (sent in Arrow batches)."""
        if callable(condition) and not isinstance(condition, Column):
            condition = row_predicate(condition, self.columns)
        return Relation(self.df.filter(condition), self.distinct)

    def project(self, *names: str) -> Relation:
        self._need(*names)
        if set(names) == set(self.columns):
            return Relation(self.df.select(*map(_col, names)), self.distinct)
        return Relation(self.df.select(*map(_col, names)), False)

    def rename(self, old: str, new: str) -> Relation:
        self._need(old)
        if new in self.columns and new != old:
            raise RelationError(f"column {new} exists")
        return self.renames({old: new})

    def renames(self, names: dict[str, str]) -> Relation:
        """Simultaneously; swaps are allowed."""
        self._need(*names)
        return Relation(self.df.select(*[_col(c).alias(names.get(c, c)) for c in self.columns]), self.distinct)

    def unnamed(self) -> Relation:
        return Relation(self.df.toDF(*[f"_{i}" for i in range(self.arity)]), self.distinct)

    def named(self, *names: str) -> Relation:
        if len(names) != self.arity:
            raise RelationError(f"{self.arity} columns, {len(names)} names")
        return Relation(self.df.toDF(*names), self.distinct)

    def extend(self, columns: dict[str, Column | str | Any], keep: bool = False) -> Relation:
        """Extended projection: computed columns (a Column, a column's name or a constant), with the others if keep."""
        made = [(v if isinstance(v, Column) else _col(v) if isinstance(v, str) and v in self.columns else F.lit(v)).alias(k) for k, v in columns.items()]
        rest = [_col(c) for c in self.columns if c not in columns] if keep else []
        return Relation(self.df.select(*rest, *made), self.distinct and keep and not set(columns) & set(self.columns))

    def constant(self, name: str, value: Any) -> Relation:
        if name in self.columns:
            raise RelationError(f"column {name} exists")
        return Relation(self.df.select("*", F.lit(value).alias(name)), self.distinct)

    def replace_null(self, name: str, value: Any) -> Relation:
        self._need(name)
        return Relation(self.df.withColumn(name, F.coalesce(_col(name), F.lit(value))))

    def explode(self, source: str, target: str | list[str]) -> Relation:
        """A row per element of an array cell: into one column, or into several from structs."""
        self._need(source)
        if isinstance(target, str):
            keep = [_col(c) for c in self.columns if c != target]
            return Relation(self.df.select(*keep, F.explode(_col(source)).alias(target)))
        keep = [_col(c) for c in self.columns if c not in target]
        return Relation(self.df.select(*keep, F.inline(_col(source)).alias(*target)))

    # --- joins
    def _on(self, other: Relation, shared: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [self.df[f"`{c}`"].eqNullSafe(other.df[f"`{c}`"]) for c in shared])

    def _apart(self, other: Relation) -> Relation:
        """other with new column identities, so that a relation can be joined with itself."""
        return Relation(other.df.select(*[_col(c).alias(c) for c in other.columns]), other.distinct)

    def natural_join(self, other: Relation) -> Relation:
        shared = [c for c in self.columns if c in other.columns]
        other = self._apart(other)
        if not shared:
            return Relation(self.df.crossJoin(other.df), self.distinct and other.distinct)
        rest = [other.df[f"`{c}`"] for c in other.columns if c not in shared]
        return Relation(self.df.join(other.df, self._on(other, shared)).select(*[self.df[f"`{c}`"] for c in self.columns], *rest), self.distinct and other.distinct)

    def equijoin(self, other: Relation, pairs: list[tuple[str, str]]) -> Relation:
        """All columns of both sides; the right ones that clash get a prime."""
        self._need(*[a for a, _ in pairs])
        other._need(*[b for _, b in pairs])
        other = self._apart(other)
        on = reduce(lambda a, b: a & b, [self.df[f"`{a}`"].eqNullSafe(other.df[f"`{b}`"]) for a, b in pairs])
        names = [*self.columns]
        for c in other.columns:
            while c in names:
                c += "'"
            names.append(c)
        return Relation(self.df.join(other.df, on).toDF(*names), self.distinct and other.distinct)

    def product(self, other: Relation) -> Relation:
        if set(self.columns) & set(other.columns):
            raise RelationError("a product's relations must not share columns")
        return self.natural_join(other)

    def left_join(self, other: Relation) -> Relation:
        shared = [c for c in self.columns if c in other.columns]
        other = self._apart(other)
        rest = [c for c in other.columns if c not in shared]
        on = self._on(other, shared) if shared else F.lit(True)
        return Relation(self.df.join(other.df, on, "left").select(*[self.df[f"`{c}`"] for c in self.columns], *[other.df[f"`{c}`"] for c in rest]), self.distinct and other.distinct)

    def full_join(self, other: Relation) -> Relation:
        shared = [c for c in self.columns if c in other.columns]
        if not shared:
            raise RelationError("a full join needs a shared column")
        other = self._apart(other)
        keys = [F.coalesce(self.df[f"`{c}`"], other.df[f"`{c}`"]).alias(c) if c in shared else self.df[f"`{c}`"] for c in self.columns]
        rest = [other.df[f"`{c}`"] for c in other.columns if c not in shared]
        return Relation(self.df.join(other.df, self._on(other, shared), "full").select(*keys, *rest))

    def semi_join(self, other: Relation) -> Relation:
        return self._filter_join(other, "left_semi")

    def anti_join(self, other: Relation) -> Relation:
        return self._filter_join(other, "left_anti")

    def _filter_join(self, other: Relation, how: str) -> Relation:
        shared = [c for c in self.columns if c in other.columns]
        other = self._apart(other)
        on = self._on(other, shared) if shared else F.lit(True)
        return Relation(self.df.join(other.df, on, how), self.distinct)

    def divide(self, other: Relation) -> Relation:
        """Rows of the other columns that stand with every row of other: the universal quantifier."""
        other._need()
        self._need(*other.columns)
        keys = [c for c in self.columns if c not in other.columns]
        mine, want = self.as_set().semi_join(other), other.as_set()
        total = want.df.agg(F.count(F.lit(1)).alias("__need"))
        counted = mine.df.groupBy(*map(_col, keys)).agg(F.count(F.lit(1)).alias("__have")).crossJoin(F.broadcast(total))
        some = counted.filter("__have = __need").select(*map(_col, keys))
        # with nothing to divide by, every candidate qualifies
        all_ = self.project(*keys).as_set().df.crossJoin(F.broadcast(total)).filter("__need = 0").select(*map(_col, keys))
        return Relation(some.unionAll(all_), True)

    # --- set operations
    def _same(self, other: Relation) -> Relation:
        if set(self.columns) != set(other.columns):
            raise RelationError(f"columns differ: {self.columns} and {other.columns}")
        return other.project(*self.columns)

    def union(self, other: Relation) -> Relation:
        return Relation(self.df.unionByName(self._same(other).df) if self.arity else self.df.unionAll(other.df)).as_set()

    def union_all(self, other: Relation) -> Relation:
        return Relation(self.df.unionByName(self._same(other).df) if self.arity else self.df.unionAll(other.df))

    def intersection(self, other: Relation) -> Relation:
        other = self._same(other)
        return Relation(self.df.intersect(other.df), True) if self.arity else self.as_set().semi_join(other)

    def difference(self, other: Relation) -> Relation:
        other = self._same(other)
        return Relation(self.df.subtract(other.df), True) if self.arity else self.as_set().anti_join(other)

    __or__, __and__, __sub__ = union, intersection, difference

    # --- aggregation
    def aggregate(self, keys: list[str], aggregates: list[tuple[str, str | None, str | Callable]]) -> Relation:
        """(target, source, function) over the distinct rows; a function is a name, a Column function, or a Python
        callable on the source's values (or on the group's frame if the source is None). An empty input gives no row."""
        if not self.arity:
            raise RelationError("a relation without columns cannot be aggregated")
        self._need(*keys, *[s for _, s, _ in aggregates if s])
        names = [t for t, _, _ in aggregates]
        if set(names) & set(keys) or len(set(names)) != len(names):
            raise RelationError("an aggregate's target repeats a key or another target")
        rows = self.as_set()
        is_native = lambda f: isinstance(f, str) or getattr(f, "column_function", False)
        native, user = [x for x in aggregates if is_native(x[2])], [x for x in aggregates if not is_native(x[2])]
        if user:
            out = rows._aggregate_python(keys, user)
            if native:
                out = rows.aggregate(keys, native).natural_join(out) if keys else rows.aggregate(keys, native).product(out)
            return out.project(*keys, *names)
        made = [(AGGREGATES[f] if isinstance(f, str) else f)(_col(s) if s else F.lit(1)).alias(t) for t, s, f in native]
        if keys:
            return Relation(rows.df.groupBy(*map(_col, keys)).agg(*made), True)
        out = rows.df.agg(*made, F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")
        return Relation(out, True)

    def nth(self, keys: list[str], source: str, target: str, n: int, largest: bool = True) -> Relation:
        """The n-th largest (or smallest) value of each group, the last one of smaller groups; repeats in rows count.

        Ranks are limited to n before the exchange (a group limit or a top-n), so no group is gathered whole.
        """
        self._need(*keys, source)
        rows, value = self.as_set().df, _col(source)
        order = value.desc() if largest else value.asc()
        if keys:
            rank = F.row_number().over(Window.partitionBy(*map(_col, keys)).orderBy(order))
            top = rows.select(*map(_col, keys), value.alias(target), rank.alias("__rank")).filter(F.col("__rank") <= n)
        else:
            top = rows.select(value.alias(target)).orderBy(F.col(target).desc() if largest else F.col(target).asc()).limit(n)
        made = (F.min if largest else F.max)(_col(target)).alias(target)
        out = top.groupBy(*map(_col, keys)).agg(made) if keys else top.agg(made).filter(_col(target).isNotNull())
        return Relation(out, True)

    def _aggregate_python(self, keys: list[str], aggregates: list) -> Relation:
        """User aggregates: one call per group in Arrow; a group's rows meet in one task, as the function needs them all.

        Nulls of a single source are left out before the call, as in native aggregates; without any value the result is null.
        """
        import pandas as pd

        kinds = {f.name: f.dataType.simpleString() for f in self.df.schema}
        fields = [f"`{k}` {kinds[k]}" for k in keys] + [f"`{t}` {getattr(f, 'returns', None) or 'double'}" for t, _, f in aggregates]

        def value(pdf: pd.DataFrame, source: str | None, fn: Callable) -> Any:
            if not source:
                return fn(pdf)
            some = pdf[source].dropna()
            return fn(some) if len(some) else None

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[*key, *[value(pdf, s, f) for _, s, f in aggregates]]])

        needed = self.df.select(*map(_col, dict.fromkeys([*keys, *([c for c in self.columns] if any(not s for _, s, _ in aggregates) else [s for _, s, _ in aggregates])])))
        if not keys:
            one = needed.withColumn("__one", F.lit(1)).groupBy("__one")
            return Relation(one.applyInPandas(lambda pdf: run((), pdf), ", ".join(fields)), True)
        return Relation(needed.groupBy(*map(_col, keys)).applyInPandas(run, ", ".join(fields)), True)

    def groups(self, *keys: str) -> Iterator[tuple[tuple, Relation]]:
        """Each group's key and its rows as a relation, in the order of keys. The keys come to the driver a partition at a
        time, the groups stay where they are."""
        self._need(*keys)
        rows = self.as_set()
        for r in rows.project(*keys).as_set().df.orderBy(*map(_col, keys)).toLocalIterator():
            yield tuple(r), rows.select_constants(dict(zip(keys, r, strict=True)))

    # --- sinks
    def to_pandas(self):
        return self.as_set().df.toPandas()

    def rows(self) -> set[tuple]:
        return {tuple(r) for r in self.as_set().df.collect()}

    def __iter__(self) -> Iterator[tuple]:
        return (tuple(r) for r in self.as_set().df.toLocalIterator())

    def __len__(self) -> int:
        return self.as_set().df.count()

    def __contains__(self, row: Any) -> bool:
        row = row if isinstance(row, tuple) else (row,)
        return not self.select_constants(dict(zip(self.columns, row, strict=True))).is_empty()

    def __bool__(self) -> bool:
        return not self.is_empty()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def fetch_one(self) -> tuple | None:
        r = self.df.first()
        return None if r is None else tuple(r)

    def equals(self, other: Relation) -> bool:
        if set(self.columns) != set(other.columns):
            return False
        if not self.arity:
            return self.is_empty() == other.is_empty()
        a, b = self.as_set().df, self._same(other).as_set().df
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def sort(self, specs: list[str]) -> DataFrame:
        """Rows ordered by ``column`` or ``column:desc``; unknown columns are ignored."""
        out = []
        for s in specs:
            name, _, way = s.partition(":")
            if name in self.columns:
                out.append(_col(name).desc() if way.lower() in ("desc", "d") else _col(name).asc())
        rows = self.as_set().df
        return rows.orderBy(*out) if out else rows


def column_function(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Mark an aggregate as a function of Columns, as against one of Python values."""
    f.column_function = True  # type: ignore[attr-defined]
    return f


def row_predicate(fn: Callable, columns: list[str]) -> Column:
    import pandas as pd
    from pyspark.sql.types import BooleanType

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([bool(fn(*row)) for row in zip(*cols, strict=True)], dtype=bool)

    return F.pandas_udf(run, BooleanType(), F.PandasUDFType.SCALAR)(*map(_col, columns))
