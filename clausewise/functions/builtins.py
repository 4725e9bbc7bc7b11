"""Functions that rules may call: native Columns, and Python callables sent in Arrow batches."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce
from operator import add
from typing import Any, get_type_hints

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _row_std(xs: tuple[Column, ...]) -> Column:
    """Sample deviation of a row's values; null for one value."""
    mean = reduce(add, xs).cast("double") / len(xs)
    return F.sqrt(F.try_divide(reduce(add, [(x - mean) * (x - mean) for x in xs]), F.lit(float(len(xs) - 1))))


# Names of functions with a Spark counterpart.
NATIVE: dict[str, Callable[..., Column]] = {
    "exp": F.exp,
    "expm1": F.expm1,
    "log": F.ln,
    "ln": F.ln,
    "log2": F.log2,
    "log10": F.log10,
    "log1p": F.log1p,
    "sqrt": F.sqrt,
    "abs": F.abs,
    "floor": F.floor,
    "ceil": F.ceil,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "arcsinh": F.asinh,
    "arccosh": F.acosh,
    "arctanh": F.atanh,
    "round": F.round,
    "len": F.length,
    "size": F.size,
    "lower": F.lower,
    "upper": F.upper,
    "least": F.least,
    "greatest": F.greatest,
    "startswith": lambda prefix, s: F.startswith(s, prefix),
    "equals": lambda a, b: a.eqNullSafe(b),
    "isin": lambda x, s: F.array_contains(s, x),
    "regexp": lambda pattern, s: F.regexp_like(s, pattern),
    "float": lambda x: x.cast("double"),
    "int": lambda x: x.cast("long"),
    "str": lambda x: x.cast("string"),
    "bool": lambda x: x.cast("boolean"),
    "EUCLIDEAN": lambda i, j, k, a, b, c: F.sqrt((i - a) * (i - a) + (j - b) * (j - b) + (k - c) * (k - c)),
    "row_max": F.greatest,
    "row_min": F.least,
    "row_sum": lambda *xs: reduce(add, xs),
    "row_mean": lambda *xs: reduce(add, xs).cast("double") / len(xs),
    "row_std": lambda *xs: _row_std(xs),
    "neg": lambda x: -x,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "**": lambda a, b: F.pow(a, b),
}

_KINDS = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}


def spark_type(annotation: Any) -> T.DataType:
    if isinstance(annotation, T.DataType):
        return annotation
    if isinstance(annotation, str):
        return T._parse_datatype_string(annotation)
    origin = getattr(annotation, "__origin__", None)
    if origin in (list, set, frozenset, tuple):
        args = getattr(annotation, "__args__", (float,))
        return T.ArrayType(spark_type(args[0]))
    return _KINDS.get(annotation, T.DoubleType())


def python_function(fn: Callable, returns: Any = None) -> Callable[..., Column]:
    """A Column function of a Python callable on values; the type comes from its annotation (default: double)."""
    if returns is None:
        try:
            returns = get_type_hints(fn).get("return", float)
        except (TypeError, NameError):
            returns = float
    kind = spark_type(returns)
    many = isinstance(kind, T.ArrayType)

    def run(*cols: pd.Series | pd.DataFrame) -> pd.Series:
        # a struct argument comes as a frame: its rows are dicts
        lists = [c.to_dict("records") if isinstance(c, pd.DataFrame) else c for c in cols]
        out = [fn(*row) for row in zip(*lists, strict=True)]
        return pd.Series([list(v) if many and v is not None else v for v in out])

    udf = F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)
    return lambda *args: udf(*args)


class Functions:
    """Scalars, aggregates and constants by name."""

    def __init__(self):
        self.scalars: dict[str, Callable[..., Column]] = dict(NATIVE)
        self.aggregates: dict[str, Callable] = {}
        self.constants: dict[str, Any] = {}
        self.callables: dict[str, Callable] = {}

    def add(self, value: Any, name: str | None = None, returns: Any = None, aggregate: bool | None = None) -> str:
        """Register a callable (used as a scalar, or as an aggregate in heads) or a constant."""
        name = name or getattr(value, "__name__", None)
        if not name:
            raise ValueError("a name is needed")
        if not callable(value):
            self.constants[name] = value
            return name
        if getattr(value, "columns", False):
            self.scalars[name] = value
        else:
            self.scalars[name] = python_function(value, returns)
        self.callables[name] = value
        if aggregate is not False:
            hint = returns
            if hint is None:
                try:
                    hint = get_type_hints(value).get("return")
                except (TypeError, NameError):
                    hint = None

            def agg(*values: Any) -> Any:
                return value(*values)

            agg.returns = spark_type(hint).simpleString() if hint is not None else "double"  # type: ignore[attr-defined]
            agg.arity = len(inspect.signature(value).parameters)  # type: ignore[attr-defined]
            self.aggregates[name] = agg
        return name
