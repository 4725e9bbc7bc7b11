"""Spatial operators: range joins on Euclidean distance, cardinal directions and intervals of boxes, voxel regions.

A region is a struct (lb, ub: arrays of doubles; voxels: array of structs i, j, k). Axes are x (left to right), y (posterior
to anterior), z (inferior to superior).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.operators.relation import Relation, _col
from clausewise.plans.ast import Call, Compare, Const, ProgramError, Var, term_vars

# --- range join


def range_join(left: DataFrame, right: DataFrame, a: list[str], b: list[str], radius: float, distance: str | None = None) -> DataFrame:
    """Pairs of points at most ``radius`` apart: an equi-join on grid cells of that size, then the exact distance.

    Only the right side is replicated, to the 27 cells around its own.
    """
    if radius <= 0:
        on = reduce(lambda x, y: x & y, [left[p] == right[q] for p, q in zip(a, b, strict=True)])
        out = left.join(right, on)
        return out.withColumn(distance, F.lit(0.0)) if distance else out
    cells = [f"__c{i}" for i in range(len(a))]
    size = float(radius)
    x = left.select("*", *[F.floor(_col(c) / size).alias(n) for c, n in zip(a, cells, strict=True)])
    y = right
    for c, n in zip(b, cells, strict=True):
        at = F.floor(_col(c) / size)
        y = y.select("*", F.explode(F.sequence(at - 1, at + 1)).alias(n))
    out = x.join(y, cells).drop(*cells)
    square = reduce(lambda p, q: p + q, [(_col(c) - _col(d)) * (_col(c) - _col(d)) for c, d in zip(a, b, strict=True)])
    out = out.filter(square <= size * size)
    return out.withColumn(distance, F.sqrt(square)) if distance else out


def distance_join(left: Relation, right: Relation, rest: list) -> tuple[list, Relation] | None:
    """A range join for two relations without shared columns, if the waiting parts bound a Euclidean distance between them.

    The bound holds inclusively, whether it is written < or <=. A bound from below is refused.
    """
    for p in rest:
        if not isinstance(p, Compare):
            continue
        for call, other in ((p.left, p.right), (p.right, p.left)):
            if not (isinstance(call, Call) and call.name == "EUCLIDEAN"):
                continue
            names = term_vars(call)
            if len(names) != 6:
                continue
            one, two = names[:3], names[3:]
            if not (set(one) <= set(left.columns) and set(two) <= set(right.columns)):
                one, two = two, one
            if not (set(one) <= set(left.columns) and set(two) <= set(right.columns)):
                continue
            if isinstance(other, Var) and p.op == "==":
                bound, used = _bound_of(other.name, rest)
                if bound is None:
                    raise ProgramError("a distance needs an upper bound")
                out = range_join(left.df, right.df, one, two, bound, other.name)
                return [q for q in rest if q is not p and q is not used], Relation(out, left.distinct and right.distinct)
            if isinstance(other, Const) and ((p.op in ("<", "<=") and call is p.left) or (p.op in (">", ">=") and call is p.right)):
                return [q for q in rest if q is not p], Relation(range_join(left.df, right.df, one, two, float(other.value)), left.distinct and right.distinct)
    return None


def _bound_of(name: str, parts: list) -> tuple[float | None, Compare | None]:
    for p in parts:
        if isinstance(p, Compare):
            if p.left == Var(name) and isinstance(p.right, Const) and p.op in ("<", "<="):
                return float(p.right.value), p
            if p.right == Var(name) and isinstance(p.left, Const) and p.op in (">", ">="):
                return float(p.left.value), p
    return None, None


# --- interval algebra on (lb, ub)


def before(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return a[1] < b[0]


def meets(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return a[1] == b[0]


def overlaps(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] < b[0]) & (b[0] < a[1]) & (a[1] < b[1])


def during(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] > b[0]) & (a[1] < b[1])


def starts(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] == b[0]) & (a[1] < b[1])


def finishes(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[1] == b[1]) & (a[0] > b[0])


def equals(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] == b[0]) & (a[1] == b[1])


def converse(relation):
    return lambda a, b: relation(b, a)


def negate(relation):
    return lambda a, b: ~relation(a, b)


RELATIONS = {"before": before, "meets": meets, "overlaps": overlaps, "during": during, "starts": starts, "finishes": finishes, "equals": equals}


# --- directions of boxes


def _axis(r: Column, k: int) -> tuple[Column, Column]:
    return r["lb"][k], r["ub"][k]


def left_of(a: Column, b: Column) -> Column:
    return _axis(a, 0)[1] <= _axis(b, 0)[0]


def right_of(a: Column, b: Column) -> Column:
    return left_of(b, a)


def posterior_of(a: Column, b: Column) -> Column:
    return _axis(a, 1)[1] <= _axis(b, 1)[0]


def anterior_of(a: Column, b: Column) -> Column:
    return posterior_of(b, a)


def inferior_of(a: Column, b: Column) -> Column:
    return _axis(a, 2)[1] <= _axis(b, 2)[0]


def superior_of(a: Column, b: Column) -> Column:
    return inferior_of(b, a)


def overlapping(a: Column, b: Column) -> Column:
    """Boxes meet on all axes and, where both have voxels, a voxel is common."""
    box = reduce(lambda x, y: x & y, [(_axis(a, k)[0] < _axis(b, k)[1]) & (_axis(b, k)[0] < _axis(a, k)[1]) for k in range(3)])
    return box & (F.coalesce(F.size(a["voxels"]), F.lit(0)).eqNullSafe(0) | F.coalesce(F.size(b["voxels"]), F.lit(0)).eqNullSafe(0) | F.arrays_overlap(a["voxels"], b["voxels"]))


DIRECTIONS = {"left_of": left_of, "right_of": right_of, "posterior_of": posterior_of, "anterior_of": anterior_of, "inferior_of": inferior_of, "superior_of": superior_of, "overlapping": overlapping}
_INVERSE = {"left_of": "right_of", "posterior_of": "anterior_of", "inferior_of": "superior_of"}
_INVERSE |= {v: k for k, v in _INVERSE.items()}


def anatomical(name: str):
    """A direction that neither its inverse nor an overlap contradicts."""
    return lambda a, b: DIRECTIONS[name](a, b) & ~(DIRECTIONS[_INVERSE[name]](a, b) | overlapping(a, b))


def direction_signs(a: Column, b: Column) -> Column:
    """Per axis: -1 wholly below, 1 wholly above, 0 where the intervals overlap (the direction matrix in short)."""
    return F.array(*[F.when(_axis(a, k)[1] <= _axis(b, k)[0], -1).when(_axis(a, k)[0] >= _axis(b, k)[1], 1).otherwise(0) for k in range(3)])


def register(functions) -> None:
    """Make directions, region aggregates and principal_direction callable from rules."""
    for name, fn in DIRECTIONS.items():
        functions.scalars[name] = fn
        if name != "overlapping":
            functions.scalars["anatomical_" + name] = anatomical(name)
    functions.scalars |= {"region_union": region_union, "region_intersection": region_intersection, "region_difference": region_difference}
    functions.aggregates |= {"create_region": create_region, "create_region_overlay": create_region_overlay}
    functions.add(principal_direction, returns=bool)
    functions.aggregates.pop("principal_direction", None)


# --- regions


def region(voxels: Column, size: float = 1.0) -> Column:
    """A region of an array of (i, j, k) structs; a voxel spans ``size`` from its corner."""
    axes = ("i", "j", "k")
    low = F.array(*[F.array_min(voxels[c]).cast("double") * size for c in axes])
    high = F.array(*[(F.array_max(voxels[c]).cast("double") + 1) * size for c in axes])
    return F.struct(low.alias("lb"), high.alias("ub"), F.sort_array(F.array_distinct(voxels)).alias("voxels"))


def create_region(i: Column, j: Column, k: Column) -> Column:
    """Aggregate: the region of a group's voxels (a region's size bounds the group)."""
    return region(F.collect_set(F.struct(i.alias("i"), j.alias("j"), k.alias("k"))))


def create_region_overlay(i: Column, j: Column, k: Column, p: Column) -> Column:
    """Aggregate: a group's voxels with their values, in voxel order."""
    return F.sort_array(F.collect_set(F.struct(i.alias("i"), j.alias("j"), k.alias("k"), p.alias("p"))))


create_region.native = True  # type: ignore[attr-defined]
create_region_overlay.native = True  # type: ignore[attr-defined]


def principal_direction(region_, direction: str, eps: float = 1e-6) -> bool:
    """Whether a region's longest principal axis runs along LR, AP or SI (in either sense); no if two axes tie."""
    import numpy as np

    xyz = np.array([[v["i"], v["j"], v["k"]] for v in region_["voxels"]], float)
    if len(xyz) < 2:
        return False
    values, vectors = np.linalg.eigh(np.cov(xyz.T))
    axis = np.abs(vectors[:, int(np.argmax(np.abs(values)))])
    order = np.argsort(axis)
    if abs(axis[order[-1]] - axis[order[-2]]) < eps:
        return False
    return ("LR", "AP", "SI")[int(order[-1])] in (direction, direction[::-1])


def regions_of(df: DataFrame, keys: list[str], i: str = "i", j: str = "j", k: str = "k") -> DataFrame:
    """One region per key from a table of voxels (a label image as rows)."""
    voxel = F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(k).alias("k"))
    return df.groupBy(*keys).agg(F.collect_set(voxel).alias("__v")).select(*keys, region(F.col("__v")).alias("region"))


def region_union(a: Column, b: Column) -> Column:
    return region(F.array_union(a["voxels"], b["voxels"]))


def region_intersection(a: Column, b: Column) -> Column:
    return region(F.array_intersect(a["voxels"], b["voxels"]))


def region_difference(a: Column, b: Column) -> Column:
    return region(F.array_except(a["voxels"], b["voxels"]))


def sphere(center: tuple[float, float, float], radius: float) -> Column:
    """Voxels whose indices lie within the radius of the centre."""
    lo = [int(c - radius) - 1 for c in center]
    hi = [int(c + radius) + 1 for c in center]
    each = lambda k: F.sequence(F.lit(lo[k]), F.lit(hi[k]))
    voxels = F.flatten(F.transform(each(0), lambda i: F.flatten(F.transform(each(1), lambda j: F.transform(each(2), lambda k: F.struct(i.alias("i"), j.alias("j"), k.alias("k")))))))
    near = F.filter(voxels, lambda v: F.pow(v["i"] - center[0], 2) + F.pow(v["j"] - center[1], 2) + F.pow(v["k"] - center[2], 2) <= radius * radius)
    return region(near)


def voxels(df: DataFrame, column: str = "region") -> DataFrame:
    """A row per voxel of a region column."""
    return df.select(*[c for c in df.columns if c != column], F.inline(F.col(column)["voxels"]))


def to_millimetres(i: Column, j: Column, k: Column, affine: list[list[float]]) -> list[Column]:
    """Voxel indices to coordinates by a 4 x 4 matrix."""
    return [sum((c * v for c, v in zip(row[:3], (i, j, k), strict=True)), F.lit(row[3])) for row in affine[:3]]


def principal_regions(df: DataFrame, k: int, column: str = "region", ties: list[str] | None = None) -> DataFrame:
    """The k regions with most voxels; equal ones in the order of ``ties``."""
    return df.orderBy(F.size(F.col(column)["voxels"]).desc(), *(ties or [])).limit(k)


def overlay(df: DataFrame, shape: tuple[int, int, int], value: str | None = None):
    """Voxel rows as a numpy image (on the driver; the image bounds its size)."""
    import numpy as np

    out = np.zeros(shape)
    for r in df.toLocalIterator():
        out[r["i"], r["j"], r["k"]] = 1.0 if value is None else r[value]
    return out
