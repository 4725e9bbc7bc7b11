"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1 (piecewise linear). Its integral, scaled to the source's target
words, is the source's cumulative demand. A source's documents stand in an order given by a hash of their ids and are
taken up to three times, pass after pass; a copy's middle word is its place in the source's cumulative supply, and
inverting the cumulative demand there gives the copy's training position. Range-sorting copies by position gives the
training order.

Targets share the total by weight; no target exceeds ``max_epochs`` times its source's size, and the excess is shared
again by weight until none is above. A copy is taken if its middle lies within the target, so a source's taken words
miss its target by half a document at most, and no document is taken more than ``max_epochs`` times.

Supply is a running sum over all documents: rows are range-partitioned by (source, hash), summed within partitions, and
shifted by the totals of the partitions before. Up to ``few`` sources are planned on the driver; more of them by distributed
sums, with the same targets.

Defined results: a null text has size 0; a document of size 0 is taken with no words. A null source is a source of its
own, ranked last. Repeated rows count as separate documents; equal keys are ordered by size. An empty table gives an empty
table. Extra columns never matter. ``training_documents`` tells rows apart by all their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewise.llm.columns import WORD, fresh, row_hash
from clausewise.runtime import cut, stored

Schedule = list[tuple[float, float]]
#: Rows of a source are dealt to this many cells where they meet its plan.
CELLS = 16


def rank_weight(rank: int) -> float:
    """Weights 1, 2, 3, repeating."""
    return float(rank % 3 + 1)


def rank_schedule(rank: int) -> Schedule:
    """Every other source fades out, the others fade in."""
    return [(0.0, 1.5), (1.0, 0.5)] if rank % 2 == 0 else [(0.0, 0.5), (1.0, 1.5)]


def share_targets(sizes: list[int], weights: list[float], total: float, max_epochs: int) -> list[float]:
    """Targets in proportion to weights, none above max_epochs times its size, the excess shared again."""
    out = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if w <= 0 or left * weights[i] / w >= max_epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
            left -= out[i]
        open_ -= set(over)
    return out


@dataclass
class Demand:
    """Cumulative demand of one source, as segments of time."""

    t0: list[float]
    w0: list[float]
    slope: list[float]
    c0: list[float]  # demand before each segment

    @staticmethod
    def of(schedule: Schedule, target: float) -> Demand:
        pts = sorted(schedule)
        if pts[0][0] > 0:
            pts = [(0.0, pts[0][1]), *pts]
        if pts[-1][0] < 1:
            pts = [*pts, (1.0, pts[-1][1])]
        area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:], strict=False)]
        if any(w < 0 for _, w in pts) or sum(area) <= 0:
            raise ValueError("a schedule must not be negative and must have a positive integral")
        k = target / sum(area)
        c = np.cumsum([0.0, *area])[:-1] * k
        return Demand([a[0] for a in pts[:-1]], [a[1] * k for a in pts[:-1]], [(b[1] - a[1]) / (b[0] - a[0]) * k if b[0] > a[0] else 0.0 for a, b in zip(pts, pts[1:], strict=False)], c.tolist())


def invert(demand: dict[str, Column], at: Column) -> Column:
    """Time at which the cumulative demand reaches ``at``: the quadratic of the last segment that begins before it."""
    n = F.size(demand["c0"])
    k = F.greatest(F.size(F.filter(demand["c0"], lambda c: c <= at)), F.lit(1))
    k = F.least(k, n)
    t0, w0, s, c0 = (F.element_at(demand[x], k) for x in ("t0", "w0", "slope", "c0"))
    y = F.greatest(at - c0, F.lit(0.0))
    root = F.sqrt(F.greatest(w0 * w0 + 2 * s * y, F.lit(0.0)))
    # the form 2y / (w0 + root) holds for a slope of 0 too
    step = F.coalesce(F.try_divide(2 * y, w0 + root), F.lit(0.0))
    return F.least(F.greatest(t0 + step, F.lit(0.0)), F.lit(1.0))


PLAN = "source_size long, target double, t0 array<double>, w0 array<double>, slope array<double>, c0 array<double>"


def _few_plans(per: DataFrame, weight: Callable[[int], float], schedule: Callable[[int], Schedule], max_epochs: int, share: float, few: int) -> DataFrame | None:
    """Each source's size, target and demand, made on the driver; None for more than ``few`` sources."""
    found = [(r["source"], r["size"]) for r in per.limit(few + 1).collect()]
    if len(found) > few:
        return None
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be", "surrogatepass")))
    targets = share_targets([s for _, s in found], [weight(k) for k in range(len(found))], share * sum(s for _, s in found), max_epochs)
    plan = [(name, size, target, d.t0, d.w0, d.slope, d.c0) for k, ((name, size), target) in enumerate(zip(found, targets, strict=True)) for d in [Demand.of(schedule(k), target)]]
    return per.sparkSession.createDataFrame(plan, f"source {per.schema['source'].dataType.simpleString()}, {PLAN}")


def _many_plans(per: DataFrame, weight: Callable[[int], float], schedule: Callable[[int], Schedule], max_epochs: int, share: float) -> DataFrame:
    """The same for any number of sources: ranks by a range sort, and the water level by sums over all sources."""
    spark = per.sparkSession
    kind = per.schema["source"].dataType.simpleString()

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at = 0
        for pdf in batches:
            yield pdf.assign(part=TaskContext.get().partitionId(), place=np.arange(at, at + len(pdf)))
            at += len(pdf)

    order = F.col("source").asc_nulls_last()
    numbered = cut(per.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order).mapInPandas(number, f"source {kind}, size long, part int, place long"))
    # a row for each partition
    first, before = {}, 0
    for r in sorted(numbered.groupBy("part").count().collect(), key=lambda r: r["part"]):
        first[r["part"]], before = before, before + r["count"]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank = pdf["place"] + pdf["part"].map(first)
            yield pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "rank": rank.astype("int64"), "w": [float(weight(int(k))) for k in rank]})

    ranked = cut(numbered.mapInPandas(weigh, f"source {kind}, size long, rank long, w double"))
    cap = F.col("size") * float(max_epochs)
    total, level = ranked.agg(F.sum("size"), F.sum("w")).first()
    total, level = share * total, share * total / level if level else float("inf")
    while level != float("inf"):
        full = F.col("w") * level >= cap
        spent, open_ = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("w")))).first()
        new = (total - (spent or 0.0)) / open_ if open_ else float("inf")
        if new == level:
            break
        level = new
    target = cap if level == float("inf") else F.least(cap, F.col("w") * level)

    def demand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [Demand.of(schedule(int(k)), t) for k, t in zip(pdf["rank"], pdf["target"], strict=True)]
            yield pd.DataFrame({"source": pdf["source"], "source_size": pdf["size"], "target": pdf["target"], **{c: [getattr(d, c) for d in made] for c in ("t0", "w0", "slope", "c0")}})

    return cut(ranked.select("source", "size", "rank", target.alias("target")).mapInPandas(demand, f"source {kind}, {PLAN}"))


def mix(docs: DataFrame, weight: Callable[[int], float] = rank_weight, schedule: Callable[[int], Schedule] = rank_schedule, max_epochs: int = 3, share: float = 1.0, few: int = 100_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: Column | None = None) -> DataFrame:
    """Per row: id, tk (key, by default the text's hash), source, size, source_size, target, copies, positions
    array<double> (one per copy taken)."""
    spark = docs.sparkSession
    named = (F.xxhash64(F.col(f"`{text_col}`")) if key is None else key).alias("tk")
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), named, F.col(f"`{source_col}`").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    keyed = cut(sized.withColumn("h", F.xxhash64("id", F.lit(9))))
    per = keyed.groupBy("source").agg(F.sum("size").alias("size"))
    plans = _few_plans(per, weight, schedule, max_epochs, share, few)
    # one row a source, and one for each partition and source that meet: few + partitions at most
    small = F.broadcast if plans is not None else lambda df: df
    if plans is None:
        plans = _many_plans(per, weight, schedule, max_epochs, share)
    kind = docs.schema[source_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict = {}
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            before = pd.Series(0, pdf.index, dtype="int64")
            for name, rows in pdf.groupby("source", dropna=False, sort=False).indices.items() if len(pdf) else ():
                key = None if name is None or name != name else name
                sums = pdf["size"].to_numpy()[rows].cumsum()
                before.iloc[rows] = held.get(key, 0) + sums - pdf["size"].to_numpy()[rows]
                held[key] = held.get(key, 0) + int(sums[-1])
            yield pdf.assign(before=before, part=part)[["id", "tk", "source", "size", "before", "part"]]

    id_kind = docs.schema[id_col].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run_sums = cut(keyed.repartitionByRange(n, "source", "h", "id", "size", "tk").sortWithinPartitions("source", "h", "id", "size", "tk").mapInPandas(run, f"id {id_kind}, tk long, source {kind}, size long, before long, part int"))
    totals = run_sums.groupBy("part", "source").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(F.col("part").alias("of_part"), F.col("source").alias("of_source"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shift"))
    x = run_sums.join(small(shift), (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source")))
    # a hot source's rows are dealt to cells, each with its plan
    x = x.select("id", "tk", "source", "size", (F.col("before") + F.col("shift")).alias("before"), F.pmod(F.xxhash64("id", "tk"), F.lit(CELLS)).cast("int").alias("cell"))
    plans = plans.withColumnRenamed("source", "of_source").withColumn("of_cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    x = x.join(small(plans), F.col("source").eqNullSafe(F.col("of_source")) & (F.col("cell") == F.col("of_cell")))
    middle = F.col("before") + F.col("size") / 2
    copies = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.least(F.lit(max_epochs), F.greatest(F.lit(0), F.floor((F.col("target") - middle) / F.col("source_size")) + 1))).cast("int")
    x = x.withColumn("copies", copies)
    demand = {c: F.col(c) for c in ("t0", "w0", "slope", "c0")}
    places = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: invert(demand, middle + k * F.col("source_size")))
    return x.select("id", "tk", "source", "size", "source_size", "target", "copies", F.when(F.col("copies") > 0, places).otherwise(F.array().cast("array<double>")).alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy taken (id, copy, position), range-sorted by position."""
    return mixed.select("id", F.posexplode("positions").alias("copy", "position")).orderBy("position", "id", "copy")


def training_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs in training order: rows not taken go, rows taken more than once repeat; columns stay as they are."""
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, key=row_hash(docs), **options)
    # rows equal in all columns pool their positions
    pooled = stored(mixed.filter(F.size("positions") > 0).groupBy("id", "tk").agg(F.count(F.lit(1)).alias("rows"), F.flatten(F.collect_list("positions")).alias("positions")))
    pid, ptk, rows, places, place, rid, row = fresh(docs, "mix_id", "mix_tk", "mix_rows", "mix_positions", "mix_position", "row_id", "row_tk")
    left = docs.withColumns({rid: F.col(f"`{id_col}`"), row: row_hash(docs)})
    if not pooled.filter("rows > 1").isEmpty():
        left = left.dropDuplicates([rid, row])
    x = left.join(pooled.toDF(pid, ptk, rows, places), F.col(rid).eqNullSafe(F.col(pid)) & (F.col(row) == F.col(ptk)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return x.select(*columns, F.explode(places).alias(place)).orderBy(place, F.col(f"`{id_col}`")).select(*columns)
