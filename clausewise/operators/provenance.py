"""Relations whose rows carry a probability in one column, and their operators.

Noisy-or is ``1 - product(1 - p)``, which is right for p = 1 too; conditional probabilities use a division that yields null
for a denominator of 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.operators.relation import Relation, RelationError, _col

P = "_p"


class ProbRelation:
    """A relation and its probability column; ``certain`` says that all probabilities are 1 (the column may be missing)."""

    def __init__(self, rel: Relation, certain: bool = False):
        if not certain and P not in rel.columns:
            raise RelationError(f"no column {P}")
        self.rel, self.certain = rel, certain

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rel.columns if c != P]

    def with_p(self) -> Relation:
        return self.rel if P in self.rel.columns else self.rel.constant(P, 1.0)

    def _group(self, names: list[str], value: Column) -> ProbRelation:
        df = self.with_p().df
        out = df.groupBy(*map(_col, names)).agg(value.alias(P))
        if not names:
            # no rows: no answer, rather than one with a neutral probability
            out = df.agg(value.alias(P), F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")
        return ProbRelation(Relation(out, True))

    # --- projections
    def project_independent(self, *names: str) -> ProbRelation:
        """Exists, over independent rows."""
        if self.certain:
            return ProbRelation(self.rel.project(*names).as_set(), True)
        return self._group(list(names), 1 - F.product(1 - _col(P)))

    def project_universal(self, *names: str) -> ProbRelation:
        """For all, over independent rows."""
        return self._group(list(names), F.product(_col(P)))

    def project_disjoint(self, *names: str) -> ProbRelation:
        """Exists, over mutually exclusive rows; also the sum of signed terms."""
        return self._group(list(names), F.sum(_col(P)))

    # --- joins
    def join(self, other: ProbRelation) -> ProbRelation:
        """Conjunction of independent events: probabilities multiply."""
        if self.certain or other.certain:
            a = Relation(self.rel.df.drop(P), self.rel.distinct) if self.certain and P in self.rel.columns else self.rel
            b = Relation(other.rel.df.drop(P), other.rel.distinct) if other.certain and P in other.rel.columns else other.rel
            return ProbRelation(a.natural_join(b), self.certain and other.certain)
        q = other.rel.rename(P, "__q")
        j = self.rel.natural_join(q)
        return ProbRelation(Relation(j.df.withColumn(P, _col(P) * _col("__q")).drop("__q"), j.distinct))

    def divide(self, other: ProbRelation) -> ProbRelation:
        """Conditional probability: join and divide."""
        q = other.with_p().rename(P, "__q")
        j = self.with_p().natural_join(q)
        return ProbRelation(Relation(j.df.withColumn(P, F.try_divide(_col(P), _col("__q"))).drop("__q"), j.distinct))

    def minus(self, other: ProbRelation) -> ProbRelation:
        """A and not B, independent: p * (1 - q), q 0 where B has no row."""
        q = other.with_p().rename(P, "__q")
        j = self.with_p().left_join(q)
        return ProbRelation(Relation(j.df.withColumn(P, _col(P) * (1 - F.coalesce(_col("__q"), F.lit(0.0)))).drop("__q"), j.distinct))

    # --- unions
    def union_independent(self, *others: ProbRelation) -> ProbRelation:
        return self._stack(others).project_independent(*self.columns)

    def union_disjoint(self, *others: ProbRelation) -> ProbRelation:
        return self._stack(others).project_disjoint(*self.columns)

    def _stack(self, others: tuple[ProbRelation, ...]) -> ProbRelation:
        """Bag union: equal rows of several sides must all count."""
        return ProbRelation(reduce(lambda a, b: a.union_all(b), [o.with_p() for o in others], self.with_p()))

    def weighted(self, weight: float) -> ProbRelation:
        return ProbRelation(Relation(self.with_p().df.withColumn(P, _col(P) * weight), self.rel.distinct))

    def positive(self) -> ProbRelation:
        """Without impossible answers."""
        return self if self.certain else ProbRelation(Relation(self.rel.df.filter(_col(P) > 0), self.rel.distinct))


def weighted_join(parts: list[ProbRelation], weights: list[float]) -> ProbRelation:
    """Sum of weight times probability over all parts; a part without a row counts as 0."""
    scaled = [p.weighted(w) for p, w in zip(parts, weights, strict=True)]
    return scaled[0].union_disjoint(*scaled[1:])
