"""Probabilities of query answers over independent facts and mutually exclusive choices.

A query over probabilistic predicates is unfolded to a union of conjunctive queries. Lifted rules turn it into relational
operators alone: sums over choice alternatives, noisy-or over a separator variable, products of independent parts, and
inclusion-exclusion between dependent disjuncts (terms with equal queries cancel). Deterministic atoms and conditions only
restrict bindings. Where no rule applies, each answer's lineage (its grounded clauses) is gathered and counted exactly by
Shannon expansion with independent components and memoisation; choices branch over their alternatives. Alternatives that
stand beside the same events in an answer are merged first, with the sum of their chances.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import combinations, product
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.operators.provenance import P, ProbRelation, weighted_join
from clausewise.operators.relation import Relation, _col
from clausewise.plans.ast import And, Atom, Call, Compare, Const, Exists, Not, NotLiftable, Or, ProgramError, Rule, Truth, Var, conjuncts, free_vars, fresh_name, substitute
from clausewise.plans.compiler import Compiler
from clausewise.plans.constraints import unify
from clausewise.runtime import released, stored

#: Clauses of one answer's lineage beyond which counting refuses.
MAX_CLAUSES = 20_000
#: Disjuncts beyond which inclusion-exclusion is not tried.
MAX_TERMS = 6


class Solver:
    def __init__(self, compiler: Compiler, kind: Callable[[str], str], rules: Callable[[str], list[Rule]]):
        """kind: det, fact, choice, or prob for predicates that rules define from probabilistic ones."""
        self.c, self.kind, self.rules = compiler, kind, rules
        self.used: list[str] = []  # names of the methods used, for tests and explanations

    # --- unfolding
    def disjuncts(self, body: Any) -> list[list]:
        """Lists of parts: atoms over stored or deterministic predicates, negated ones, and conditions."""
        parts = conjuncts(self.c.expand_formula(body))
        out: list[list] = [[]]
        for p in parts:
            out = [a + b for a, b in product(out, self._unfold(p))]
        return [self._simplify(x) for x in out if x is not None]

    def _touches(self, f: Any) -> bool:
        if isinstance(f, Atom):
            return self.c.is_predicate(f.pred) and self.kind(f.pred) != "det"
        if isinstance(f, (Not, Exists)):
            return self._touches(f.body)
        if isinstance(f, (And, Or)):
            return any(self._touches(x) for x in f.items)
        return False

    def _unfold(self, p: Any) -> list[list]:
        if not self._touches(p):
            return [[p]] if p != Truth(True) else [[]]
        if isinstance(p, And):
            out: list[list] = [[]]
            for x in p.items:
                out = [a + b for a, b in product(out, self._unfold(x))]
            return out
        if isinstance(p, Or):
            return [y for x in p.items for y in self._unfold(x)]
        if isinstance(p, Exists):
            return self._unfold(substitute(p.body, {v: Var(fresh_name(v)) for v in p.vars}))
        if isinstance(p, Not):
            if isinstance(p.body, Atom) and self.kind(p.body.pred) in ("fact", "choice"):
                return [[p]]
            if isinstance(p.body, Not):
                return self._unfold(p.body.body)
            raise ProgramError("only stored probabilistic predicates can be negated in a probabilistic rule")
        if self.kind(p.pred) in ("fact", "choice"):
            return [self.c.flatten([p])]
        out = []
        for r in self.rules(p.pred):
            if r.given is not None or r.kind != "det":
                raise ProgramError(f"{p.pred} cannot be unfolded")
            names = {v: Var(fresh_name(v)) for v in {*free_vars(r.head), *free_vars(r.body)}}
            head, body = substitute(r.head, names), substitute(r.body, names)
            if len(head.args) != len(p.args):
                raise ProgramError(f"{p.pred} has {len(head.args)} arguments, not {len(p.args)}")
            if any(isinstance(a, Call) for a in head.args):
                raise ProgramError(f"{p.pred} computes values from probabilistic predicates")
            to = unify(p, head)
            if to is None:
                continue
            mine = {v: t for v, t in to.items() if v in free_vars(p)}
            more = [Compare("==", Var(v), t) for v, t in mine.items()]
            inner = substitute(body, {v: t for v, t in to.items() if v not in mine})
            for d in self.disjuncts(inner):
                out.append(d + more)
        return out

    def _simplify(self, parts: list) -> list | None:
        """Without repeats; atoms of one choice made equal; equalities between variables of the body put in place."""
        while True:
            parts = list(dict.fromkeys(parts))
            seen: dict[str, Atom] = {}
            again = None
            for p in parts:
                if isinstance(p, Atom) and self.c.is_predicate(p.pred) and self.kind(p.pred) == "choice":
                    if p.pred in seen:
                        to = unify(seen[p.pred], p)
                        if to is None:
                            return None
                        again = to
                        break
                    seen[p.pred] = p
            if again is None:
                return parts
            parts = [substitute(p, again) for p in parts] + [Compare("==", Var(v), t) for v, t in again.items()]
            parts = list(dict.fromkeys(parts))
            if all(isinstance(p, Compare) for p in parts):
                return parts
            # the equality stays only for variables that others still name
            parts = [p for p in parts if not (isinstance(p, Compare) and p.op == "==" and p.left == p.right)]

    # --- lifted plans
    def _literals(self, parts: list) -> list[tuple[Atom, bool]]:
        out = []
        for p in parts:
            a = p.body if isinstance(p, Not) else p
            if isinstance(a, Atom) and self.c.is_predicate(a.pred) and self.kind(a.pred) != "det":
                out.append((a, not isinstance(p, Not)))
        return out

    def solve(self, head: list[str], body: Any, methods: tuple[str, ...] = ("lifted", "lineage")) -> ProbRelation:
        """Answers over the head variables with their probabilities; methods are tried in order."""
        found = [d for d in self.disjuncts(body) if d is not None]
        if not found:
            raise ProgramError("the query can never hold")
        for k, m in enumerate(methods):
            try:
                out = self.lift_union(head, found) if m == "lifted" else self.lineage(head, found)
                self.used.append(m)
                return out.positive()
            except NotLiftable:
                if k + 1 == len(methods):
                    raise
        raise NotLiftable("no method")

    def lift_union(self, head: list[str], found: list[list]) -> ProbRelation:
        found = self._drop_contained(head, found)
        groups: list[tuple[set, list[list]]] = []
        for parts in found:
            symbols = {a.pred for a, _ in self._literals(parts)}
            mine = [g for g in groups if g[0] & symbols]
            groups = [g for g in groups if not any(g is m for m in mine)]
            groups.append((set().union(symbols, *[m[0] for m in mine]), [x for m in mine for x in m[1]] + [parts]))
        sides = [self._lift_group(head, g) for _, g in groups]
        if len(sides) == 1:
            return sides[0]
        return sides[0].union_independent(*sides[1:])

    def _lift_group(self, head: list[str], found: list[list]) -> ProbRelation:
        if len(found) == 1:
            return self.lift(head, found[0])
        if all(not self._literals(p) for p in found):
            sides = [self.lift(head, p).rel.project(*head) for p in found]
            out = sides[0]
            for s in sides[1:]:
                out = out.union(s)
            return ProbRelation(out.as_set(), True)
        if len(found) > MAX_TERMS:
            raise NotLiftable("too many dependent disjuncts")
        terms: dict[str, tuple[float, list]] = {}
        for k in range(1, len(found) + 1):
            for some in combinations(found, k):
                parts: list = []
                for j, d in enumerate(some):
                    names = {v: Var(fresh_name(v)) for p in d for v in free_vars(p) if v not in head} if j else {}
                    parts += [substitute(p, names) for p in d]
                simple = self._simplify(parts)
                if simple is None:
                    continue  # two alternatives of one choice never hold together
                simple = self._core(head, simple)
                key = self._key(head, simple)
                weight = terms.get(key, (0.0, simple))[0] + (1.0 if k % 2 else -1.0)
                terms[key] = (weight, simple)
        used = [(w, p) for w, p in terms.values() if w]
        return weighted_join([self.lift(head, p) for _, p in used], [w for w, _ in used])

    def lift(self, head: list[str], parts: list) -> ProbRelation:
        lits = self._literals(parts)
        other = [p for p in parts if not self._literals([p])]
        inner = {v for p in parts for v in free_vars(p)} - set(head)
        # parts over head variables only restrict or multiply the joined result
        late = [p for p in parts if not set(free_vars(p)) & inner and (not isinstance(p, Atom) or not self.c.is_predicate(p.pred))]
        rest = [p for p in parts if p not in late]
        groups: list[tuple[set, list]] = []
        for p in rest:
            mine_vars = set(free_vars(p)) & inner
            mine = [g for g in groups if g[0] & mine_vars]
            groups = [g for g in groups if not any(g is m for m in mine)]
            groups.append((mine_vars.union(*[m[0] for m in mine]), [x for m in mine for x in m[1]] + [p]))
        # a part that only computes or compares needs the atoms that bind its variables
        binding = [g for g in groups if any(isinstance(p, Atom) and self.c.is_predicate(p.pred) for p in g[1])]
        if len(binding) != len(groups):
            raise NotLiftable("a condition stands apart from its atoms")
        certain = [g for g in binding if not self._literals(g[1])]
        random = [g for g in binding if self._literals(g[1])]
        if len(random) > 1:
            symbols = [{a.pred for a, _ in self._literals(g[1])} for g in random]
            if any(a & b for a, b in combinations(symbols, 2)):
                raise NotLiftable("parts that are not independent")
        if not random and not lits:
            rel = self.c.conjunction(parts)
            return ProbRelation(rel.project(*[v for v in head if v in rel.columns]).as_set(), True)
        out: ProbRelation | None = None
        if certain:
            all_ = [p for g in certain for p in g[1]]
            names = {v for p in all_ for v in free_vars(p)}
            rel = self.c.conjunction(all_)
            out = ProbRelation(rel.project(*[v for v in head if v in names]).as_set(), True)
        for _, g in random:
            names = {v for p in g for v in free_vars(p)}
            side = self._lift_connected([v for v in head if v in names], g)
            out = side if out is None else out.join(side)
        if out is None:
            raise NotLiftable("nothing binds the variables")
        return self._late(out, late, other)

    def _late(self, out: ProbRelation, late: list, other: list) -> ProbRelation:
        tests = [p for p in late if not (isinstance(p, Not) and self._literals([p]))]
        if tests:
            out = ProbRelation(self.c.conjunction(tests, out.rel), out.certain)
        for p in late:
            if isinstance(p, Not) and self._literals([p]):
                out = out.minus(ProbRelation(self._stored(p.body)))
        return out

    def _stored(self, a: Atom) -> Relation:
        """A probabilistic atom's matches with their probabilities."""
        return self.c.atom(Atom(a.pred, (Var(P), *a.args)), self.c.lookup(a.pred))

    def _lift_connected(self, head: list[str], parts: list) -> ProbRelation:
        lits = self._literals(parts)
        inner = [v for v in dict.fromkeys(v for a, _ in lits for v in free_vars(a)) if v not in head]
        if not inner:
            if len(lits) != 1:
                raise NotLiftable("several events share hidden variables")
            (a, positive), det = lits[0], [p for p in parts if not self._literals([p])]
            if positive:
                rel = self.c.conjunction(det, self._stored(a)) if det else self._stored(a)
                return ProbRelation(rel.project(*[v for v in head], P).as_set())
            rel = self.c.conjunction(det)
            return ProbRelation(rel.project(*[v for v in head if v in rel.columns]).as_set(), True).minus(ProbRelation(self._stored(a)))
        for a, positive in lits:
            mine = [v for v in free_vars(a) if v in inner]
            if self.kind(a.pred) == "choice" and positive and mine:
                return self.lift([*head, *mine], parts).project_disjoint(*head)
        for x in inner:
            at: dict[str, set] = {}
            if all(x in free_vars(a) for a, _ in lits):
                for a, _ in lits:
                    at.setdefault(a.pred, set()).add(tuple(i for i, t in enumerate(a.args) if t == Var(x)))
                if all(len(s) == 1 or set.intersection(*map(set, s)) for s in at.values()) and all(self.kind(a.pred) == "fact" for a, _ in lits):
                    return self.lift([*head, x], parts).project_independent(*head)
        two = self._two_apart(head, parts, lits, inner)
        if two is not None:
            return two
        raise NotLiftable("no separator variable")

    def _two_apart(self, head: list[str], parts: list, lits: list[tuple[Atom, bool]], inner: list[str]) -> ProbRelation | None:
        """Two atoms of one fact predicate that differ in one hidden variable, held apart by x < y or x != y: ranking.

        Both hold for some pair if at least two of the rows with the other arguments hold: a sum over rows, no pairs.
        """
        tests = [p for p in parts if isinstance(p, Compare)]
        if len(lits) != 2 or len(tests) != 1 or len(parts) != 3 or len(inner) != 2 or tests[0].op not in ("<", ">", "!=") or {tests[0].left, tests[0].right} != {Var(v) for v in inner}:
            return None
        (a, one), (b, other) = lits
        apart = [(s, t) for s, t in zip(a.args, b.args, strict=False) if s != t]
        if not (one and other) or a.pred != b.pred or self.kind(a.pred) != "fact" or len(a.args) != len(b.args) or len(apart) != 1 or {*apart[0]} != {Var(v) for v in inner}:
            return None
        rows = self._stored(a)
        chance, keys = _col(P), [_col(h) for h in head]
        open_ = F.when(chance < 1.0, chance)
        # rows that surely hold; the chance that none of the others holds; the sum that leads to exactly one of them
        sums = rows.df.filter((chance > 0) & _col(apart[0][0].name).isNotNull()).groupBy(*keys).agg(F.count(F.when(chance >= 1.0, 1)).alias("__sure"), F.exp(F.coalesce(F.sum(F.log1p(-open_)), F.lit(0.0))).alias("__none"), F.coalesce(F.sum(open_ / (1 - open_)), F.lit(0.0)).alias("__odds"))
        both = F.when(F.col("__sure") > 1, 1.0).when(F.col("__sure") == 1, 1 - F.col("__none")).otherwise(1 - F.col("__none") * (1 + F.col("__odds")))
        return ProbRelation(Relation(sums.select(*keys, F.greatest(both, F.lit(0.0)).alias(P)), True)).positive()

    # --- minimisation
    def _homomorphism(self, a: list, b: list, head: list[str]) -> bool:
        """Whether the positive atoms of a map into those of b with head variables fixed (no other parts allowed)."""
        if not all(isinstance(p, Atom) for p in [*a, *b]):
            return a == b

        def search(k: int, to: dict[str, Any]) -> bool:
            if k == len(a):
                return True
            for q in b:
                if q.pred != a[k].pred or len(q.args) != len(a[k].args):
                    continue
                now = dict(to)
                for s, t in zip(a[k].args, q.args, strict=True):
                    if isinstance(s, Const) or (isinstance(s, Var) and s.name in head):
                        if s != t:
                            break
                    elif now.setdefault(s.name, t) != t:
                        break
                else:
                    if search(k + 1, now):
                        return True
            return False

        return search(0, {})

    def _drop_contained(self, head: list[str], found: list[list]) -> list[list]:
        """Without disjuncts that another one contains."""
        out: list[list] = []
        for i, a in enumerate(found):
            if any(self._homomorphism(b, a, head) and (j < i or not self._homomorphism(a, b, head)) for j, b in enumerate(found) if j != i):
                continue
            out.append(self._core(head, a))
        return out

    def _core(self, head: list[str], parts: list) -> list:
        """Without atoms that the others imply."""
        parts = list(parts)
        for p in list(parts):
            rest = [q for q in parts if q is not p]
            if rest and all(isinstance(q, Atom) for q in parts) and set(head) & {v for q in parts for v in free_vars(q)} <= {v for q in rest for v in free_vars(q)} and self._homomorphism(parts, rest, head):
                parts = rest
        return parts

    def _key(self, head: list[str], parts: list) -> str:
        names: dict[str, str] = {h: h for h in head}
        order = sorted(parts, key=lambda p: (getattr(p, "pred", "~"), [str(a) if isinstance(a, Const) or (isinstance(a, Var) and a.name in head) else "" for a in getattr(p, "args", ())]))
        for p in order:
            for v in free_vars(p):
                names.setdefault(v, f"?{len(names)}")
        return "&".join(sorted(str(substitute(p, {v: Var(n) for v, n in names.items()})) for p in parts))

    # --- exact counting
    def lineage(self, head: list[str], found: list[list]) -> ProbRelation:
        """Ground clauses of each answer, counted exactly per answer."""
        rows = None
        for parts in found:
            lits = self._literals(parts)
            det = [p for p in parts if not self._literals([p])]
            rel: Relation | None = None
            cells, drop = [], []
            for k, (a, positive) in enumerate(lits):
                if not positive:
                    continue
                p = f"__p{k}"
                side = self._stored(a).rename(P, p)
                rel = side if rel is None else rel.natural_join(side)
                cells.append(self._cell(a, _col(p), False))
                drop.append(p)
            if det:
                rel = self.c.conjunction(det, rel)
            if rel is None:
                raise ProgramError("a probabilistic body needs a positive atom")
            for k, (a, positive) in enumerate(lits):
                if not positive:
                    p = f"__p{k}"
                    if set(free_vars(a)) - set(rel.columns):
                        raise ProgramError("unsafe negation of a probabilistic atom")
                    rel = rel.left_join(self._stored(a).rename(P, p))
                    cells.append(F.when(_col(p) > 0, self._cell(a, _col(p), True)))
            clause = F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast("array<struct<id:string,p:double,block:string,neg:boolean>>")
            side = rel.df.select(*map(_col, head), F.sort_array(clause).alias("__clause"))
            rows = side if rows is None else rows.unionByName(side)
        # clauses travel as JSON: arrays of arrays of structs have no frame form
        rows = stored(rows.distinct())
        every = [x for parts in found for x in self._literals(parts)]
        negated = {a.pred for a, positive in every if not positive}
        for choice in sorted({a.pred for a, _ in every if self.kind(a.pred) == "choice"} - negated):
            whole, rows = rows, stored(self._merge_alternatives(head, rows, choice))
            released(whole)
        # counted before any answer's clauses are gathered
        self._refuse_more(rows, *map(_col, head))
        grouped = rows.groupBy(*map(_col, head)).agg(F.collect_list(F.to_json("__clause")).alias("__clauses"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = pdf[head].copy()
                out[P] = [count_clauses([[(c["id"], c["p"], c.get("block"), c["neg"]) for c in json.loads(clause)] for clause in clauses]) for clauses in pdf["__clauses"]]
                yield out

        fields = {f.name: f.dataType.simpleString() for f in grouped.schema}
        return ProbRelation(Relation(grouped.mapInPandas(run, ", ".join([*[f"`{h}` {fields[h]}" for h in head], f"{P} double"])), True))

    @staticmethod
    def _refuse_more(rows: DataFrame, *keys) -> None:
        if not rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > MAX_CLAUSES).isEmpty():
            raise ProgramError(f"an answer's lineage has more than {MAX_CLAUSES} clauses")

    def _merge_alternatives(self, head: list[str], rows: DataFrame, choice: str) -> DataFrame:
        """Clauses in which alternatives of a choice that stand beside the same rests in an answer are one alternative.

        They exclude each other and nothing tells them apart, so their chances add up. A clause holds one alternative of a
        choice at most (``_simplify``); the choice is not negated.
        """
        keys = [*map(_col, head)]
        mine = F.filter("__clause", lambda x: x["block"].eqNullSafe(choice))
        rest = F.filter("__clause", lambda x: ~x["block"].eqNullSafe(choice))
        split = rows.select(*keys, F.get(mine, F.lit(0)).alias("__one"), rest.alias("__rest"))
        named = split.filter("__one IS NOT NULL")
        # the rests of one alternative are gathered, so they are counted before
        self._refuse_more(named, *keys, "__one")
        alike = named.groupBy(*keys, "__one").agg(F.sort_array(F.collect_list("__rest")).alias("__rests")).groupBy(*keys, "__rests").agg(F.min("__one.id").alias("__id"), F.sum("__one.p").alias("__p"))
        merged = F.struct(F.col("__id").alias("id"), F.col("__p").alias("p"), F.lit(choice).alias("block"), F.lit(False).alias("neg"))
        joined = alike.select(*keys, F.explode("__rests").alias("__rest"), merged.alias("__one")).select(*keys, F.sort_array(F.concat(F.array("__one"), "__rest")).alias("__clause"))
        return joined.unionByName(split.filter("__one IS NULL").select(*keys, F.col("__rest").alias("__clause")))

    def _cell(self, a: Atom, p, neg: bool):
        values = [self.c.column(t).cast("string") for t in a.args]
        name = F.concat_ws("\u0001", F.lit(a.pred), *[F.coalesce(v, F.lit("\u0000")) for v in values])
        block = F.lit(a.pred) if self.kind(a.pred) == "choice" else F.lit(None).cast("string")
        return F.struct(name.alias("id"), p.cast("double").alias("p"), block.alias("block"), F.lit(neg).alias("neg"))


def count_clauses(clauses: list[list[tuple[str, float, str | None, bool]]], limit: int = MAX_CLAUSES) -> float:
    """Probability that some clause holds; a clause is a conjunction of (id, probability, block or None, negated)."""
    if len(clauses) > limit:
        raise ProgramError(f"an answer's lineage has more than {limit} clauses")
    chance = {i: p for c in clauses for i, p, _, _ in c}
    block = {i: b for c in clauses for i, _, b, _ in c}
    memo: dict[frozenset, float] = {}

    def known(c: frozenset) -> frozenset | None:
        """A clause without contradictions: of one block at most one positive alternative."""
        positive = [i for i, n in c if not n]
        if any((i, True) in c for i in positive):
            return None
        of: dict[str, str] = {}
        for i in positive:
            b = block[i]
            if b is not None and of.setdefault(b, i) != i:
                return None
        # a chosen alternative rules out the others of its block
        return frozenset((i, n) for i, n in c if not (n and block[i] in of and of[block[i]] != i)) if of else c

    def solve(cs: frozenset) -> float:
        if not cs:
            return 0.0
        if frozenset() in cs:
            return 1.0
        if cs in memo:
            return memo[cs]
        # independent components share no fact and no block
        parent: dict[Any, Any] = {}

        def find(x: Any) -> Any:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for c in cs:
            keys = [block[i] or i for i, _ in c]
            for k in keys[1:]:
                parent[find(keys[0])] = find(k)
        groups: dict[Any, list] = {}
        for c in cs:
            i = next(iter(c))[0]
            groups.setdefault(find(block[i] or i), []).append(c)
        if len(groups) > 1:
            none = 1.0
            for g in groups.values():
                none *= 1.0 - solve(frozenset(g))
            out = 1.0 - none
        else:
            counts: dict[str, int] = {}
            for c in cs:
                for k in {block[i] or i for i, _ in c}:
                    counts[k] = counts.get(k, 0) + 1
            facts = {k for k in counts if block.get(k, k) is None}
            # a choice counts as one event; of equals a fact goes first, as it has two branches only
            pick = max(sorted(counts), key=lambda k: (counts[k], k in facts))
            if pick in facts:
                p = chance[pick]
                out = p * solve(given(cs, pick, True)) + (1 - p) * solve(given(cs, pick, False))
            else:
                out = sum(p * solve(some) for p, some in branches(cs, pick))
        memo[cs] = out
        return out

    def given(cs: frozenset, fact: str, value: bool) -> frozenset:
        # (fact, True) is its negation
        return frozenset(c - {(fact, not value)} for c in cs if (fact, value) not in c)

    def branches(cs: frozenset, b: str) -> Iterator[tuple[float, frozenset]]:
        """What each alternative of block b leaves, once for all alternatives that leave the same, with their chance."""
        free, chosen, denied = [], {}, []
        for c in cs:
            mine = [x for x in c if block[x[0]] == b]
            if not mine:
                free.append(c)
            elif positive := [i for i, n in mine if not n]:
                chosen.setdefault(positive[0], []).append(c.difference(mine))
            else:
                denied.append(({i for i, _ in mine}, c.difference(mine)))
        named = {i for ids, _ in denied for i in ids}
        same: dict[tuple, float] = {}
        for i in sorted(named.union(chosen)):
            key = frozenset(chosen.get(i, ())), i if i in named else None
            same[key] = same.get(key, 0.0) + chance[i]
        # or none of those that clauses name
        other = frozenset(), None
        same[other] = same.get(other, 0.0) + max(0.0, 1.0 - sum(same.values()))
        for (more, i), p in same.items():
            yield p, more.union(free, (c for ids, c in denied if i not in ids))

    start = [known(frozenset((i, n) for i, _, _, n in c)) for c in clauses]
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(chance) + 2000))
    return solve(frozenset(c for c in start if c is not None))
