"""Rule bodies to DataFrame plans.

A body's conjunction becomes natural joins of its atoms (in an order that shares variables), filters and computed columns
as soon as their variables are bound, explodes, and null-safe anti-joins for negation. Nothing runs here: Catalyst sees the
whole rule.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.functions.builtins import Functions
from clausewise.operators.relation import Relation, _col, column_function, percentile_threshold
from clausewise.plans.ast import (
    AggBody,
    And,
    Atom,
    Call,
    Compare,
    Const,
    Exists,
    External,
    ForAll,
    Lambda,
    Not,
    Or,
    ProgramError,
    TupleTerm,
    Truth,
    Var,
    atoms_of,
    conjuncts,
    free_vars,
    fresh_name,
    substitute,
    term_vars,
)

#: A predicate's relation, with columns in argument order.
Lookup = Callable[[str], Relation]


class Compiler:
    def __init__(self, functions: Functions, lookup: Lookup, is_predicate: Callable[[str], bool], macros: dict | None = None, host: dict | None = None, distance_join: Callable | None = None):
        self.functions, self.lookup, self.is_predicate = functions, lookup, is_predicate
        self.macros, self.host, self.distance_join = macros or {}, host or {}, distance_join

    # --- terms
    def expand(self, t: Any) -> Any:
        """Host values, named constants and named lambdas put in place."""
        if isinstance(t, External):
            if t.name not in self.host:
                raise ProgramError(f"no host value {t.name}")
            return Const(self.host[t.name])
        if isinstance(t, Var) and t.name in self.functions.constants:
            return Const(self.functions.constants[t.name])
        if isinstance(t, Call):
            args = tuple(self.expand(a) for a in t.args)
            if t.name in self.macros:
                params, body = self.macros[t.name]
                if len(params) != len(args):
                    raise ProgramError(f"{t.name} takes {len(params)} arguments")
                return self.expand(substitute(body, dict(zip(params, args, strict=True))))
            return Call(t.name, args)
        if isinstance(t, TupleTerm):
            return TupleTerm(tuple(self.expand(a) for a in t.items))
        return t

    def expand_formula(self, f: Any) -> Any:
        if isinstance(f, Atom):
            return Atom(f.pred, tuple(self.expand(a) for a in f.args))
        if isinstance(f, Compare):
            return Compare(f.op, self.expand(f.left), self.expand(f.right))
        if isinstance(f, Not):
            return Not(self.expand_formula(f.body))
        if isinstance(f, (And, Or)):
            return type(f)(tuple(self.expand_formula(x) for x in f.items))
        if isinstance(f, (Exists, ForAll)):
            return type(f)(f.vars, self.expand_formula(f.body))
        if isinstance(f, AggBody):
            return AggBody(f.keys, self.expand_formula(f.body), f.fn, self.expand(f.arg), self.expand(f.result))
        return f

    def column(self, t: Any) -> Column:
        if isinstance(t, Var):
            return _col(t.name)
        if isinstance(t, Const):
            if isinstance(t.value, (list, set, frozenset, tuple)):
                return F.array(*[F.lit(v) for v in t.value])
            return F.lit(t.value)
        if isinstance(t, TupleTerm):
            return F.struct(*[self.column(x).alias(f"_{i}") for i, x in enumerate(t.items)])
        if isinstance(t, Call) and t.name == "item" and t.name not in self.functions.scalars:
            # an element of a tuple, by its place
            if len(t.args) != 2 or not isinstance(t.args[1], Const):
                raise ProgramError("item takes a tuple and a place")
            return self.column(t.args[0])[f"_{t.args[1].value}"]
        if isinstance(t, Call):
            fn = self.functions.scalars.get(t.name)
            if fn is None:
                raise ProgramError(f"no function {t.name}")
            return fn(*[self.column(a) for a in t.args])
        if isinstance(t, Lambda):
            raise ProgramError("a lambda can only be applied")
        raise ProgramError(f"cannot compute {t}")

    def condition(self, c: Compare) -> Column:
        a, b = self.column(c.left), self.column(c.right)
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]

    # --- atoms
    def atom(self, a: Atom, rel: Relation | None = None) -> Relation:
        """An atom's matches, with a column per variable."""
        rel = self.lookup(a.pred) if rel is None else rel
        if rel.arity != len(a.args):
            raise ProgramError(f"{a.pred} has {rel.arity} arguments, not {len(a.args)}")
        rel = rel.unnamed()
        keep: dict[str, str] = {}
        for i, t in enumerate(a.args):
            if isinstance(t, Const):
                rel = rel.select_constants({f"_{i}": t.value})
            elif isinstance(t, Var):
                if t.name in keep:
                    rel = rel.select_columns(keep[t.name], f"_{i}")
                else:
                    keep[t.name] = f"_{i}"
            else:
                raise ProgramError(f"an argument of {a.pred} must be a variable or a constant here")
        distinct = rel.distinct and all(isinstance(t, (Const, Var)) for t in a.args)
        return Relation(rel.df.select(*[_col(c).alias(v) for v, c in keep.items()]), distinct)

    def flatten(self, parts: list) -> list:
        """Expressions inside atoms become variables with an equality."""
        out = []
        for p in parts:
            if isinstance(p, Atom) and (self.is_predicate(p.pred) or p.pred == "contains"):
                args, more = [], []
                for i, t in enumerate(p.args):
                    if isinstance(t, (Var, Const)) or (p.pred == "contains" and i == 1):
                        args.append(t)
                    else:
                        v = Var(fresh_name())
                        args.append(v)
                        more.append(Compare("==", v, t))
                out += [Atom(p.pred, tuple(args)), *more]
            else:
                out.append(p)
        return out

    # --- conjunctions
    def body(self, f: Any) -> Relation:
        return self.conjunction(conjuncts(self.expand_formula(f)))

    def conjunction(self, parts: list, start: Relation | None = None) -> Relation:
        parts = self.flatten(parts)
        rel = start
        waiting = [p for p in parts if p != Truth(True)]
        if Truth(False) in waiting:
            names = [v for p in parts for v in free_vars(p)]
            rel = self.conjunction([p for p in parts if p != Truth(False)], start) if len(waiting) > 1 else None
            if rel is None:
                raise ProgramError("False needs other conditions that bind the variables")
            return Relation(rel.df.filter(F.lit(False)), True)
        while waiting:
            bound = set(rel.columns) if rel is not None else set()
            done = None
            for step in (self._filters, self._bindings, self._explodes):
                done = step(waiting, rel, bound)
                if done is not None:
                    break
            if done is None:
                done = self._join(waiting, rel, bound)
            if done is None:
                done = self._negations(waiting, rel, bound)
            if done is None:
                raise ProgramError(f"cannot bind all variables of {waiting}")
            waiting, rel = done
        if rel is None:
            raise ProgramError("a body needs an atom or a binding")
        return rel

    def _is_condition(self, p: Any) -> bool:
        return isinstance(p, Compare) or (isinstance(p, Atom) and not self.is_predicate(p.pred) and p.pred in self.functions.scalars)

    def _boolean(self, f: Any) -> Column | None:
        """A formula of conditions alone as a boolean Column."""
        if isinstance(f, Compare):
            return self.condition(f)
        if isinstance(f, Truth):
            return F.lit(f.value)
        if isinstance(f, Atom) and self._is_condition(f):
            return self.functions.scalars[f.pred](*[self.column(a) for a in f.args])
        if isinstance(f, Not):
            inner = self._boolean(f.body)
            return None if inner is None else ~inner
        if isinstance(f, (And, Or)):
            sides = [self._boolean(x) for x in f.items]
            if any(x is None for x in sides):
                return None
            return reduce((lambda a, b: a & b) if isinstance(f, And) else (lambda a, b: a | b), sides)
        return None

    def _filters(self, waiting: list, rel: Relation | None, bound: set):
        if rel is None:
            return None
        for p in waiting:
            if isinstance(p, (Or, And)) and set(free_vars(p)) <= bound and (c := self._boolean(p)) is not None:
                return [q for q in waiting if q is not p], Relation(rel.df.filter(c), rel.distinct)
        ready, rest = [], []
        for p in waiting:
            inner = p.body if isinstance(p, Not) else p
            ok = self._is_condition(inner) and set(free_vars(inner)) <= bound
            ok = ok or (isinstance(inner, Atom) and inner.pred == "contains" and set(free_vars(inner)) <= bound and not self.is_predicate("contains"))
            (ready if ok else rest).append(p)
        if not ready:
            return None
        for p in ready:
            inner = p.body if isinstance(p, Not) else p
            if isinstance(inner, Compare):
                c = self.condition(inner)
            elif inner.pred == "contains":
                c = F.array_contains(self.column(inner.args[0]), self.column(inner.args[1]))
            else:
                c = self.functions.scalars[inner.pred](*[self.column(a) for a in inner.args])
            rel = Relation(rel.df.filter(~c if isinstance(p, Not) else c), rel.distinct)
        return rest, rel

    def _bindings(self, waiting: list, rel: Relation | None, bound: set):
        for p in waiting:
            if isinstance(p, Compare) and p.op == "==":
                for a, b in ((p.left, p.right), (p.right, p.left)):
                    if isinstance(a, Var) and a.name not in bound and a.name not in term_vars(b) and set(term_vars(b)) <= bound:
                        if rel is None:
                            if any(isinstance(q, Atom) and self.is_predicate(q.pred) for q in waiting):
                                continue  # join first; the value comes after
                            raise ProgramError("a body needs an atom")
                        rest = [q for q in waiting if q is not p]
                        return rest, Relation(rel.df.withColumn(a.name, self.column(b)), rel.distinct)
                    # a tuple of new variables
                    if isinstance(a, TupleTerm) and rel is not None and set(term_vars(b)) <= bound and all(isinstance(x, Var) for x in a.items):
                        value = self.column(b)
                        df, rest = rel.df, [q for q in waiting if q is not p]
                        for i, x in enumerate(a.items):
                            df = df.withColumn(x.name, value[f"_{i}"]) if x.name not in bound else df.filter(_col(x.name) == value[f"_{i}"])
                        return rest, Relation(df, rel.distinct)
        return None

    def _explodes(self, waiting: list, rel: Relation | None, bound: set):
        """contains(S, x) with S bound and x new: a row per element."""
        if rel is None or self.is_predicate("contains"):
            return None
        for p in waiting:
            if isinstance(p, Atom) and p.pred == "contains" and len(p.args) == 2 and set(term_vars(p.args[0])) <= bound:
                target, source = p.args[1], self.column(p.args[0])
                rest = [q for q in waiting if q is not p]
                if isinstance(target, Var):
                    return rest, Relation(rel.df.select("*", F.explode(source).alias(target.name)))
                if isinstance(target, TupleTerm) and all(isinstance(x, Var) for x in target.items):
                    names = [x.name if x.name not in bound else fresh_name(x.name) for x in target.items]
                    out = Relation(rel.df.select("*", F.inline(source).alias(*names)))
                    for n, x in zip(names, target.items, strict=True):
                        if n != x.name:
                            out = Relation(out.df.filter(_col(n).eqNullSafe(_col(x.name))).drop(n))
                    return rest, out
        return None

    def _join(self, waiting: list, rel: Relation | None, bound: set):
        """The next positive part: of those that share most variables with what is bound, the first."""
        best = None
        for k, p in enumerate(waiting):
            if isinstance(p, Atom) and self.is_predicate(p.pred):
                score = (len(set(free_vars(p)) & bound), any(isinstance(t, Const) for t in p.args), -k)
            elif isinstance(p, Or) and not any(self.is_predicate(a.pred) for a, _ in atoms_of(p)):
                continue
            elif isinstance(p, (Exists, Or, AggBody)):
                score = (len(set(free_vars(p)) & bound), False, -k - len(waiting))
            else:
                continue
            if best is None or score > best[0]:
                best = (score, p)
        if best is None:
            return None
        p = best[1]
        rest = [q for q in waiting if q is not p]
        if isinstance(p, Atom):
            right = self.atom(p)
            if self.distance_join is not None and rel is not None and not set(right.columns) & bound:
                # a bound on a Euclidean distance makes the product a range join
                done = self.distance_join(rel, right, rest)
                if done is not None:
                    return done
        elif isinstance(p, Exists):
            names = {v: fresh_name(v) for v in p.vars}
            inner = self.conjunction(conjuncts(substitute(p.body, {v: Var(n) for v, n in names.items()})))
            right = inner.project(*[c for c in inner.columns if c not in names.values()]).as_set()
            if rel is not None and set(right.columns) <= bound:
                return rest, rel.semi_join(right)
        elif isinstance(p, Or):
            right = self.disjunction(p)
        else:
            right = self.aggregate_body(p)
        if rel is None:
            return rest, right
        return rest, rel.natural_join(right)

    def disjunction(self, f: Or) -> Relation:
        sides = [self.conjunction(conjuncts(x)) for x in f.items]
        names = [c for c in sides[0].columns if all(c in s.columns for s in sides)]
        want = [v for v in free_vars(f)]
        if any(v not in names for v in want if all(v in free_vars(x) for x in f.items)) or {v for v in want} - {v for x in f.items for v in free_vars(x)}:
            raise ProgramError("the sides of a disjunction must bind the same variables")
        out = sides[0].project(*names)
        for s in sides[1:]:
            out = out.union_all(s.project(*names))
        return Relation(out.df).as_set()

    def _negations(self, waiting: list, rel: Relation | None, bound: set):
        for p in waiting:
            if isinstance(p, ForAll):
                p = Not(Exists(p.vars, Not(p.body))) if not isinstance(p.body, Not) else Not(Exists(p.vars, p.body.body))
                rest = [q for q in waiting if not isinstance(q, ForAll)] + [q for q in waiting if isinstance(q, ForAll)][1:]
                if rel is None:
                    raise ProgramError("a universal quantifier needs bound variables")
                return rest, rel.anti_join(self._inner(p.body, rel))
            if isinstance(p, Not):
                if isinstance(p.body, Not):
                    return [q for q in waiting if q is not p] + [p.body.body], rel
                missing = set(free_vars(p.body)) - bound
                if missing or rel is None:
                    raise ProgramError(f"unsafe negation: {sorted(missing)} not bound by a positive atom")
                rest = [q for q in waiting if q is not p]
                return rest, rel.anti_join(self._inner(p.body, rel))
        return None

    def _inner(self, f: Any, rel: Relation) -> Relation:
        """What a negation removes: matches of f over the outer variables that it mentions."""
        if isinstance(f, Exists):
            outer = [c for c in rel.columns if c in free_vars(f)]
            parts = conjuncts(f.body)
            start = None
            if not any(isinstance(p, Atom) and self.is_predicate(p.pred) for p in parts) or any(isinstance(p, Not) for p in parts):
                start = rel.project(*outer).as_set()
                quantified = [v for v in f.vars]
                domain = self._domain_of(quantified, parts)
                if domain is not None:
                    start = start.natural_join(domain)
            inner = self.conjunction(parts, start)
            return inner.project(*[c for c in inner.columns if c in outer]).as_set()
        inner = self.conjunction(conjuncts(f), None if any(isinstance(p, (Atom, Exists, Or)) for p in conjuncts(f)) else rel.project(*[c for c in rel.columns if c in free_vars(f)]).as_set())
        return inner.project(*[c for c in inner.columns if c in rel.columns])

    def _domain_of(self, names: list[str], parts: list) -> Relation | None:
        """Values of quantified variables under a negation: their positions in the negated atoms' positive guards."""
        for p in parts:
            if isinstance(p, Or):
                for x in p.items:
                    if isinstance(x, Not) and isinstance(x.body, Atom) and set(names) <= set(free_vars(x.body)):
                        return self.atom(x.body).project(*names).as_set()
        return None

    # --- heads and aggregates
    def aggregate_body(self, f: AggBody) -> Relation:
        rel = self.conjunction(conjuncts(f.body)).as_set()
        rel = self.aggregate(rel, list(f.keys), [(f.result.name if isinstance(f.result, Var) else fresh_name(), Call(f.fn, (f.arg,)))])
        if isinstance(f.result, Const):
            rel = rel.select_constants({rel.columns[-1]: f.result.value}).project(*rel.columns[:-1])
        return rel

    def aggregate(self, rel: Relation, keys: list[str], aggregates: list[tuple[str, Call]]) -> Relation:
        """Aggregates over the distinct bindings of all variables of the body."""
        rel = rel.as_set()
        made = []
        for target, call in aggregates:
            name, args = call.name, call.args
            if name in ("top_percent", "bottom_percent"):
                q = args[1].value
                fn: Any = column_function(percentile_threshold(100 - q if name == "top_percent" else q))
                args = args[:1]
            elif name in ("top", "bottom"):
                source = fresh_name()
                wide = rel.extend({source: self.column(args[0])}, keep=True)
                if len(aggregates) > 1:
                    raise ProgramError("a rank aggregate stands alone in its head")
                return wide.nth(keys, source, target, int(args[1].value), name == "top")
            else:
                fn = self.functions.aggregates.get(name, name)
            if not callable(fn) and fn == "count":
                made.append((target, None, "count"))
                continue
            if getattr(fn, "native", False):
                columns = [self.column(a) for a in args]
                made.append((target, None, column_function(lambda c, fn=fn, columns=columns: fn(*columns))))
                continue
            if callable(fn) and not getattr(fn, "column_function", False) and len(args) > 1:
                sources = []
                for a in args:
                    s = fresh_name()
                    rel = rel.extend({s: self.column(a)}, keep=True)
                    sources.append(s)
                call_fn = fn

                def several(pdf: Any, call_fn: Any = call_fn, sources: list = sources) -> Any:
                    return call_fn(*[pdf[s] for s in sources])

                several.returns = getattr(fn, "returns", "double")  # type: ignore[attr-defined]
                made.append((target, None, several))
                continue
            if len(args) == 1 and isinstance(args[0], Var):
                source = args[0].name
            else:
                source = fresh_name()
                rel = rel.extend({source: self.column(args[0])}, keep=True)
            made.append((target, source, fn))
        if rel.distinct is False:
            rel = Relation(rel.df, True)  # computed columns do not make distinct rows equal
        return rel.aggregate(keys, made)

    def is_aggregate(self, t: Any) -> bool:
        from clausewise.operators.relation import AGGREGATES

        return isinstance(t, Call) and (t.name in AGGREGATES or t.name in self.functions.aggregates or t.name in ("top", "bottom", "top_percent", "bottom_percent"))

    def head(self, head: Atom, rel: Relation, names: list[str] | None = None) -> Relation:
        """Project a body's bindings to the head's arguments (constants, repeats, expressions, aggregates)."""
        args = [self.expand(a) for a in head.args]
        names = names or head_names(head)
        missing = [v for a in args for v in term_vars(a) if v not in rel.columns]
        if missing:
            raise ProgramError(f"head variables {missing} of {head.pred} are not bound in the body")
        aggs = [(n, a) for n, a in zip(names, args, strict=True) if self.is_aggregate(a)]
        if aggs:
            keys: dict[str, str] = {}
            wide = rel.as_set()
            for n, a in zip(names, args, strict=True):
                if not self.is_aggregate(a):
                    if isinstance(a, Var):
                        keys[n] = a.name
                    else:
                        keys[n] = fresh_name()
                        wide = Relation(wide.df.withColumn(keys[n], self.column(a)), True)
            targets = [(fresh_name("agg"), a) for _, a in aggs]
            out = self.aggregate(wide, list(dict.fromkeys(keys.values())), targets)
            of = {n: t for (n, _), (t, _) in zip(aggs, targets, strict=True)}
            return Relation(out.df.select(*[_col(of.get(n, keys.get(n, n))).alias(n) for n in names]), True)
        plain = [a.name for a in args if isinstance(a, Var)]
        if not args:
            return Relation(rel.df.select(), False).as_set()
        all_kept = rel.distinct and set(rel.columns) <= set(plain)
        out = Relation(rel.df.select(*[self.column(a).alias(n) for n, a in zip(names, args, strict=True)]), all_kept)
        return out.as_set()


def head_names(head: Atom) -> list[str]:
    """Column names of a rule's result: its variables; positions where there is none or a repeat."""
    out: list[str] = []
    for i, a in enumerate(head.args):
        if isinstance(a, Var):
            n = a.name
        elif isinstance(a, Call) and len(a.args) >= 1 and isinstance(a.args[0], Var):
            n = f"{a.name}_{a.args[0].name}" if a.name.isidentifier() else f"_{i}"
        else:
            n = a.name if isinstance(a, Call) and a.name.isidentifier() else f"_{i}"
        out.append(n if n not in out else f"_{i}")
    return out
