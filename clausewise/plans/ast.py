"""Terms, formulas and rules of logic programs, and small helpers over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import count
from typing import Any


class ProgramError(ValueError):
    """A program breaks a rule of the language: unsafe, not stratifiable, ill-typed or not parseable."""


class NotLiftable(ProgramError):
    """A probabilistic query has no plan of relational operators alone."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Call:
    """A function, an operator (+ - * / ** neg) or, in a head, an aggregate or PROB over arguments."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Lambda:
    params: tuple[str, ...]
    body: Any


@dataclass(frozen=True)
class TupleTerm:
    items: tuple


@dataclass(frozen=True)
class External:
    """A value from the host program, by name."""

    name: str


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    body: Any


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Exists:
    vars: tuple[str, ...]
    body: Any


@dataclass(frozen=True)
class ForAll:
    vars: tuple[str, ...]
    body: Any


@dataclass(frozen=True)
class Truth:
    value: bool


@dataclass(frozen=True)
class ProbBody:
    """PROB[body // given] = result inside a rule body."""

    body: Any
    given: Any
    result: Any


@dataclass(frozen=True)
class AggBody:
    """AGGREGATE[keys](body @ fn(arg)) = result."""

    keys: tuple[str, ...]
    body: Any
    fn: str
    arg: Any
    result: Any


@dataclass(frozen=True)
class Rule:
    """head :- body, body // given, or a fact. kind: det, fact or choice (then weight is the probability's term)."""

    head: Atom
    body: Any = Truth(True)
    given: Any = None
    kind: str = "det"
    weight: Any = None


@dataclass(frozen=True)
class Constraint:
    """body -: head: whoever satisfies the body also satisfies the head (head variables may be existential)."""

    body: Any
    head: Atom


@dataclass(frozen=True)
class NegativeFact:
    atom: Atom


@dataclass(frozen=True)
class Assign:
    name: str
    params: tuple[str, ...] | None
    value: Any


@dataclass(frozen=True)
class Command:
    name: str
    args: tuple
    kwargs: tuple


@dataclass
class Program:
    items: list = field(default_factory=list)


_fresh = count()


def fresh_name(hint: str = "v") -> str:
    return f"_{hint}{next(_fresh)}"


def term_vars(t: Any) -> list[str]:
    """Variables of a term, in order, without repeats."""
    out: dict[str, None] = {}

    def walk(x: Any) -> None:
        if isinstance(x, Var):
            out.setdefault(x.name)
        elif isinstance(x, Call):
            for a in x.args:
                walk(a)
        elif isinstance(x, TupleTerm):
            for a in x.items:
                walk(a)
        elif isinstance(x, Lambda):
            for v in term_vars(x.body):
                if v not in x.params:
                    out.setdefault(v)

    walk(t)
    return list(out)


def free_vars(f: Any) -> list[str]:
    """Free variables of a formula, in order, without repeats."""
    out: dict[str, None] = {}
    if isinstance(f, Atom):
        names = [v for a in f.args for v in term_vars(a)]
    elif isinstance(f, Compare):
        names = term_vars(f.left) + term_vars(f.right)
    elif isinstance(f, Not):
        names = free_vars(f.body)
    elif isinstance(f, (And, Or)):
        names = [v for x in f.items for v in free_vars(x)]
    elif isinstance(f, (Exists, ForAll)):
        names = [v for v in free_vars(f.body) if v not in f.vars]
    elif isinstance(f, ProbBody):
        names = free_vars(f.body) + (free_vars(f.given) if f.given is not None else []) + term_vars(f.result)
    elif isinstance(f, AggBody):
        names = list(f.keys) + term_vars(f.result)
    else:
        names = []
    for n in names:
        out.setdefault(n)
    return list(out)


def atoms_of(f: Any) -> Iterator[tuple[Atom, bool]]:
    """Every atom with whether it stands under a negation or a universal quantifier."""
    if isinstance(f, Atom):
        yield f, False
    elif isinstance(f, (Not, ForAll)):
        for a, _ in atoms_of(f.body):
            yield a, True
    elif isinstance(f, (And, Or)):
        for x in f.items:
            yield from atoms_of(x)
    elif isinstance(f, Exists):
        yield from atoms_of(f.body)
    elif isinstance(f, ProbBody):
        yield from atoms_of(f.body)
        if f.given is not None:
            yield from atoms_of(f.given)
    elif isinstance(f, AggBody):
        for a, _ in atoms_of(f.body):
            yield a, True


def substitute(x: Any, to: dict[str, Any]) -> Any:
    """Replace free variables by terms (quantified ones are left alone)."""
    if isinstance(x, Var):
        return to.get(x.name, x)
    if isinstance(x, Call):
        return Call(x.name, tuple(substitute(a, to) for a in x.args))
    if isinstance(x, TupleTerm):
        return TupleTerm(tuple(substitute(a, to) for a in x.items))
    if isinstance(x, Lambda):
        return Lambda(x.params, substitute(x.body, {k: v for k, v in to.items() if k not in x.params}))
    if isinstance(x, Atom):
        return Atom(x.pred, tuple(substitute(a, to) for a in x.args))
    if isinstance(x, Compare):
        return Compare(x.op, substitute(x.left, to), substitute(x.right, to))
    if isinstance(x, Not):
        return Not(substitute(x.body, to))
    if isinstance(x, (And, Or)):
        return type(x)(tuple(substitute(a, to) for a in x.items))
    if isinstance(x, (Exists, ForAll)):
        inner = {k: v for k, v in to.items() if k not in x.vars}
        # a quantified name that a replacement mentions is renamed first
        clash = {v for t in inner.values() for v in term_vars(t)} & set(x.vars)
        names = {v: fresh_name(v) for v in clash}
        body = substitute(x.body, {v: Var(n) for v, n in names.items()}) if names else x.body
        return type(x)(tuple(names.get(v, v) for v in x.vars), substitute(body, inner))
    if isinstance(x, ProbBody):
        return ProbBody(substitute(x.body, to), None if x.given is None else substitute(x.given, to), substitute(x.result, to))
    if isinstance(x, AggBody):
        return replace(x, keys=tuple(to[k].name if k in to and isinstance(to[k], Var) else k for k in x.keys), result=substitute(x.result, to))
    return x


def conjuncts(f: Any) -> list:
    """Flat list of a conjunction's parts."""
    if isinstance(f, And):
        return [y for x in f.items for y in conjuncts(x)]
    return [f]


def conjunction(items: list) -> Any:
    flat = [y for x in items for y in conjuncts(x) if y != Truth(True)]
    return flat[0] if len(flat) == 1 else And(tuple(flat)) if flat else Truth(True)
