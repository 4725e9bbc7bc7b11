"""Recursive strata by semi-naive rounds.

Each round evaluates every recursive rule once per recursive atom, with that atom restricted to the last round's new
rows; rows not yet known are kept by an anti-join and a table in the shared folder cuts the lineage. The rounds are a loop
in the driver; each is one distributed plan. Linear and non-linear rules are treated alike.
"""

from __future__ import annotations

from collections.abc import Callable

from clausewise.operators.relation import Relation
from clausewise.plans.ast import And, Atom, Exists, Or, ProgramError, Rule, conjuncts
from clausewise.runtime import cut, stored

DELTA = "\x00delta:"


def _positions(f, part: set[str]) -> int:
    """Number of positive atoms of the stratum in a body."""
    if isinstance(f, Atom):
        return int(f.pred in part)
    if isinstance(f, (And, Or)):
        return sum(_positions(x, part) for x in f.items)
    if isinstance(f, Exists):
        return _positions(f.body, part)
    return 0


def _restrict(f, part: set[str], k: int) -> tuple[object, int]:
    """The body with its k-th atom of the stratum reading the new rows only."""
    if isinstance(f, Atom):
        if f.pred in part:
            return (Atom(DELTA + f.pred, f.args) if k == 0 else f), k - 1
        return f, k
    if isinstance(f, (And, Or)):
        items = []
        for x in f.items:
            y, k = _restrict(x, part, k)
            items.append(y)
        return type(f)(tuple(items)), k
    if isinstance(f, Exists):
        body, k = _restrict(f.body, part, k)
        return Exists(f.vars, body), k
    return f, k


def solve_recursive(part: list[str], rules: dict[str, list[Rule]], evaluate: Callable[[Rule, dict[str, Relation]], Relation], max_rounds: int = 10_000, naive: bool = False) -> dict[str, Relation]:
    """Least fixpoint of a stratum. evaluate(rule, relations) gives a rule's rows with positional columns.

    max_rounds 0 means no limit. ``naive`` re-evaluates the rules over all rows each round (the same answer).
    """
    names = set(part)
    base = {p: [r for r in rules[p] if not _positions(r.body, names)] for p in part}
    steps = [(p, r, k) for p in part for r in rules[p] for k in range(_positions(r.body, names))]
    total: dict[str, Relation] = {}
    delta: dict[str, Relation] = {}
    for p in part:
        if not base[p]:
            continue
        rows = evaluate(base[p][0], {})
        for r in base[p][1:]:
            rows = rows.union_all(evaluate(r, {}))
        delta[p] = Relation(cut(Relation(rows.df, False if len(base[p]) > 1 else rows.distinct).as_set().df), True)
        total[p] = delta[p]
    if not total:
        raise ProgramError(f"{part} have no rule that does not depend on themselves")
    rounds = 0
    while delta:
        rounds += 1
        if max_rounds and rounds > max_rounds:
            raise ProgramError(f"no fixpoint after {max_rounds} rounds")
        new: dict[str, Relation] = {}
        for p, r, k in steps:
            body, _ = _restrict(r.body, names, k)
            if naive and k:
                continue
            known = dict(total)
            if naive:
                body = r.body
            else:
                wanted = [a.pred for x in conjuncts(body) for a in _atoms(x) if a.pred.startswith(DELTA)]
                if not all(w[len(DELTA) :] in delta for w in wanted):
                    continue
                known |= {DELTA + q: d for q, d in delta.items()}
            if any(a.pred in names and a.pred not in total for x in conjuncts(body) for a in _atoms(x)):
                continue
            rows = evaluate(Rule(r.head, body, r.given, r.kind, r.weight), known)
            new[p] = Relation(rows.df) if p not in new else new[p].union_all(rows)
        delta = {}
        for p, rows in new.items():
            fresh = rows.as_set()
            if p in total:
                fresh = fresh.anti_join(total[p])
            kept = Relation(stored(fresh.df), True)
            if kept.is_empty():
                continue
            delta[p] = kept
        for p, d in delta.items():
            # rows of different rounds never repeat
            total[p] = Relation(total[p].df.unionAll(d.df), True) if p in total else d
            if rounds % 8 == 0:
                total[p] = Relation(stored(total[p].df), True)
    return {p: total[p] for p in total}


def _atoms(f):
    if isinstance(f, Atom):
        yield f
    elif isinstance(f, (And, Or)):
        for x in f.items:
            yield from _atoms(x)
    elif isinstance(f, Exists):
        yield from _atoms(f.body)
