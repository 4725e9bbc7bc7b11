"""Programs as text."""

from __future__ import annotations

from typing import Any

from clausewise.plans.ast import AggBody, And, Atom, Call, Compare, Const, Exists, External, ForAll, Lambda, Not, Or, ProbBody, Rule, Truth, TupleTerm, Var


def show(x: Any) -> str:
    if isinstance(x, Var):
        return x.name
    if isinstance(x, Const):
        return repr(x.value)
    if isinstance(x, External):
        return "@" + x.name
    if isinstance(x, Call):
        if x.name in ("+", "-", "*", "/", "**"):
            return f"({show(x.args[0])} {x.name} {show(x.args[1])})"
        if x.name == "neg":
            return f"-{show(x.args[0])}"
        return f"{x.name}({', '.join(map(show, x.args))})"
    if isinstance(x, TupleTerm):
        return f"({', '.join(map(show, x.items))})"
    if isinstance(x, Lambda):
        return f"lambda {', '.join(x.params)}: {show(x.body)}"
    if isinstance(x, Atom):
        name = x.pred if x.pred.isidentifier() else f"`{x.pred}`"
        return f"{name}({', '.join(map(show, x.args))})"
    if isinstance(x, Compare):
        return f"({show(x.left)} {x.op} {show(x.right)})"
    if isinstance(x, Not):
        return "~" + show(x.body)
    if isinstance(x, And):
        return ", ".join(map(show, x.items))
    if isinstance(x, Or):
        return "(" + " or ".join(map(show, x.items)) + ")"
    if isinstance(x, (Exists, ForAll)):
        return f"{'exists' if isinstance(x, Exists) else 'forall'}({', '.join(x.vars)}; {show(x.body)})"
    if isinstance(x, ProbBody):
        return f"PROB[{show(x.body)}{'' if x.given is None else ' // ' + show(x.given)}] = {show(x.result)}"
    if isinstance(x, AggBody):
        return f"AGGREGATE[{', '.join(x.keys)}]({show(x.body)} @ {x.fn}({show(x.arg)})) = {show(x.result)}"
    if isinstance(x, Rule):
        head = show(x.head)
        if x.kind != "det":
            op = "::" if x.kind == "fact" else "^"
            head = f"{head} {op} {show(x.weight)}" if x.body != Truth(True) else f"{show(x.weight)} {op} {head}"
        if x.body == Truth(True):
            return head + "."
        return f"{head} :- {show(x.body)}{'' if x.given is None else ' // ' + show(x.given)}."
    return str(x)
