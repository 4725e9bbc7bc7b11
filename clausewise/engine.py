"""The engine: registered tables, rules, and answers as relations."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions.builtins import Functions
from clausewise.functions.spatial import distance_join
from clausewise.operators.provenance import P, ProbRelation
from clausewise.operators.relation import Relation, RelationError, _col
from clausewise.plans import datalog_parser
from clausewise.plans.ast import (
    And,
    Assign,
    Atom,
    Call,
    Command,
    Const,
    Constraint,
    Exists,
    NegativeFact,
    Not,
    Or,
    ProbBody,
    Program,
    ProgramError,
    Rule,
    Truth,
    Var,
    atoms_of,
    conjunction,
    conjuncts,
    free_vars,
    fresh_name,
    substitute,
    term_vars,
)
from clausewise.plans.compiler import Compiler, head_names
from clausewise.plans.constraints import rewrite_rule
from clausewise.plans.dependencies import body_atoms, check_stratified, components, is_recursive, reachable
from clausewise.plans.fixpoint import DELTA, solve_recursive
from clausewise.plans.magic import rewrite, seed
from clausewise.plans.probability import Solver
from clausewise.runtime import prepare

#: The predicate that a text program queries.
ANSWER = "ans"
PROTECTED = {"PROB", "MARG", "SUCC"}
TOLERANCE = 1e-6


class Engine:
    """One program over one session. Answers are lazy relations; rules are compiled when an answer asks for them."""

    def __init__(self, spark: SparkSession, max_rounds: int = 10_000, host: dict | None = None, check_unicity: bool = False):
        self.spark = prepare(spark)
        self.functions = Functions()
        self.tables: dict[str, Relation] = {}
        self.kinds: dict[str, str] = {}
        self.rules: dict[str, list[Rule]] = {}
        self.constraints: list[Constraint] = []
        self.negative: list[Atom] = []
        self.macros: dict[str, tuple[tuple[str, ...], Any]] = {}
        self.host = host or {}
        self.max_rounds, self.check_unicity = max_rounds, check_unicity
        self.methods = ("lifted", "lineage")
        self.memo: dict[str, Relation] = {}
        self.explained: list[str] = []
        self.commands: dict[str, Callable] = {}
        self.waiting: dict[str, tuple[str, list[tuple]]] = {}
        from clausewise.sources import commands

        commands.register(self)

    # --- tables
    def _put(self, name: str, rel: Relation, kind: str) -> str:
        if name in PROTECTED:
            raise ProgramError(f"{name} is a word of the language")
        if name in self.rules:
            raise ProgramError(f"{name} is defined by rules")
        if kind != "det" and name in self.tables:
            raise ProgramError(f"{name} is defined already")
        self.tables[name], self.kinds[name] = rel, kind
        self.memo.clear()
        return name

    def _frame(self, data: Any, columns: Any = None) -> DataFrame:
        if isinstance(data, Relation):
            return data.df
        if isinstance(data, DataFrame):
            return data
        import pandas as pd

        if isinstance(data, pd.DataFrame):
            return self.spark.createDataFrame(data)
        rows = [tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in data]
        if not rows:
            return self.spark.createDataFrame([], columns if isinstance(columns, str) else ", ".join(f"`{c}` string" for c in columns or ["_0"]))
        return self.spark.createDataFrame(rows, columns if columns is not None else [f"_{i}" for i in range(len(rows[0]))])

    def add_table(self, data: Any, name: str, columns: Any = None, distinct: bool = False) -> str:
        """A deterministic relation from tuples, a pandas or Spark frame, or a relation (shared, not copied)."""
        if not isinstance(data, (Relation, DataFrame)) and not hasattr(data, "columns"):
            data = list(data)
            if data and all(isinstance(r, tuple) and not r for r in data):
                return self._put(name, Relation.true(self.spark), "det")
        df = self._frame(data, columns)
        return self._put(name, Relation(df, distinct or (isinstance(data, Relation) and data.distinct)), "det")

    add_tuple_set = add_table

    def create_view(self, name: str, source: str) -> str:
        return self._put(name, self.tables[source], self.kinds[source])

    def _weighted(self, data: Any, columns: Any) -> Relation:
        df = self._frame(data, columns)
        first = df.schema.fields[0]
        if first.dataType.typeName() not in ("double", "float", "integer", "long", "decimal"):
            raise ProgramError("the first column must be a probability")
        df = df.select(_col(first.name).cast("double").alias(P), *[_col(c) for c in df.columns[1:]])
        return Relation(df)

    def add_probabilistic_facts(self, data: Any, name: str, columns: Any = None) -> str:
        """(probability, arguments...): independent rows."""
        rel = self._weighted(data, columns).as_set()
        self._check_probabilities(rel, name)
        return self._put(name, rel, "fact")

    def add_probabilistic_choice(self, data: Any, name: str, columns: Any = None) -> str:
        """(probability, arguments...): exactly one row holds; probabilities sum to 1."""
        rel = self._weighted(data, columns).as_set()
        self._check_probabilities(rel, name)
        self._check_sum(rel, name)
        return self._put(name, rel, "choice")

    def _check_probabilities(self, rel: Relation, name: str) -> None:
        if not rel.df.filter(~_col(P).between(0.0, 1.0) | _col(P).isNull()).isEmpty():
            raise ProgramError(f"{name} has values that are no probabilities")
        if self.check_unicity:
            args = [c for c in rel.columns if c != P]
            if not rel.df.groupBy(*map(_col, args)).count().filter("count > 1").isEmpty():
                raise ProgramError(f"{name} has a tuple with two probabilities")

    @staticmethod
    def _check_sum(rel: Relation, name: str) -> None:
        total = rel.df.agg(F.sum(P)).first()[0]
        if total is None or abs(total - 1) > TOLERANCE:
            raise ProgramError(f"the probabilities of {name} sum to {total}, not 1")

    def add_uniform_choice(self, data: Any, name: str, columns: Any = None) -> str:
        """A choice in which each distinct row has the same probability."""
        rows = Relation(self._frame(data, columns)).as_set()
        n = rows.df.count()
        if not n:
            raise ProgramError("a choice over no rows")
        return self._put(name, Relation(rows.df.select(F.lit(1.0 / n).alias(P), *map(_col, rows.columns)), True), "choice")

    add_probabilistic_facts_from_tuples = add_probabilistic_facts
    add_probabilistic_choice_from_tuples = add_probabilistic_choice
    add_uniform_probabilistic_choice_over_set = add_uniform_choice

    def add_symbol(self, value: Any = None, name: str | None = None, returns: Any = None) -> Any:
        """Register a function, an aggregate or a constant; also a decorator."""
        if value is None:
            return lambda fn: self.add_symbol(fn, name, returns)
        self.functions.add(value, name, returns)
        return value

    def new_symbol(self, hint: str = "s") -> str:
        return fresh_name(hint)

    def symbols(self) -> dict[str, str]:
        """Every known name with what it is."""
        out = {n: self.kinds[n] for n in self.tables}
        out |= dict.fromkeys(self.rules, "rule")
        out |= dict.fromkeys(self.functions.callables, "function")
        return out | dict.fromkeys(self.functions.constants, "constant")

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)
        self.kinds.pop(name, None)
        self.rules.pop(name, None)
        self.memo.clear()

    @contextmanager
    def scope(self):
        """What is added inside is forgotten afterwards."""
        saved = (dict(self.tables), dict(self.kinds), {k: list(v) for k, v in self.rules.items()}, list(self.constraints), list(self.negative), dict(self.macros), dict(self.functions.constants))
        try:
            yield self
        finally:
            self.tables, self.kinds, self.rules, self.constraints, self.negative, self.macros, self.functions.constants = saved
            self.memo.clear()

    def reset_program(self) -> None:
        self.rules.clear()
        self.constraints.clear()
        self.negative.clear()
        self.memo.clear()

    @property
    def program(self) -> list[Rule]:
        return [r for rs in self.rules.values() for r in rs]

    # --- rules
    def add_rule(self, rule: Rule) -> None:
        name = rule.head.pred
        if name in PROTECTED:
            raise ProgramError(f"{name} is a word of the language")
        if rule.body == Truth(True) and (rule.kind != "det" or rule.given is None):
            self._ground(rule)
            self._flush()
            return
        if name in self.tables:
            raise ProgramError(f"{name} is a stored relation and cannot be defined by a rule")
        if rule.kind != "det" and name in self.rules:
            raise ProgramError(f"{name} is defined twice as a probabilistic predicate")
        probs = [a for a in rule.head.args if isinstance(a, Call) and a.name in PROTECTED]
        if rule.given is not None and len(probs) != 1:
            raise ProgramError("a conditional rule needs exactly one PROB in its head")
        known = set(free_vars(rule.body)) | (set(free_vars(rule.given)) if rule.given is not None else set())
        missing = [v for a in rule.head.args for v in term_vars(a) if v not in known and v not in self.functions.constants]
        if missing:
            raise ProgramError(f"head variables {missing} of {name} are not in the body")
        self.rules.setdefault(name, []).append(rule)
        self.memo.clear()

    def _values(self, atom: Atom) -> tuple:
        c = self.compiler()
        out = []
        for a in atom.args:
            a = c.expand(a)
            if not isinstance(a, Const):
                raise ProgramError(f"a fact of {atom.pred} has a variable")
            out.append(a.value)
        return tuple(out)

    def _ground(self, rule: Rule) -> None:
        """Hold a ground fact back until ``_flush`` stores all of its predicate at once."""
        name, values = rule.head.pred, self._values(rule.head)
        if name in self.rules:
            raise ProgramError(f"{name} is defined by rules")
        if rule.kind != "det":
            weight = self.compiler().expand(rule.weight)
            if isinstance(weight, Call):
                weight = Const(float(self.spark.range(1).select(self.compiler().column(weight)).first()[0]))
            values = (float(weight.value), *values)
        kind, rows = self.waiting.setdefault(name, (rule.kind, []))
        if kind != rule.kind or self.kinds.get(name, kind) != kind or (rows and len(rows[0]) != len(values)) or (name in self.tables and self.tables[name].arity != len(values)):
            raise ProgramError(f"{name} is another kind of relation")
        rows.append(values)

    def _flush(self) -> None:
        """Store the ground facts read so far: one frame for each predicate and types of its values."""
        for name, (kind, rows) in self.waiting.items():
            if not rows[0]:
                self.tables[name], self.kinds[name] = Relation.true(self.spark), kind
                continue
            of_types: dict[tuple, list[tuple]] = {}
            for r in rows:
                of_types.setdefault(tuple(map(type, r)), []).append(r)
            df = self.tables[name].df if name in self.tables else None
            for same in of_types.values():
                some = self.spark.createDataFrame(same, [f"_{i}" for i in range(len(same[0]))] if kind == "det" else [P, *[f"_{i}" for i in range(len(same[0]) - 1)]])
                df = some if df is None else df.unionAll(some)
            self.tables[name], self.kinds[name] = Relation(df), kind
        if self.waiting:
            self.waiting = {}
            self.memo.clear()

    def load(self, program: Program | str) -> list[Rule]:
        """Add a program's statements; returns its queries (rules for ``ans``)."""
        if isinstance(program, str):
            program = datalog_parser.parse(program)
        queries = []
        for x in program.items:
            if isinstance(x, Rule) and x.head.pred not in PROTECTED and x.body == Truth(True) and (x.kind != "det" or x.given is None):
                self._ground(x)
                continue
            if not isinstance(x, (Rule, Constraint, NegativeFact)) or (isinstance(x, Rule) and x.head.pred in self.waiting):
                self._flush()
            if isinstance(x, Rule):
                if x.head.pred == ANSWER:
                    queries.append(x)
                else:
                    self.add_rule(x)
            elif isinstance(x, Constraint):
                self.constraints.append(x)
                self.memo.clear()
            elif isinstance(x, NegativeFact):
                self.negative.append(x.atom)
            elif isinstance(x, Assign):
                self._assign(x)
            elif isinstance(x, Command):
                if x.name not in self.commands:
                    raise ProgramError(f"no command .{x.name}")
                self.commands[x.name](*x.args, **dict(x.kwargs))
        self._flush()
        return queries

    def _assign(self, x: Assign) -> None:
        if x.params is not None:
            self.macros[x.name] = (x.params, x.value)
            return
        from clausewise.plans.ast import Lambda

        if isinstance(x.value, Lambda):
            self.macros[x.name] = (x.value.params, x.value.body)
            return
        value = self.compiler().expand(x.value)
        if not isinstance(value, Const):
            value = Const(self.spark.range(1).select(self.compiler().column(value)).first()[0])
        self.functions.constants[x.name] = value.value

    def execute(self, text: str) -> Relation | None:
        """Run a text program; the answer of its query, if it has one."""
        queries = self.load(text)
        if len(queries) > 1:
            raise ProgramError("a program has one query")
        return self.answer(queries[0]) if queries else None

    execute_datalog_program = execute

    # --- kinds
    def kind(self, name: str) -> str:
        """det, fact, choice, or prob for a predicate whose rules use probabilistic ones without asking for PROB."""
        return self._kind(name, frozenset())

    def _kind(self, name: str, seen: frozenset) -> str:
        if name in self.kinds:
            return self.kinds[name]
        if name in seen or name not in self.rules:
            return "det"
        for r in self.rules[name]:
            if r.kind != "det":
                return r.kind
            if self._asks(r):
                continue
            for q, _ in body_atoms(r):
                if self._kind(q, seen | {name}) != "det" and not self._inside_prob(r, q):
                    return "prob"
        return "det"

    @staticmethod
    def _asks(r: Rule) -> bool:
        return any(isinstance(a, Call) and a.name in PROTECTED for a in r.head.args)

    @staticmethod
    def _inside_prob(r: Rule, q: str) -> bool:
        """Whether all of the body's atoms of q stand inside PROB[...]."""
        outside = [a.pred for p in conjuncts(r.body) if not isinstance(p, ProbBody) for a, _ in atoms_of(p)]
        return q not in outside

    def is_predicate(self, name: str) -> bool:
        return name in self.tables or name in self.rules or name in self.memo or name.startswith((DELTA, "magic:"))

    # --- evaluation
    def compiler(self, extra: dict[str, Relation] | None = None) -> Compiler:
        extra = extra or {}
        return Compiler(self.functions, lambda n: extra[n] if n in extra else self.relation(n), lambda n: n in extra or self.is_predicate(n), self.macros, self.host, distance_join)

    def relation(self, name: str) -> Relation:
        """A predicate's rows, columns in argument order (probabilistic ones with the probability first)."""
        if name in self.tables:
            return self.tables[name]
        if name not in self.memo:
            if name not in self.rules:
                raise ProgramError(f"no predicate {name}")
            self._solve(name)
        return self.memo[name]

    def _effective(self, rules: dict[str, list[Rule]]) -> dict[str, list[Rule]]:
        """With constraints rewritten into the rules."""
        if not self.constraints:
            return rules
        heads = {c.head.pred for c in self.constraints}
        out: dict[str, list[Rule]] = {}
        for p, rs in rules.items():
            for r in rs:
                if r.kind != "det" or self._asks(r) or not {q for q, _ in body_atoms(r)} & heads:
                    out.setdefault(p, []).append(r)
                    continue
                # a predicate that only constraints derive has no rows of its own
                made = [x for x in rewrite_rule(r, self.constraints) if all(q not in heads or self.is_predicate(q) for q, _ in body_atoms(x))]
                if not made:
                    raise ProgramError(f"nothing derives the body of {p}")
                out.setdefault(p, []).extend(made)
        return out

    def _solve(self, goal: str) -> None:
        rules = self._effective(reachable(goal, self.rules))
        self._run(rules)

    def _run(self, rules: dict[str, list[Rule]], extra: dict[str, Relation] | None = None) -> dict[str, Relation]:
        found = dict(extra or {})
        for part in components(rules):
            if all(p in self.memo for p in part) and not extra:
                continue
            if is_recursive(part, rules):
                check_stratified(part, rules)
                if any(self.kind(p) != "det" for p in part if p in self.rules):
                    raise ProgramError("recursion through probabilistic predicates is not supported")
                solved = solve_recursive(part, rules, lambda r, known: self._rule_rows(r, {**found, **known}), self.max_rounds)
                for p in part:
                    rel = solved[p] if p in solved else None
                    if rel is None:
                        raise ProgramError(f"{p} has no base rule")
                    named = head_names(rules[p][0].head)
                    found[p] = rel.named(*named) if rel.arity else rel
            else:
                p = part[0]
                if p in self.rules and self.kind(p) == "prob":
                    continue  # unfolded where a PROB asks for it
                found[p] = self._predicate(p, rules[p], found)
            if not extra:
                for p in part:
                    if p in found:
                        self.memo[p] = found[p]
        return found

    def _predicate(self, name: str, rules: list[Rule], known: dict[str, Relation]) -> Relation:
        if rules[0].kind != "det":
            return self._weighted_rule(name, rules[0], known)
        rows = [self._rule_rows(r, known) for r in rules]
        if len({r.arity for r in rows}) > 1:
            raise ProgramError(f"the rules of {name} differ in their number of arguments")
        out = rows[0]
        if len(rows) > 1:
            for r in rows[1:]:
                out = Relation(out.df.unionAll(r.df))
            out = out.as_set()
        if not out.arity:
            return out
        return out.named(*head_names(rules[0].head))

    def _weighted_rule(self, name: str, r: Rule, known: dict[str, Relation]) -> Relation:
        """A fact or choice whose probabilities a deterministic body computes."""
        if any(self.kind(q) != "det" for q, _ in body_atoms(r)):
            raise ProgramError(f"the body of {name} must be deterministic")
        c = self.compiler(known)
        rel = c.body(r.body)
        weight = c.expand(r.weight)
        names = head_names(r.head)
        if c.is_aggregate(weight):
            # aggregated per head tuple
            out = c.head(Atom(name, (*r.head.args, weight)), rel, [*names, P])
        else:
            out = Relation(rel.df.select(*[c.column(c.expand(a)).alias(n) for n, a in zip(names, r.head.args, strict=True)], c.column(weight).cast("double").alias(P))).as_set()
        out = Relation(out.df.select(_col(P).cast("double").alias(P), *map(_col, names)), out.distinct)
        if r.kind == "choice":
            self._check_sum(out, name)
        return out

    def _rule_rows(self, r: Rule, known: dict[str, Relation]) -> Relation:
        """A deterministic or PROB rule's rows, columns _0, _1, ..."""
        names = [f"_{i}" for i in range(len(r.head.args))]
        extra = dict(known)
        body = r.body
        if self._asks(r):
            return self._prob_rule(r, extra, names)
        if r.given is not None:
            raise ProgramError("a conditional rule needs exactly one PROB in its head")
        if any(isinstance(p, ProbBody) for p in conjuncts(body)):
            body = self._desugar(r, extra)
        for q, _ in body_atoms(r):
            if q not in extra and self.kind(q) != "det" and not self._inside_prob(r, q):
                raise ProgramError(f"{q} is probabilistic: ask for its probability with PROB")
        c = self.compiler(extra)
        return c.head(r.head, c.body(body), names)

    def _solver(self, extra: dict[str, Relation]) -> Solver:
        c = self.compiler(extra)
        return Solver(c, lambda n: self.kind(n) if n in self.kinds or n in self.rules else "det", lambda n: self.rules[n])

    def _prob(self, head: list[str], body: Any, given: Any, extra: dict[str, Relation]) -> ProbRelation:
        s = self._solver(extra)
        if given is None:
            out = s.solve(head, body, self.methods)
        else:
            shared = [v for v in head if v in free_vars(given)]
            joint = s.solve(head, conjunction([body, given]), self.methods)
            out = joint.divide(s.solve(shared, given, self.methods)).positive()
        self.explained += s.used
        return out

    def _prob_rule(self, r: Rule, extra: dict[str, Relation], names: list[str]) -> Relation:
        probs = [i for i, a in enumerate(r.head.args) if isinstance(a, Call) and a.name in PROTECTED]
        if len(probs) != 1:
            raise ProgramError("a rule asks for one PROB")
        body = self._desugar(r, extra) if any(isinstance(p, ProbBody) for p in conjuncts(r.body)) else r.body
        head = list(dict.fromkeys(v for i, a in enumerate(r.head.args) if i not in probs for v in term_vars(a)))
        for q, _ in body_atoms(r):
            if q in self.rules and self.kind(q) == "det":
                extra.setdefault(q, self.relation(q))
        found = self._prob(head, body, r.given, extra).with_p()
        c = self.compiler(extra)
        columns = [_col(P).cast("double") if i in probs else c.column(c.expand(a)) for i, a in enumerate(r.head.args)]
        return Relation(found.df.select(*[x.alias(n) for x, n in zip(columns, names, strict=True)])).as_set()

    def _desugar(self, r: Rule, extra: dict[str, Relation]) -> Any:
        """PROB[...] = v in a body becomes an atom over its computed answers."""
        parts = conjuncts(r.body)
        outside = {v for a in r.head.args for v in term_vars(a)} | {v for p in parts if not isinstance(p, ProbBody) for v in free_vars(p)}
        out = []
        for p in parts:
            if not isinstance(p, ProbBody):
                out.append(p)
                continue
            others = {v for q in parts if isinstance(q, ProbBody) and q is not p for v in free_vars(q)}
            inside = free_vars(p.body) + (free_vars(p.given) if p.given is not None else [])
            head = [v for v in dict.fromkeys(inside) if v in outside | others]
            found = self._prob(head, p.body, p.given, extra).with_p()
            name = fresh_name("prob")
            extra[name] = Relation(found.df.select(*map(_col, head), _col(P)))
            out.append(Atom(name, (*map(Var, head), p.result)))
        return conjunction(out)

    # --- questions
    def answer(self, rule: Rule) -> Relation:
        """A query rule's rows, with columns named by its head."""
        names = head_names(rule.head)
        goal = self._magic(rule)
        if goal is not None:
            rule, known = goal
        else:
            known = {}
        rules = self._effective({rule.head.pred: [rule]})[rule.head.pred]
        rows = self._rule_rows(rules[0], dict(known))
        for r in rules[1:]:
            rows = Relation(rows.df.unionAll(self._rule_rows(r, dict(known)).df))
        rows = rows.as_set()
        self.check_integrity()
        return rows.named(*names) if names else rows

    def _magic(self, rule: Rule) -> tuple[Rule, dict[str, Relation]] | None:
        """The query over rules specialised to its constants, where it asks a recursive predicate for them."""
        parts = conjuncts(self.compiler().expand_formula(rule.body))
        values = {}
        from clausewise.plans.ast import Compare

        for p in parts:
            if isinstance(p, Compare) and p.op == "==":
                for a, b in ((p.left, p.right), (p.right, p.left)):
                    if isinstance(a, Var) and isinstance(b, Const):
                        values[a.name] = b
        for k, p in enumerate(parts):
            if not isinstance(p, Atom) or p.pred not in self.rules or self.kind(p.pred) != "det":
                continue
            goal = Atom(p.pred, tuple(values.get(a.name, a) if isinstance(a, Var) else a for a in p.args))
            rules = reachable(p.pred, self.rules)
            if not any(is_recursive(part, rules) for part in components(rules)):
                continue
            made = rewrite(goal, rules)
            if made is None:
                continue
            rules, name = made
            seed_name, row = seed(goal, name)
            start = Relation(self.spark.createDataFrame([row], [f"_{i}" for i in range(len(row))]), True)
            # the seed is a base rule of its magic predicate
            rules.setdefault(seed_name, [])
            table = fresh_name("seed")
            rules[seed_name].insert(0, Rule(Atom(seed_name, tuple(Var(f"x{i}") for i in range(len(row)))), Atom(table, tuple(Var(f"x{i}") for i in range(len(row))))))
            found = self._run(rules, {table: start})
            out = [*parts]
            out[k] = Atom(name, p.args)
            return Rule(rule.head, conjunction(out), rule.given), {name: found[name]}
        return None

    def query(self, *args: Any) -> Any:
        """query(body) is a truth value; query(head variables, body) a relation; a body is text or a formula."""
        body = args[-1]
        if isinstance(body, str):
            body = datalog_parser.Parser(body).body()
        if len(args) == 1:
            return not self.answer(Rule(Atom(ANSWER, ()), body)).is_empty()
        head = args[0] if isinstance(args[0], (tuple, list)) else (args[0],)
        return self.answer(Rule(Atom(ANSWER, tuple(Var(h) if isinstance(h, str) else h for h in head)), body))

    def solve_all(self) -> dict[str, Relation]:
        """Every defined predicate that has an answer of its own."""
        out = {}
        for name in list(self.rules):
            if self.kind(name) == "det":
                out[name] = self.relation(name).as_set()
        self.check_integrity()
        return out

    def check_integrity(self) -> None:
        """Negative facts must not be derivable."""
        for a in self.negative:
            if self.is_predicate(a.pred) and self.kind(a.pred) == "det" and not self.compiler().atom(self.compiler().expand_formula(a)).is_empty():
                raise ProgramError(f"{a.pred} holds for {a.args}, which a negative fact forbids")

    def probability_columns(self, name: str) -> list[str]:
        return self.relation(name).columns

    def parameter_names(self, name: str) -> list[str]:
        if name in self.rules:
            return head_names(self.rules[name][0].head)
        return [c for c in self.tables[name].columns if c != P]

    def explain(self, name: str) -> str:
        """The rules that a predicate needs and its physical plan."""
        from clausewise.plans.pretty import show

        rules = reachable(name, self.rules)
        text = "\n".join(show(r) for rs in rules.values() for r in rs)
        plan = self.relation(name).df._sc._jvm.PythonSQLUtils.explainString(self.relation(name).df._jdf.queryExecution(), "formatted")
        return text + "\n\n" + plan


__all__ = ["And", "Engine", "Exists", "Not", "Or", "RelationError", "substitute"]
