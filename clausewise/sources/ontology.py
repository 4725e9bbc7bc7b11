"""RDF/OWL ontologies as facts and constraints.

Reads N-Triples, a subset of Turtle and RDF/XML on the driver (an ontology's size does not grow with the data). Triples
become facts ``triple(subject, predicate, object)`` and, by their meaning, rules and constraints:

subClassOf C D: C(x) -: D(x); subPropertyOf p q: p(x, y) -: q(x, y); domain p C: p(x, y) -: C(x); range p C: p(x, y) -: C(y);
inverseOf p q: both ways; subClassOf of a someValuesFrom restriction: C(x) -: p(x, y); type C: the fact C(x).
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from clausewise.plans.ast import Atom, Constraint, Var

# Vocabulary addresses.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"

Triple = tuple[str, str, str]

_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<text>"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w:-]+))?)|(?P<word>@prefix|_:[\w-]+|[\w-]*:[\w.-]*[\w-]|[\w-]*:|a\b|[\d.]+\d|\d+)|(?P<sign>[.;,\[\]])')


def parse_turtle(text: str) -> list[Triple]:
    """N-Triples and Turtle without collections."""
    toks, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            toks.append(m.group())
    prefixes: dict[str, str] = {}
    out: list[Triple] = []
    i, blank = 0, 0

    def name(t: str) -> str:
        if t.startswith("<"):
            return t[1:-1]
        if t.startswith('"'):
            return re.match(r'"((?:[^"\\]|\\.)*)"', t).group(1)
        if t == "a":
            return RDF + "type"
        if ":" in t and not t.startswith("_:"):
            p, _, rest = t.partition(":")
            return prefixes.get(p, p + ":") + rest
        return t

    def value() -> str:
        nonlocal i, blank
        if toks[i] == "[":
            blank += 1
            node = f"_:b{blank}"
            i += 1
            if toks[i] != "]":
                properties(node)
            i += 1
            return node
        i += 1
        return name(toks[i - 1])

    def properties(subject: str) -> None:
        nonlocal i
        while True:
            p = name(toks[i])
            i += 1
            out.append((subject, p, value()))
            while toks[i] == ",":
                i += 1
                out.append((subject, p, value()))
            if toks[i] != ";":
                return
            i += 1
            if toks[i] in (".", "]"):
                return

    while i < len(toks):
        if toks[i] == "@prefix":
            prefixes[toks[i + 1][:-1]] = toks[i + 2][1:-1]
            i += 4
            continue
        subject = value()
        properties(subject)
        i += 1
    return out


def parse_rdfxml(text: str) -> list[Triple]:
    out: list[Triple] = []
    blank = 0

    def tag(x: ET.Element) -> str:
        return x.tag.replace("{", "").replace("}", "")

    def node(x: ET.Element) -> str:
        nonlocal blank
        name = x.get(f"{{{RDF}}}about") or x.get(f"{{{RDF}}}ID")
        if name is None:
            blank += 1
            name = f"_:x{blank}"
        if tag(x) != RDF + "Description":
            out.append((name, RDF + "type", tag(x)))
        for p in x:
            target = p.get(f"{{{RDF}}}resource")
            if target is not None:
                out.append((name, tag(p), target))
            elif len(p):
                for child in p:
                    out.append((name, tag(p), node(child)))
            else:
                out.append((name, tag(p), p.text or ""))
        return name

    for child in ET.fromstring(text):
        node(child)
    return out


def local(iri: str) -> str:
    """The last part of an address, as a predicate's name."""
    return re.sub(r"\W", "_", re.split(r"[#/]", iri.rstrip("#/"))[-1])


def read(path: str) -> list[Triple]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return parse_rdfxml(text) if text.lstrip().startswith("<?xml") or "<rdf:RDF" in text[:2000] else parse_turtle(text)


def constraints_of(triples: list[Triple]) -> list[Constraint]:
    x, y = Var("x"), Var("y")
    some = {s: o for s, p, o in triples if p == OWL + "onProperty"}
    out = []
    for s, p, o in triples:
        a, b = local(s), local(o)
        if p == RDFS + "subClassOf":
            if o in some:
                out.append(Constraint(Atom(a, (x,)), Atom(local(some[o]), (x, y))))
            elif s in some:
                out.append(Constraint(Atom(local(some[s]), (x, y)), Atom(b, (x,))))
            else:
                out.append(Constraint(Atom(a, (x,)), Atom(b, (x,))))
        elif p == OWL + "equivalentClass":
            out += [Constraint(Atom(a, (x,)), Atom(b, (x,))), Constraint(Atom(b, (x,)), Atom(a, (x,)))]
        elif p == RDFS + "subPropertyOf":
            out.append(Constraint(Atom(a, (x, y)), Atom(b, (x, y))))
        elif p == RDFS + "domain":
            out.append(Constraint(Atom(a, (x, y)), Atom(b, (x,))))
        elif p == RDFS + "range":
            out.append(Constraint(Atom(a, (x, y)), Atom(b, (y,))))
        elif p == OWL + "inverseOf":
            out += [Constraint(Atom(a, (x, y)), Atom(b, (y, x))), Constraint(Atom(b, (x, y)), Atom(a, (y, x)))]
    return out


def load(engine, *paths: str) -> list[Triple]:
    """Add an ontology's facts and constraints to an engine."""
    triples = [t for p in paths for t in read(p)]
    engine.add_table(sorted(set(triples)), "triple", "subject string, predicate string, object string")
    kinds: dict[str, set] = {}
    links: dict[str, set] = {}
    own = (RDF, RDFS, OWL)
    for s, p, o in triples:
        if p == RDF + "type" and not o.startswith(own):
            kinds.setdefault(local(o), set()).add((s,))
        elif not p.startswith(own):
            links.setdefault(local(p), set()).add((s, o))
    for name, rows in {**kinds, **links}.items():
        if name not in engine.tables:
            engine.add_table(sorted(rows), name)
    engine.constraints += constraints_of(triples)
    engine.memo.clear()
    return triples
