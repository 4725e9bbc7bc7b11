"""Command line: run a program over tables.

    python -m clausewise.cli 'ans(n) :- nation(k, n, r).' --table nation=/data/nation.parquet --format csv --sort n:desc
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time

from clausewise.operators.relation import Relation


def table_format(rel: Relation, rows: list) -> str:
    head = rel.columns
    cells = [head, *[["" if v is None else str(v) for v in r] for r in rows]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(head))]
    line = lambda c: " | ".join(v.ljust(w) for v, w in zip(c, widths, strict=True)).rstrip()
    return "\n".join([line(head), "-+-".join("-" * w for w in widths), *map(line, cells[1:])])


def emit(rel: Relation, how: str, sort: list[str], out) -> None:
    """Write an answer; rows come one by one, except for the table, which needs its widths."""
    known = [s for s in sort if s.partition(":")[0] in rel.columns]
    for s in sort:
        if s not in known:
            logging.warning("no column %s", s.partition(":")[0])
    rows = (tuple(r) for r in rel.sort(known).toLocalIterator())
    if how == "csv":
        import csv

        w = csv.writer(out)
        w.writerow(rel.columns)
        w.writerows(rows)
    elif how == "json":
        for r in rows:
            out.write(json.dumps(dict(zip(rel.columns, r, strict=True)), default=str) + "\n")
    else:
        out.write(table_format(rel, list(rows)) + "\n")


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    ap = argparse.ArgumentParser(prog="clausewise", description="Run a logic program.")
    ap.add_argument("program", nargs="?", help="program text; - reads standard input")
    ap.add_argument("--file", help="program file")
    ap.add_argument("--english", action="store_true", help="the program is controlled English")
    ap.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="parquet, CSV or TSV table")
    ap.add_argument("--facts", action="append", default=[], metavar="NAME=PATH", help="probabilistic facts, probability first")
    ap.add_argument("--choice", action="append", default=[], metavar="NAME=PATH", help="probabilistic choice, probability first")
    ap.add_argument("--config", help="JSON engine description: tables, facts, choices, program")
    ap.add_argument("--format", choices=("table", "csv", "json"), default="table")
    ap.add_argument("--sort", action="append", default=[], metavar="COLUMN[:desc]")
    ap.add_argument("--list", action="store_true", help="list predicates and their arguments")
    ap.add_argument("--show-datalog", action="store_true", help="print the rules before the answer")
    ap.add_argument("--explain", metavar="PREDICATE", help="print a predicate's rules and plan")
    ap.add_argument("--dry-run", action="store_true", help="check the program without running it")
    a = ap.parse_args(argv)
    out = out or sys.stdout
    text = open(a.file, encoding="utf-8").read() if a.file else sys.stdin.read() if a.program == "-" else a.program
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("clausewise").getOrCreate()
    from clausewise.config import build_engine, read_table
    from clausewise.engine import Engine
    from clausewise.plans.ast import ProgramError
    from clausewise.plans.pretty import show

    try:
        engine = build_engine(spark, json.load(open(a.config, encoding="utf-8"))) if a.config else Engine(spark)
        for specs, add in ((a.table, engine.add_table), (a.facts, engine.add_probabilistic_facts), (a.choice, engine.add_probabilistic_choice)):
            for s in specs:
                name, _, path = s.partition("=")
                add(read_table(spark, path), name)
        if a.list:
            for name in sorted(engine.symbols()):
                args = engine.parameter_names(name) if engine.is_predicate(name) else []
                out.write(f"{name}({', '.join(args)})\n")
        if not text:
            return 0
        began = time.time()
        if a.english:
            from clausewise.english import execute

            answers = execute(engine, text, run=not a.dry_run)
        else:
            queries = engine.load(text)
            answers = {} if a.dry_run else {("ans" if len(queries) == 1 else f"ans_{k}"): engine.answer(q) for k, q in enumerate(queries)}
        if a.show_datalog:
            for r in engine.program:
                out.write(show(r) + "\n")
        if a.explain:
            out.write(engine.explain(a.explain) + "\n")
        if isinstance(answers, Relation):
            answers = {"ans": answers}
        if not answers and not a.dry_run:
            answers = engine.solve_all()
        for name, rel in (answers or {}).items():
            if len(answers) > 1:
                out.write(f"# {name}\n")
            emit(rel, a.format, a.sort, out)
        logging.info("answered in %.1f s", time.time() - began)
    except ProgramError as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
