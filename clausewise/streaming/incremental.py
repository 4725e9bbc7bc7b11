"""Non-recursive rules over a growing table: an extension for Structured Streaming.

One table may be a stream of appended rows. Answers that only select, project, extend and join the stream with fixed tables
are streams themselves; aggregates need an event-time column and a watermark. Set semantics over an unbounded stream would
need unbounded state, so duplicates are removed within the watermark only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.engine import Engine
from clausewise.operators.relation import Relation
from clausewise.plans.ast import Not, ProgramError, conjuncts
from clausewise.plans.compiler import head_names
from clausewise.plans.datalog_parser import parse


def stream_answer(engine: Engine, stream: DataFrame, name: str, program: str, event_time: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """The program's answer as a streaming frame; ``name`` is the streaming table."""
    df = stream.withWatermark(event_time, watermark) if event_time else stream
    # rows of a stream are taken as they come: a batch-wide distinct would keep state for ever
    engine.add_table(Relation(df, True), name)
    queries = engine.load(parse(program))
    if len(queries) != 1:
        raise ProgramError("a streaming program has one query")
    rule = queries[0]
    c = engine.compiler()
    rel = c.conjunction(conjuncts(c.expand_formula(rule.body)))
    if any(isinstance(p, Not) and name in str(p) for p in conjuncts(rule.body)):
        raise ProgramError("a stream cannot be negated")
    if any(c.is_aggregate(c.expand(a)) for a in rule.head.args):
        raise ProgramError("an aggregate over a stream needs windows: see windowed_counts")
    out = rel.df.select(*[c.column(c.expand(a)).alias(n) for a, n in zip(rule.head.args, head_names(rule.head), strict=True)])
    return out.dropDuplicatesWithinWatermark() if event_time and event_time in out.columns else out


def windowed_counts(stream: DataFrame, event_time: str, keys: list[str], width: str, watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts per key and tumbling or sliding window, late rows beyond the watermark left out."""
    window = F.window(F.col(event_time), width, slide) if slide else F.window(F.col(event_time), width)
    return stream.withWatermark(event_time, watermark).groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))
