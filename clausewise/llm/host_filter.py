"""URL filtering by rules and by trust and distrust spread over the host graph.

Rules (host, path, verdict) decide the urls they fit: the rule's host is the url's or a parent domain, and the url's path
starts with the rule's; the longest rule wins. For other urls the host decides. Host edges come from absolute and
protocol-relative links in pages (repeated links of a page's host to a host count once). Trust is personalised PageRank
from hosts with allowed pages along edges; distrust is the same from hosts with blocked pages against the edges (who links
to a blocked host is suspect). Restart weight is the share of a host's pages that the rules allow or block. A host
is blocked if its distrust, in units of a wholly blocked host's own, is at least ``threshold`` and above its trust.

All steps are DataFrame operations. Up to ``INLINE_RULES`` rules become one expression; more are a table, joined on the
parent domains of each distinct host and path, with the same result. Edges and host tables are pre-aggregated before they
are joined; an iteration is one equi-join on the host and one partially aggregated sum, and lineage is cut by checkpoints.
A host with very many pages or links is dealt to ``CELLS`` cells wherever its rows meet its scores.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed. A null html has
no links. Hosts without links only have their own restart weight. Repeated rows are judged alike. An empty table gives an
empty table. Extra columns never matter. Of rules that are equally long the least host and path wins, of repeated ones the first.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.runtime import cut, stored

INLINE_RULES, CELLS = 500, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def url_host(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z in lower case; '' if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path joined; null if none) and its verdict."""
    name, verdict = None, None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    nothing = F.lit(None).cast("string")
    return (nothing if name is None else name), (nothing if verdict is None else verdict)


def join_rules(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (id, host, path) with columns rule and ruled, as ``matching_rule`` gives them, by a join on parent domains."""
    spark = rows.sparkSession
    first = {(h, p): what for what, h, p in reversed(rules)}
    table = spark.createDataFrame([(h, p, what) for (h, p), what in first.items()], "domain string, prefix string, ruled string")
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    x = rows.select("host", "path").distinct().withColumn("domain", F.explode(domains)).join(table, "domain").filter(F.startswith(F.col("path"), F.col("prefix")))
    name = F.concat("domain", "prefix")
    best = x.groupBy("host", "path").agg(F.min(F.struct((-F.char_length(name)).alias("n"), name.alias("rule"), "ruled")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.ruled").alias("ruled"))


def _cell(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(CELLS)).cast("int")


def _all_cells() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts, from columns host and html."""
    links = pages.filter((F.col("host") != "") & F.contains(F.col("html"), F.lit("//"))).select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("link"))
    full = F.when(F.startswith(F.col("link"), F.lit("//")), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", url_host(full).alias("dst")).filter((F.col("dst") != "") & (F.col("dst") != F.col("src"))).distinct()


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """Unnormalised personalised PageRank: (kind, host, score), in units of a seed of weight 1 without links.

    edges: (kind, src, dst, share) with shares of a source's out-edges; seeds: (kind, host, weight). Stops when all
    that is still to be moved adds up to less than the tolerance.
    """
    # dealt once; the scores come to the edges in every round
    edges = cut(edges.withColumn("cell", _cell("dst")).repartition("kind", "src", "cell"))
    score = seeds.select("kind", "host", F.col("weight").alias("score"))
    moved = score
    for k in count():
        # only what changed moves on: the sum of all moves is the stationary score
        step = moved.withColumnRenamed("host", "src").withColumn("cell", _all_cells()).join(edges, ["kind", "src", "cell"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share") * damping).alias("score"))
        moved = cut(step)
        mass = moved.agg(F.sum("score")).first()[0]
        if mass is None:
            break
        score = score.unionAll(moved)
        # each further round moves damping times the last one's sum at most
        if mass * damping / (1 - damping) < tolerance:
            break
        if k % 5 == 4:
            score = cut(score.groupBy("kind", "host").agg(F.sum("score").alias("score")))
    return score.groupBy("kind", "host").agg(F.sum("score").alias("score"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, host, path, rule, verdict, trust, distrust."""
    x = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    x = x.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    if len(rules) <= INLINE_RULES:
        rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
        ruled = x.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    else:
        ruled = stored(join_rules(x.select("id", "host", "path"), rules))
    mean = lambda what: F.avg(F.when(F.col("ruled") == what, 1.0).otherwise(0.0))
    hosts = ruled.filter("host != ''").groupBy("host").agg(mean("allow").alias("trust"), mean("block").alias("distrust"))
    seeds = hosts.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "weight")).filter("weight > 0")
    links = cut(host_edges(x))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").unionAll(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("kind", "src").agg((1.0 / F.count(F.lit(1))).alias("share"))
    dealt = both.withColumn("cell", _cell("dst")).join(degree.withColumn("cell", _all_cells()), ["kind", "src", "cell"]).drop("cell")
    scores = spread(dealt, cut(seeds), damping)
    found = scores.groupBy("host").pivot("kind", ["trust", "distrust"]).agg(F.sum("score")).withColumn("cell", _all_cells())
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return (
        ruled.withColumn("cell", F.pmod(F.xxhash64("id", "path"), F.lit(CELLS)).cast("int"))
        .join(found, ["host", "cell"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
        .select("id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
    )
