"""Fuzzy line deduplication by MinHash: one line is kept per component of near-equal lines.

A line is a part of a text between line ends that holds a character other than white space; its normal form is trimmed
and in lower case. Its shingles are the ``SHINGLE`` characters from every character on; a shorter line is its own shingle.
Lines link at a Jaccard similarity of ``threshold`` or more between shingle sets.

Steps, all DataFrame functions:

1. Lines are reduced to distinct normal forms, named by a 64-bit hash. Their characters are taken as fixed-width code
   points, so that a shingle is a slice of bytes; shingles are exploded, STEP to a row, and hashed in generated code, and
   ROWS * COLUMNS minima kept by a hash aggregate without a further exchange. One hash gives COLUMNS minima, those of its
   rotations by TURN bits; the minima of a band come from different hashes.
2. Bands of ROWS minima are hashed to buckets. A band takes one minimum of each of ROWS groups of COLUMNS, along a line
   of slope 0, 1 or 2 modulo the prime COLUMNS, so two bands share one minimum at most: BANDS = 21 bands need 42 minima in
   place of 126. A similarity of 0.8 meets in some bucket with a chance of 98.7 %, one of 0.85 with 99.8 %. Six minima a
   band keep apart lines that only share the common shingles of a language.
3. Buckets of one line are told by counting. Of other buckets, each member is checked against the line with most
   occurrences: first by cells, then exactly. A line's shingles fall into 1,024 cells. Each cell that one of two lines fills
   alone holds a shingle that only it has, so the count of such cells is a lower bound of their difference, and no pair
   that reaches the threshold is lost. Cells need no set of a line's shingles, which only the exact check makes.
   Verified links are joined by a distributed union-find.
4. The exact rest: pairs of a bucket without its leader, where the two ends are not of one component yet. Members that link
   to the leader are joined through it, so one of the two does not. They meet by leader. Lines that by their cells reach
   no other of it go first; the others are held against each other by parities, for which one set a line is made: whether
   an odd number of its shingles falls in a cell, a closer bound with exact sizes (16 words each, in generated code). What
   can reach the threshold is checked exactly. No candidate is dropped; a leader of n members of which m do not link to it
   costs n * m comparisons of cells and of parities at most, but few exact checks.
5. What the rest links is joined by a union-find over components.

Kept is the first occurrence of a component: the least document id, there the first line. All other lines of the component
are dropped; lines without a word always stay.

Defined results: a null or empty text has no lines to drop. Rows with equal id and text count as one document and get
equal results; a null id counts as later than all others. An empty table gives an empty table. Extra columns never matter.
With N distinct lines, two different ones share a name with a chance of N / 2**64 each; shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.columns import fresh, let
from clausewise.llm.components import connected_components
from clausewise.runtime import released, stored

SHINGLE, ROWS, COLUMNS, BANDS, THRESHOLD = 5, 6, 7, 21, 0.8
#: Shingles of a line that go by one row, and bits between the orders that one hash gives.
STEP, TURN = 4, 9
#: Words of 64 cells in a line's parities.
WORDS = 16
#: Rows of a component are dealt to this many cells where they meet its first document.
CELLS = 16
#: The table of all lines is streamed past the smaller side, whose names are unique or occur once a band at most.
HASH = "shuffle_hash"
#: White space; a line of nothing else has no word.
SPACES = " \t\n\x0b\x0c\r"


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _last(points: Column) -> Column:
    """The byte (from 1) at which the last shingle starts in a line's code points of 4 bytes; 1 for a line of one shingle."""
    return F.greatest(F.length(points) - 4 * SHINGLE, F.lit(0)) + 1


def _shingle(points: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(points, at, F.lit(4 * SHINGLE)))


def shingles(line: Column) -> Column:
    """The set of a normal form's shingles, as hashes; never empty for a line with a word."""
    return let(F.encode(line, "UTF-32"), lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), _last(p), F.lit(4)), lambda at: _shingle(p, at))))


def exploded(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep..., h0, h1, ...): the shingles of norm, STEP to a row, with repeats; the last row is filled with the last one."""
    x = lines.select(*keep, F.encode("norm", "UTF-32").alias("points"))
    x = x.select(*keep, "points", _last(F.col("points")).alias("last"))
    # the outer form infers no filter, which would encode each line twice
    x = x.select(*keep, "points", "last", F.explode_outer(F.sequence(F.lit(1), F.col("last"), F.lit(4 * STEP))).alias("at"))
    return x.select(*keep, *[_shingle(F.col("points"), F.least(F.col("at") + 4 * j, F.col("last"))).alias(f"h{j}") for j in range(STEP)])


def band_members() -> list[list[int]]:
    """The minima of each band: of group g, the place slope * g + shift modulo COLUMNS."""
    return [[g * COLUMNS + (band // COLUMNS * g + band) % COLUMNS for g in range(ROWS)] for band in range(BANDS)]


def _rotated(v: Column, by: int) -> Column:
    return F.shiftleft(v, by).bitwiseOR(F.shiftrightunsigned(v, 64 - by)) if by else v


def signatures(hashed: DataFrame, *keep: str) -> DataFrame:
    """(name, keep..., bands) of a table (name, keep..., one or more columns of shingle hashes); keep holds numbers that go
    by name."""
    hashes = [c for c in hashed.columns if c not in ("name", *keep)]
    # each number is hashed after h: of h xor constants, pairs of 9 shingles at 0.8 met by 99.3 % and not the 98.7 % of
    # independent minima
    again = hashed.select("name", *keep, *[F.xxhash64(F.col(h), F.lit(g)).alias(f"{h}_{g}") for g in range(ROWS) for h in hashes])
    least = lambda values: F.least(*values) if len(values) > 1 else values[0]
    minima = [F.min(least([_rotated(F.col(f"{h}_{g}"), TURN * k) for h in hashes])).alias(f"m{g * COLUMNS + k}") for g in range(ROWS) for k in range(COLUMNS)]
    signed = again.groupBy("name").agg(*minima, *[F.min(c).alias(c) for c in keep])
    bands = F.array(*[F.xxhash64(F.lit(k), *[F.col(f"m{i}") for i in members]) for k, members in enumerate(band_members())])
    return signed.select("name", *keep, bands.alias("bands"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, pos, norm, name): every line with a word; tk tells rows of one id and different texts apart."""
    # hashed and split first, so that exploded rows do not carry the text; the outer form infers no filter, which would
    # split each text twice
    x = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.split(F.col(text_col), "\n").alias("parts"))
    x = x.select("id", "tk", F.posexplode_outer("parts").alias("pos", "line"))
    x = x.filter(F.ltrim(F.col("line"), F.lit(SPACES)) != "").select("id", "tk", "pos", normal(F.col("line")).alias("norm"))
    return x.withColumn("name", F.xxhash64("norm"))


def parities(texts: DataFrame) -> DataFrame:
    """(name, size, bits) of a table (name, norm) of distinct names: the number of a line's shingles, and for each of
    64 * WORDS cells whether an odd number of them falls there."""
    # dealt by name first, so that a line's set is counted in the task that makes it
    dealt = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    # the outer form infers no filter, which would make each set twice
    x = dealt.select("name", F.explode_outer(shingles(F.col("norm"))).alias("h"))
    word, bit = F.col("h").bitwiseAND(F.lit(WORDS - 1)), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int))")
    x = x.select("name", word.alias("word"), bit.alias("bit"))
    words = [F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0))).alias(f"w{k}") for k in range(WORDS)]
    counted = x.groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("size"), *words)
    return counted.select("name", "size", F.array(*[F.col(f"w{k}") for k in range(WORDS)]).alias("bits"))


def cells(texts: DataFrame) -> DataFrame:
    """(name, size, w0, w1, ...) of a table (name, norm) of distinct names: the number of a line's shingles with repeats, and
    for each of 64 * WORDS cells whether a shingle falls there. Repeats set no further cell, so no set is made."""
    dealt = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    x = exploded(dealt.withColumn("size", F.greatest(F.char_length("norm") - (SHINGLE - 1), F.lit(1))), "name", "size")
    hashes = [c for c in x.columns if c not in ("name", "size")]
    # bit by bit before the words are chosen, so that each is made once a shingle
    word = [F.col(h).bitwiseAND(F.lit(WORDS - 1)).alias(f"{h}_word") for h in hashes]
    x = x.select("name", "size", *word, *[F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, 32) & 63 as int))").alias(f"{h}_bit") for h in hashes])
    of = lambda k: [F.when(F.col(f"{h}_word") == k, F.col(f"{h}_bit")).otherwise(F.lit(0)) for h in hashes]
    words = [F.bit_or(reduce(Column.bitwiseOR, of(k))).alias(f"w{k}") for k in range(WORDS)]
    return x.groupBy("name").agg(F.min("size").alias("size"), *words)


def _most_unlike(size1: Column, size2: Column, threshold: float) -> Column:
    """The most shingles of one line alone that a pair with sets of these sizes can have where it reaches the threshold."""
    return F.lit((1 - threshold) / (1 + threshold)) * (size1 + size2) + 1e-6


def _unlike(words1: list[Column], words2: list[Column]) -> Column:
    return reduce(Column.__add__, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(words1, words2, strict=True)])


def _may_reach(size1: Column, bits1: Column, size2: Column, bits2: Column, threshold: float) -> Column:
    """False only for pairs below the threshold: cells of unlike parity hold a shingle of one line alone, and pairs that
    reach it have at most this share of such shingles."""
    most = _most_unlike(size1, size2, threshold)
    words = lambda bits: [F.get(bits, F.lit(k)) for k in range(WORDS)]
    return (F.abs(size1 - size2) <= most) & (_unlike(words(bits1), words(bits2)) <= most)


def _cells_may_reach(s1: str, s2: str, threshold: float) -> Column:
    """False only for pairs below the threshold: a cell that one line alone fills holds a shingle of that line alone, and
    the shingles that both have, at most those of the smaller set, bound the others too. Of columns of ``cells`` with these
    suffixes; their sizes bound those of the sets from above, so their difference tells nothing."""
    words = lambda s: [F.col(f"w{k}{s}") for k in range(WORDS)]
    size1, size2 = F.col(f"size{s1}"), F.col(f"size{s2}")
    most = F.least(_most_unlike(size1, size2, threshold), F.lit((1 - threshold) / threshold) * F.least(size1, size2) + 1e-6)
    return _unlike(words(s1), words(s2)) <= most


def _both(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of marks (name, ...) for each, ending in _a and _b."""
    for side in ("b", "a"):
        pairs = pairs.join(marks.toDF(*[side if c == "name" else f"{c}_{side}" for c in marks.columns]), side)
    return pairs


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose lines reach the threshold, by their whole shingle sets. Many pairs may share their a."""
    x = pairs.join(texts.toDF("b", "norm_b"), "b").join(texts.toDF("a", "norm_a"), "a")
    sets = F.struct(*[shingles(F.col(c)).alias(c) for c in ("norm_a", "norm_b")])
    sizes = lambda v: F.struct(F.size(v["norm_a"]).alias("na"), F.size(v["norm_b"]).alias("nb"), F.size(F.array_intersect(v["norm_a"], v["norm_b"])).alias("both"))
    # a row of a generator: the filter below would else be moved under it and make the sets once for each number it reads
    x = x.select("a", "b", F.explode_outer(F.array(let(sets, sizes))).alias("s")).select("a", "b", "s.*")
    return x.filter(_reaches(F.col("both"), F.col("na"), F.col("nb"), threshold)).select("a", "b")


def _reaches(both: Column, na: Column, nb: Column, threshold: float) -> Column:
    """Whether a common part of this size makes the similarity reach the threshold."""
    return both >= F.lit(threshold) * (na + nb - both) - 1e-9


def _partnered(rest: DataFrame, threshold: float) -> DataFrame:
    """The rows of rest (leader, name, component, out, size, w0, ...) that may reach another one of their leader by their
    cells, where components differ and one is out. Semi-joins: no row for each pair."""
    other = rest.toDF(*[f"{c}_other" for c in rest.columns])
    mine = rest.toDF(*[f"{c}_mine" for c in rest.columns])
    met = (F.col("leader_mine") == F.col("leader_other")) & (F.col("component_mine") != F.col("component_other")) & _cells_may_reach("_mine", "_other", threshold)
    found = mine.filter("out_mine").join(other, met, "left_semi").unionAll(mine.filter("NOT out_mine").join(other.filter("out_other"), met, "left_semi"))
    return found.select(*[F.col(f"{c}_mine").alias(c) for c in ("leader", "name", "component", "out")])


def _rest_pairs(rest: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) of rest (leader, name, component, out, size, bits): two lines checked against one leader, of
    different components, one of them out, that can reach the threshold by their parities."""
    side = lambda s: [F.col(c).alias(c + s) for c in ("name", "component", "size", "bits", "out")]
    mine, theirs = rest.filter("out").select("leader", *side("1")), rest.select("leader", *side("2"))
    pair = (F.col("component1") != F.col("component2")) & (~F.col("out2") | (F.col("name1") < F.col("name2")))
    near = _may_reach(F.col("size1"), F.col("bits1"), F.col("size2"), F.col("bits2"), threshold)
    return theirs.join(mine, "leader").filter(pair & near).select(F.least("name1", "name2").alias("a"), F.greatest("name1", "name2").alias("b")).distinct()


def _components(members: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(name, component) of linked lines among members (name, n, bucket), a row for each line and band; a stored table."""
    # counted by bucket alone: most buckets hold one line
    shared = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("bucket"))
    # buckets met are unique and few beside the members, which are not sorted this way
    met = stored(members.join(shared.hint(HASH), "bucket"))
    # a bucket's leader is its line with most occurrences: others tend to be edits of it
    leaders = stored(met.groupBy("bucket").agg(F.max_by("name", F.struct("n", "name")).alias("leader")))
    pairs = stored(met.join(leaders, "bucket").filter("name != leader").select(F.col("leader").alias("a"), F.col("name").alias("b")).distinct())
    released(shared, met, leaders)
    names = stored(pairs.select(F.col("a").alias("name")).unionAll(pairs.select("b")).distinct())
    texts = stored(lines.select("name", "norm").join(names, "name").groupBy("name").agg(F.first("norm").alias("norm")))
    marks = stored(cells(texts))
    close = stored(_both(pairs, marks).filter(_cells_may_reach("_a", "_b", threshold)).select("a", "b"))
    links = stored(_linked(close, texts, threshold))
    whole = connected_components(links)
    found = stored(whole.withColumnRenamed("node", "name"))
    released(names, close, links, whole)

    # members of all buckets of one leader are held against each other, which no bucket's pairs miss; the two ends of a
    # pair of one component need no check, and what is in the leader's component is not out
    of = lambda c: found.toDF(c, f"component_{c}")
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.col("a").alias("leader"), F.col("b").alias("name"), F.coalesce("component_a", "a").alias("main"), F.coalesce("component_b", "b").alias("component"))
    placed = stored(placed.withColumn("out", F.col("component") != F.col("main")).drop("main"))
    reach = placed.groupBy("leader").agg(F.max("out").alias("any"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("any AND c1 != c2")
    rest = stored(placed.join(reach.select("leader"), "leader").join(marks, "name"))
    # few lines of the rest may reach another: only these need their sets, for parities
    few = stored(_partnered(rest, threshold))
    odd = stored(parities(texts.join(few.select("name").distinct(), "name")))
    close = stored(_rest_pairs(few.join(odd, "name"), threshold))
    more = stored(_linked(close, texts, threshold))
    released(pairs, texts, marks, placed, rest, few, odd, close)
    if more.isEmpty():
        released(more)
        return found
    # later links join components that exist already, or lines that stood alone
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    whole = connected_components(joined)
    merged = stored(whole.toDF("component", "whole"))
    released(whole)
    old = found.join(merged, "component", "left").select("name", F.coalesce("whole", "component").alias("component"))
    alone = merged.join(found.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("name"), F.col("whole").alias("component"))
    out = stored(old.unionAll(alone))
    released(more, found, merged)
    return out


def similar_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(name, component, first_id, n): lines that occur more than once or link to others, with their component, its
    first document and the line's occurrences."""
    lines = _lines(docs, id_col, text_col)
    # the one exchange of all text: each distinct line of a task; minima follow in the same tasks
    distinct = lines.groupBy("name").agg(F.first("norm").alias("norm"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    table = stored(signatures(exploded(distinct, "name", "first_id", "n"), "first_id", "n"))
    members = table.select("name", "n", F.explode("bands").alias("bucket"))
    found = _components(members, lines, threshold)
    marked = table.select("name", "first_id", "n").join(found.hint(HASH), "name", "left").filter("n > 1 OR component IS NOT NULL")
    marked = stored(marked.select("name", "first_id", "n", "component"))
    released(table, found)
    alone = marked.filter("component IS NULL").select("name", F.col("name").alias("component"), "first_id", "n")
    linked = marked.filter("component IS NOT NULL")
    # a large component is dealt to cells, each with the component's first document
    first = linked.groupBy("component").agg(F.min("first_id").alias("comp_first")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    dealt = linked.withColumn("cell", F.pmod(F.xxhash64("name"), F.lit(CELLS)).cast("int"))
    out = stored(alone.unionAll(dealt.join(first, ["component", "cell"]).select("name", "component", F.col("comp_first").alias("first_id"), "n")))
    released(marked)
    return out


def dropped_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, dropped): for each document that loses lines, their places (from 0) in order; tk is the text's hash. A
    stored table."""
    similar = similar_lines(docs, threshold, id_col, text_col)
    places = _lines(docs, id_col, text_col).select("id", "tk", "pos", "name")
    x = places.join(similar.select("name", "component", "first_id").hint(HASH), "name")
    # a document's lines of one component; positions are of one document only
    per = x.groupBy("id", "tk", "component").agg(F.sort_array(F.collect_set("pos")).alias("at"), F.first(F.col("id").eqNullSafe(F.col("first_id"))).alias("own"))
    per = per.select("id", "tk", F.when(F.col("own"), F.slice("at", 2, F.size("at"))).otherwise(F.col("at")).alias("at")).filter(F.size("at") > 0)
    out = stored(per.groupBy("id", "tk").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("dropped")))
    released(similar)
    return out


def line_report(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines, n_dropped, dropped (places of dropped lines)."""
    gone = dropped_lines(docs, threshold, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0)).alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    x = rows.join(gone.withColumnsRenamed({"id": "gid", "tk": "gtk"}), F.col("id").eqNullSafe(F.col("gid")) & (F.col("tk") == F.col("gtk")), "left")
    return x.select("id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of their texts; all rows and columns stay."""
    gone = dropped_lines(docs, threshold, id_col, text_col)
    gid, gtk, at = fresh(docs, "gone_id", "gone_tk", "gone_at")
    gone = gone.toDF(gid, gtk, at)
    text = F.col(f"`{text_col}`")
    x = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(gid)) & (F.xxhash64(text) == F.col(gtk)), "left")
    # lines are walked along with the sorted places, so long documents stay linear
    parts = F.split(text, "\n")
    marks = F.array_union(F.transform(F.col(at), lambda p: p), F.array().cast("array<int>"))
    spans = F.zip_with(F.concat(F.array(F.lit(-1)), marks), F.concat(marks, F.array(F.size(parts))), lambda a, b: F.slice(parts, a + 2, b - a - 1))
    kept = F.when(F.col(at).isNull(), text).otherwise(F.array_join(F.flatten(spans), "\n"))
    return x.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
