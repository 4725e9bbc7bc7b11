"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 majority bits over the XXH64 (seed 42) of the text's three-word shingles. Two fingerprints link at
``distance`` 3 or fewer differing bits.

Anchors are the words of a covering code: the perfect Hamming code [31, 26], radius 1, on 31 bits of each 32-bit half
(2**26 anchors a half). Of two linked fingerprints, one half differs in at most one bit (3 // 2). In that half, the one
lies within radius 1 of its nearest anchor, so the other lies within 1 + 1 = 2 of it. Each distinct fingerprint therefore goes
to its own anchor as home, and to all anchors within radius plus threshold (its own and 15 others) as probe; homes and
probes are compared per anchor with an exact count of differing bits. No link is lost and there is no cap.

Copies are collapsed before: only distinct fingerprints take part, each with its least id. An anchor with very many
fingerprints is cut into blocks of homes by blocks of probes, so that no task holds a whole hot anchor. Within a block,
linked members are joined by union-find and leave as a forest (a row per member at most), never as all pairs.
The forests' components come from ``connected_components``.

Defined results: a null or blank text has fingerprint 0, linked like any other. Rows with a null id get a fingerprint and
the least id of their component that is not null (null if there is none). Repeated rows share a component. An empty table gives an
empty table. Extra columns never matter. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.columns import fresh, row_hash
from clausewise.llm.components import connected_components
from clausewise.runtime import stored

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Homes and probes of a block; candidate pairs compared at once.
BLOCK, PAIRS = 512, 2_000_000
#: Shingles hashed at once.
PIECE = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        spans = zip(starts[i : min(i + PIECE, n)].tolist(), last[i : i + PIECE].tolist(), strict=True)
        h = np.array([digest(flat[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, tk long, fp long) of every row; tk is the text's XXH64, which tells rows of one id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "tk": pdf["tk"], "fp": [_signed(fingerprint(t)) for t in pdf["text"]]})

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tk"), F.col(f"`{text_col}`").alias("text")).mapInPandas(run, "id long, tk long, fp long")


# Of the positions 1..31 of a half's upper bits, position p is bit p - 1; a word of the code has syndrome 0.
_POSITIONS = np.arange(1, 32)
#: By syndrome: the masks that lead from a word to the code words within two bits (the nearest first).
_MASKS = [[0]] + [[1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i != s and i < i ^ s] for s in range(1, 32)]
_PADDED = np.array([m + [-1] * (16 - len(m)) for m in _MASKS], np.int64)


def anchors(half: np.ndarray) -> np.ndarray:
    """Anchors within two bits of each 32-bit half: [n, 16], the nearest first, -1 where there are fewer."""
    word = (half >> 1).astype(np.int64)
    syndrome = np.zeros(len(word), np.int64)
    for p in _POSITIONS:
        syndrome ^= np.where((word >> (p - 1)) & 1, p, 0)
    masks = _PADDED[syndrome]
    return np.where(masks < 0, -1, word[:, None] ^ np.maximum(masks, 0))


def block_forest(key: np.ndarray, home: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (rep, rep) of the links between homes and probes with equal keys; rows sorted by key, homes first."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    homes = np.add.reduceat(home.astype(np.int64), start)
    use = (homes > 0) & (size > homes)
    start, homes, probes = start[use], homes[use], (size - homes)[use]
    out_a, out_b = [], []
    work = homes * probes
    for lo, hi in _spans(work, PAIRS):
        h, p, s, w = homes[lo:hi], probes[lo:hi], start[lo:hi], work[lo:hi]
        group = np.repeat(np.arange(hi - lo), w)
        k = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        a = s[group] + k // p[group]
        b = s[group] + h[group] + k % p[group]
        hit = (np.bitwise_count(fp[a] ^ fp[b]) <= distance) & (rep[a] != rep[b])
        a, b = a[hit], b[hit]
        if not len(a):
            continue
        # a fingerprint may stand as home and as probe: name nodes by place of their rep
        nodes, place = np.unique(np.concatenate([rep[a], rep[b]]), return_inverse=True)
        a, b = place[: len(a)], place[len(a) :]
        label = np.arange(len(nodes))
        while True:
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while (label != label[label]).any():
                label = label[label]
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        out_a.append(nodes[moved])
        out_b.append(nodes[label[moved]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _spans(work: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of groups whose work adds up to about ``most``."""
    i, total = 0, np.cumsum(work)
    while i < len(work):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + most, side="right")))
        yield i, j
        i = j


def link_components(prints: DataFrame) -> DataFrame:
    """(fp, rep, component): each distinct fingerprint, its least id and the least id of its component."""
    spark = prints.sparkSession
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp, rep = pdf["fp"].to_numpy(), pdf["rep"].to_numpy()
            bits = fp.view(np.uint64)
            for half in (0, 1):
                near = anchors((bits >> np.uint64(32)) if half else (bits & np.uint64(0xFFFFFFFF)))
                row, col = np.nonzero(near >= 0)
                key = near[row, col] | (half << 31)
                yield pd.DataFrame({"key": np.append(near[:, 0] | (half << 31), key), "home": np.append(np.ones(len(fp), bool), np.zeros(len(key), bool)), "fp": np.append(fp, fp[row]), "rep": np.append(rep, rep[row])})

    rows = stored(distinct.filter(F.col("rep").isNotNull()).mapInPandas(emit, "key long, home boolean, fp long, rep long"))
    counts = rows.groupBy("key").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.sum((~F.col("home")).cast("long")).alias("probes"))
    # a home probes its own anchor too: alone there, or without a home, fingerprints have nothing to meet and leave here
    met = stored(counts.filter("homes > 0 AND probes > 1"))
    dealt = rows.join(met, "key")
    home_blocks, probe_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("homes", "probes"))
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), home_blocks).otherwise(probe_blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), probe_blocks).otherwise(home_blocks) - 1))
    dealt = dealt.select("key", "home", "fp", "rep", own.alias("own"), each.alias("other"))
    cell = F.when(F.col("home"), F.struct(F.col("own").alias("i"), F.col("other").alias("j"))).otherwise(F.struct(F.col("other").alias("i"), F.col("own").alias("j")))
    dealt = dealt.withColumn("cell", cell).select("key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "home", "fp", "rep")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def forest(x: pd.DataFrame) -> pd.DataFrame:
            cells = x[["key", "i", "j"]].to_numpy()
            new = np.append(True, (cells[1:] != cells[:-1]).any(axis=1))
            a, b = block_forest(np.cumsum(new), x["home"].to_numpy(), x["fp"].to_numpy().view(np.uint64), x["rep"].to_numpy())
            return pd.DataFrame({"a": a, "b": b})

        for pdf in batches:
            x = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cells = x[["key", "i", "j"]].to_numpy()
            new = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1))
            cut_at = int(new[-1]) + 1 if len(new) else 0
            held = x.iloc[cut_at:].reset_index(drop=True)
            if cut_at:
                yield forest(x.iloc[:cut_at])
        if held is not None and len(held):
            yield forest(held)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("home")).mapInPandas(compare, "a long, b long")
    found = connected_components(links)
    return distinct.join(stored(found.withColumnRenamed("node", "rep")), "rep", "left").select("fp", "rep", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, tk, fp (signed 64-bit), component (least id reachable over links)."""
    prints = stored(fingerprints(docs, id_col, text_col))
    # the stored right side lets a fingerprint with very many copies be split
    return prints.join(stored(link_components(prints).select("fp", "component")), "fp").select("id", "tk", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id (null last), then of the least text hash, and of rows
    equal in both that of the least hash over all columns."""
    found = stored(near_duplicates(docs, id_col, text_col))
    # components of rows without any id are told apart by fingerprint
    group = F.when(F.col("component").isNull(), F.col("fp"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "tk")
    best = found.groupBy("component", group.alias("alone")).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows"))
    kept = stored(best.select("best.id", "best.tk"))
    of_row = found.groupBy("id", "tk").agg(F.count(F.lit(1)).alias("rows"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["tk"] == b["tk"])
    gone = stored(of_row.join(kept, same(of_row, kept), "left_anti").select("id", "tk"))
    text = F.col(f"`{text_col}`")
    gid, gtk = fresh(docs, "gone_id", "gone_tk")
    left = docs.join(gone.toDF(gid, gtk), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(gid)) & (F.xxhash64(text) == F.col(gtk)), "left_anti")
    if of_row.filter("rows > 1").join(kept, same(of_row, kept), "left_semi").isEmpty():
        return left
    # rows equal in a kept id and text: one of them, the same in every run
    rid, rtk, row, best = fresh(docs, "row_id", "row_tk", "row_hash", "best_hash")
    left = left.withColumns({rid: F.col(f"`{id_col}`"), rtk: F.xxhash64(text), row: row_hash(docs)})
    least = left.groupBy(rid, rtk).agg(F.min(row).alias(best)).toDF(gid, gtk, best)
    one = left.join(least, F.col(rid).eqNullSafe(F.col(gid)) & (F.col(rtk) == F.col(gtk)) & (F.col(row) == F.col(best)), "left_semi")
    return one.dropDuplicates([rid, rtk]).drop(rid, rtk, row)
