"""Document fingerprints by consistent weighted sampling.

A text's terms are its words in lower case (runs of other than ASCII white space); a term's weight is the number of its
occurrences. For each of ``SAMPLES`` hash functions, a term's gamma- and
uniformly-distributed parameters come from a generator seeded by the term alone, and the term whose weight gives the
least sample value is chosen together with its quantised weight. Two texts choose the same sample with the chance of
their generalised Jaccard similarity, sum of min weights / sum of max weights, so the share of equal samples estimates it.

Weights are whole numbers, so a term's sample values depend on the term and its count only; the values of frequent ones
are kept in a bounded cache and a text's signature is a column-wise minimum over its terms' rows.

Of a sample (term, quantised weight) the fingerprint keeps 16 bits, so different samples agree with a chance of 2**-16.

Defined results: a null text counts as empty; an empty text has one term, the empty one, so empty texts equal
each other. Equal texts have equal fingerprints. An empty table gives an empty table. Extra columns never matter. Rows in id order
decide a row's next; equal ids are ordered by text, null ids come first.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = 64
#: Rows of sample values kept by a worker (SAMPLES * 6 bytes each).
KEEP_ROWS = 100_000
EDIT_SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows of new terms made at once.
PIECE = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(seed: np.ndarray, stream: int) -> np.ndarray:
    """64 random bits for each term and hash function, [terms, SAMPLES]."""
    x = seed[:, None] + (np.arange(SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(stream + 1)) * _MIX
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _unit(x: np.ndarray, shift: int) -> np.ndarray:
    """24 of the bits as a number in (0, 1)."""
    return (((x >> np.uint64(shift)) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def sample_rows(seed: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of terms and weights: the sample values and the samples' 16-bit names, [terms, SAMPLES] each.

    With r and c gamma(2, 1) (minus the log of two uniforms' product) and b uniform:
    t = floor(ln w / r + b), ln y = r (t - b), value = ln c - ln y - r.
    """
    x, y = _hash(seed, 0), _hash(seed, 1)
    r = -np.log(_unit(x, 0) * _unit(x, 24))
    c = -np.log(_unit(y, 0) * _unit(y, 24))
    # the 16 bits left of each
    b = (((x >> np.uint64(48)) << np.uint64(8)) ^ (y >> np.uint64(48))).astype(np.float32) * np.float32(2.0**-24)
    t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
    value = np.log(c) - r * (t - b) - r
    name = (seed[:, None] ^ (t.astype(np.int64).astype(np.uint64) + np.uint64(1)) * _MIX) * np.uint64(0xD6E8FEB86659FD93)
    return value.astype(np.float32), (name >> np.uint64(48)).astype(np.uint16)


class Signer:
    def __init__(self):
        self.place: dict[tuple[int, int], int] = {}
        self.value = np.zeros((KEEP_ROWS, SAMPLES), np.float32)
        self.name = np.zeros((KEEP_ROWS, SAMPLES), np.uint16)

    @staticmethod
    def terms(text: str) -> Counter:
        counts = Counter(text.lower().encode("utf-8", "surrogatepass").split())
        digest = xxhash.xxh64_intdigest
        return Counter({digest(w, 1): n for w, n in counts.items()}) or Counter({0: 1})

    def signature(self, counts: Counter) -> np.ndarray:
        """SAMPLES names of 16 bits."""
        keys = list(counts.items())
        if len(self.place) + len(keys) > KEEP_ROWS:
            self.place = {}
        best_value = np.full(SAMPLES, np.inf, np.float32)
        best_name = np.zeros(SAMPLES, np.uint16)
        place = self.place
        known = [place[k] for k in keys if k in place]
        fresh = [k for k in keys if k not in place] if len(known) < len(keys) else []
        cols = np.arange(SAMPLES)
        for i in range(0, len(known), PIECE):
            rows = np.array(known[i : i + PIECE])
            v = self.value[rows]
            k = v.argmin(axis=0)
            low = v[k, cols]
            # ties go to the smaller name, so the order of terms never matters
            name = self.name[rows[k], cols]
            better = (low < best_value) | ((low == best_value) & (name < best_name))
            best_value, best_name = np.where(better, low, best_value), np.where(better, name, best_name)
        for i in range(0, len(fresh), PIECE):
            some = fresh[i : i + PIECE]
            v, n = sample_rows(np.array([s for s, _ in some], np.uint64), np.array([w for _, w in some]))
            k = v.argmin(axis=0)
            low, name = v[k, cols], n[k, cols]
            better = (low < best_value) | ((low == best_value) & (name < best_name))
            best_value, best_name = np.where(better, low, best_value), np.where(better, name, best_name)
            base = len(place)
            keep = min(len(some), KEEP_ROWS - base)
            if keep > 0:
                self.value[base : base + keep], self.name[base : base + keep] = v[:keep], n[:keep]
                place.update(zip(some[:keep], range(base, base + keep), strict=True))
        return best_name

    def text(self, text: str | None) -> np.ndarray:
        return self.signature(self.terms(text or ""))


_SIGNERS: list[Signer] = []


def signer() -> Signer:
    """One per worker: what it has kept serves later tasks too."""
    if not _SIGNERS:
        _SIGNERS.append(Signer())
    return _SIGNERS[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fingerprint": [as_text(signer().text(t)) for t in pdf["text"]]})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by as many of the following text's first (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text and the next text are those of the following row in id order (after the last: the first). Rows are
    dealt into ranges of ids, whose first ids come from a pass over ids alone (one a partition). The first row of a range
    also goes, as a halo, to the range before it (the table's first row to the last range), so each text is exchanged
    once and no task needs more than a row and its successor.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = x.select("id").repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low"), F.sum(F.col("id").isNull().cast("long")).alias("nulls")).collect()
    nulls = any(r["nulls"] for r in ranges)
    lows = sorted({r["low"] for r in ranges if r["low"] is not None})
    if not ranges:
        return spark.createDataFrame([], EDIT_SCHEMA)
    bounds, last = np.array(lows or [0], np.int64), max(len(lows) - 1, 0)

    @F.pandas_udf(T.IntegerType())
    def range_of(ids: pd.Series) -> pd.Series:
        got = np.searchsorted(bounds, ids.fillna(-(2.0**63)).astype("int64").to_numpy() if ids.isna().any() else ids.to_numpy(), side="right") - 1
        return pd.Series(np.maximum(got, 0))

    at = F.col("at")
    is_first = F.col("id").isin(lows[1:]) if len(lows) > 1 else F.lit(False)
    is_top = F.col("id").isNull() if nulls else F.col("id") == int(bounds[0])
    copies = F.array(F.struct(at.alias("at"), F.lit(True).alias("own")))
    copies = F.when(is_first, F.array_append(copies, F.struct((at - 1).alias("at"), F.lit(False).alias("own")))).when(is_top, F.array_append(copies, F.struct(F.lit(last).alias("at"), F.lit(False).alias("own")))).otherwise(copies)
    dealt = x.withColumn("at", range_of("id")).select("id", "text", F.inline(copies)).repartitionById(last + 1, "at").sortWithinPartitions("at", F.desc("own"), "id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign = signer()
        held: tuple | None = None  # the row that waits for its next
        for pdf in batches:
            rows = []
            for part, own, key, text in zip(pdf["at"], pdf["own"], pdf["id"], pdf["text"], strict=True):
                if held is not None and held[0] == part:
                    # of a range's halo only the first row counts
                    now = sign.text(text)
                    changed = edited(held[2], text)
                    print_ = sign.text(changed)
                    rows.append((held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(held[3]), as_text(print_), likeness(held[3], print_), likeness(held[3], now)))
                    held = (part, key, text, now) if own else None
                elif own:
                    held = (part, key, text, sign.text(text))
            if rows:
                out = pd.DataFrame(rows, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                out["id"] = pd.array([None if k != k else int(k) for k in out["id"]], "Int64")
                yield out

    return dealt.mapInPandas(run, EDIT_SCHEMA)
