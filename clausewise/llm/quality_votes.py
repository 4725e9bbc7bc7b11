"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) from a text's measures. Expectation-maximisation over the counts of
vote patterns estimates, for good and bad documents, how often each rule casts each vote (its accuracy and coverage), and
so the posterior probability of good quality, which decides in place of an all-must-pass filter.

Everything that touches documents is DataFrame functions. Documents are reduced to the counts of their vote patterns
(3 to the number of rules at most, whatever the input); EM runs on those counts, and the posteriors of the patterns go
back by a broadcast join of that bounded table. Counts cover all documents.

Repeated three-word windows are found by sorting the windows' 64-bit hashes within a document; two different windows of a
document with n windows share a hash with a chance below n*n / 2**65.

Defined results: a null or blank text has no words, fails the base rule and is not kept; its rules abstain. Repeated rows
get equal results. An empty table gives an empty table. Extra columns never matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.columns import let, words_of
from clausewise.runtime import cut

SYMBOLS = "[#*$%&|<>]"


def measures(text: Column) -> dict[str, Column]:
    """The base measures and those that further rules use; text must not be null."""

    def repeated(w: Column) -> Column:
        """Words covered by three-word windows that occur twice or more."""

        def covered(at: Column) -> Column:
            """Words under windows that start at the sorted places."""
            gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        twins = let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        places = F.sort_array(F.transform(twins, lambda x: x["i"]))
        return F.when(F.size(w) >= 3, let(places, covered)).otherwise(F.lit(0))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated(w).cast("long").alias("n_repeat_words"))),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_letters": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{L}", ""))).cast("long"),
        "n_digits": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Nd}", ""))).cast("long"),
    }


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def default_rules() -> dict[str, Column]:
    """Rules over the measures; a text without words leaves all of them abstaining."""
    c = F.col
    per_word = lambda x: c(x) / c("n_words")
    return {
        "length": _vote((c("n_words") >= 50) & (c("n_words") <= 100_000), (c("n_words") < 50) | (c("n_words") > 1_000_000)),
        "word_length": _vote((per_word("word_chars") >= 3) & (per_word("word_chars") <= 10), (per_word("word_chars") < 2) | (per_word("word_chars") > 15)),
        "symbols": _vote(per_word("n_symbols") <= 0.02, per_word("n_symbols") > 0.2),
        "dup_lines": _vote(c("n_dup_lines") * 20 <= c("n_lines"), c("n_dup_lines") * 2 > c("n_lines")),
        "repeats": _vote(per_word("n_repeat_words") <= 0.2, per_word("n_repeat_words") > 0.5),
        "letters": _vote(c("n_letters") / c("word_chars") >= 0.92, c("n_letters") / c("word_chars") < 0.88),
        "digits": _vote(c("n_digits") / c("word_chars") <= 0.05, c("n_digits") / c("word_chars") > 0.2),
    }


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], prior_good: float = 0.8, bad_hit: float = 0.5, false_alarm: float = 0.02, strength: float = 0.01, rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """EM over (votes, number of documents): the share of good documents; per rule and vote its chance among good and bad
    documents; and each pattern's posterior.

    A Dirichlet prior worth ``strength`` of the documents says that a rule that votes calls a bad document bad with
    ``bad_hit`` and a good one with ``false_alarm``; it fixes which class is which and keeps estimates away from 0 and 1.
    """
    total = sum(n for _, n in patterns)
    m = len(patterns[0][0]) if patterns else 0
    weight = strength * total + 1.0
    base = []
    for j in range(m):
        abstain = min(max(sum(n for v, n in patterns if v[j] == 0) / total, 0.01), 0.9)
        base.append({-1: (false_alarm * (1 - abstain), bad_hit * (1 - abstain)), 1: ((1 - false_alarm) * (1 - abstain), (1 - bad_hit) * (1 - abstain)), 0: (abstain, abstain)})
    share, chance = prior_good, base
    posterior: dict[tuple[int, ...], float] = {}
    last = -math.inf
    for _ in range(rounds):
        like = 0.0
        sums = [{v: [0.0, 0.0] for v in (-1, 0, 1)} for _ in range(m)]
        good = 0.0
        for votes, n in patterns:
            a = math.log(share) + sum(math.log(chance[j][v][0]) for j, v in enumerate(votes))
            b = math.log(1 - share) + sum(math.log(chance[j][v][1]) for j, v in enumerate(votes))
            top = max(a, b)
            z = top + math.log(math.exp(a - top) + math.exp(b - top))
            p = math.exp(a - z)
            posterior[votes] = p
            like += n * z
            good += n * p
            for j, v in enumerate(votes):
                sums[j][v][0] += n * p
                sums[j][v][1] += n * (1 - p)
        share = (good + weight * prior_good) / (total + weight)
        chance = []
        for j in range(m):
            of = [sum(sums[j][v][k] for v in (-1, 0, 1)) + weight for k in (0, 1)]
            chance.append({v: tuple((sums[j][v][k] + weight * base[j][v][k]) / of[k] for k in (0, 1)) for v in (-1, 0, 1)})
        if total and abs(like - last) < tolerance * total:
            break
        last = like
    return share, chance, posterior


def judge(docs: DataFrame, rules: Callable[[], dict[str, Column]] = default_rules, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the measures, votes (string of + - 0), posterior, base_failed, kept."""
    found = measures(F.coalesce(F.col("text"), F.lit("")))
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", *[v.alias(k) for k, v in found.items()])
    x = x.select("id", "words.*", "lines.*", "n_symbols", "n_letters", "n_digits")
    cast = rules()
    votes = F.concat(*[F.element_at(F.array(F.lit("-"), F.lit("0"), F.lit("+")), F.coalesce(F.when(F.col("n_words") > 0, v), F.lit(0)) + 2) for v in cast.values()])
    # a few numbers per document; EM needs them once for the counts and once for the verdicts
    x = cut(x.withColumn("votes", votes))
    sign = {"-": -1, "0": 0, "+": 1}
    # 3 ** rules patterns at most
    patterns = sorted((tuple(sign[c] for c in r["votes"]), r["n"]) for r in x.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())
    _, _, posterior = fit_votes(patterns)
    back = {v: k for k, v in sign.items()}
    table = x.sparkSession.createDataFrame([("".join(back[i] for i in v), p) for v, p in posterior.items()], "votes string, posterior double")
    x = x.join(F.broadcast(table), "votes")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return x.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


