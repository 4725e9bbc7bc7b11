"""Language identification by word-first backoff.

A model holds, per language, log frequencies of words and of character n-grams (lengths 4 to 1, words
padded with a space on either side). A text's words are its runs of letters in lower case. A word that the model knows
is scored by its log frequency in each language; an unseen word by the mean log frequency of its longest known
n-grams, falling back to shorter ones until some are known. A text's score is the mean over its words; a tempered softmax
makes it a probability.

The model is fitted on a bounded sample of labelled rows: about ``max_docs`` of them, chosen by a hash of id and text. All
words and n-grams of the sample count, with no further bound; words seen fewer than ``min_count`` times only do so by their
n-grams. Counting is distributed; the tables that come to the driver hold what the bounded sample holds. Prediction covers
every text whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0. If nothing could be learned (no labelled
rows), every text is ``und``. If no n-gram of a text is known, all languages tie; ties go to the least language code.
Repeated rows are predicted alike. Extra columns pass through; added columns get names that do not clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.runtime import stored

UNKNOWN = "und"
LONGEST = 4
LETTERS = re.compile(r"[^\W\d_]+")
#: Unseen words kept with their scores between batches of a worker.
KEEP_WORDS = 200_000
#: Rows are sampled by a hash modulo this, finer than any number of rows.
SPAN = 1 << 62


def letter_words(text: str) -> Counter:
    """Lower-case words (runs of letters) with their numbers; runs of number signs without a letter don't count."""
    counts = Counter(LETTERS.findall(text.lower()))
    for w in [w for w in counts if not w.isalpha() and not any(map(str.isalpha, w))]:
        del counts[w]
    return counts


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each padded with a space on either side, and the word of each."""
    flat = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return flat, np.array([len(w) for w in words], np.int64)


def _grams(flat: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of the n-grams that start at each code point (the last n - 1 starts are left out)."""
    key = np.full(len(flat) - n + 1, n, np.uint64)
    for k in range(n):
        key = (key ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray  # words x languages
    gram_keys: list[np.ndarray]  # by length - 1: sorted
    gram_scores: list[np.ndarray]


class Scorer:
    def __init__(self, model: LanguageModel, sharpness: float = 4.0):
        self.m, self.sharp = model, sharpness
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)), np.float32)

    def back_off(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words from their longest known n-grams."""
        n_lang = len(self.m.languages)
        out = np.zeros((len(words), n_lang), np.float32)
        flat, lengths = _codes(words)
        start = np.cumsum(lengths + 1) - lengths - 1  # of each word's pad in front
        word = np.append(np.repeat(np.arange(len(words)), lengths + 1), len(words) - 1)
        open_ = np.ones(len(words), bool)
        for n in range(LONGEST, 0, -1):
            keys, scores = self.m.gram_keys[n - 1], self.m.gram_scores[n - 1]
            if not len(keys) or len(flat) < n:
                continue
            got = _grams(flat, n)
            w = word[: len(got)]
            inside = np.arange(len(got)) + n <= start[w] + lengths[w] + 2
            at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            hit = np.flatnonzero(inside & open_[w] & (keys[at] == got))
            if not len(hit):
                continue
            count = np.bincount(w[hit], minlength=len(words))
            for k in range(n_lang):
                total = np.bincount(w[hit], scores[at[hit], k], minlength=len(words))
                out[:, k] += np.where(open_ & (count > 0), total / np.maximum(count, 1), 0)
            open_ &= count == 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs = self.m.languages
        if len(self.seen) > KEEP_WORDS:
            self.seen, self.rows = {}, self.rows[:0]
        counts = [letter_words(t) if t and langs else Counter() for t in texts]
        new = [w for w in set().union(*counts) if w not in self.seen]
        if new:
            known = np.array([self.m.words.get(w, -1) for w in new])
            rows = np.zeros((len(new), len(langs)), np.float32)
            rows[known >= 0] = self.m.word_scores[known[known >= 0]]
            odd = np.flatnonzero(known < 0)
            if len(odd):
                rows[odd] = self.back_off([new[i] for i in odd.tolist()])
            base = len(self.rows)
            self.seen.update((w, base + i) for i, w in enumerate(new))
            self.rows = np.concatenate([self.rows, rows])
        labels, scores = [], []
        for c in counts:
            if not c:
                labels.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.fromiter(map(self.seen.__getitem__, c), np.int64, len(c))
            n = np.fromiter(c.values(), np.float64, len(c))
            # evidence grows with the square root of the words, as words of a text depend on each other
            s = (n @ self.rows[at]) / n.sum() * self.sharp * min(n.sum(), 400.0) ** 0.5 / 4
            p = np.exp(s - s.max())
            k = int(p.argmax())
            labels.append(langs[k])
            scores.append(float(p[k] / p.sum()))
        return labels, scores


def fit(docs: DataFrame, max_docs: int = 20_000, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> LanguageModel:
    """Learn from labelled rows (of ``where``): about max_docs of them at most, by a hash of id and text. All words of
    these rows count, those seen min_count times or more by themselves, all of them by their n-grams."""
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if where is not None:
        usable = usable.filter(where)
    total = usable.count()
    if total > max_docs:
        usable = usable.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(8)), F.lit(SPAN)) < SPAN * max_docs // total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        n = 0
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                held.setdefault(lang, Counter()).update(c := letter_words(text))
                n += len(c)
            if n > 500_000:
                yield from _frames(held)
                held, n = {}, 0
        yield from _frames(held)

    counted = stored(usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInPandas(run, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    grams = counted.mapInPandas(_gram_counts, "size int, gram long, lang string, n long").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    sure = counted.groupBy("word").agg(F.sum("n").alias("all")).filter(F.col("all") >= min_count).select("word")
    # what comes to the driver comes from the bounded sample alone
    totals = {r["lang"]: (r["words"], r["types"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("types")).collect()}
    every = counted.select("word").distinct().count()
    return build(totals, every, counted.join(sure, "word").select("word", "lang", "n").toPandas(), grams.toPandas())


def _frames(held: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    for lang, c in held.items():
        if c:
            yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(size, gram, lang, n): n-grams of counted words (word, lang, n), summed within a batch."""
    for pdf in batches:
        for lang, rows in pdf.groupby("lang", sort=False) if len(pdf) else ():
            flat, lengths = _codes(rows["word"].tolist())
            n = rows["n"].to_numpy()
            start = np.cumsum(lengths + 1) - lengths - 1
            word = np.append(np.repeat(np.arange(len(rows)), lengths + 1), len(rows) - 1)
            for size in range(1, LONGEST + 1):
                got = _grams(flat, size)
                w = word[: len(got)]
                inside = np.arange(len(got)) + size <= start[w] + lengths[w] + 2
                if size == 1:
                    inside &= flat[: len(got)] != 32
                keys, at = np.unique(got[inside], return_inverse=True)
                yield pd.DataFrame({"size": np.full(len(keys), size, np.int32), "gram": keys.view(np.int64), "lang": lang, "n": np.bincount(at, n[w[inside]], minlength=len(keys)).astype(np.int64)})


def build(totals: dict[str, tuple[int, int]], every: int, words: pd.DataFrame, grams: pd.DataFrame) -> LanguageModel:
    """Tables from counts: per language its words and different words, of all languages the different words; the counts
    (word, lang, n) of words that stand for themselves, and (size, gram, lang, n) of n-grams."""
    langs = sorted(totals)
    if not langs:
        return LanguageModel([], {}, np.zeros((0, 0), np.float32), [np.zeros(0, np.uint64)] * LONGEST, [np.zeros((0, 0), np.float32)] * LONGEST)
    which = {x: k for k, x in enumerate(langs)}

    def table(names: pd.Series, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        uniq, at = np.unique(names.to_numpy(), return_inverse=True)
        out = np.zeros((len(uniq), len(langs)))
        out[at, rows["lang"].map(which).to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
        return uniq, out

    names, counts = table(words["word"], words)
    keys, scores = [], []
    for size in range(1, LONGEST + 1):
        rows = grams[grams["size"] == size]
        uniq, counted = table(rows["gram"].astype("int64"), rows)
        order = np.argsort(uniq.view(np.uint64))
        keys.append(uniq.view(np.uint64)[order])
        scores.append(_logs(counted, counted.sum(axis=0), len(counted))[order])
    sums = np.array([totals[x][0] for x in langs], float)
    return LanguageModel(langs, {w: i for i, w in enumerate(names.tolist())}, _logs(counts, sums, every), keys, scores)


def _logs(table: np.ndarray, sums: np.ndarray, types: int) -> np.ndarray:
    """Log frequencies by column, smoothed, less each row's mean: only differences between languages tell."""
    logs = np.log((table + 0.5) / (sums + 0.5 * types))
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32) if len(table) else logs.astype(np.float32)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with two more columns: predicted language and its score. The model is broadcast; its size is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField(label_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    @F.pandas_udf(kind, F.PandasUDFType.SCALAR_ITER)
    def run(batches):
        scorer = Scorer(shared.value)
        for texts in batches:
            labels, scores = scorer.predict(texts.tolist())
            yield pd.DataFrame({label_col: labels, score_col: scores})

    from clausewise.llm.columns import fresh

    (got,) = fresh(docs, "language_prediction")
    return docs.withColumn(got, run(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{got}.{label_col}").alias(label_col), F.col(f"{got}.{score_col}").alias(score_col))


def accepted(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language is not identified: no letter, or a score below min_score. The model is
    fitted on a bounded sample of docs' own labelled rows; without any label nothing can be told and all rows stay."""
    from clausewise.llm.columns import fresh

    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not model.languages:
        return docs
    label, score = fresh(docs, "lang_pred", "score")
    found = predict(docs, model, text_col, label, score)
    return found.filter((F.col(label) != UNKNOWN) & (F.col(score) >= min_score)).drop(label, score)
