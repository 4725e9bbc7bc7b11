"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is parsed on the driver into a few numpy tables (bounded by the vocabulary) and broadcast. A text is
escaped (space to U+2581, one in front) and cut before each run of U+2581 that follows another character; no piece
spans such a cut, so each part ("word") is encoded alone and equal words of a batch are encoded once. All words of a
batch form one flat symbol array. A round takes each word's best pair rank (segmented minimum), merges its leftmost
non-overlapping occurrences in all words at once, and compacts; finished words leave the array.

Merging several occurrences of a pair at once equals the library's one-at-a-time agenda only if no pair made by the
merge has a better or equal rank. Pieces for which that can happen are known from the vocabulary; of such a pair a round
merges the leftmost occurrence only.

Defined results: a null text counts as empty; an empty text has no ids and decodes to ''. Repeated rows give repeated
results. Rows of an empty table give an empty table. Extra columns never matter: only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NO_PAIR = np.int32(2**31 - 1)
#: Characters of the distinct words that one pass of merge rounds takes.
PASS_CHARS = 200_000
#: Words kept between batches of a worker; longer words are not kept.
KEEP_WORDS, KEEP_CHARS = 150_000, 32


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i += 1
        out |= (c & 127) << shift
        shift += 7
        if c < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        yield key >> 3, value


@dataclass
class PieceTables:
    """What workers need. Symbols are pieces (their ids) and single characters that are no piece but part of one."""

    char_symbol: np.ndarray  # sorted code points, and
    char_id: np.ndarray  # their symbols
    pair_key: np.ndarray  # sorted left * n_symbols + right
    pair_rank: np.ndarray  # 0 is the best score
    pair_symbol: np.ndarray
    careful: np.ndarray  # by symbol: merge one occurrence at a time
    n_symbols: int
    n_pieces: int
    byte_ids: np.ndarray | None
    unk_id: int
    out_bytes: list[bytes] = field(repr=False, default_factory=list)  # decoded form by id
    is_control: np.ndarray | None = None


def load_tables(model_file: str) -> PieceTables:
    """Parse a SentencePiece BPE model with identity normalisation and a dummy prefix (others are refused)."""
    with open(model_file, "rb") as f:
        raw = f.read()
    pieces: list[tuple[str, float, int]] = []
    trainer: dict = {}
    norm: dict = {}
    for number, value in _fields(raw):
        if number == 1:
            d = dict(_fields(value))
            pieces.append((d.get(1, b"").decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            norm = dict(_fields(value))
    if trainer.get(3, 1) != 2:
        raise ValueError("only BPE models are supported")
    if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24, 0):
        raise ValueError("only identity normalisation with a dummy prefix and kept spaces is supported")
    kinds = {k for *_, k in pieces}
    if not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    by_text = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
    if any(SPACE in p.lstrip(SPACE) for p in by_text):
        raise ValueError("a piece spans words")
    symbols = dict(by_text)
    for p in by_text:
        for c in p:
            symbols.setdefault(c, len(pieces) + len(symbols) - len(by_text))
    ranks = {s: r for r, s in enumerate(sorted({s for _, s, kind in pieces if kind == NORMAL}, reverse=True))}
    rank = {p: ranks[pieces[i][1]] for p, i in by_text.items()}
    n = len(pieces) + len(symbols) - len(by_text)
    keys, made = [], []
    careful = np.zeros(n, bool)
    for p, i in by_text.items():
        for k in range(1, len(p)):
            a, b = p[:k], p[k:]
            if a in symbols and b in symbols:
                keys.append(symbols[a] * n + symbols[b])
                made.append((rank[p], i))
                for part in (a, b):
                    if len(part) > 1 and rank[part] >= rank[p]:
                        careful[symbols[part]] = True
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    chars = sorted((ord(c), s) for c, s in symbols.items() if len(c) == 1)
    bytes_ = [i for i, (_, _, kind) in enumerate(pieces) if kind == BYTE]
    byte_ids = None
    if trainer.get(35, 0):
        byte_ids = np.zeros(256, np.int64)
        for i in bytes_:
            byte_ids[int(pieces[i][0][3:5], 16)] = i
    unk = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
    surface = trainer.get(44, b" \xe2\x81\x87 ")
    out = []
    for p, _, kind in pieces:
        out.append({NORMAL: p.replace(SPACE, " ").encode(), BYTE: bytes([int(p[3:5], 16)]) if kind == BYTE else b"", UNKNOWN: surface, CONTROL: b""}[kind])
    return PieceTables(
        np.array([c for c, _ in chars], np.int64),
        np.array([s for _, s in chars], np.int64),
        np.array(keys, np.int64)[order],
        np.array([r for r, _ in made], np.int32)[order],
        np.array([s for _, s in made], np.int64)[order],
        careful,
        n,
        len(pieces),
        byte_ids,
        unk,
        out,
        np.array([kind == CONTROL for *_, kind in pieces]),
    )


class PieceCoder:
    """Encodes and decodes with tables; keeps frequent words between calls."""

    def __init__(self, tables: PieceTables):
        self.t = tables
        self.kept: dict[str, tuple[int, bytes, bytes]] = {}
        # a dense table answers most pair look-ups without a search
        self.first = np.searchsorted(tables.pair_key, np.arange(tables.n_symbols + 1, dtype=np.int64) * tables.n_symbols)
        self.dec = [b"%d," % i for i in range(tables.n_pieces)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; NO_PAIR where there is none. A negative symbol never merges."""
        t = self.t
        key = left * t.n_symbols + right
        at = np.searchsorted(t.pair_key, key)
        at[at == len(t.pair_key)] = 0
        hit = (t.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, t.pair_rank[at], NO_PAIR), t.pair_symbol[at]

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.searchsorted(self.t.char_symbol, points)
        at[at == len(self.t.char_symbol)] = 0
        # a character in no piece is kept as -1 - code point
        return np.where(self.t.char_symbol[at] == points, self.t.char_id[at], -1 - points)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, flat, and the word of each."""
        sym = self._symbols("".join(words))
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word = [], []
        last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        rank, made = self._ranks(sym, np.append(sym[1:], -1)) if len(sym) else (np.zeros(0, np.int32), sym)
        rank[last] = NO_PAIR
        while len(sym):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, start)
            sizes = np.diff(np.append(start, len(sym)))
            over = best == NO_PAIR
            if over.any():  # finished words leave
                out = np.repeat(over, sizes)
                done_sym.append(sym[out])
                done_word.append(word[out])
                keep = ~out
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
                if not len(sym):
                    break
                best, sizes = best[~over], sizes[~over]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # leftmost, not overlapping: of adjacent hits every other one; of a careful pair the first in its word
            run = np.append(True, np.diff(hit) != 1)
            began = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - began) % 2 == 0
            care = self.t.careful[made[hit]]
            if care.any():
                first = np.append(True, word[hit[1:]] != word[hit[:-1]])
                held = np.zeros(len(sizes), bool)
                seg = np.cumsum(first) - 1
                held[seg[care]] = True
                take &= ~held[seg] | first
            hit = hit[take]
            sym[hit] = made[hit]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            keep = ~gone
            at = np.cumsum(keep)[hit] - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            # only pairs next to a merge change
            near = np.zeros(len(sym), bool)
            near[at] = True
            near[np.maximum(at - 1, 0)] = True
            again = np.flatnonzero(near)
            nxt = np.minimum(again + 1, len(sym) - 1)
            r, m = self._ranks(sym[again], sym[nxt])
            r[(word[nxt] != word[again]) | (nxt == again)] = NO_PAIR
            rank[again], made[again] = r, m
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, w = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(w, kind="stable")
        return s[order], w[order]

    def _ids(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; characters without a piece become byte pieces (or unknown)."""
        odd = (sym < 0) | (sym >= self.t.n_pieces)
        if not odd.any():
            return sym, word
        reps, parts = np.ones(len(sym), np.int64), {}
        chars = {s: c for c, s in zip(self.t.char_symbol.tolist(), self.t.char_id.tolist(), strict=True) if s >= self.t.n_pieces}
        for i in np.flatnonzero(odd).tolist():
            point = -1 - int(sym[i]) if sym[i] < 0 else chars[int(sym[i])]
            raw = chr(point).encode("utf-8", "surrogatepass")
            parts[i] = self.t.byte_ids[list(raw)] if self.t.byte_ids is not None else np.array([self.t.unk_id])
            reps[i] = len(parts[i])
        ids = np.repeat(sym, reps)
        begin = np.cumsum(reps) - reps
        for i, p in parts.items():
            ids[begin[i] : begin[i] + len(p)] = p
        return ids, np.repeat(word, reps)

    @staticmethod
    def split(text: str) -> list[str]:
        return re.findall(SPACE + "+[^" + SPACE + "]*", SPACE + text.replace(" ", SPACE)) if text else []

    def words_ids(self, words: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """Some words, their ids one after another, and where each word's ids end; in passes of bounded size."""
        for i, j in _chunks(words, PASS_CHARS):
            ids, word = self._ids(*self.encode_words(words[i:j]))
            yield words[i:j], ids.tolist(), np.searchsorted(word, np.arange(j - i), side="right").tolist()

    def encode(self, text: str | None) -> list[int]:
        words = self.split(text or "")
        distinct = list(dict.fromkeys(words))
        of: dict[str, list[int]] = {}
        for some, ids, ends in self.words_ids(distinct):
            of.update((w, ids[a:b]) for w, a, b in zip(some, [0, *ends], ends, strict=False))
        return [i for w in words for i in of[w]]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, U+2581 as space, without the one space put in front; broken bytes as U+FFFD."""
        raw = b"".join(map(self.t.out_bytes.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if not self.t.is_control[i]), None)
        return raw[1:] if raw.startswith(" ") and first != self.t.unk_id else raw

    def digests(self, texts: list[str | None]) -> list[tuple[int, bytes, str]]:
        """(number of ids, ids as decimals each followed by a comma, decoded text) of each text."""
        split = [self.split(t or "") for t in texts]
        if len(self.kept) > KEEP_WORDS:
            self.kept = {}
        known, dec, out = self.kept, self.dec, self.t.out_bytes
        new = list(set().union(*split).difference(known))
        for some, ids, ends in self.words_ids(new):
            of, raw = [dec[i] for i in ids], [out[i] for i in ids]
            known.update((w, (b - a, b"".join(of[a:b]), b"".join(raw[a:b]))) for w, a, b in zip(some, [0, *ends], ends, strict=False))
        rows = []
        for words in split:
            got = [known[w] for w in words]
            text = b"".join([g[2] for g in got]).decode("utf-8", "replace")
            rows.append((sum(g[0] for g in got), b"".join([g[1] for g in got]), text[1:] if text.startswith(" ") else text))
        for w in new:
            if len(w) > KEEP_CHARS:
                del known[w]
        return rows


def _chunks(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Spans of a list, each of so many characters or of one text."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= chars):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ids array<int>, decoded string (the text that decode() gives for the ids), and the columns to keep."""
    tables = docs.sparkSession.sparkContext.broadcast(load_tables(model_file))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = PieceCoder(tables.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in _chunks(texts, 4 * PASS_CHARS):
                got = coder.digests(texts[i:j])
                yield pd.DataFrame({"id": pdf["id"].iloc[i:j].to_numpy(), "ids": [np.fromstring(g[1].decode(), np.int32, sep=",") if g[1] else np.zeros(0, np.int32) for g in got], "decoded": [g[2] for g in got], **{c: pdf[c].iloc[i:j].to_numpy() for c in keep}})

    kinds = [("id", docs.schema[id_col].dataType), ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType()), *[(c, docs.schema[c].dataType) for c in keep]]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep).mapInPandas(run, T.StructType([T.StructField(n, k) for n, k in kinds]))


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the ids as decimals joined by commas, SHA-256 of the decoded text."""
    tables = docs.sparkSession.sparkContext.broadcast(load_tables(model_file))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = PieceCoder(tables.value)
        sha = hashlib.sha256
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in _chunks(texts, 4 * PASS_CHARS):
                got = coder.digests(texts[i:j])
                yield pd.DataFrame({
                    "id": pdf["id"].iloc[i:j].to_numpy(),
                    "n_tokens": [g[0] for g in got],
                    "ids_sha256": [sha(g[1][:-1]).hexdigest() for g in got],
                    "decoded_sha256": [sha(g[2].encode()).hexdigest() for g in got],
                })

    kind = docs.schema[id_col].dataType
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
