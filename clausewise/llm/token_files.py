"""Token-id output in fixed-width bit-packed shard files, and reading them back.

A document's ids (with an end id) are packed at the fewest bits that hold the vocabulary, whatever the ids, so id i of a
shard starts at bit ``i * bits``: a slice is found without decoding what stands before it, and numpy unpacks it at once.
Documents are written in ascending id order (ties: by text; null ids first), in shards of bounded size.

Shard file, little-endian::

    magic 'CWTK' | u16 version | u16 bits | u64 n_tokens | u64 n_docs | u64 n_blocks
    block offsets u64[n_blocks + 1]   byte offsets into the payload, one block per BLOCK ids (each starts on a byte)
    token ends    u64[n_docs]         ids of the shard up to the end of each document
    doc ids       i64[n_docs]         (null: the least i64)
    payload                           the blocks, bits packed from the least significant bit

Shards are named by partition and number; a task writes each under a temporary name and renames it, so a repeated or
speculative attempt replaces equal bytes. Files go to the shared folder of the session.

Defined results: a null text counts as empty; each document has at least its end id. Repeated rows are repeated
documents. An empty table writes nothing and reads back as no rows. Extra columns never matter.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.runtime import shared_dir

MAGIC, VERSION = b"CWTK", 1
HEAD = struct.Struct("<4sHHQQQ")
#: Ids of a block (its offset is stored) and ids after which a shard ends with the document.
BLOCK, SHARD_IDS = 1 << 16, 1 << 22
NULL_ID = -(2**63)
#: Chunks of text kept with their ids between batches of a worker; longer ones are not kept.
KEEP_CHUNKS, KEEP_CHARS = 600_000, 32


def bit_width(vocab_size: int) -> int:
    """Bits that hold every id below vocab_size (1 at least)."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at a fixed width, least significant bit first, padded to a byte."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count of packed bytes."""
    first = start * bits // 8
    last = -(-(start + count) * bits // 8)
    if bits == 16:
        return np.frombuffer(raw, "<u2", count, start * 2).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, np.uint8, last - first, first), bitorder="little")
    skip = start * bits - first * 8
    planes = planes[skip : skip + count * bits].reshape(count, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def build_shard(doc_ids: list[int], arrays: list[np.ndarray], bits: int) -> bytes:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    if len(flat) and int(flat.max()) >> bits:
        raise ValueError("an id does not fit the vocabulary's bits")
    blocks = [pack(flat[i : i + BLOCK], bits) for i in range(0, len(flat), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    ends = np.cumsum([len(a) for a in arrays]).astype("<u8")
    head = HEAD.pack(MAGIC, VERSION, bits, len(flat), len(doc_ids), len(blocks))
    return b"".join([head, offsets.tobytes(), ends.tobytes(), np.array(doc_ids, "<i8").tobytes(), *blocks])


class ShardReader:
    """Random access to the ids of one shard's bytes."""

    def __init__(self, raw: bytes):
        magic, version, self.bits, self.n_tokens, self.n_docs, n_blocks = HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard")
        at = HEAD.size
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at).astype(np.int64)
        at += 8 * (n_blocks + 1)
        self.ends = np.frombuffer(raw, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.payload = memoryview(raw)[at + 8 * self.n_docs :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop of the shard; only the blocks that hold them are touched."""
        out = []
        while start < stop:
            b = start // BLOCK
            n = min(stop, (b + 1) * BLOCK) - start
            out.append(unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], self.bits, start - b * BLOCK, n))
            start += n
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class ChunkEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, each distinct chunk of a batch once.

    A chunk starts at a single space or line end between two characters that are not white space. Byte-level
    pre-tokenisers always start a token there (a space joins the word that follows it, a line end stands alone), so a
    text's ids are its chunks' ids in order. Chunks go to the library in joined runs, which saves an object for each.
    """

    CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
    RUN = 200

    def __init__(self, config: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kept = Tokenizer.from_str(config), {}
        self.end = np.array([end_id], "<u4").tobytes()
        special = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        self.sep_id, self.sep = next(((i, c) for i, c in special.items()), (None, ""))
        self.odd_inside = re.compile("|".join([r"[^\S ]|\0", *map(re.escape, special.values())]))
        self.odd = re.compile("|".join([r"[\s\0]", *map(re.escape, special.values())]))
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line_id = line[0] if len(line) == 1 and self.sep_id is not None else None
        self.special = re.compile("|".join(map(re.escape, special.values()))) if special else None

    @staticmethod
    def _text(key: str) -> str:
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def _learn(self, keys: list[str]) -> None:
        """Encode new chunks, in runs with something between that gives one id of its own: a line end between words that
        follow a space, a special token between other chunks. Chunks that hold a special token's text go alone.
        """
        plain = [k for k in keys if k[:1] != "\0" and k[:1] != "\n"]
        joined = " ".join(plain)
        if len(joined.split()) == len(plain) and not self.odd_inside.search(joined):
            odd = [k for k in keys if k[:1] == "\0" or k[:1] == "\n"]
        else:
            odd = [k for k in keys if self.odd.search(k)]
        if odd:
            held = set(odd)
            keys = [k for k in keys if k not in held]
            texts = list(map(self._text, odd))
            if self.special is None or self.line_id is None:
                self._alone(odd, texts)
            else:
                alone = [bool(self.special.search(t)) for t in texts]
                self._alone([k for k, x in zip(odd, alone, strict=True) if x], [t for t, x in zip(texts, alone, strict=True) if x])
                self._runs([k for k, x in zip(odd, alone, strict=True) if not x], [t for t, x in zip(texts, alone, strict=True) if not x], self.sep, self.sep_id)
        if self.line_id is None:
            self._alone(keys, [" " + k for k in keys])
        else:
            self._runs(keys, keys, "\n ", self.line_id, " ")

    def _alone(self, keys: list[str], texts: list[str]) -> None:
        self.kept.update((k, np.array(e.ids, "<u4").tobytes()) for k, e in zip(keys, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True))

    def _runs(self, keys: list[str], texts: list[str], sep: str, sep_id: int, front: str = "") -> None:
        size = self.RUN
        end = sep.rstrip(" ")
        for i in range(0, len(keys), 100 * size):
            runs = [front + sep.join(texts[k : k + size]) + end for k in range(i, min(i + 100 * size, len(keys)), size)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(runs, add_special_tokens=False)])
            ends = np.flatnonzero(ids == sep_id) * 4
            raw = ids.tobytes()
            self.kept.update(zip(keys[i : i + 100 * size], [raw[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)], strict=True))

    def _split(self, text: str) -> list[str]:
        """Chunks by their keys: the first with U+0000 in front, a later one without its space or with its line end.

        All chunks of a text that has U+0000 itself get it in front.
        """
        # white space other than single spaces and line ends between words (none else is printable)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or not text.replace("\n", "").isprintable():
            first, *rest = self.CUT.split(text)
            if "\0" in text:
                return ["\0" + p for p in [first, *rest]]
            return ["\0" + first, *[p[1:] if p[0] == " " else p for p in rest]]
        first, *rest = text.replace("\n", " \n").split(" ")
        return ["\0" + first, *rest]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self._split(t) if t else [] for t in texts]
        if len(self.kept) > KEEP_CHUNKS:
            self.kept = {}
        kept = self.kept
        new = list(set().union(*split).difference(kept))
        self._learn(new)
        out = [np.frombuffer(b"".join(map(kept.__getitem__, parts)) + self.end, "<u4") for parts in split]
        for p in new:
            if len(p) > KEEP_CHARS:
                del kept[p]
        return out


#: By configuration and end id: what a worker has learned serves its later tasks too.
_CODERS: dict[tuple[str, int], ChunkEncoder] = {}


def coder_of(config: str, end_id: int) -> ChunkEncoder:
    if (config, end_id) not in _CODERS:
        _CODERS[config, end_id] = ChunkEncoder(config, end_id)
    return _CODERS[config, end_id]


#: A row for each file.
MANIFEST = "partition int, shard int, n_docs long, n_tokens long, file string"


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Tokenise and write all rows in ascending id order below ``path``; runs now.

    Returns one row per shard: partition, shard, n_docs, n_tokens.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        config = f.read()
    from tokenizers import Tokenizer

    bits = bit_width(max(Tokenizer.from_str(config).get_vocab_size(), end_id + 1))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(config)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = coder_of(shared.value, end_id)
        store, base = fs.FileSystem.from_uri(path)
        ids: list[int] = []
        arrays: list[np.ndarray] = []
        held = shard = 0

        def flush() -> pd.DataFrame:
            # each attempt of a task writes files of its own; the manifest names those that count
            name = f"{part:08d}-{shard:06d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(build_shard(ids, arrays, bits))
            return pd.DataFrame({"partition": [part], "shard": [shard], "n_docs": [len(ids)], "n_tokens": [held], "file": [name]})

        for pdf in batches:
            texts, keys = pdf["text"].tolist(), pdf["id"].tolist()
            for i in range(0, len(texts), 500):
                for key, got in zip(keys[i : i + 500], coder.encode(texts[i : i + 500]), strict=True):
                    ids.append(NULL_ID if key is None or key != key else int(key))
                    arrays.append(got)
                    held += len(got)
                    if held >= SHARD_IDS:
                        yield flush()
                        ids, arrays, held, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    manifest = rows.mapInPandas(run, MANIFEST)
    # one row per shard: their number is the output's size over SHARD_IDS, not the number of documents
    found = [tuple(r) for r in manifest.collect()]
    return spark.createDataFrame(sorted(found), MANIFEST)


def read_token_files(spark, path: str, manifest: DataFrame, columns: str = "digest") -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all before it), n_tokens, and its ids or their CRC-32."""
    rows = sorted((r["partition"], r["shard"], r["file"], r["n_tokens"]) for r in manifest.collect())
    starts, total = {}, 0
    for _, _, name, count in rows:
        starts[name] = total
        total += count
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if columns == "digest" else "ids array<int>")
    if not rows:
        return spark.createDataFrame([], schema)
    begin = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                at = begin.value.get(name.rsplit("/", 1)[-1])
                if at is None:
                    continue
                r = ShardReader(raw)
                first = np.append(0, r.ends[:-1])
                keys = pd.Series(r.doc_ids).astype("Int64").mask(r.doc_ids == NULL_ID)
                flat = r.ids(0, r.n_tokens).astype("<u4")
                spans = zip(first.tolist(), r.ends.tolist(), strict=True)
                got = [zlib.crc32(flat[a:b]) for a, b in spans] if columns == "digest" else [flat[a:b].astype(np.int32) for a, b in spans]
                yield pd.DataFrame({"doc_id": keys, "start": first + at, "n_tokens": r.ends - first, schema.split()[-2]: got})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select("path", "content")
    return files.mapInPandas(run, schema)


def fresh_path(spark, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
