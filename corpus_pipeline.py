"""A training corpus from raw documents: five stages, each one operator, each stage's rows written and read again.

1. language ID: documents without an identified language go;
2. line dedup: of near-equal lines one stays in the corpus (texts shrink, documents stay);
3. SimHash near-dedup: one document of each group stays;
4. mixing: documents are taken to their sources' target words and put in training order;
5. SentencePiece encoding and decoding: token ids and decoded text of each document taken, with its place in the order.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewise.llm.language_id import accepted
from clausewise.llm.line_dedup import dedup_lines
from clausewise.llm.queries import PIECES, vocabulary
from clausewise.llm.sentencepiece_bpe import encode_documents
from clausewise.llm.simhash import keep_one
from clausewise.llm.source_mix import training_documents
from clausewise.runtime import prepare, shared_dir

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return training_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position (place in the training order, from 0), n_tokens, ids and the decoded text of each document taken.

    The order is that of the files that docs is read from; where docs is not read from files, position is null.
    """
    coded = encode_documents(in_order(docs), vocabulary(PIECES), keep=("position",))
    return coded.select(F.col("id").alias("doc_id"), "position", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, position): rows with their place in the files' order (file names, then rows)."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return docs.select("doc_id", "text", F.lit(None).cast("long").alias("position"))
    x = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # a row for each file
    sizes = x.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("file", F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return x.join(F.broadcast(before), "file").select("doc_id", "text", (F.col("before") + F.col("row")).alias("position"))


def _prepared(stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    return lambda spark, docs, sf_dir: stage(prepare(spark), docs, sf_dir)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [(f.__name__, _prepared(f)) for f in (language_id, line_dedup, simhash_dedup, source_mix, sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
