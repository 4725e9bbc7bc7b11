"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.runtime import prepare

PIECES, BYTE_BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.sentencepiece_bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), vocabulary(PIECES)).withColumnRenamed("id", "doc_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.token_files import fresh_path, read_token_files, write_token_files

    path = fresh_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(BYTE_BPE))
    return read_token_files(spark, path, manifest)


def held_out(doc_id) -> Column:
    """The rows that op8 keeps from learning: crc32 of the id as text, modulo 5, is 0 (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, where=~held_out(F.col("doc_id")))
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).drop("text")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.source_mix import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("positions")).cast("long").alias("taken"), F.get("positions", F.lit(0)).alias("first_position"))


def op1_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.weighted_minhash import edit_likeness

    return edit_likeness(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    # the best find: the greatest coefficient, then the earliest
    best = F.array_sort("finds", lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).otherwise(F.signum(a["start"] - b["start"]).cast("int")))[0]
    best = F.when(F.size("finds") > 0, best)
    return found.select(F.col("id").alias("doc_id"), F.size("finds").alias("n_finds"), best["template"].alias("license"), best["dice"].alias("dice"), best["start"].alias("span_start"), best["end"].alias("span_end"), F.to_json("finds").alias("finds"))


def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.quality_votes import judge

    found = judge(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "posterior")


def op10_host_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.host_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weighted_minhash": op1_weighted_minhash,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_quality_votes": op4_quality_votes,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_files": op7_token_files,
    "op8_language_id": op8_language_id,
    "op9_source_mix": op9_source_mix,
    "op10_host_filter": op10_host_filter,
}

ORACLES: dict[str, str] = {}
