"""One query per operator over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testlog.llm import (
    bpe,
    chat,
    decontam,
    htmltext,
    licenses,
    linededup,
    mixing,
    neardup,
    oracles,
    phrases,
    prefixtrie,
    quality,
    sharding,
    warc,
)
from testlog.llm.catalog import query, table
from testlog.operators.durable import session_folder


@query("op9_quality_divergence", oracles.QUALITY_DIVERGENCE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def token_digests(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of what they decode to, one row per document."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.decode(bpe.encode(docs.select("doc_id", "text"), vocabulary), vocabulary)
    return tokens.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


@query("op2_order_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op1_line_templates", oracles.LINE_TEMPLATES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_lines",
        "n_recurring",
        "n_dropped",
        "is_copy",
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op6_spaced_seeds", oracles.SPACED_SEEDS)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "share")


@query("op7_hypergeometric_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    return sharding.shard_rows(rows, ["doc_id", "size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_license_join", oracles.LICENSE_JOIN)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op4_warc_chains", oracles.WARC_CHAINS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{session_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op10_block_rules", oracles.BLOCK_RULES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars", "n_kept"
    )


@query("op5_perspectives", oracles.PERSPECTIVES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    return views.withColumn(
        "spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    )


@query("op13_phrase_graph", oracles.PHRASE_GRAPH)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op11_water_filling", oracles.WATER_FILLING)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query("op12_prefix_trie", oracles.PREFIX_TRIE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))
