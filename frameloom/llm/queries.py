"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import bpe, decontaminate, fim, licenses, near_dup, pieces, quality, secrets, simple8b, slots, toxicity, warc, whiten
from frameloom.llm.common import job_session, shared_root
from frameloom.llm.common import read_table as plain_table

RANKS, WORD_PIECES, PIECES, END_ID = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model", 1
SHARDS, CRAWL_DATE = 24, "2024-01-01T00:00:00Z"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plain_table(job_session(spark), sf_dir, name)


def bpe_digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    vocabulary = bpe.load_vocabulary(docs.sparkSession, vocabulary_path)
    return bpe.tokens(docs, vocabulary, pattern).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op4_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    seen = read_table(spark, sf_dir, "labels").filter(toxicity.crc_fold() != 0)
    scored = toxicity.fit(docs, seen).score(docs)
    return scored.select("doc_id", (toxicity.crc_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_PIECES), END_ID)


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The map of a data set stays in the shared folder: a later run loads it, and edits it if the data or the shards have changed.
    folder = f"{shared_root(spark)}/frameloom/slot-map/{hashlib.md5(sf_dir.encode()).hexdigest()}"
    dealt = slots.shard(read_table(spark, sf_dir, "documents"), SHARDS, folder=folder)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op7_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.responses_of_pages(read_table(spark, sf_dir, "pages"), CRAWL_DATE)
    return warc.derive(responses, ("page_id",))


def op9_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read_table(spark, sf_dir, "documents"))


def fim_digests(docs: DataFrame) -> DataFrame:
    done = fim.fill_in_middle(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(read_table(spark, sf_dir, "documents"))


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    made = pieces.tokens(docs, pieces.load_model(docs.sparkSession, model_path))
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_crf": op3_secret_crf,
    "op4_toxicity_gbt": op4_toxicity_gbt,
    "op5_simple8b_tokens": op5_simple8b_tokens,
    "op6_virtual_slots": op6_virtual_slots,
    "op7_containment_search": op7_containment_search,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_license_dice": op9_license_dice,
    "op10_order_minhash": op10_order_minhash,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.judge_sql(),
    "op7_containment_search": decontaminate.FIND_SQL,
    "op11_fill_in_middle": fim.DIGESTS_SQL,
}
