"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

toxicity drops documents that the classifier rejects; near_duplicates keeps the document of least id of
each class; decontamination drops documents that hold a benchmark item; secrets keeps every document and
masks the secrets in its text; tokens encodes and decodes.

Defined cases: a null text is an empty document and passes every filter but that of near duplicates, where all
null texts are equal; a document without an id is known by its text; rows that repeat an id and its text are one
document, and different texts under one id are several (near_duplicates knows them by 64 bits: of 10^10 documents some three
pairs would be taken for one another); extra columns pass through unchanged whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import bpe, decontaminate, near_dup, secrets, toxicity
from frameloom.llm.common import job_session, materialize, read_table, remove, scratch_path, stored

#: The pipeline rejects a document from this calibrated score on.
REJECT = 0.5


def _by_place(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The rows with columns named by their place, so that no name clashes; the names of id and text."""
    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    return plain, *(f"_c{docs.columns.index(c)}" for c in ("doc_id", "text"))


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read_table(job_session(spark), sf_dir, "labels"))
    plain, _, text = _by_place(docs)
    scored = model.score(plain, text, tuple(plain.columns))
    return scored.filter(F.col("score") < REJECT).select(*plain.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    job_session(spark)
    plain, ident, text = _by_place(docs)
    # A document is an id with its text, so different texts under one id are documents of their own.
    keyed = plain.withColumn("_key", F.xxhash64(ident, F.md5(F.encode(text, "UTF-8"))))
    classes = near_dup.classes(keyed, text, "_key").distinct()
    ids = materialize(keyed.groupBy("_key").agg(F.min(ident).alias("id"), F.count("*").alias("n")), "documents")
    # The document of least id stands for its class, one without an id only where none has one.
    named = materialize(classes.join(ids, "_key"), "named")
    least = named.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "_key"))["_key"].alias("stays"))
    gone = materialize(named.join(least, named["_key"] == least["stays"], "left_anti").select("_key"), "gone")
    twice = materialize(named.filter("n > 1").select("_key").join(gone, "_key", "left_anti"), "repeated")
    # What goes, and documents that repeat, are few as a rule: a small table is broadcast by its measured size, and no text shuffled.
    kept = keyed.join(gone, "_key", "left_anti")
    if not twice.isEmpty():
        again = kept.join(twice, "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(twice, "_key", "left_anti").unionByName(again)
    return kept.select(*plain.columns).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, ident, text = _by_place(docs)
    # 128 bits, so that no document goes for another's leak.
    keyed = plain.withColumn("_key", F.xxhash64(ident, text)).withColumn("_more", F.xxhash64(F.lit(1), text, ident))
    found = materialize(decontaminate.find(keyed, read_table(job_session(spark), sf_dir, "benchmark"), text=text, keys=("_key", "_more")).select("_key", "_more").distinct(), "leaks")
    return keyed.join(found, ["_key", "_more"], "left_anti").select(*plain.columns).toDF(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    job_session(spark)
    out = secrets.redact(docs, secrets.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    job_session(spark)
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.tokens(docs, vocabulary, public_tokenizers.PATTERN, remember=False)  # leaves the workers' memory to other stages
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", toxic_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

#: Classifier, field and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder. A stage's rows go when the next one's
    are written, the last ones when the application ends."""
    docs, before = read_table(job_session(spark), sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        docs = stored(stage(spark, docs, sf_dir), path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
