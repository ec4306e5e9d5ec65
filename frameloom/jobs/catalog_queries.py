"""Registered queries over digests and the catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.fnv import sampled_fingerprint
from frameloom.jobs.session import job
from frameloom.operators import catalog, digest
from frameloom.sources.mapped import duck, table
from frameloom.sources.scratch import scratch_path
from frameloom.streaming.history import keyed_history, keyed_history_stream

FRACTION, TARGET, NEWEST, STREAM_FILES = 20, 20_000, 50, 4
ADDED = ("-main", "-sub", 7)


def q_file_digests(spark: SparkSession, d: str) -> DataFrame:
    return digest.file_digests(table(spark, d, "files")).select("file_id", "md5", "sha1", "sha256")


def q_sampled_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("file_id", sampled_fingerprint("content").alias("fingerprint"))


def q_append_suffix(spark: SparkSession, d: str) -> DataFrame:
    made = digest.append_suffix(table(spark, d, "files"), *ADDED)
    return made.select("file_id", "added", F.upper(F.md5("content")).alias("md5"))


def q_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    marked = digest.file_digests(table(spark, d, "files")).select("file_id", "length", "sha256")
    return digest.duplicate_groups(marked, "sha256", "file_id")


def q_sniff_type(spark: SparkSession, d: str) -> DataFrame:
    magic = F.expr("CASE file_id % 4 WHEN 0 THEN X'89504E470D0A1A0A' WHEN 1 THEN X'FFD8FF' WHEN 2 THEN encode('GIF89a', 'UTF-8') ELSE X'' END")
    typed = table(spark, d, "files").select("file_id", "length", catalog.sniff_type(F.concat(magic, "content")).alias("kind"))
    return typed.groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def q_is_gif(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("file_id", catalog.is_gif(F.col("name"), F.col("mime")).alias("is_gif"))


def q_list_catalog_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select("file_id", "name", "source")
    hot = F.col("source") == "src0"
    return catalog.list_catalog_files(files.filter(hot), files.filter(~hot), "tag", "file_id").select("file_id", "name", "folder")


def q_output_name(spark: SparkSession, d: str) -> DataFrame:
    named = catalog.number_batch(table(spark, d, "history"), "dedupe_key", "id")
    return named.select("id", catalog.output_name(F.col("position"), F.col("filename"), "hidden", F.col("time"), "png").alias("name"))


def q_number_batch(spark: SparkSession, d: str) -> DataFrame:
    return catalog.number_batch(table(spark, d, "history"), "dedupe_key", "id").select("id", "position", "badge")


def q_history_keyed_stream(spark: SparkSession, d: str) -> DataFrame:
    """The history table as files of an input folder, streamed in several batches."""
    here = scratch_path(spark, "history-stream")
    rows = table(spark, d, "history").select("id", "type", "dedupe_key", "size")
    schema = "id long, type string, dedupe_key string, size long"
    rows.repartition(STREAM_FILES).write.parquet(f"{here}/in")
    for query in keyed_history_stream(spark, f"{here}/in", schema, f"{here}/out", f"{here}/state", STREAM_FILES // 2):
        query.awaitTermination()
    return keyed_history(spark, schema, f"{here}/out")


def q_history_upsert(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "history")
    old = F.col("id") % FRACTION != 0
    return catalog.history_upsert(history.filter(old), history.filter(~old)).select("id", "type", "dedupe_key", "size")


def q_history_delete(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "history")
    gone = history.filter("size < 2000").select("id")
    return catalog.history_delete(history, gone).select("id", "type", "size")


def q_history_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.history_list(table(spark, d, "history"), NEWEST)


def q_history_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.history_stats(table(spark, d, "history"))


def q_human_size(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "history").withColumn("bytes", F.expr("size * CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 ELSE 100000000000 END"))
    return history.select("id", catalog.human_size(F.col("bytes")).alias("shown"))


def q_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.batch_summary(table(spark, d, "results"))


def q_pick_under_budget(spark: SparkSession, d: str) -> DataFrame:
    return catalog.pick_under_budget(table(spark, d, "probes"), TARGET)


def q_hash_report(spark: SparkSession, d: str) -> DataFrame:
    return catalog.hash_report(digest.file_digests(table(spark, d, "files")))


def q_tile_order(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tile_order(table(spark, d, "files").select("file_id", "name")).select("file_id", "tile_no")


QUERIES = {k[2:]: job(v) for k, v in list(globals().items()) if k.startswith("q_")}

ORACLE_SQL = {k: duck(v) for k, v in {
    "file_digests": "SELECT file_id, upper(md5(text)) AS md5, upper(sha1(text)) AS sha1, upper(sha256(text)) AS sha256 FROM {files}",
    "sampled_fingerprint": """
        WITH f AS (SELECT file_id, text, strlen(text) AS n, hex(encode(text)) AS h, greatest(1, strlen(text) // 4096) AS step FROM {files}),
        s AS (SELECT file_id, n, list_concat(range(0, n, step), range(greatest(0, n - 64), n)) AS places, h FROM f),
        b AS (SELECT file_id, n, list_transform(places, lambda i: (('0x' || substr(h, (2 * i + 1)::INT, 2))::UBIGINT)::BIGINT) AS bytes FROM s)
        SELECT file_id, concat(n, ':', lower(hex(list_reduce(list_prepend(2166136261::BIGINT, bytes), lambda acc, x: (xor(acc, x) * 16777619) % 4294967296)::UBIGINT))) AS fingerprint FROM b""",
    "append_suffix": """
        SELECT file_id, strlen('-main-sub')::INT + 8 + ('0x' || substr(sha256(concat('7:', path)), 1, 2))::INT % 17 AS added,
               upper(md5(encode(concat(text, '-main-sub')) || unhex(substr(sha256(concat('7:', path)), 1, 2 * (8 + ('0x' || substr(sha256(concat('7:', path)), 1, 2))::INT % 17))))) AS md5 FROM {files}""",
    "duplicate_groups": "SELECT upper(sha256(text)) AS sha256, count(*) AS n, max(file_id) AS newest, (sum(length) - max_by(length, file_id))::BIGINT AS wasted FROM {files} WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "sniff_type": "SELECT CASE file_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'GIF' END AS kind, count(*) AS n, sum(length)::BIGINT AS bytes FROM {files} GROUP BY 1",
    "is_gif": "SELECT file_id, mime = 'image/gif' OR lower(name) LIKE '%.gif' AS is_gif FROM {files}",
    "list_catalog_files": "SELECT file_id, name, 'main' AS folder FROM {files} WHERE source = 'src0' UNION ALL SELECT file_id, name, 'other' FROM {files} WHERE source <> 'src0' AND (lower(name) LIKE '%.png' OR lower(name) LIKE '%.gif') AND name LIKE '%tag%'",
    "output_name": "SELECT id, concat(CASE WHEN p < 1000 THEN lpad(p::VARCHAR, 3, '0') ELSE p::VARCHAR END, '_', regexp_replace(filename, '\\.[^.]+$', ''), '_hidden_', strftime(time, '%Y%m%d%H%M%S'), '.png') AS name FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id) AS p FROM {history})",
    "number_batch": "SELECT id, p::INT AS position, CASE WHEN n > 1 THEN p::INT END AS badge FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id) AS p, count(*) OVER (PARTITION BY dedupe_key) AS n FROM {history})",
    "history_keyed_stream": "SELECT id, type, dedupe_key, size FROM (SELECT *, row_number() OVER (PARTITION BY type, dedupe_key ORDER BY id DESC) AS rn FROM {history}) WHERE rn = 1 OR coalesce(dedupe_key, '') = ''",
    "history_upsert": "SELECT id, type, dedupe_key, size FROM (SELECT *, row_number() OVER (PARTITION BY type, dedupe_key ORDER BY id DESC) AS rn FROM {history}) WHERE rn = 1 OR coalesce(dedupe_key, '') = ''",
    "history_delete": "SELECT id, type, size FROM {history} WHERE size >= 2000",
    "history_list": f"SELECT id, filename, CASE type WHEN 'click' THEN 'restored' WHEN 'view' THEN 'hidden' ELSE 'other' END AS label, printf('%.1f KB', floor(size / 1024 * 10 + 0.5) / 10) AS kb FROM {{history}} ORDER BY id DESC LIMIT {NEWEST}",
    "history_stats": "SELECT type, count(*) AS n, sum(size)::BIGINT AS bytes FROM {history} GROUP BY ROLLUP (type)",
    "human_size": """
        WITH h AS (SELECT id, size * CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 ELSE 100000000000 END AS bytes FROM {history}),
        u AS (SELECT id, bytes, CASE WHEN bytes < 1024 THEN 0 ELSE greatest(1, floor(log2(bytes) / 10)::INT) END AS i FROM h)
        SELECT id, CASE WHEN i = 0 THEN concat(bytes, ' B') ELSE printf('%.1f %sB', floor(bytes / pow(1024, i) * 10 + 0.5) / 10, substr('KMGTPE', i, 1)) END AS shown FROM u""",
    "batch_summary": """
        SELECT batch_id, count_if(NOT failed)::BIGINT AS ok, count_if(failed)::BIGINT AS failed, coalesce(sum(CASE WHEN NOT failed THEN old_size END), 0)::BIGINT AS bytes_before, coalesce(sum(CASE WHEN NOT failed THEN new_size END), 0)::BIGINT AS bytes_after,
               coalesce(greatest(0, floor((1 - sum(CASE WHEN NOT failed THEN new_size END) / sum(CASE WHEN NOT failed THEN old_size END)) * 100 + 0.5)), 0)::BIGINT AS saved_percent,
               max(CASE WHEN NOT failed THEN CASE WHEN old_size > 0 THEN greatest(0, floor((1 - new_size / old_size) * 100 + 0.5)) ELSE 0 END END)::BIGINT AS best_percent FROM {results} GROUP BY batch_id""",
    "pick_under_budget": f"""
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scale DESC, quality DESC, size DESC) AS rn FROM {{probes}} WHERE size <= {TARGET})
        SELECT f.file_id, coalesce(scale, 0.3) AS scale, coalesce(quality, 0.1) AS quality, size, r.file_id IS NOT NULL AS fits FROM (SELECT DISTINCT file_id FROM {{probes}}) f LEFT JOIN r ON r.file_id = f.file_id AND rn = 1""",
    "hash_report": "SELECT file_id, concat_ws(chr(10), name, 'MD5: ' || upper(md5(text)), 'SHA1: ' || upper(sha1(text)), 'SHA256: ' || upper(sha256(text))) AS report FROM {files}",
    "tile_order": "SELECT file_id, try_cast(regexp_extract(name, '^([0-9]+)', 1) AS BIGINT) AS tile_no FROM {files}",
}.items()}
