"""A file stream of new records, kept as a keep-latest history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frameloom.operators.catalog import history_upsert
from frameloom.sources.scratch import exists


def _versions(spark: SparkSession, snapshot: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(snapshot)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def _buckets(df: DataFrame, buckets: int) -> DataFrame:
    """A bucket by type and key; records without a key go by their id."""
    keyless = F.coalesce("dedupe_key", F.lit("")) == ""
    return df.withColumn("bucket", F.pmod(F.xxhash64("type", "dedupe_key", F.when(keyless, F.col("id"))), F.lit(buckets)).cast("int"))


def current(spark: SparkSession, snapshot: str, before: int | None = None) -> DataFrame | None:
    """The history: of each bucket the newest complete version (older than `before`)."""
    known = [v for v in _versions(spark, snapshot) if before is None or v < before]
    if not known:
        return None
    rows = spark.read.option("basePath", snapshot).parquet(*(f"{snapshot}/version={v}" for v in known))
    newest = rows.select("bucket", "version").distinct().groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"]).drop("version")  # a row for each bucket


def _tidy(spark: SparkSession, snapshot: str, number: int, keep: int = 2) -> None:
    """Write all buckets as one version now and then, and drop the versions that it replaces but the last `keep`."""
    for v in [v for v in _versions(spark, snapshot) if v <= number][:-keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{snapshot}/version={v}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def history_stream(spark: SparkSession, source: str, schema: str, snapshot: str, checkpoint: str, buckets: int = 256, whole_every: int = 20) -> StreamingQuery:
    """Read what is new under `source`, and write a version for each batch, named by the batch's number.

    A version holds only the buckets (by type and key) that the batch touches; every `whole_every` batches one holds all of
    them, and the versions before it go, but for the last two. A batch that runs again overwrites its own version and
    starts from the ones before, so the result is the same after a failure. Records with a content get its SHA-256.
    """
    def upsert(batch: DataFrame, number: int) -> None:
        new = _buckets(batch.withColumn("sha256", F.upper(F.sha2("content", 256))).drop("content"), buckets)
        old, whole = current(spark, snapshot, number), number % whole_every == whole_every - 1
        if old is not None and not whole:
            old = old.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")  # at most `buckets` rows
        merged = history_upsert(old if old is not None else new.limit(0), new)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{snapshot}/version={number}")
        if whole:
            _tidy(spark, snapshot, number)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_history_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, files_a_batch: int = 1000) -> list[StreamingQuery]:
    """The same history with its state in the stream: the newest record of every (type, key) by id, in Spark's state store.

    A batch reads and writes nothing but its own records and the state of their keys, however long the history is. It writes the
    keys it touched as they stand now, under its own number, so a batch that runs again after a failure replaces
    what it wrote. A late record of a lower id changes nothing. Records without a key need no state and go by a query of their own.
    """
    def read() -> DataFrame:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        return stream.withColumn("sha256", F.upper(F.sha2("content", 256))).drop("content") if "content" in stream.columns else stream

    keyed = F.coalesce("dedupe_key", F.lit("")) != ""
    rows = read().filter(keyed)
    names = rows.columns
    newest = rows.groupBy("type", "dedupe_key").agg(F.max_by(F.struct(*(c for c in names if c not in ("type", "dedupe_key"))), "id").alias("r")).select("type", "dedupe_key", "r.*").select(*names)

    def changes(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/keyed/batch={number}")

    once = {"availableNow": True}
    return [
        newest.writeStream.outputMode("update").foreachBatch(changes).option("checkpointLocation", f"{checkpoint}/keyed").trigger(**once).start(),
        read().filter(~keyed).writeStream.format("parquet").option("path", f"{sink}/loose").option("checkpointLocation", f"{checkpoint}/loose").trigger(**once).start(),
    ]


def keyed_history(spark: SparkSession, schema: str, sink: str) -> DataFrame:
    """The history as it stands: of every key the row of greatest id that a batch wrote, and all records without a key."""
    plain = spark.createDataFrame([], schema)
    names = [c for c in plain.columns if c != "content"] + ["sha256"] * ("content" in plain.columns)
    kinds = plain.withColumn("sha256", F.lit("")).select(*names).schema if "content" in plain.columns else plain.schema
    keyed = spark.read.schema(kinds).parquet(f"{sink}/keyed/batch=*") if exists(spark, f"{sink}/keyed") else spark.createDataFrame([], kinds)
    loose = spark.read.schema(kinds).parquet(f"{sink}/loose") if exists(spark, f"{sink}/loose") else spark.createDataFrame([], kinds)
    newest = keyed.groupBy("type", "dedupe_key").agg(F.max_by(F.struct(*(c for c in names if c not in ("type", "dedupe_key"))), "id").alias("r")).select("type", "dedupe_key", "r.*")
    return newest.select(*names).unionByName(loose.select(*names))
