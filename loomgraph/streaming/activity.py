"""Streams over arriving events: windowed counts with a watermark, and idempotent arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream of the schema of `like`; timestamps get a zone, which watermarks need."""
    raw = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def activity(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Events and their value by kind and window; each event id counts once, later than `late` is dropped."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


BUCKETS = 64


def upsert_sink(path: str, key: list[str]):
    """For foreachBatch: appends only rows whose key the folder doesn't hold yet.

    Rows lie by bucket of their key, so a batch looks into the buckets that it touches only, and by batch: one that runs
    again after a failure replaces what it had left and does not see itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")
        new = batch.dropDuplicates(key).withColumn("bucket_", bucket)
        touched = [r[0] for r in new.select("bucket_").distinct().collect()]  # BUCKETS at most
        try:
            old = spark.read.parquet(path).where(F.col("bucket_").isin(touched) & (F.col("batch_") != number))
            new = new.join(old.select(*key), key, "left_anti")
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.select(*batch.columns, "bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{path}/batch_={number}")

    return write


def running_states(events: DataFrame, key: str = "user_id") -> DataFrame:
    """key, n_events, last_event, last_kind, total: each key's state after every batch that touches it, kept by the stream.

    A fold with a state of fixed size for each key; events that come again or late count by their id, the largest being
    the last. For outputMode("update").
    """
    kind = events.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_events long, last_event long, last_kind string, total double"

    def step(k, batches, state):
        import pandas as pd

        n, last, what, total = state.get if state.exists else (0, -1, "", 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
            at = int(b["event_id"].idxmax()) if len(b) else None
            if at is not None and int(b.loc[at, "event_id"]) > last:
                last, what = int(b.loc[at, "event_id"]), str(b.loc[at, "event_type"])
        state.update((n, last, what, total))
        yield pd.DataFrame([(*k, n, last, what, total)], columns=[key, "n_events", "last_event", "last_kind", "total"])

    return events.groupBy(key).applyInPandasWithState(step, schema, "n long, last long, kind string, total double", "update", "NoTimeout")
