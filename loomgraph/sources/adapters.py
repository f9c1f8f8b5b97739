"""The tables at hand as the engine's model: segments, story events, claims."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = ("view", "click", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(documents: DataFrame, text: str = "text", book: str = "doc_id") -> DataFrame:
    """book_id, ordinal, text, char_start: the lines of each document in order; offsets count the line ends. No shuffle."""
    kind = documents.schema[book].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                lines = [(t or "").split("\n") for t in part.column(1).to_pylist()]
                n = [len(x) for x in lines]
                size = np.fromiter((len(x) + 1 for y in lines for x in y), np.int64, sum(n))
                first = np.repeat(np.cumsum(n) - n, n)
                before = np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.arange(size.size) - first), pa.array([x for y in lines for x in y], pa.string()), pa.array(before - before[first])], names=["book_id", "ordinal", "text", "char_start"])

    return documents.select(book, text).mapInArrow(run, f"book_id {kind}, ordinal long, text string, char_start long")


def anchored(segments_: DataFrame) -> DataFrame:
    """With anchor and content_hash, by which a segment is known again."""
    digest = F.sha2("text", 256)
    return segments_.withColumn("content_hash", digest).withColumn("anchor", F.concat(F.lit("seg-"), F.col("ordinal"), F.lit("-"), F.substring(digest, 1, 12)))


def story_events(events: DataFrame) -> DataFrame:
    """event_id, subject, ts, kind, value, place (null where the event has none), target (k of props)."""
    place = F.when(F.col("event_type").isin(*PLACES), F.col("event_type"))
    return events.select("event_id", F.col("user_id").alias("subject"), "ts", F.col("event_type").alias("kind"), "value", place.alias("place"), F.get_json_object("props", "$.k").cast("long").alias("target"))
