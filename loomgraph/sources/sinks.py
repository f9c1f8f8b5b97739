"""Sinks and small sources: export, keyed upsert, a generated book, entities written out in a text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def export_book(tables: Mapping[str, DataFrame], path: str, book: str | None = None, with_text: bool = True) -> DataFrame:
    """Every table as JSON lines under path/name, one book or all; returns (name, n). Texts can be left out."""
    counts = None
    for name, df in tables.items():
        rows = df.where(F.col("book_id") == book) if book is not None else df
        rows = rows if with_text else rows.drop("text")
        rows.write.mode("overwrite").json(f"{path}/{name}")
        n = rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    return counts


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: bool = False) -> DataFrame:
    """old with the rows of new: on equal keys those of new replace it, or with keep_old are ignored.

    new holds one row for each key. Where both sides are bucketed by the
    key, no shuffle is needed.
    """
    if keep_old:
        return old.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def generated_book(spark: SparkSession, n: int, people: int = 60, places: int = 12, factions: int = 6) -> DataFrame:
    """n chapters, one event each, by modular arithmetic: who, with whom, where from and to, and when in the story.

    Every chapter with remainder 3 of 7 tells of something that lies twelve chapters back.
    """
    i = F.col("id")
    told = F.when(i % 7 == 3, F.greatest(F.lit(0), i - 12) + 0.25).otherwise(i.cast("double"))
    rows = spark.range(n).select(
        i.alias("ordinal"), (i % people).alias("lead"), ((i + 1) % people).alias("partner"), (i % factions).alias("faction"), (i % places).alias("from_place"), ((i + 1) % places).alias("to_place"),
        (i % 5).alias("transport"), told.alias("story_order"), (i % 7 == 3).alias("flashback"), (i % 3 == 0).alias("has_entry"),
    )
    return rows.withColumn("n_claims", F.lit(2))


def marked_entities(segments: DataFrame, text: str = "text", marker: str = r"\[(\w+):([^\]]+)\]") -> DataFrame:
    """book_id, kind, name, first_segment, n of entities marked as [kind:name]; a marker pattern gives both groups."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(marker), F.lit(1)).alias("kind"), F.regexp_extract_all(text, F.lit(marker), F.lit(2)).alias("name"))
    rows = segments.select("book_id", "ordinal", F.inline(pairs))
    return rows.groupBy("book_id", "kind", F.trim("name").alias("name")).agg(F.min("ordinal").alias("first_segment"), F.count(F.lit(1)).alias("n"))


def first_sentences(segments: DataFrame, text: str = "text") -> DataFrame:
    """The first sentence of each segment: the event that stands for it when no model is asked."""
    return segments.select("book_id", "ordinal", F.trim(F.regexp_extract(text, r"^\s*([^.!?。！？]*[.!?。！？]?)", 1)).alias("event"))


def repaired(evidence: DataFrame, segments: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence whose segment is of another book than its fact: pointed at the same ordinal of the fact's book, else dropped.

    evidence: evidence_id, fact_id, segment_id. segments: segment_id, book_id, ordinal. facts: fact_id, book_id.
    """
    s = segments.select("segment_id", F.col("book_id").alias("in_"), "ordinal")
    rows = evidence.join(s, "segment_id").join(facts.select("fact_id", "book_id"), "fact_id")
    own = Window.partitionBy("book_id", "ordinal").orderBy("segment_id")
    there = segments.withColumn("k_", F.row_number().over(own)).where("k_ = 1").select("book_id", "ordinal", F.col("segment_id").alias("to_"))
    rows = rows.join(there, ["book_id", "ordinal"], "left").withColumn("segment_id", F.when(F.col("in_") == F.col("book_id"), F.col("segment_id")).otherwise(F.col("to_")))
    return rows.where("segment_id is not null").select("evidence_id", "fact_id", "segment_id")
