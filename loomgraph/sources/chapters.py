"""Chapters to segments, published wrappers, manifests, versioned copies, and where extractions come from."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a segment at most, and of a chapter title.
TARGET, TITLE = 4500, 160
_MARK = r"(?im)^\*{3}\s*%s OF THE PROJECT GUTENBERG EBOOK[^\n]*\*{3}\s*$"
_START, _END = _MARK % "START", _MARK % "END"
_LEGACY = r"(?im)^\s*End of Project Gutenberg(?:'s)?[^\n]*\s*$"
_CHAPTER = r"(?im)^\s*(?:chapter\s+[0-9ivxlc]+|第\s*[0-9一二三四五六七八九十百千零]+\s*[章回节])"
_CREDIT = r"(?im)^\s*(?:produced|prepared|transcribed)\s+by\b"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def unwrapped(text: Column) -> Column:
    """What lies between the start and end markers of a published text, if both stand there in this order.

    A closing line in the last 1000 characters, and credits in the first 1000 before the first chapter, go too.
    """
    stripped = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s++$", "")

    def without_close(body: Column) -> Column:
        from_ = F.greatest(F.length(body) - 1000, F.lit(0))
        end = F.substring(body, from_ + 1, F.lit(1001))
        return _let(F.regexp_extract(end, _LEGACY, 0), lambda old: F.when(old != "", F.regexp_replace(F.substring(body, F.lit(1), from_ + F.instr(end, old) - 1), r"\s++$", "")).otherwise(body))

    def without_credit(body: Column) -> Column:
        head = F.substring(body, 1, 1200)
        begin = _let(F.regexp_extract(head, _CHAPTER, 0), lambda c: F.when((c != "") & (F.instr(head, c) <= 1000), F.instr(head, c)))
        return _let(begin, lambda at: F.when(at.isNotNull() & (F.regexp_extract(F.substring(head, F.lit(1), at - 1), _CREDIT, 0) != ""), F.substring(body, at, F.length(body))).otherwise(body))

    def between(start: Column, end: Column) -> Column:
        begin = F.instr(text, start) + F.length(start)
        body = stripped(F.substring(text, begin, F.instr(text, end) - begin))
        return F.when((start != "") & (end != "") & (F.instr(text, end) >= begin), stripped(_let(_let(body, without_close), without_credit))).otherwise(text)

    marked = _let(F.regexp_extract(text, _START, 0), lambda s: _let(F.regexp_extract(text, _END, 0), lambda e: between(s, e)))
    return F.when(F.contains(text, F.lit("***")), marked).otherwise(text)


def pieces(text: str | None, target: int = TARGET) -> list[str]:
    """Paragraphs packed greedily up to `target` characters; longer paragraphs are cut, what is left of one starts a piece."""
    import re

    text = text or ""
    out, held = [], ""
    for p in [q for x in re.split(r"\n\s*\n|(?<=。)\n", text) if (q := x.strip())] or [text]:
        *full, rest = [p[a : a + target] for a in range(0, len(p), target)] or [""]
        if full:
            out += [held, *full] if held else full
            held = ""
        both = f"{held}\n\n{rest}".strip() if held else rest
        if held and len(both) > target:
            out.append(held)
            held = rest
        else:
            held = both
    return [*out, held] if held else out


def chunked(chapters: DataFrame, book: str = "book_id", at: str = "chapter", title: str = "title", text: str = "text", target: int = TARGET) -> DataFrame:
    """book, ordinal, title, text, char_start, char_end, anchor: segments that never cross a chapter.

    Offsets run through a book, one more for each segment; only each chapter's lengths meet in the window.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda t: pieces(t, target))

    rows = chapters.select(book, at, F.substring(title, 1, TITLE).alias(title), cut(F.col(text)).alias("p_"))
    before = Window.partitionBy(book).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    chars = F.aggregate("p_", F.lit(0).cast("long"), lambda s, x: s + F.length(x) + 1)
    rows = rows.withColumns({"n_": F.size("p_"), "c_": chars}).withColumns({"from_": F.coalesce(F.sum("n_").over(before), F.lit(0)), "at_": F.coalesce(F.sum("c_").over(before), F.lit(0))})
    sized = rows.withColumn("s_", F.transform("p_", lambda x: F.length(x) + 1))
    parts = sized.select(book, title, "from_", "at_", "s_", F.posexplode("p_").alias("k_", text))
    start = F.col("at_") + F.aggregate(F.slice("s_", F.lit(1), F.col("k_")), F.lit(0).cast("long"), lambda s, x: s + x)
    parts = parts.withColumns({"ordinal": (F.col("from_") + F.col("k_")).cast("long"), "char_start": start})
    digest = F.substring(F.sha2(text, 256), 1, 12)
    return parts.select(book, "ordinal", title, text, "char_start", (F.col("char_start") + F.length(text)).alias("char_end"), F.concat(F.lit("seg-"), F.col("ordinal"), F.lit("-"), digest).alias("anchor"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON manifest; none if it is missing or broken."""
    rows = T.ArrayType(T.StructType.fromDDL(schema))
    try:
        return spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", rows)))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def published(df: DataFrame, path: str) -> None:
    """Replaces what lies at `path`: written beside it, then moved there, so that readers see the old rows or the new."""
    spark, draft = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(draft)
    fs, where, to = _files(spark, path)
    old = to(f"{draft}.old")
    if fs.exists(where):
        fs.rename(where, old)
    if not fs.rename(to(draft), where):
        if fs.exists(old):
            fs.rename(old, where)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)


def snapshot(tables: dict[str, DataFrame], path: str) -> str:
    """A consistent copy of all tables below path/<version>; the version counts as whole once its _DONE file is there."""
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    fs, _, to = _files(spark, path)
    fs.create(to(f"{path}/{version}/_DONE")).close()
    return version


class Provider(Protocol):
    """Who extracts: gets segments (book_id, ordinal, text), returns candidate facts with their quotes as columns."""

    def extract(self, segments: DataFrame) -> DataFrame: ...

    def review(self, facts: DataFrame, segments: DataFrame) -> DataFrame: ...


class RuleProvider:
    """Extraction by rules alone, without a model: each function adds candidates (book_id, ordinal, kind, name, quote)."""

    def __init__(self, *rules: Callable[[DataFrame], DataFrame]):
        self.rules = rules

    def extract(self, segments: DataFrame) -> DataFrame:
        found = [rule(segments).select("book_id", "ordinal", "kind", "name", "quote") for rule in self.rules]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out.dropDuplicates()

    def review(self, facts: DataFrame, segments: DataFrame) -> DataFrame:
        """Facts with `holds`: whether their segment has their quote word for word."""
        text = segments.select("book_id", "ordinal", F.col("text").alias("text_"))
        return facts.join(text, ["book_id", "ordinal"], "left").withColumn("holds", F.coalesce(F.contains("text_", "quote"), F.lit(False))).drop("text_")
