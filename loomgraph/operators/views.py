"""Read views: progress-bounded counts, search, knowledge projections, latest corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import excerpt, like_pattern


def visible(rows: DataFrame, progress: int, position: str = "first_segment", book: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """What a reader at `progress` may see; with counts (book, segment_count) no further than the book's last segment."""
    if counts is None:
        return rows.where(F.col(position) <= progress)
    upto = counts.select(book, F.least(F.lit(progress), F.greatest(F.lit(0), F.col("segment_count") - 1)).alias("upto_"))
    return rows.join(upto, book).where(F.col(position) <= F.col("upto_")).drop("upto_")


def search(sources: list[tuple[str, DataFrame, str, str]], query: str, limit: int) -> DataFrame:
    """Cascading search: sources in order, each by id, until the limit. Each source is (name, frame, id, text).

    Each source gives at most `limit` rows before the union; wildcards in the query are literal.
    """
    out = None
    for rank, (name, df, key, text) in enumerate(sources):
        hit = df.where(F.col(text).ilike(like_pattern(query))).select(F.lit(rank).alias("source_rank"), F.lit(name).alias("source"), F.col(key).cast("long").alias("id"), excerpt(F.col(text), query).alias("snippet")).orderBy("id").limit(limit)
        out = hit if out is None else out.unionByName(hit)
    return out.orderBy("source_rank", "id").limit(limit)


def concepts(parts: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """One concept for each (category, label) of several tables, with how many rows stand behind it."""
    out = None
    for scheme, df, category, label in parts:
        c = df.select(F.lit(scheme).alias("scheme"), category.alias("category"), label.alias("label"))
        out = c if out is None else out.unionByName(c)
    return out.where("label is not null").groupBy("category", "label").agg(F.min("scheme").alias("scheme"), F.count(F.lit(1)).alias("n_sources"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, item, n) of several columns in one pass over the table."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("item")) for c in columns])).alias("f"))
    return rows.groupBy("f.facet", "f.item").agg(F.count(F.lit(1)).alias("n"))


def latest_version(log: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The last entry of a correction log for each key, and how many there are."""
    return log.groupBy(*key).agg(F.max(F.struct(*order, value)).alias("m"), F.count(F.lit(1)).alias("n_revisions")).select(*key, F.col(f"m.{value}").alias(value), "n_revisions")


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k of each group; the limit acts before the shuffle."""
    return df.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("at") <= k)


def packed(sizes: Column, limit: int) -> Column:
    """Greedy batches of consecutive sizes as an array of batch numbers: a new one where the limit would be passed."""
    start = F.struct(F.array().cast("array<int>").alias("of"), F.lit(0).cast("long").alias("used"), F.lit(-1).alias("at"))

    def step(s: Column, x: Column) -> Column:
        new = (s["at"] < 0) | (s["used"] + x > limit)
        at = F.when(new, s["at"] + 1).otherwise(s["at"])
        return F.struct(F.concat(s["of"], F.array(at)).alias("of"), F.when(new, x).otherwise(s["used"] + x).cast("long").alias("used"), at.alias("at"))

    return F.aggregate(sizes, start, step, lambda s: s["of"])
