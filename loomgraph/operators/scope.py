"""Scopes and small views: what a filter lets through, what belongs together, and in which order it is shown."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import SEPARATOR, like_pattern
from loomgraph.operators.graph import components

LOW_CONFIDENCE = 0.65


def before(rows: DataFrame, progress: int, ordinal: str = "first_segment") -> DataFrame:
    """What was known strictly before a segment."""
    return rows.where(F.col(ordinal) < progress)


def where_all(rows: DataFrame, wanted: Mapping[str, object], query: str | None = None, searched: Sequence[str] = ()) -> DataFrame:
    """Rows that meet every filter given: equality by column (None: no filter), and a query that any searched column holds."""
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    if query:
        tests.append(reduce(Column.__or__, [F.col(c).ilike(like_pattern(query)) for c in searched]))
    return rows.where(reduce(Column.__and__, tests)) if tests else rows


def glob(column: Column, pattern: str) -> Column:
    """GLOB: * any characters, ? one, [..] one of a set, all case-sensitive."""
    out = "".join({"*": ".*", "?": "."}.get(p, p if len(p) > 1 else re.escape(p)) for p in re.findall(r"\[[^\]]+\]|.", pattern, re.S))
    return column.rlike(f"(?s)^{out}$")


def low_confidence(tables: Mapping[str, DataFrame], limit: float = LOW_CONFIDENCE) -> DataFrame:
    """(source, id, confidence) under the limit, of all tables of (id, confidence)."""
    parts = [df.where(F.col("confidence") < limit).select(F.lit(name).alias("source"), "id", "confidence") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def in_scope(events: DataFrame, units: DataFrame, book: str = "book_id") -> DataFrame:
    """Events of the units of a scope: those whose segment lies in one, each once for each. units: book, unit_id, first, last.

    Units of a book hardly overlap, so they are dealt out by blocks of segments and met on equal blocks.
    """
    size = 16
    blocks = units.select(book, "unit_id", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))).alias("block_"))
    met = events.withColumn("block_", F.floor(F.col("ordinal") / size)).join(blocks, [book, "block_"])
    return met.where("ordinal between first and last").drop("block_", "first", "last")


def level_of_detail(nodes: DataFrame, level: str) -> DataFrame:
    """low: nodes of the main route and aggregates; medium: also the first eight components; high: all."""
    if level == "high":
        return nodes
    shown = F.col("on_route") | F.col("aggregate")
    return nodes.where(shown | (F.col("component_rank") < 8) if level == "medium" else shown)


def cache_key(*parts: Column) -> Column:
    """One digest of all parts, a separator between them, null counting as empty."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with `cached`: whether their key was answered, and by which (the latest) result."""
    last = cache.groupBy("key").agg(F.max_by("result", F.struct("at", "result")).alias("result"))
    return requests.join(last, "key", "left").withColumn("cached", F.col("result").isNotNull())


def sharing(members: DataFrame, group: str = "unit_id", item: str = "entity_id", within: str = "book_id") -> DataFrame:
    """Pairs of groups of one book that share items, and how many: a join on equal items, one pair each.

    Its size is the number of such pairs. For what only needs to know which groups hang together use merged_groups().
    """
    m = members.select(within, group, item).dropDuplicates()
    l, r = m.withColumnRenamed(group, "left_id"), m.withColumnRenamed(group, "right_id")
    return l.join(r, [within, item]).where("left_id < right_id").groupBy(within, "left_id", "right_id").agg(F.count(F.lit(1)).alias("n_shared"))


def merged_groups(members: DataFrame, group: str = "unit_id", item: str = "entity_id") -> DataFrame:
    """group, merged: the smallest group that each hangs together with over shared items. Items tie to their smallest group, so no pairs are made."""
    m = members.select(group, item).dropDuplicates()
    least = m.groupBy(item).agg(F.min(group).alias("least_"))
    edges = m.join(least, item).select(F.col(group).alias("a"), F.col("least_").alias("b")).dropDuplicates()
    found = components(edges).select(F.col("node").alias(group), F.col("component").alias("merged"))
    return m.select(group).dropDuplicates().join(found, group, "left").select(group, F.coalesce("merged", group).alias("merged"))


def conflict_labels(conflicts: DataFrame, tables: Mapping[str, DataFrame], missing: str = "unknown") -> DataFrame:
    """Conflicts (conflict_id, left_type, left_id, right_type, right_id) with a label for each side, from tables of (id, label) by type."""
    named = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("type"), "id", "label") for kind, df in tables.items()])
    out = conflicts
    for side in ("left", "right"):
        n = named.select(F.col("type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"))
        out = out.join(n, [f"{side}_type", f"{side}_id"], "left").withColumn(f"{side}_label", F.coalesce(f"{side}_label", F.lit(missing)))
    return out


def merged_maps(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """(key, name, value): attribute maps in JSON laid over each other, the value of the latest row for each name; broken JSON is no map."""
    maps = rows.select(key, order, F.explode(F.from_json(column, "map<string,string>")).alias("name", "value"))
    return maps.groupBy(key, "name").agg(F.max_by("value", order).alias("value"))


def joined_roles(rows: DataFrame, key: Sequence[str], role: str = "role", order: str = "ordinal", glue: str = ", ") -> DataFrame:
    """Roles of each key in order, without those that the text so far holds already."""
    first = rows.groupBy(*key, role).agg(F.min(order).alias("o_"))
    listed = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o_", role))).alias("r_"))
    joined = F.aggregate("r_", F.lit(""), lambda s, x: F.when(s == "", x[role]).when(F.contains(s, x[role]), s).otherwise(F.concat(s, F.lit(glue), x[role])))
    return listed.select(*key, joined.alias("roles"))


def cluster_status(rows: DataFrame, cluster: str = "cluster_id", status: str = "status") -> DataFrame:
    """The last status of each cluster in alphabetical order."""
    return rows.groupBy(cluster).agg(F.max(status).alias(status))


def first_visits(steps: DataFrame, key: str = "subject", place: str = "place", at: str = "at") -> DataFrame:
    """(key, place, first_at, visit): each place once, in the order of the first visits."""
    first = steps.where(F.col(place).isNotNull()).groupBy(key, place).agg(F.min(at).alias("first_at"))
    return first.withColumn("visit", F.row_number().over(Window.partitionBy(key).orderBy("first_at", place)))


def by_rank(rows: DataFrame, group: str, column: str, ranks: Sequence[str], *then: Column) -> DataFrame:
    """Rows with `pos` in their group: the values of `column` in the order of `ranks`, others after them, null last of all; then by `then`."""
    place = reduce(lambda c, kv: c.when(F.col(column) == kv[1], kv[0]), enumerate(ranks[1:], 1), F.when(F.col(column) == ranks[0], 0)).otherwise(len(ranks))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(F.col(column).isNull(), place, *then)))


def tail(items: Column, k: int) -> Column:
    """The last k of an array, or all."""
    return F.slice(items, F.greatest(F.size(items) - k + 1, F.lit(1)), k)


def bounded(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def library(books: DataFrame, counts: Mapping[str, DataFrame], folder: str = "folder") -> DataFrame:
    """Books (book_id, folder, title, updated) with how many rows each table of (book_id) holds, and their place in the folder."""
    out = books
    for name, df in counts.items():
        out = out.join(df.groupBy("book_id").agg(F.count(F.lit(1)).alias(name)), "book_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(folder).orderBy(F.col("updated").isNull(), F.desc("updated"), "title", "book_id")))


def evidence_chain(concepts: DataFrame, links: DataFrame, claims: DataFrame, evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Each concept with its claims, their quotes and the segments these lie in, down five left joins; counts are zero where a chain ends.

    concepts: concept_id, parent_id. links: concept_id, claim_id. claims: claim_id, confidence. evidence: claim_id,
    segment_id. segments: segment_id, book_id.
    """
    rows = concepts.select("concept_id", "parent_id").join(links, "concept_id", "left").join(claims, "claim_id", "left").join(evidence, "claim_id", "left").join(segments, "segment_id", "left")
    got = rows.groupBy("concept_id", "parent_id").agg(F.countDistinct("claim_id").alias("n_claims"), F.countDistinct("segment_id").alias("n_segments"), F.countDistinct("book_id").alias("n_books"), F.max("confidence").alias("confidence"))
    up = concepts.select(F.col("concept_id").alias("parent_id"), F.col("label").alias("parent"))
    return got.join(up, "parent_id", "left").drop("parent_id")
