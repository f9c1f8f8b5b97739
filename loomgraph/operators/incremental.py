"""Incremental updates: which chapters changed, what must be analysed again, where facts are anchored now."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan(old: DataFrame, new: DataFrame, book: str = "book_id") -> DataFrame:
    """book, old_ordinal, new_ordinal, change: unchanged, renamed, reordered, modified, removed or inserted.

    Equal bodies are matched first, the k-th of one side with the k-th of the other in order of position, by title if
    titles agree; what is left on both sides is matched by title, then told apart as inserted or removed. A null title
    or hash equals none. Both sides: book, ordinal, title, content_hash. Both are dealt out by book once, which serves
    all windows; no side is joined.
    """
    cols = [book, "ordinal", "title", "content_hash"]
    rows = old.select(*cols, F.lit(0).alias("side")).unionByName(new.select(*cols, F.lit(1).alias("side"))).repartition(book)
    rows = rows.withColumn("step", F.lit(None).cast("string")).withColumn("other", F.lit(None).cast("long"))

    def match(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        free = F.col("step").isNull()
        for c in keys:
            free = free & F.col(c).isNotNull()
        df = df.withColumn("free", free)
        df = df.withColumn("k", F.row_number().over(Window.partitionBy(book, *keys, "free", "side").orderBy("ordinal")))
        both = Window.partitionBy(book, *keys, "free", "k")
        df = df.withColumn("n", F.count(F.lit(1)).over(both)).withColumn("total", F.sum("ordinal").over(both))
        met = F.col("free") & (F.col("n") == 2)
        return df.withColumn("other", F.when(met, F.col("total") - F.col("ordinal")).otherwise(F.col("other"))).withColumn("step", F.when(met, name).otherwise(F.col("step")))

    rows = match(match(match(rows, ["content_hash", "title"], "same"), ["content_hash"], "renamed"), ["title"], "modified")
    rows = rows.where("side = 1 or step is null").withColumn("found", F.col("step").isNotNull())
    here, there = F.col("ordinal").cast("long"), F.col("other").cast("long")
    rows = rows.withColumn("old_ordinal", F.when(F.col("side") == 0, here).otherwise(there)).withColumn("new_ordinal", F.when(F.col("side") == 1, here))
    each = Window.partitionBy(book, "found")
    moved = F.row_number().over(each.orderBy("old_ordinal")) != F.row_number().over(each.orderBy("new_ordinal"))
    rows = rows.withColumn("moved", moved)
    lone = F.when(F.col("side") == 0, "removed").otherwise("inserted")
    change = F.when(~F.col("found"), lone).when(F.col("step") != "same", F.col("step")).when(F.col("moved"), "reordered").otherwise("unchanged")
    return rows.select(book, "old_ordinal", "new_ordinal", change.alias("change"))


def alike_titles(changes: DataFrame, old: DataFrame, new: DataFrame, book: str = "book_id", least: float = 0.68) -> DataFrame:
    """changes, with removed and inserted chapters of a book paired as modified where their titles are alike.

    In old order each removed chapter takes the most alike inserted one that is free, the first of equals. Only what
    plan() left unmatched is compared, within a book, so one task holds the leftovers of a book alone.
    """
    gone = changes.where("change = 'removed'").join(old.select(book, F.col("ordinal").alias("old_ordinal"), "title"), [book, "old_ordinal"]).select(book, F.col("old_ordinal").alias("at"), "title")
    come = changes.where("change = 'inserted'").join(new.select(book, F.col("ordinal").alias("new_ordinal"), "title"), [book, "new_ordinal"]).select(book, F.col("new_ordinal").alias("at"), "title")
    gone, come = gone.toDF(book, "at", "title"), come.toDF(book, "at", "title")

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free, out = dict(sorted(zip(b["at"].tolist(), b["title"].tolist(), strict=True))), []
        for at, title in sorted(zip(a["at"].tolist(), a["title"].tolist(), strict=True)):
            best, score = None, least
            matcher = SequenceMatcher(None, autojunk=False)
            matcher.set_seq2(title or "")
            for k, t in free.items():
                matcher.set_seq1(t or "")
                if title and t and matcher.real_quick_ratio() >= score and (r := matcher.ratio()) >= score and (best is None or r > score):
                    best, score = k, r
            if best is not None:
                del free[best]
                out.append((at, best))
        return pd.DataFrame({book: [a[book].iloc[0]] * len(out) if len(a) else [], "old_": [x for x, _ in out], "new_": [y for _, y in out]})

    kind = changes.schema[book].dataType.simpleString()
    pairs = gone.groupBy(book).cogroup(come.groupBy(book)).applyInPandas(pair, f"{book} {kind}, old_ long, new_ long")
    rows = changes.join(pairs.select(book, F.col("old_").alias("old_ordinal"), "new_"), [book, "old_ordinal"], "left")
    rows = rows.join(pairs.select(book, F.col("new_").alias("new_ordinal"), F.lit(True).alias("taken_")), [book, "new_ordinal"], "left").where("not (change = 'inserted' and taken_ is not null)")
    hit = F.col("new_").isNotNull()
    return rows.select(book, "old_ordinal", F.when(hit, F.col("new_")).otherwise(F.col("new_ordinal")).alias("new_ordinal"), F.when(hit, "modified").otherwise(F.col("change")).alias("change"))


def reuse_ratio(changes: DataFrame, book: str = "book_id") -> DataFrame:
    """Share of the new chapters whose results can be kept."""
    kept = F.sum(F.when(F.col("change").isin("unchanged", "renamed", "reordered"), 1).otherwise(0))
    now = F.sum(F.when(F.col("new_ordinal").isNotNull(), 1).otherwise(0))
    return changes.groupBy(book).agg(kept.alias("n_reused"), now.alias("n_new"), F.when(now > 0, F.round(kept / now, 4)).alias("reuse_ratio"))


def common_prefix(old: DataFrame, new: DataFrame, book: str = "book_id") -> DataFrame:
    """How many chapters at the beginning of each book are equal."""
    both = old.select(book, "ordinal", F.col("content_hash").alias("a")).join(new.select(book, "ordinal", F.col("content_hash").alias("b")), [book, "ordinal"], "full")
    differ = F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("ordinal")))
    return both.groupBy(book).agg(F.coalesce(differ, F.count(F.lit(1))).cast("long").alias("n_common"))


def neighbours(rows: DataFrame, changed: Column, book: str, ordinal: str) -> DataFrame:
    """Changed positions and those next to them, as far as they exist."""
    near = rows.where(changed).select(book, F.explode(F.array(*[F.col(ordinal) + d for d in (-1, 0, 1)])).alias(ordinal)).dropDuplicates()
    return rows.select(book, ordinal).dropDuplicates().join(near, [book, ordinal], "left_semi")


def reanchor(evidence: DataFrame, fact: str, ordinal: str) -> DataFrame:
    """first_segment of each fact: the smallest position of its evidence."""
    return evidence.groupBy(fact).agg(F.min(ordinal).alias("first_segment"), F.count(F.lit(1)).alias("n_evidence"))


def sync_tasks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Review tasks by task_key: new ones open, known ones keep their status, vanished ones close by themselves."""
    o, n = old.select("task_key", F.col("status").alias("was")), new.select("task_key", "severity").withColumn("here", F.lit(True))
    status = F.when(F.col("here").isNull(), "auto_closed").when(F.col("was").isNull() | (F.col("was") == "auto_closed"), "open").otherwise(F.col("was"))
    return o.join(n, "task_key", "full").select("task_key", "severity", status.alias("status"))
