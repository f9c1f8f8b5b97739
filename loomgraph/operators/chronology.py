"""Story time: latest states, effective locations, journeys, islands, interval merging, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


def latest_state(events: DataFrame, key: str = "subject") -> DataFrame:
    """The last event of each subject by (ts, event_id): aggregated, not sorted."""
    best = F.max(F.struct("ts", "event_id", "kind", "value")).alias("m")
    return events.groupBy(key).agg(best).select(key, F.col("m.event_id").alias("event_id"), F.col("m.kind").alias("kind"), F.col("m.value").alias("value"))


def effective_location(events: DataFrame, key: str = "subject") -> DataFrame:
    """event_id, place, effective_place, status: explicit, inherited from the last placed event, or unresolved."""
    w = Window.partitionBy(key).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("place", ignorenulls=True).over(w)
    status = F.when(F.col("place").isNotNull(), "explicit").when(F.col("last_").isNotNull(), "inherited").otherwise("unresolved")
    return events.withColumn("last_", last).select(key, "event_id", "place", F.col("last_").alias("effective_place"), status.alias("status"))


def journeys(events: DataFrame, key: str = "subject") -> DataFrame:
    """Legs between consecutive placed events at different places; gap_status tells whether unplaced events lie between."""
    w = Window.partitionBy(key).orderBy(*ORDER)
    unplaced = F.sum(F.when(F.col("place").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = events.withColumn("gaps_", unplaced).where(F.col("place").isNotNull())
    legs = placed.withColumn("from_place", F.lag("place").over(w)).withColumn("between_", F.col("gaps_") - F.lag("gaps_").over(w))
    legs = legs.where(F.col("from_place").isNotNull() & (F.col("from_place") != F.col("place")))
    known = F.col("between_") == 0
    return legs.select(key, "event_id", "from_place", F.col("place").alias("to_place"), F.col("between_").cast("long").alias("n_between"), F.when(known, "direct").otherwise("unknown_path").alias("gap_status"), F.when(known, 0.95).otherwise(0.55).alias("confidence"))


def story_ranks(events: DataFrame, key: str = "subject") -> DataFrame:
    """Rank as told (by id) and as it happened (by time), from 0, and whether they differ."""
    told = F.row_number().over(Window.partitionBy(key).orderBy("event_id")) - 1
    happened = F.row_number().over(Window.partitionBy(key).orderBy(*ORDER)) - 1
    return events.select(key, "event_id", told.cast("long").alias("narrative_rank"), happened.cast("long").alias("story_rank")).withColumn("nonlinear", F.col("narrative_rank") != F.col("story_rank"))


def islands(events: DataFrame, boundary: Column, key: str = "subject") -> DataFrame:
    """Units between boundaries. boundary may use prev_ts, prev_kind and prev_place of the event before."""
    w = Window.partitionBy(key).orderBy(*ORDER)
    rows = events.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("ts", "kind", "place")})
    unit = F.sum(F.when(boundary, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("unit", unit.cast("long")).groupBy(key, "unit").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def merge_intervals(rows: DataFrame, key: str, start: str = "start", end: str = "end", width: float = 86_400_000_000) -> DataFrame:
    """Unions of overlapping or touching intervals of each key, with how many they hold.

    Intervals are merged among those that begin in one stretch of `width` first, in as many tasks as there are
    stretches; only the unions that are left then meet in the window over the whole key.
    """

    def merged(df: DataFrame, keys: list[str], n) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(start, end)
        reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("new_", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
        df = df.withColumn("group_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return df.groupBy(*keys, "group_").agg(F.min(start).alias(start), F.max(end).alias(end), n.alias("n")).drop("group_")

    parts = merged(rows.withColumn("stretch_", F.floor(F.col(start) / width)), [key, "stretch_"], F.count(F.lit(1)))
    return merged(parts.drop("stretch_"), [key], F.sum("n"))


def map_steps(events: DataFrame, legs: DataFrame, key: str = "subject") -> DataFrame:
    """The one sequence that all views read: every event in story order with its leg, if any."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*ORDER)) - 1
    where = F.when(F.col("place").isNull(), "unlocated").otherwise("located")
    steps = events.select(key, "event_id", at.cast("long").alias("canonical_index"), where.alias("location_state"))
    return steps.join(legs.select("event_id", "from_place", "to_place", "gap_status"), "event_id", "left")


def threads(events: DataFrame, opens: str, closes: str, key: str = "subject") -> DataFrame:
    """Open or resolved by the last opening or closing event of each subject."""
    last = F.max(F.struct("ts", "event_id", "kind"))
    opened = F.max(F.when(F.col("kind") == opens, F.struct("ts", "event_id")))
    rows = events.where(F.col("kind").isin(opens, closes)).groupBy(key).agg(last.alias("l"), opened.alias("o"))
    return rows.where(F.col("o").isNotNull()).select(key, F.when(F.col("l.kind") == opens, "open").otherwise("resolved").alias("status"), F.col("o.event_id").alias("opened_event"), F.when(F.col("l.kind") == closes, F.col("l.event_id")).alias("resolved_event"))


def character_states(events: DataFrame, key: str = "subject", last: int = 12) -> DataFrame:
    """Last event, last place and the last `last` event ids of each subject in story order.

    The ids come from a window that passes only the last rows on, so a subject with many events is not collected.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))
    tail = events.withColumn("back_", back).where(F.col("back_") <= last).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("t"))
    fold = events.groupBy(key).agg(F.max(F.struct("ts", "event_id")).alias("l"), F.max(F.when(F.col("place").isNotNull(), F.struct("ts", "event_id", "place"))).alias("p"), F.count(F.lit(1)).alias("n_events"))
    return fold.join(tail, key).select(key, "n_events", F.col("l.event_id").alias("through_event"), F.col("p.place").alias("last_place"), F.array_join(F.transform("t", lambda x: x["event_id"].cast("string")), ",").alias("recent_events"))


def in_units(events: DataFrame, units: DataFrame) -> DataFrame:
    """Events of each unit [first_day, last_day]: units are dealt out by day, so the join is on equal days."""
    days = units.select("unit_id", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return events.join(days, "day").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("subject").alias("n_subjects"))
