"""Narrative structure and memory: orders, causal links, explicit legs, units and worlds, states, arcs and contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.parsing import generic_title
from loomgraph.operators.scope import merged_groups, tail

#: Items that a memory holds at most: states, source events, scenes, threads, entities, events of a context, its characters.
STATES, SOURCES, SCENES, THREADS, ENTITIES, EVENTS, CONTEXT = 12, 24, 24, 20, 80, 16, 14_000
#: Confidence of a unit that begins at an explicit boundary, and of one that doesn't.
BOUNDED, WHOLE = 0.86, 0.72


def narrative_order(ordinal: Column, local: Column) -> Column:
    """Where an event is told: its segment, then its place there, of which the first hundred are told apart."""
    return (ordinal * 100 + F.least(local, F.lit(99))).cast("long")


def folded(rows: DataFrame, key: str, order: Sequence[str | Column], start: Callable[[], object], step: Callable, finish: Callable, schema: str) -> DataFrame:
    """One row for each key by a sequential fold over its rows in order.

    Rows are dealt out and sorted by Spark and stream through; a task holds one key's state, however many rows the key has.
    step(state, row) returns the state, finish(key, state) the values of a row of `schema`.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, held = None, None, False
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k = getattr(r, key)
                if not held or (k != now and (k == k or now == now)):  # nulls are one key, as elsewhere in SQL
                    if held:
                        out.append(finish(now, state))
                    now, state, held = k, start(), True
                state = step(state, r)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([finish(now, state)], columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def causal_links(pending: DataFrame, events: DataFrame) -> DataFrame:
    """book_id, source_id, target_id, relation, confidence: the latest other event of the wanted title; links whose quote isn't held are left out.

    pending: book_id, source_id, target_title, relation, confidence, holds. events: book_id, event_id, title,
    story_order. Of equal (source, target, relation) the most confident stays. Two candidates a title are enough.
    """
    w = Window.partitionBy("book_id", "title").orderBy(F.desc("story_order"), F.desc("event_id"))
    last = events.withColumn("k_", F.row_number().over(w)).where("k_ <= 2").groupBy("book_id", "title").agg(F.max(F.when(F.col("k_") == 1, F.col("event_id"))).alias("first_"), F.max(F.when(F.col("k_") == 2, F.col("event_id"))).alias("second_"))
    met = pending.where("holds").join(last.withColumnRenamed("title", "target_title"), ["book_id", "target_title"])
    target = F.when(F.col("first_") != F.col("source_id"), F.col("first_")).otherwise(F.col("second_"))
    return met.withColumn("target_id", target).where("target_id is not null").groupBy("book_id", "source_id", "target_id", "relation").agg(F.max("confidence").alias("confidence"))


def explicit_legs(routes: DataFrame, names: DataFrame) -> DataFrame:
    """book_id, subject_id, from_id, to_id, route_id, leg: consecutive different places of each told route, for each of its subjects.

    routes: route_id, book_id, subjects and places (arrays of names), holds. names: book_id, name, entity_id. A route of
    one place is a leg from there to there. Routes with an unknown place, without a known subject or without their quote
    are left out; unknown subjects are.
    """
    there = F.filter("places", lambda x: x.isNotNull() & (x != ""))
    rows = routes.where("holds").withColumn("all_", there)
    steps = F.filter(F.transform("all_", lambda x, i: F.when((i == 0) | (x != F.element_at("all_", F.greatest(i, F.lit(1)))), x)), lambda x: x.isNotNull())
    rows = rows.withColumn("steps_", steps).where("size(steps_) > 0")
    stops = rows.select("route_id", "book_id", F.size("steps_").alias("n_"), F.posexplode("steps_").alias("at_", "name")).join(names, ["book_id", "name"])
    known = stops.groupBy("route_id", "book_id", "n_").agg(F.array_sort(F.collect_list(F.struct("at_", "entity_id"))).alias("p_")).where("size(p_) = n_")
    ids = F.transform("p_", lambda x: x["entity_id"])
    ends = F.when(F.col("n_") == 1, F.concat(ids, ids)).otherwise(ids)
    legs = known.withColumn("e_", ends).select("route_id", "book_id", "e_", F.explode(F.sequence(F.lit(1), F.size("e_") - 1)).alias("leg"))
    legs = legs.select("route_id", "book_id", F.element_at("e_", F.col("leg")).alias("from_id"), F.element_at("e_", F.col("leg") + 1).alias("to_id"), "leg")
    who = rows.select("route_id", "book_id", F.explode("subjects").alias("name")).join(names, ["book_id", "name"]).select("route_id", F.col("entity_id").alias("subject_id")).dropDuplicates()
    return legs.join(who, "route_id").select("book_id", "subject_id", "from_id", "to_id", "route_id", "leg")


def units(segments: DataFrame, members: DataFrame) -> DataFrame:
    """book_id, ordinal, unit_id (the ordinal of the unit's first segment): a unit begins where a title of its own meets disjoint entities.

    segments: book_id, ordinal, title. members: book_id, ordinal, entity_id. Without entities on either side there is no
    boundary.
    """
    sets = members.groupBy("book_id", "ordinal").agg(F.collect_set("entity_id").alias("set_"))
    rows = segments.join(sets, ["book_id", "ordinal"], "left")
    w = Window.partitionBy("book_id").orderBy("ordinal")
    last = F.lag("set_").over(w)
    apart = (F.size("set_") > 0) & (F.size("last_") > 0) & ~F.arrays_overlap("set_", "last_")
    rows = rows.withColumn("last_", last).withColumn("begins_", F.coalesce(apart, F.lit(False)) & ~generic_title(F.col("title")))
    first = F.min("ordinal").over(Window.partitionBy("book_id"))
    begin = F.last(F.when(F.col("begins_"), F.col("ordinal")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("book_id", "ordinal", F.coalesce(begin, first).alias("unit_id"))


def unit_specs(segments: DataFrame, members: DataFrame) -> DataFrame:
    """book_id, unit_id, title, first, last, confidence, world: units with their worlds, a world being units that hang together over shared entities."""
    placed = units(segments, members)
    key = F.concat_ws(":", "book_id", F.lpad(F.col("unit_id").cast("string"), 12, "0"))
    inside = members.join(placed, ["book_id", "ordinal"]).select(key.alias("unit"), F.concat_ws(":", "book_id", "entity_id").alias("entity"))
    worlds = merged_groups(inside, "unit", "entity")
    spans = placed.groupBy("book_id", "unit_id").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).withColumn("unit", key)
    title = segments.select("book_id", F.col("ordinal").alias("unit_id"), "title")
    got = spans.join(title, ["book_id", "unit_id"]).join(worlds, "unit", "left").withColumn("world", F.coalesce("merged", "unit"))
    start = F.min("unit_id").over(Window.partitionBy("book_id"))
    return got.select("book_id", "unit_id", "title", "first", "last", F.when(F.col("unit_id") == start, WHOLE).otherwise(BOUNDED).alias("confidence"), "world")


def states(events: DataFrame, key: str = "subject", opening: Callable[[list], list] = list) -> DataFrame:
    """key, through_event, place, goal, states, source_events: what is known of each subject after its last event, in story order.

    events: key, event_id, story_order (null: last), place, goal, changes (array; nulls count for nothing). The last place
    and goal that were said stay; of the changes the last STATES different ones, of the events the last SOURCES. Of events
    without a subject only the first counts, as others may be another's. opening: the order in which the changes of a
    subject's first event are kept; it decides which are forgotten first.
    """

    def step(s, r):
        k, first = getattr(r, key), not s["events"]
        if not first and (k is None or k != k):
            return s
        said = [c for c in r.changes if c is not None] if r.changes is not None else []
        have = s["states"]
        for c in opening(said) if first else said:
            if c not in have:
                have.append(c)
        goal = r.goal if isinstance(r.goal, str) and (r.goal or first) else s["goal"]
        return {"through": r.event_id, "place": s["place"] if pd.isna(r.place) else r.place, "goal": goal, "states": have[-STATES:], "events": [*s["events"], int(r.event_id)][-SOURCES:]}

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "event_id", "story_order", "place", "goal", "changes")
    order = [F.col("story_order").asc_nulls_last(), "event_id"]
    return folded(rows, key, order, lambda: {"place": None, "goal": None, "states": [], "events": [], "through": None}, step, lambda k, s: (k, s["through"], s["place"], s["goal"], s["states"], s["events"]), f"{key} {kind}, through_event long, place string, goal string, states array<string>, source_events array<long>")


def threads(events: DataFrame, book: str = "book_id") -> DataFrame:
    """book, thread, status, opened_event, resolved_event: by the last word on each; opening it again starts anew.

    events: book, event_id, story_order, opened and resolved (arrays of titles). Of one event what it opens comes first.
    """
    said = events.select(book, "event_id", "story_order", F.explode("opened").alias("thread"), F.lit(0).alias("closes")).unionByName(events.select(book, "event_id", "story_order", F.explode("resolved").alias("thread"), F.lit(1).alias("closes")))
    at = F.struct("story_order", "event_id", "closes")
    opened = F.max(F.when(F.col("closes") == 0, at))
    got = said.groupBy(book, "thread").agg(F.max(at).alias("l"), opened.alias("o"), F.max(F.when(F.col("closes") == 1, at)).alias("c"))
    over = F.col("l.closes") == 1
    return got.select(book, "thread", F.when(over, "resolved").otherwise("open").alias("status"), F.col("o.event_id").alias("opened_event"), F.when(over, F.col("c.event_id")).alias("resolved_event"))


def arcs(events: DataFrame, book: str = "book_id") -> DataFrame:
    """book, ordinal, n_events, source_hash of each chapter: the digest of its event ids in story order tells whether its summary still stands."""
    w = events.groupBy(book, "ordinal").agg(F.array_sort(F.collect_list(F.struct("story_order", "event_id"))).alias("e"))
    ids = F.array_join(F.transform("e", lambda x: x["event_id"].cast("string")), ", ")
    return w.select(book, "ordinal", F.size("e").cast("long").alias("n_events"), F.sha2(F.concat(F.lit("["), ids, F.lit("]")), 256).alias("source_hash"))


def bounded_memory(events: DataFrame, links: DataFrame, through: int, book: str = "book_id") -> DataFrame:
    """book, section, id: the last SCENES events up to a segment, and the links of which both ends are told by then."""
    seen = events.where(F.col("ordinal") <= through)
    w = Window.partitionBy(book).orderBy(F.desc("story_order"), F.desc("event_id"))
    scenes = seen.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= SCENES).select(book, F.lit("scene").alias("section"), F.col("event_id").cast("string").alias("id"))
    ids = seen.select(book, F.col("event_id"))
    both = links.join(ids.withColumnRenamed("event_id", "source_id"), [book, "source_id"], "left_semi").join(ids.withColumnRenamed("event_id", "target_id"), [book, "target_id"], "left_semi")
    return scenes.unionByName(both.select(book, F.lit("link").alias("section"), F.concat_ws(">", "source_id", "target_id").alias("id")))


def context(entities: DataFrame, events: DataFrame, ordinal: int, book: str = "book_id") -> DataFrame:
    """book, context: what a model may be told before a segment, CONTEXT characters at most.

    The ENTITIES most important entities (name, kind, importance, first_segment), the last EVENTS events (title,
    story_order, event_id, ordinal) as they were told, and the last THREADS open threads (opened, resolved) of those;
    nothing from the segment on.
    """
    e = entities.where(F.col("first_segment") < ordinal).withColumn("k_", F.row_number().over(Window.partitionBy(book).orderBy(F.desc("importance"), "first_segment", "name"))).where(F.col("k_") <= ENTITIES)
    known = e.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("k_", F.concat_ws("|", "kind", "name").alias("line")))).alias("k"))
    v = events.where(F.col("ordinal") < ordinal).withColumn("k_", F.row_number().over(Window.partitionBy(book).orderBy(F.desc("ordinal"), F.desc("event_id")))).where(F.col("k_") <= EVENTS)
    told = v.groupBy(book).agg(F.array_sort(F.collect_list(F.struct((-F.col("k_")).alias("o"), "title", "opened", "resolved"))).alias("v"))
    flat = lambda c: F.flatten(F.transform("v", lambda x: F.coalesce(x[c], F.array().cast("array<string>"))))
    open_ = tail(F.array_except(F.array_distinct(flat("opened")), flat("resolved")), THREADS)
    lines = lambda head, items: F.concat(F.array(F.lit(head)), F.when(F.size(items) > 0, items).otherwise(F.array(F.lit("-"))))
    none = F.array().cast("array<string>")
    rows = known.join(told, book, "full").select(book, F.coalesce(F.transform("k", lambda x: x["line"]), none).alias("k"), F.coalesce(F.transform("v", lambda x: x["title"]), none).alias("t"), F.coalesce(open_, none).alias("o"))
    return rows.select(book, F.substring(F.array_join(F.concat(lines("entities:", F.col("k")), lines("scenes:", F.col("t")), lines("open threads:", F.col("o"))), "\n"), 1, CONTEXT).alias("context"))
