"""Repairs and their bookkeeping: facts mined by patterns, places found again, evidence moved, verdicts, digests.

Null texts and names match nothing; rows with a null key take part in no join; repeated rows count once unless said
otherwise; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import SEPARATOR
from loomgraph.operators.graph import cut


def kin_claims(entities: DataFrame, persons: DataFrame, pattern: str, owner: int = 1, kin: int = 2) -> DataFrame:
    """Claims from names that say whose kin an entity is: source (the owner), target, predicate, confidence.

    entities, persons: entity_id, name. owner, kin: groups of the pattern. An owner's name must be one person's only,
    and nobody is their own kin.
    """
    named = entities.select(F.col("entity_id").alias("target"), F.regexp_extract("name", pattern, owner).alias("owner"), F.regexp_extract("name", pattern, kin).alias("predicate")).where("owner <> '' and predicate <> ''")
    sole = persons.where("name is not null").groupBy(F.col("name").alias("owner")).agg(F.min("entity_id").alias("source"), F.max("entity_id").alias("other")).where("source = other")
    return named.join(sole, "owner").where("source <> target").select("source", "target", "predicate", F.lit(0.98).alias("confidence")).dropDuplicates()


def said_relations(segments: DataFrame, pattern: str, source: int, predicate: int, target: int, known: DataFrame) -> DataFrame:
    """Relations that texts state in words, each with its first segment, how often it is said, and which ends are new.

    segments: segment, text. known: name. An end that isn't known has to be created before the claim.
    """
    said = segments.select("segment", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("said"))
    part = said.select("segment", *[F.regexp_extract("said", pattern, g).alias(n) for n, g in (("source", source), ("predicate", predicate), ("target", target))])
    sums = part.where("source <> target").groupBy("source", "predicate", "target").agg(F.min("segment").alias("first_segment"), F.count(F.lit(1)).alias("n_evidence"))
    names = known.select("name").where("name is not null").dropDuplicates()
    for end in ("source", "target"):
        marked = names.select(F.col("name").alias(end), F.lit(False).alias(f"new_{end}"))
        sums = sums.join(marked, end, "left").withColumn(f"new_{end}", F.coalesce(f"new_{end}", F.lit(True)))
    return sums.select("source", "predicate", "target", "first_segment", "n_evidence", "new_source", "new_target")


def sole_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of those keys that have one distinct value: an event whose words name a single place lies there."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("other_")).where(F.col(value) == F.col("other_")).drop("other_")


def scenes(quotes: DataFrame, key: str, text: str, pattern: str, group: int = 1) -> DataFrame:
    """key, place: where a key's quotes name by the pattern one place only, upper and lower case alike."""
    found = quotes.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("place"))
    return sole_value(found.withColumn("place", F.lower("place")), key, "place")


def repaired_locations(candidates: DataFrame, canonical: DataFrame) -> DataFrame:
    """event_id, place, basis: what titles name goes before what quotes name; either must come to one canonical place.

    candidates: event_id, place, titled (boolean). canonical: place, canonical_place.
    """
    m = canonical.select("place", "canonical_place").dropDuplicates(["place"])
    rows = candidates.join(m, "place", "left").select("event_id", F.coalesce("canonical_place", "place").alias("p"), "titled").where("p is not null")
    sides = [x for name, on in (("title", F.col("titled")), ("quote", ~F.col("titled"))) for x in (F.min(F.when(on, F.col("p"))).alias(f"{name}_low"), F.max(F.when(on, F.col("p"))).alias(f"{name}_high"))]
    basis = F.when(F.col("title_low").isNotNull(), "title").otherwise("quote")
    got = rows.groupBy("event_id").agg(*sides).withColumn("basis", basis)
    low, high = F.coalesce("title_low", "quote_low"), F.when(F.col("basis") == "title", F.col("title_high")).otherwise(F.col("quote_high"))
    return got.where(low == high).select("event_id", low.alias("place"), "basis")


def moved(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows with `column` led to where mapping (old, new) says; what then repeats stays once."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("new_")).dropDuplicates([column])
    return rows.join(m, column, "left").withColumn(column, F.coalesce("new_", column)).select(*rows.columns).dropDuplicates()


def mention_windows(hits: DataFrame, around: int = 240, least: int = 2) -> DataFrame:
    """segment, start, end, n_targets: stretches of text around mentions, joined where they touch, with enough targets.

    hits: segment, target, start, end, length (of the segment). A segment's hits are sorted by one task, which spills.
    """
    h = hits.select("segment", "target", F.greatest(F.col("start") - around, F.lit(0)).alias("s"), F.least(F.col("end") + around, F.col("length")).alias("e"))
    w = Window.partitionBy("segment").orderBy("s", "e", "target")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("new_", F.when(before >= F.col("s"), 0).otherwise(1)).withColumn("at_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return h.groupBy("segment", "at_").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.countDistinct("target").alias("n_targets")).where(F.col("n_targets") >= least).drop("at_")


def audited(verdicts: DataFrame, key: str = "node") -> DataFrame:
    """One state for the parts that a node was audited in: key, state, confidence, n_parts.

    verdicts: key, verdict (related, isolated, unclear or null for a part without an answer), confidence. One related
    part connects the node; else an unanswered part keeps it pending; it is isolated only if all parts say so.
    """
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    n, related, isolated, missing = F.count(F.lit(1)), is_("related"), is_("isolated"), F.count_if(F.col("verdict").isNull())
    state = F.when(related > 0, "connected").when(missing > 0, "pending").when(isolated == n, "isolated").otherwise("ambiguous")
    sure = F.when(related > 0, F.max(F.when(F.col("verdict") == "related", F.col("confidence")))).otherwise(F.min("confidence"))
    return verdicts.groupBy(key).agg(state.alias("state"), sure.alias("confidence"), n.alias("n_parts"))


def suites(cases: DataFrame) -> DataFrame:
    """suite, n_cases, n_confirmed, n_held_out, accuracy (of confirmed cases, in percent; null without any)."""
    sure = F.col("status") == "confirmed"
    n = F.count_if(sure)
    return cases.groupBy("suite").agg(F.count(F.lit(1)).alias("n_cases"), n.alias("n_confirmed"), F.count_if(F.col("held_out")).alias("n_held_out"), F.when(n > 0, F.round(F.count_if(sure & F.col("passed")) / n * 100, 1)).alias("accuracy"))


def first_per_key(hits: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each key (the report's length)."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")).where(F.col("rank") <= most)


def reparented(units: DataFrame, worlds: DataFrame, moves: DataFrame) -> DataFrame:
    """unit, world after moves into worlds that exist. Worlds left without a unit are absent from the result.

    units: unit, world. worlds: world. moves: unit, to_world, at; of several moves of a unit the last valid one counts.
    """
    valid = moves.join(worlds.select(F.col("world").alias("to_world")).dropDuplicates(), "to_world", "left_semi")
    last = valid.groupBy("unit").agg(F.max(F.struct("at", "to_world")).alias("m")).select("unit", F.col("m.to_world").alias("to_"))
    return units.join(last, "unit", "left").select("unit", F.coalesce("to_", "world").alias("world"))


def settled(decisions: DataFrame, states: Mapping[str, str], key: str, order: str, decision: str) -> DataFrame:
    """key, status: what the latest known decision makes of a conflict; without one it is open."""
    to = F.coalesce(*[F.when(F.col(decision) == k, v) for k, v in states.items()], F.lit(None).cast("string"))
    got = decisions.withColumn("to_", to).groupBy(key).agg(F.max(F.when(F.col("to_").isNotNull(), F.struct(order, "to_"))).alias("m"))
    return got.select(key, F.coalesce("m.to_", F.lit("open")).alias("status"))


def numbered_titles(books: DataFrame, folder: str, title: str, order: str) -> DataFrame:
    """books with shown_title: the second and later books of one title in a folder bear a number."""
    n = F.row_number().over(Window.partitionBy(folder, title).orderBy(order))
    return books.withColumn("n_", n).withColumn("shown_title", F.when(F.col("n_") == 1, F.col(title)).otherwise(F.concat(title, F.lit(" ("), F.col("n_"), F.lit(")")))).drop("n_")


def content_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, n_rows, digest: by which a derived view is known to be current.

    The digest adds up hashes of rows, so their order doesn't matter and no group is collected; repeated rows count.
    """
    row = F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(n.alias("n_rows"), F.sha2(F.concat(n.cast("string"), F.lit(":"), F.sum(part).cast("string")), 256).alias("digest"))


def cyclic_moves(parents: DataFrame, moves: DataFrame, most_depth: int = 1000) -> DataFrame:
    """moves (move_id, folder, new_parent) that would put a folder under itself or its own descendant.

    parents: folder, parent (null at the top). Only the moves climb, one join a level, until all are at the top or
    go round in a loop that was there before. Raises an error if folders lie more than `most_depth` deep.
    """
    at = moves.select("move_id", "folder", F.col("new_parent").alias("at"), F.array("new_parent").alias("path"))
    up = parents.where("parent is not null").select(F.col("folder").alias("at"), F.col("parent").alias("next"))
    bad = at.where("at = folder").select("move_id")
    for _ in range(most_depth):
        step = at.where("at <> folder").join(up, "at").where(~F.array_contains("path", F.col("next")))
        at = cut(step.select("move_id", "folder", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")))
        if at.isEmpty():
            break
        bad = bad.unionByName(at.where("at = folder").select("move_id"))
    else:
        raise ValueError(f"folders lie more than {most_depth} deep")
    return moves.join(bad.dropDuplicates(), "move_id", "left_semi")


def best_segments(hits: DataFrame, key: str, segment: str) -> DataFrame:
    """key, segment, n_hits: the segment that holds most of a key's quotes; of equal ones the smallest."""
    n = hits.groupBy(key, segment).agg(F.count(F.lit(1)).alias("n_hits"))
    best = n.groupBy(key).agg(F.max(F.struct("n_hits", (-F.col(segment)).alias("s"))).alias("b"))
    return best.select(key, (-F.col("b.s")).alias(segment), F.col("b.n_hits").alias("n_hits"))


def hidden(rows: DataFrame, when: Column, columns: list[str]) -> DataFrame:
    """rows with `columns` null where `when` holds: answers of sealed cases aren't shown."""
    return rows.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in columns})
