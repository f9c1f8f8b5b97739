"""Curation: evidence trails, visible claims, merged attributes, correction logs, reviews, gates and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drill_down(facts: DataFrame, evidence: DataFrame, results: DataFrame) -> DataFrame:
    """Each fact (target_type, target_id) with its evidence and how much of it is traced to a run.

    evidence: target_type, target_id, segment_id, run_id (null if not recorded; then that of the segment's latest
    result). results: segment_id, at, run_id. trace_status: none, complete, or legacy where a run is missing.
    """
    latest = results.groupBy("segment_id").agg(F.max(F.struct("at", "run_id")).alias("m")).select("segment_id", F.col("m.run_id").alias("late_"))
    traced = evidence.join(latest, "segment_id", "left").withColumn("run_id", F.coalesce("run_id", "late_"))
    sums = traced.groupBy("target_type", "target_id").agg(F.count(F.lit(1)).alias("n"), F.count("run_id").alias("t"))
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("t", F.lit(0))
    status = F.when(n == 0, "none").when(n == t, "complete").otherwise("legacy")
    return facts.select("target_type", "target_id").join(sums, ["target_type", "target_id"], "left").select("target_type", "target_id", n.alias("n_evidence"), t.alias("n_traced"), status.alias("trace_status"))


def claim_context(claims: DataFrame, evidence: DataFrame, progress: int) -> DataFrame:
    """Claims that a reader at `progress` sees, with the evidence seen so far; those from the text need some.

    claims: claim_id, origin, first_segment. evidence: claim_id, segment. Only evidence up to `progress` counts.
    """
    seen = evidence.where(F.col("segment") <= progress).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    rows = claims.where(F.col("first_segment") <= progress).join(seen, "claim_id", "left").withColumn("n_evidence", F.coalesce("n", F.lit(0)))
    return rows.where((F.col("origin") != "original_text") | (F.col("n_evidence") > 0)).select("claim_id", "origin", "n_evidence")


def visible_notes(notes: DataFrame, covers: DataFrame, progress: int) -> DataFrame:
    """Notes up to `progress`, without raw ones that a visible synthesis covers.

    notes: note_id, origin, first_segment. covers: raw_id, synthesis_id.
    """
    shown = notes.where(F.col("first_segment") <= progress)
    synthesis = shown.where("origin = 'synthesis'").select(F.col("note_id").alias("synthesis_id"))
    hidden = covers.join(synthesis, "synthesis_id", "left_semi").select(F.col("raw_id").alias("note_id"))
    return shown.join(hidden, "note_id", "left_anti")


def effective(rows: DataFrame, at: Column, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Rows in force at a time; without an end they stay so."""
    return rows.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at)))


def merge_attributes(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row per cluster: canonical name (most important, then earliest, then smallest id), the others as aliases.

    members: cluster, entity_id, name, importance, first_segment, n_evidence, summary. The longest summary stays, of
    equally long ones the smallest.
    """
    lead = F.max_by("name", F.struct("importance", -F.col("first_segment"), -F.col("entity_id")))
    text = F.min_by("summary", F.struct(-F.length("summary"), "summary"))
    got = members.groupBy(cluster).agg(
        lead.alias("name"), F.max("importance").alias("importance"), F.min("first_segment").alias("first_segment"), F.sum("n_evidence").alias("n_evidence"), F.collect_set("name").alias("names_"), text.alias("summary")
    )
    return got.withColumn("aliases", F.array_join(F.array_sort(F.array_except("names_", F.array("name"))), "; ")).drop("names_")


def adjacent_pairs(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Each event with the one that follows it: candidates for questions about what came first."""
    follow = F.lead("event_id").over(Window.partitionBy(key).orderBy(*order))
    return events.select(key, F.col("event_id").alias("earlier"), follow.alias("later")).where("later is not null")


def parts(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """key, order, part, n_parts: consecutive rows of each key in parts of `size`."""
    w = Window.partitionBy(key)
    part = F.floor((F.row_number().over(w.orderBy(order)) - 1) / size) + 1
    return rows.select(key, order, part.cast("long").alias("part"), F.ceil(F.count(F.lit(1)).over(w) / size).cast("long").alias("n_parts"))


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The correction log between two versions of a table: one row for each field that differs."""
    o = old.select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields])
    n = new.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old_value"), F.col(f"n_{f}").alias("new_value")) for f in fields])
    return o.join(n, key).select(key, F.inline(each)).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def undoable(decisions: DataFrame, moves: DataFrame) -> DataFrame:
    """Merges, and whether they can be undone: no later decision has moved a member that they moved.

    decisions: decision_id. moves: decision_id, entity_id.
    """
    last = moves.groupBy("entity_id").agg(F.max("decision_id").alias("last_"))
    touched = moves.join(last, "entity_id").groupBy("decision_id").agg(F.max(F.col("last_") > F.col("decision_id")).alias("later_"))
    return decisions.select("decision_id").join(touched, "decision_id", "left").select("decision_id", (~F.coalesce("later_", F.lit(False))).alias("can_undo"))


def closed(items: DataFrame) -> DataFrame:
    """What is left open is closed without asserting anything: pairs stay apart, contradictions and edges don't hold."""
    to = F.when((F.col("kind") == "merge") & (F.col("status") == "needs_review"), "auto_separate")
    to = to.when((F.col("kind") == "contradiction") & (F.col("status") == "open"), "auto_quarantined")
    to = to.when((F.col("kind") == "time") & (F.col("status") == "conflict"), "auto_rejected")
    return items.withColumn("status", F.coalesce(to, F.col("status")))


def connectivity(nodes: DataFrame, edges: DataFrame, reviews: DataFrame, n_segments: int) -> DataFrame:
    """node, state: connected, else the last review's verdict if it saw as many segments, else pending.

    edges: a, b. reviews: node, verdict, n_segments (one row for each node).
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).dropDuplicates().withColumn("linked_", F.lit(True))
    rows = nodes.select("node").join(ends, "node", "left").join(reviews.withColumnRenamed("n_segments", "saw_"), "node", "left")
    state = F.when(F.col("linked_"), "connected").when(F.col("saw_") == n_segments, F.col("verdict")).otherwise("pending")
    return rows.select("node", state.alias("state"))


def provider_health(calls: DataFrame, failures: int = 3, pause: str = "INTERVAL 30 MINUTES") -> DataFrame:
    """By provider: calls, failures, failures in a row at the end, and until when it rests if those are too many.

    calls: provider, at, call_id, ok. The trailing run is counted against the last success, so nothing is sorted.
    """
    good = calls.where("ok").groupBy("provider").agg(F.max(F.struct("at", "call_id")).alias("good_"))
    c = calls.join(good, "provider", "left")
    trailing = ~F.col("ok") & (F.col("good_").isNull() | (F.struct("at", "call_id") > F.col("good_")))
    got = c.groupBy("provider").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(~F.col("ok")).alias("n_failed"), F.count_if(trailing).alias("n_in_row"), F.max("at").alias("last_"))
    return got.select("provider", "n_calls", "n_failed", "n_in_row", F.when(F.col("n_in_row") >= failures, F.col("last_") + F.expr(pause)).alias("rests_until"))


def job_rollup(jobs: DataFrame, calls: DataFrame) -> DataFrame:
    """By job: calls, tokens and cost. The calls' own cost counts if every call has one, else the job's estimate."""
    sums = calls.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("tokens"), F.count("cost").alias("priced_"), F.sum("cost").alias("cost_"))
    j = jobs.select("job_id", "estimate").join(sums, "job_id", "left")
    own = (F.col("n_calls") > 0) & (F.col("priced_") == F.col("n_calls"))
    return j.select("job_id", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.when(own, F.col("cost_")).otherwise(F.col("estimate")), 8).alias("cost"))


def backtest(samples: DataFrame, key: str, order: list[str], predictor: str, actual: str, calibrate: int = 10, most: int = 50, allowed: float = 0.25) -> DataFrame:
    """Of the oldest `most` samples of each key the first `calibrate` give a median ratio that the rest are held against."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = samples.withColumn("at_", at).where(F.col("at_") <= most).withColumn("r_", F.col(actual) / F.when(F.col(predictor) != 0, F.col(predictor)))
    early = rows.where(F.col("at_") <= calibrate).groupBy(key).agg(F.median("r_").alias("ratio"))
    late = rows.where(F.col("at_") > calibrate).groupBy(key).agg(F.sum(predictor).alias("p_"), F.sum(actual).alias("a_"), F.count(F.lit(1)).alias("n_held_out"))
    error = F.abs(F.col("p_") * F.col("ratio") - F.col("a_")) / F.when(F.col("a_") != 0, F.col("a_"))
    return late.join(early, key).select(key, "n_held_out", F.round("ratio", 6).alias("ratio"), F.round(error, 6).alias("error"), (error <= allowed).alias("holds"))


def release_gate(cases: DataFrame, least: int = 300, books: int = 12, per_book: int = 25, held_out: float = 0.2, accuracy: float = 0.95) -> DataFrame:
    """One row: counts, smallest book, held-out share and accuracy, and whether all of them reach what is required.

    cases: book_id, passed, held_out (booleans). Counted by book first, so one shuffled row stands for each book.
    """
    by = cases.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("held_out").alias("h"), F.count_if(F.col("held_out") & F.col("passed")).alias("ok"))
    n, h = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("h"), F.lit(0))
    one = by.agg(n.alias("n_cases"), F.count(F.lit(1)).alias("n_books"), F.coalesce(F.min("n"), F.lit(0)).alias("least_per_book"), F.round(F.when(n > 0, h / n), 6).alias("held_out_share"), F.round(F.when(h > 0, F.sum("ok") / h), 6).alias("held_out_accuracy"))
    c = F.col
    opens = (c("n_cases") >= least) & (c("n_books") >= books) & (c("least_per_book") >= per_book) & (c("held_out_share") >= held_out) & (c("held_out_accuracy") >= accuracy)
    return one.withColumn("gate_open", F.coalesce(opens, F.lit(False)))


def reference_edges(mentions: DataFrame, events: DataFrame) -> DataFrame:
    """earlier, later from an event's words about another: the latest event of that title, itself excepted.

    mentions: book_id, event_id, title, relation (before, after; others give no edge). events: book_id, event_id, title.
    The two latest of a title are enough to step over the event itself.
    """
    e = events.groupBy("book_id", "title").agg(F.slice(F.reverse(F.array_sort(F.collect_set("event_id"))), 1, 2).alias("late_"))
    m = mentions.where(F.col("relation").isin("before", "after")).join(e, ["book_id", "title"])
    other = F.get(F.filter("late_", lambda x: x != F.col("event_id")), F.lit(0))
    first = F.col("relation") == "before"
    m = m.withColumn("other_", other).where("other_ is not null")
    return m.select("book_id", F.when(first, F.col("event_id")).otherwise(F.col("other_")).alias("earlier"), F.when(first, F.col("other_")).otherwise(F.col("event_id")).alias("later"))


def missing_places(named: DataFrame, known: DataFrame) -> DataFrame:
    """Places that relations, events or legs name without a record: added once each, at their first position."""
    rows = named.where("name is not null and trim(name) <> ''").groupBy("book_id", "name").agg(F.min("segment").alias("first_segment"))
    return rows.join(known.select("book_id", "name"), ["book_id", "name"], "left_anti").withColumn("importance", F.lit(0.65))
