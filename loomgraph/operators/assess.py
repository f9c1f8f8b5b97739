"""Assessment: gates, mined cases, provider reports, forecasts, updates applied, repairs, capsules and snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.repair import content_digest

#: Fixed values of forecasts: samples that count, least samples, largest cache share, ratios without samples (input median, its 90th percentile, output likewise).
RECENT, LEAST_SAMPLES, MOST_CACHED, COLD = 400, 3, 0.95, (1.8, 3.2, 0.42, 1.05)
#: Fixed values of budgets: head room, and what no limit may exceed.
HEADROOM, HARD_USD, HARD_TOKENS_IN, HARD_TOKENS_OUT = 1.2, 1000.0, 500_000_000, 100_000_000


def standing(rows: DataFrame, statuses: Sequence[str] | None = None, hidden: Sequence[str] = ("rejected",), status: str = "status", archived: str | None = None) -> DataFrame:
    """Rows of the wanted statuses (None: any) that aren't hidden or archived; a null status hides nothing."""
    ok = ~F.coalesce(F.col(status).isin(*hidden), F.lit(False))
    if statuses is not None:
        ok = ok & F.col(status).isin(*statuses)
    return rows.where(ok & F.col(archived).isNull() if archived else ok)


def eligible(routes: DataFrame, health: DataFrame, now: Column, failures: int = 3) -> DataFrame:
    """Routes (provider, enabled, eligible) that may be used: enabled, allowed, and not resting after failures in a row."""
    h = health.select("provider", "n_in_row", "rests_until")
    rests = F.coalesce((F.col("n_in_row") >= failures) & (F.col("rests_until") > now), F.lit(False))
    return routes.join(h, "provider", "left").where(F.col("enabled") & F.col("eligible") & ~rests).select("provider")


def race(calls: DataFrame, failures: int = 3) -> DataFrame:
    """provider, n_calls, success_pct, median_ms, cost_per_ok, in_race: the report of a race between providers.

    calls: provider, ok, ms, cost. A provider that never succeeded in `failures` calls is out.
    """
    n, good = F.count(F.lit(1)), F.count_if("ok")
    got = calls.groupBy("provider").agg(n.alias("n_calls"), F.round(good / n * 100, 2).alias("success_pct"), F.round(F.median(F.when(F.col("ok"), F.col("ms"))), 3).alias("median_ms"), F.round(F.when(good > 0, F.sum("cost") / good), 6).alias("cost_per_ok"))
    return got.withColumn("in_race", (F.col("success_pct") > 0) | (F.col("n_calls") < failures))


def gates(m: DataFrame) -> DataFrame:
    """book_id, gate, open: the gates of each book's counts.

    m: book_id, n_events, n_edges, n_places, n_place_edges, n_pending, n_nodes, n_connected, n_isolated, n_unresolved,
    n_facts, n_evidenced, n_conflicts, n_cases, n_passed, n_critical_failed.
    """
    c = F.col
    dense = (c("n_events") < 5) | (c("n_edges") * 4 >= c("n_events"))
    placed = (c("n_places") < 2) | (c("n_place_edges") > 0)
    told = (c("n_pending") == 0) & (c("n_connected") + c("n_isolated") == c("n_nodes")) & (c("n_unresolved") == 0)
    accurate = (c("n_cases") >= 20) & (c("n_passed") * 100 >= c("n_cases") * 95) & (c("n_critical_failed") == 0)
    each = {"structure": dense & placed & told, "evidence": c("n_evidenced") == c("n_facts"), "conflicts": c("n_conflicts") == 0, "accuracy": accurate}
    return m.select("book_id", F.inline(F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(v, F.lit(False)).alias("open")) for k, v in each.items()])))


def scan_states(nodes: DataFrame, edges: DataFrame, scans: DataFrame, n_segments: int) -> DataFrame:
    """node, state: connected; else what the scans of as many segments say: isolated, or ambiguous if they differ; else pending.

    edges: a, b. scans: node, verdict, n_segments, any number a node.
    """
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).dropDuplicates().withColumn("linked_", F.lit(True))
    said = scans.where(F.col("n_segments") == n_segments).groupBy("node").agg(F.min("verdict").alias("v_"), (F.min("verdict") != F.max("verdict")).alias("differ_"))
    rows = nodes.select("node").join(ends, "node", "left").join(said, "node", "left")
    return rows.select("node", F.when(F.col("linked_"), "connected").when(F.col("differ_"), "ambiguous").otherwise(F.coalesce("v_", F.lit("pending"))).alias("state"))


def mined_cases(aliases: DataFrame, events: DataFrame, quotes: DataFrame, n_aliases: int = 40, n_events: int = 48, per_target: int = 2) -> DataFrame:
    """book_id, case_key, case_type, n_quotes: candidates for gold cases, each with `per_target` quotes of a target at most.

    The first aliases as identities, the first events as present, each of those with the next as an order, and three
    checks of integrity a book. aliases: book_id, entity_id, alias. events: book_id, event_id, ordinal. quotes: target
    (such as event:7), quote.
    """
    top = lambda df, n, *o: df.withColumn("k_", F.row_number().over(Window.partitionBy("book_id").orderBy(*o))).where(F.col("k_") <= n)
    a = top(aliases, n_aliases, "entity_id", "alias").select("book_id", F.concat_ws(":", F.lit("identity"), "entity_id", "alias").alias("case_key"), F.lit("identity_same").alias("case_type"), F.array(F.concat(F.lit("entity:"), "entity_id")).alias("targets"))
    e = top(events, n_events, "ordinal", "event_id").withColumn("next_", F.lead("event_id").over(Window.partitionBy("book_id").orderBy("ordinal", "event_id")))
    name = lambda c: F.concat(F.lit("event:"), c)
    present = e.select("book_id", F.concat(F.lit("present:"), "event_id").alias("case_key"), F.lit("event_present").alias("case_type"), F.array(name("event_id")).alias("targets"))
    order = e.where("next_ is not null").select("book_id", F.concat_ws(":", F.lit("order"), "event_id", "next_").alias("case_key"), F.lit("event_before").alias("case_type"), F.array(name("event_id"), name("next_")).alias("targets"))
    checks = events.select("book_id").dropDuplicates().select("book_id", F.explode(F.array(*map(F.lit, ("segment_accounting", "fact_evidence", "quote_integrity")))).alias("case_type"))
    checks = checks.select("book_id", F.col("case_type").alias("case_key"), "case_type", F.array().cast("array<string>").alias("targets"))
    cases = reduce(DataFrame.unionByName, (a, present, order, checks))
    have = quotes.dropDuplicates(["target", "quote"]).groupBy("target").agg(F.least(F.count(F.lit(1)), F.lit(per_target)).alias("q_"))
    found = cases.select("book_id", "case_key", F.explode("targets").alias("target")).join(have, "target").groupBy("book_id", "case_key").agg(F.sum("q_").alias("n_quotes"))
    return cases.drop("targets").join(found, ["book_id", "case_key"], "left").withColumn("n_quotes", F.coalesce("n_quotes", F.lit(0)))


def forecast(samples: DataFrame, remaining: DataFrame, key: str = "model") -> DataFrame:
    """key, n_samples, confidence, tokens_in, tokens_in_p90, tokens_out, tokens_out_p90, cached_share of what remains to be done.

    The RECENT last samples (key, at, chars, tokens_in, cached, tokens_out) of a key give median and 90th percentile of
    tokens a character, from LEAST_SAMPLES on; with fewer the ratios of COLD hold. remaining: key, chars.
    """
    w = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("chars"))
    s = samples.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= RECENT).where("chars > 0")
    i, o = F.col("tokens_in") / F.col("chars"), F.col("tokens_out") / F.col("chars")
    got = s.groupBy(key).agg(F.count(F.lit(1)).alias("n_"), *[f.alias(n) for n, f in (("i5", F.median(i)), ("i9", F.percentile(i, F.lit(0.9))), ("o5", F.median(o)), ("o9", F.percentile(o, F.lit(0.9))))], (F.sum("cached") / F.sum("tokens_in")).alias("c_"))
    rows = remaining.join(got, key, "left")
    n = F.coalesce("n_", F.lit(0))
    known = n >= LEAST_SAMPLES
    ratio = {c: F.when(known, F.col(c)).otherwise(F.lit(cold)) for c, cold in zip(("i5", "i9", "o5", "o9"), COLD, strict=True)}
    tokens = {name: F.ceil(F.round(F.col("chars") * ratio[c], 6)).cast("long") for name, c in (("tokens_in", "i5"), ("tokens_in_p90", "i9"), ("tokens_out", "o5"), ("tokens_out_p90", "o9"))}
    sure = F.when(n >= 40, "high").when(n >= 10, "medium").otherwise("low")
    share = F.when(known, F.least(F.coalesce("c_", F.lit(0.0)), F.lit(MOST_CACHED))).otherwise(0.0)
    return rows.select(key, n.alias("n_samples"), sure.alias("confidence"), *[c.alias(k) for k, c in tokens.items()], F.round(share, 6).alias("cached_share"))


def limits(usd: Column, tokens_in: Column, tokens_out: Column) -> dict[str, Column]:
    """Limits that a projected run may get: HEADROOM over it, within what no limit may exceed."""
    return {"limit_usd": F.round(F.least(usd * HEADROOM, F.lit(HARD_USD)), 4), "limit_in": F.least(F.ceil(tokens_in * HEADROOM), F.lit(HARD_TOKENS_IN)).cast("long"), "limit_out": F.least(F.ceil(tokens_out * HEADROOM), F.lit(HARD_TOKENS_OUT)).cast("long")}


def preview(old: DataFrame, new: DataFrame, mode: str = "auto") -> DataFrame:
    """book_id, mode, n_common, n_new, conflict: how a new text would be taken in, before anything is done.

    Both: book_id, ordinal, content_hash. auto appends if the old text is the beginning of the new one, else everything
    is compared. Appending chapters that are there already is a conflict.
    """
    both = old.select("book_id", "ordinal", F.col("content_hash").alias("o_")).join(new.select("book_id", "ordinal", F.col("content_hash").alias("n_")), ["book_id", "ordinal"], "full")
    differ = F.min(F.when(~F.col("o_").eqNullSafe(F.col("n_")), F.col("ordinal")))
    by = both.groupBy("book_id").agg(F.count("o_").alias("n_old"), F.count("n_").alias("n_new"), F.coalesce(differ, F.count(F.lit(1))).cast("long").alias("n_common"))
    again = new.join(old.select("book_id", "content_hash").dropDuplicates(), ["book_id", "content_hash"], "left_semi").groupBy("book_id").agg(F.count(F.lit(1)).alias("again_"))
    whole = F.col("n_common") >= F.col("n_old")
    how = F.when(whole, "append").otherwise("full") if mode == "auto" else F.lit(mode)
    twice = (F.lit(mode) == "append") & (F.coalesce("again_", F.lit(0)) > 0)
    return by.join(again, "book_id", "left").select("book_id", how.alias("mode"), "n_common", "n_new", twice.alias("conflict"))


def applied(changes: DataFrame, facts: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of facts and evidence once modified and removed chapters are taken out: evidence moves with its chapter.

    changes: book_id, old_ordinal, new_ordinal, change. facts: fact_id, book_id, created_by. evidence: fact_id, book_id,
    ordinal. Model facts that lose all evidence go, those of people stay; first_segment is the smallest place left.
    """
    kept = changes.where(F.col("change").isin("unchanged", "renamed", "reordered")).select("book_id", F.col("old_ordinal").alias("ordinal"), "new_ordinal")
    left = evidence.join(kept, ["book_id", "ordinal"]).select("fact_id", "book_id", F.col("new_ordinal").alias("ordinal"))
    at = left.groupBy("fact_id").agg(F.min("ordinal").alias("first_segment"), F.count(F.lit(1)).alias("n_evidence"))
    rows = facts.join(at, "fact_id", "left").where((F.col("created_by") != "model") | F.col("n_evidence").isNotNull())
    return rows.withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))), left


def requeued(jobs: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a restart: jobs that ran wait again, routes from a place to itself are dropped."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status"))), routes.where("from_id <> to_id")


def repointed(evidence: DataFrame, queue: DataFrame) -> DataFrame:
    """Evidence with the segment that its job was queued for; without such a job it stays where it is."""
    q = queue.groupBy("job_id").agg(F.max_by("segment_id", "queue_id").alias("to_"))
    return evidence.join(q, "job_id", "left").withColumn("segment_id", F.coalesce("to_", "segment_id")).drop("to_")


def last_parents(relations: DataFrame) -> DataFrame:
    """(node, parent) from relations (relation_id, kind, source, target): source inside target, or source contains target; the last one of a node wins."""
    inside = F.col("kind") == "inside"
    rows = relations.where(F.col("kind").isin("inside", "contains")).select("relation_id", F.when(inside, F.col("source")).otherwise(F.col("target")).alias("node"), F.when(inside, F.col("target")).otherwise(F.col("source")).alias("parent"))
    return rows.where("node <> parent").groupBy("node").agg(F.max_by("parent", "relation_id").alias("parent"))


def contained(parents: DataFrame, boxes: DataFrame) -> DataFrame:
    """(node, parent, holds): whether each node's box lies within its parent's. boxes: node, x0, y0, x1, y1; without both there is nothing to hold."""
    b = boxes.toDF("parent", "px0", "py0", "px1", "py1")
    rows = parents.join(boxes, "node", "left").join(b, "parent", "left")
    ok = (F.col("x0") >= F.col("px0")) & (F.col("y0") >= F.col("py0")) & (F.col("x1") <= F.col("px1")) & (F.col("y1") <= F.col("py1"))
    return rows.select("node", "parent", F.coalesce(ok, F.lit(False)).alias("holds"))


def map_snapshot(places: DataFrame, cached: DataFrame, book: str = "book_id") -> DataFrame:
    """book, n_places, bounds of the world, source_hash, current: whether the cached map (book, source_hash) is of these places."""
    bounds = places.groupBy(book).agg(F.count(F.lit(1)).alias("n_places"), *[f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))])
    digest = content_digest(places, book, ["place_id", "x", "y"]).select(book, F.col("digest").alias("source_hash"))
    was = cached.select(book, F.col("source_hash").alias("was_"))
    return bounds.join(digest, book).join(was, book, "left").withColumn("current", F.coalesce(F.col("was_") == F.col("source_hash"), F.lit(False))).drop("was_")


def suite_version(cases: DataFrame, suite: str = "suite") -> DataFrame:
    """suite, version: gold-<cases>-<digest> over the confirmed cases in the order of their ids."""
    got = cases.where("confirmed").groupBy(suite).agg(F.array_sort(F.collect_list(F.struct("case_id", "expected"))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["case_id"], x["expected"])), "\n")
    return got.select(suite, F.concat(F.lit("gold-"), F.size("c"), F.lit("-"), F.substring(F.sha2(body, 256), 1, 12)).alias("version"))


def main_subjects(scores: DataFrame, chosen: DataFrame, book: str = "book_id") -> DataFrame:
    """book, cluster_id: the protagonist that a person chose, else the highest score, then the earliest, then the smallest id."""
    best = scores.groupBy(book).agg(F.max_by("cluster_id", F.struct("score", -F.col("first_segment"), -F.col("cluster_id"))).alias("best_"))
    own = chosen.where("created_by <> 'auto'").groupBy(book).agg(F.min("cluster_id").alias("own_"))
    return best.join(own, book, "left").select(book, F.coalesce("own_", "best_").alias("cluster_id"))


def longest(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The longest text of each key; of equally long ones the first by `order`."""
    return rows.groupBy(key).agg(F.min_by(text, F.struct(-F.length(text), order)).alias(text))


def wrapped(text: Column, width: int, most: int = 3) -> Column:
    """Lines of `width` characters, `most` at most; the last one ends in an ellipsis if something is left out."""
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / width).cast("int") - 1, F.lit(0))), lambda i: F.substring(text, i * width + 1, F.lit(width)))
    cut = F.concat(F.slice(lines, 1, most - 1), F.array(F.concat(F.substring(F.element_at(lines, most), F.lit(1), F.lit(width - 1)), F.lit("…"))))
    return F.when(F.size(lines) <= most, lines).otherwise(cut)


def world_moves(units: DataFrame, moves: DataFrame) -> DataFrame:
    """units (unit_id, book_id, world) after moves (move_id, kind, unit_id or world, to): split puts a unit into a world of its own, merge puts a world into another, move a unit.

    Moves to worlds that the book doesn't have are left out; of several moves of a unit the last one counts; merges come
    after splits and moves. Worlds without units are gone by themselves.
    """
    worlds = units.select("book_id", F.col("world").alias("to")).dropDuplicates()
    one = moves.where("kind = 'split'").select("unit_id", "move_id", F.concat(F.lit("split-"), "unit_id").alias("to_"))
    there = moves.where("kind = 'move'").join(units.select("unit_id", "book_id"), "unit_id").join(worlds, ["book_id", "to"], "left_semi").select("unit_id", "move_id", F.col("to").alias("to_"))
    last = one.unionByName(there).groupBy("unit_id").agg(F.max_by("to_", "move_id").alias("to_"))
    placed = units.join(last, "unit_id", "left").select("unit_id", "book_id", F.coalesce("to_", "world").alias("world"))
    merged = moves.where("kind = 'merge'").select("world", "to", "move_id").join(worlds, "to", "left_semi").groupBy("world").agg(F.max_by("to", "move_id").alias("into_"))
    return placed.join(merged, "world", "left").select("unit_id", "book_id", F.coalesce("into_", "world").alias("world"))


def capsule(participants: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """event_id, n_claims, n_parallel, n_unexplained: what is known of an event's participants and place.

    participants: event_id, entity_id. claims: claim_id, entity_id, status, origin. evidence: claim_id. Accepted and
    parallel claims show; those from the text need evidence; an entity of the event without any claim is unexplained.
    """
    n = evidence.groupBy("claim_id").agg(F.count(F.lit(1)).alias("e_"))
    shown = claims.where(F.col("status").isin("accepted", "parallel")).join(n, "claim_id", "left").where("origin <> 'original_text' or e_ is not null")
    by = shown.groupBy("entity_id").agg(F.count(F.lit(1)).alias("c_"), F.count_if(F.col("status") == "parallel").alias("p_"))
    rows = participants.dropDuplicates(["event_id", "entity_id"]).join(by, "entity_id", "left")
    return rows.groupBy("event_id").agg(F.sum(F.coalesce("c_", F.lit(0))).alias("n_claims"), F.sum(F.coalesce("p_", F.lit(0))).alias("n_parallel"), F.count_if(F.col("c_").isNull()).alias("n_unexplained"))


def synced_concepts(sources: Mapping[str, DataFrame], categories: Sequence[str]) -> DataFrame:
    """category, label, n_sources, n_evidence, needs_classification: concepts from tables of (category, label, n_evidence), one for each (category, label).

    Unknown and null categories become 'other', to be classified; blank labels are left out.
    """
    rows = reduce(DataFrame.unionByName, [df.select("category", F.trim("label").alias("label"), "n_evidence", F.lit(name).alias("source")) for name, df in sources.items()]).where("label <> ''")
    known = F.coalesce(F.col("category").isin(*categories), F.lit(False))
    rows = rows.withColumn("needs_", ~known).withColumn("category", F.when(known, F.col("category")).otherwise("other"))
    return rows.groupBy("category", "label").agg(F.countDistinct("source").alias("n_sources"), F.sum("n_evidence").alias("n_evidence"), F.max("needs_").alias("needs_classification"))


def unique_facts(facts: DataFrame, keys: Sequence[str], evidence: DataFrame, fact: str = "fact_id") -> DataFrame:
    """Facts once for each key, the smallest id, with the evidence of all that say the same counted once for each segment."""
    kept = facts.withColumn("kept_", F.min(fact).over(Window.partitionBy(*keys)))
    n = evidence.join(kept.select(fact, "kept_"), fact).select(F.col("kept_").alias(fact), "segment_id").dropDuplicates().groupBy(fact).agg(F.count(F.lit(1)).alias("n_evidence"))
    return kept.where(F.col(fact) == F.col("kept_")).drop("kept_").join(n, fact, "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
