"""Facts kept over time: keyed entities, candidates, rewired merges, gated edits, revisions, prices, tasks and cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.parsing import holds_quote
from loomgraph.operators.resolve import verdicts

#: Confidence of candidates that share their own name's key, or another name's.
SAME_NAME, SHARED_NAME = 0.999, 0.75
FACT_TYPES = ("entity", "claim", "place_relation", "event", "journey_leg", "world_note", "entry")


def upserted_entities(known: DataFrame, found: DataFrame) -> DataFrame:
    """book_id, kind, key, entity_id, name, importance, first_segment, summary: known entities and found ones, one for each (book, kind, key).

    The largest importance and the first segment count; the first of the longest summaries does, unless a person wrote
    the known one. Both: book_id, kind, key, name, importance, first_segment, summary; known also entity_id, created_by;
    found also seq, its order. New entities have no id yet. Empty keys are left out.
    """
    cols = ["book_id", "kind", "key", "name", "importance", "first_segment", "summary"]
    k = known.select(*cols, "entity_id", "created_by", (F.col("entity_id") - F.lit(1 << 62)).alias("seq"))  # known ones come first, by id
    f = found.select(*cols, F.lit(None).cast("long").alias("entity_id"), F.lit("model").alias("created_by"), F.col("seq").cast("long").alias("seq"))
    longest = F.min_by("summary", F.struct(-F.length("summary"), "seq"))
    kept = F.max(F.when(F.col("created_by") != "model", F.col("summary")))
    got = k.unionByName(f).where("key <> ''").groupBy("book_id", "kind", "key").agg(
        F.min("entity_id").alias("entity_id"), F.min_by("name", "seq").alias("name"), F.max("importance").alias("importance"), F.min("first_segment").alias("first_segment"), F.coalesce(kept, longest).alias("summary")
    )
    return got


def candidates(entities: DataFrame, aliases: DataFrame, generic: DataFrame) -> DataFrame:
    """left_id, right_id, reason, confidence: entities that share a key with its owner; none for generic names.

    entities: book_id, kind, entity_id, key, first_segment. aliases: entity_id, key. generic: key (a configured list,
    broadcast by Spark while it is small). A key's owner is the first entity of that name, else the first that has it as
    another name; pairs are made with the owner only, so a common name makes as many rows as it has holders.
    """
    own = entities.select("book_id", "kind", "key", "entity_id", "first_segment", F.lit(0).alias("other"))
    also = entities.select("book_id", "kind", "entity_id", "first_segment").join(aliases.join(generic, "key", "left_anti"), "entity_id").select("book_id", "kind", "key", "entity_id", "first_segment", F.lit(1).alias("other"))
    names = own.unionByName(also).where("key <> ''")
    owner = names.groupBy("book_id", "kind", "key").agg(F.min(F.struct("other", "first_segment", "entity_id")).alias("o"))
    pairs = names.join(owner, ["book_id", "kind", "key"]).where("entity_id <> o.entity_id")
    pairs = pairs.select(F.least("entity_id", "o.entity_id").alias("left_id"), F.greatest("entity_id", "o.entity_id").alias("right_id"), F.when((F.col("other") == 0) & (F.col("o.other") == 0), "name").otherwise("alias").alias("reason"))
    return pairs.dropDuplicates().withColumn("confidence", F.when(F.col("reason") == "name", SAME_NAME).otherwise(SHARED_NAME))


def decisions(found: DataFrame, entities: DataFrame, conflicts: DataFrame) -> DataFrame:
    """left_id, right_id, reasons, verdict, confidence, keep_id: one decision for each pair, however many candidates name it.

    entities: entity_id, kind, summary, importance, first_segment. conflicts: left_id, right_id. A pair of different
    kinds conflicts too. Of a merged pair the more important entity stays, then the earlier, then the smaller id.
    """
    pairs = found.groupBy("left_id", "right_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"), F.max("confidence").alias("confidence"))
    side = lambda s: entities.select(F.col("entity_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("kind", "summary", "importance", "first_segment")])
    rows = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    rows = rows.join(conflicts.select("left_id", "right_id", F.lit(True).alias("c_")).dropDuplicates(), ["left_id", "right_id"], "left")
    rows = rows.withColumns({"conflict": F.coalesce("c_", F.lit(False)) | (F.col("left_kind") != F.col("right_kind")), "same_key": F.contains("reasons", F.lit("name")), "shared_alias": F.contains("reasons", F.lit("alias"))})
    rank = lambda s: F.struct(F.col(f"{s}_importance"), -F.col(f"{s}_first_segment"), -F.col(f"{s}_id"))
    keep = F.when(F.col("verdict") == "merge", F.when(rank("left") >= rank("right"), F.col("left_id")).otherwise(F.col("right_id")))
    return verdicts(rows).select("left_id", "right_id", "reasons", "verdict", F.col("verdict_confidence").alias("confidence"), keep.alias("keep_id"))


def rewired(facts: DataFrame, ends: Sequence[str], mapping: DataFrame, same: Sequence[str] = (), loops: bool = True, fact: str = "fact_id") -> DataFrame:
    """Facts with their ends moved to the entities that stay, and `kept_id`: the fact that each is now the same as (the smallest id).

    mapping: remove_id, keep_id, already final. loops=False drops facts whose ends fall together, as a place near itself.
    """
    out = facts
    for c in ends:
        m = mapping.select(F.col("remove_id").alias(c), F.col("keep_id").alias("to_"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce("to_", c)).drop("to_")
    if not loops:
        out = out.where(F.col(ends[0]) != F.col(ends[1]))
    return out.withColumn("kept_id", F.min(fact).over(Window.partitionBy(*ends, *same)))


def moved_evidence(evidence: DataFrame, facts: DataFrame, fact: str = "fact_id") -> DataFrame:
    """Evidence of rewired facts at the facts that stay, each (fact, segment, quote) once; that of dropped facts goes."""
    return evidence.join(facts.select(fact, "kept_id"), fact).select(F.col("kept_id").alias(fact), "segment_id", "quote").dropDuplicates()


def linked_notes(raw: DataFrame, syntheses: DataFrame) -> DataFrame:
    """note_id, synthesis_id: the first synthesis of the same category and topic by (confidence, larger first; id).

    raw: note_id, category, topic. syntheses: synthesis_id, category, topic, confidence.
    """
    best = syntheses.groupBy("category", "topic").agg(F.max_by("synthesis_id", F.struct("confidence", -F.col("synthesis_id"))).alias("synthesis_id"))
    return raw.join(best, ["category", "topic"]).select("note_id", "synthesis_id")


def gated(edits: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits that may be applied and the others: one that claims to come from the text needs its quote in the chosen segment of its book.

    edits: book_id, segment_id, origin, quote. segments: segment_id, book_id, text.
    """
    s = segments.select("segment_id", "book_id", F.col("text").alias("text_"))
    rows = edits.join(s, ["book_id", "segment_id"], "left").withColumn("holds_", holds_quote(F.col("text_"), F.col("quote"))).drop("text_")
    ok = F.col("holds_") | (F.col("origin") != "original_text")
    return rows.where(ok).drop("holds_"), rows.where(~ok).drop("holds_")


def revisions(log: DataFrame, key: str = "fact_id", at: str = "at") -> DataFrame:
    """The log with `revision` from 1 and `current`: every edit of a fact is a revision, the last one is what readers see."""
    w = Window.partitionBy(key)
    return log.withColumn("revision", F.row_number().over(w.orderBy(at, "edit_id"))).withColumn("current", F.col("revision") == F.count(F.lit(1)).over(w))


def synthesis(notes: DataFrame, basis: DataFrame, facts: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Syntheses with their first segment, which is the LAST of their basis, and the evidence that they inherit from it.

    notes: synthesis_id. basis: synthesis_id, fact_id. facts: fact_id, first_segment. evidence: fact_id, segment_id.
    """
    at = basis.join(facts, "fact_id").groupBy("synthesis_id").agg(F.max("first_segment").alias("first_segment"), F.count(F.lit(1)).alias("n_basis"))
    inherited = basis.join(evidence, "fact_id").select("synthesis_id", "segment_id").dropDuplicates()
    return notes.join(at, "synthesis_id"), inherited


def prompts(rules: DataFrame, bundle: str = "bundle") -> DataFrame:
    """bundle, prompt, prompt_hash, n_rules: the active rules of a bundle, by priority, then id, and the digest that results refer to."""
    got = rules.where("active").groupBy(bundle).agg(F.array_sort(F.collect_list(F.struct("priority", "rule_id", "text"))).alias("r"))
    return got.select(bundle, F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("prompt"), F.size("r").cast("long").alias("n_rules")).withColumn("prompt_hash", F.sha2("prompt", 256))


def prices(usage: DataFrame, table: DataFrame) -> DataFrame:
    """usage (provider, model, at) with the price in force: the model's last one by then, else its provider's (model '*'), else null.

    table: provider, model, from_at, price; null prices count for nothing, of prices from one time the highest does. Each
    different (provider, model, at) is priced once, by one pass over its key's times and prices in order: no use meets a
    price but its own.
    """
    cols = ["provider", "model", "at"]
    listed = table.where("provider is not null and model is not null and from_at is not null and price is not null").select("provider", "model", F.col("from_at").alias("at"), F.col("price").alias("p_"))

    def priced(points: DataFrame, by: DataFrame, keys: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("at", "asks_", "p_").rowsBetween(Window.unboundedPreceding, 0)
        rows = points.withColumn("asks_", F.lit(1)).unionByName(by.withColumn("asks_", F.lit(0)), allowMissingColumns=True)
        return rows.withColumn(name, F.last("p_", ignorenulls=True).over(w)).where("asks_ = 1").drop("asks_", "p_")

    points = priced(usage.select(*cols).dropDuplicates(), listed, ["provider", "model"], "own_")
    points = priced(points, listed.where("model = '*'").drop("model"), ["provider"], "any_")
    points = points.select(*[F.col(c).alias(f"{c}_") for c in cols], F.coalesce("own_", "any_").alias("price"))
    return usage.join(points, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in cols]), "left").drop(*[f"{c}_" for c in cols])


def resolved_updates(proposals: DataFrame, books: DataFrame) -> DataFrame:
    """proposal_id, action, book_id, title: what becomes of each proposed new text of a book.

    proposals: proposal_id, book_id, choice (keep, apply, import), content_hash, title. books: book_id, content_hash,
    title. Importing what is there already points to it; a title that is taken gets a number.
    """
    same = books.groupBy("content_hash").agg(F.min("book_id").alias("there_"))
    taken = books.groupBy("title").agg(F.count(F.lit(1)).alias("n_"))
    rows = proposals.join(same, "content_hash", "left").join(taken, "title", "left")
    new = F.col("choice") == "import"
    action = F.when(~new, F.col("choice")).when(F.col("there_").isNotNull(), "duplicate").otherwise("import")
    book = F.when(~new, F.col("book_id")).otherwise(F.col("there_"))
    title = F.when((action == "import") & F.col("n_").isNotNull(), F.concat("title", F.lit(" ("), (F.col("n_") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return rows.select("proposal_id", action.alias("action"), book.alias("book_id"), title.alias("title"))


def halved(batches: DataFrame, most: int, batch: str = "batch_id", sizes: str = "sizes") -> DataFrame:
    """batch, part, n, size, state: batches too large for one answer are halved until they fit; a single target that doesn't is ambiguous."""
    kind = batches.schema[batch].dataType.simpleString()

    def run(parts):
        for b in parts:
            out = []
            for key, all_ in zip(b[batch], b[sizes], strict=True):
                todo = [list(all_)]
                k = 0
                while todo:
                    one = todo.pop(0)
                    if sum(one) <= most or len(one) == 1:
                        out.append((key, k, len(one), int(sum(one)), "sent" if sum(one) <= most else "ambiguous"))
                        k += 1
                    elif one:
                        cut = len(one) // 2
                        todo[:0] = [one[:cut], one[cut:]]
            yield pd.DataFrame(out, columns=[batch, "part", "n", "size", "state"])

    return batches.select(batch, sizes).mapInPandas(run, f"{batch} {kind}, part long, n long, size long, state string")


def gold_hash(book: Column, segment: Column, text: Column, expected: Column) -> Column:
    """What a gold case's evidence was: changes with the segment's text or the expected answer."""
    return F.sha2(F.concat_ws("\x1f", book.cast("string"), segment.cast("string"), text, expected), 256)


def gold_cases(cases: DataFrame, log: DataFrame, now: DataFrame) -> DataFrame:
    """case_id, status, stale: the last word on each candidate (proposed without any), and whether its evidence has changed since.

    cases: case_id, evidence_hash. log: case_id, at, status. now: case_id, evidence_hash.
    """
    last = log.groupBy("case_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    n = now.select("case_id", F.col("evidence_hash").alias("now_"))
    return cases.join(last, "case_id", "left").join(n, "case_id", "left").select("case_id", F.coalesce("status", F.lit("proposed")).alias("status"), (~F.col("evidence_hash").eqNullSafe(F.col("now_"))).alias("stale"))


def systems(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """system, node_id, rank, pos, n_relations, comparable: nodes in use, ranked ones first, and whether a system's are all ranked.

    nodes: system, node_id, rank, status, holds. relations: source_id, target_id, status. Nodes need their quote held;
    archived and deprecated ones, and relations that touch them, are out.
    """
    out = ("archived", "deprecated")
    n = nodes.where(F.col("holds") & ~F.col("status").isin(*out)).select("system", "node_id", "rank")
    r = relations.where(~F.col("status").isin(*out))
    ids = n.select("node_id")
    r = r.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    ends = r.select(F.col("source_id").alias("node_id")).unionAll(r.select("target_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("system")
    rows = n.join(ends, "node_id", "left").withColumn("n_relations", F.coalesce("n", F.lit(0)))
    pos = F.row_number().over(w.orderBy(F.col("rank").isNull(), "rank", "node_id"))
    return rows.select("system", "node_id", "rank", pos.alias("pos"), "n_relations", (F.count("rank").over(w) == F.count(F.lit(1)).over(w)).alias("comparable"))


def review_tasks(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """task_key, category, severity of all open findings. sources: by category a frame of (id, status) and the severity."""
    parts = [df.where(F.col("status").isin("unreviewed", "needs_review", "pending", "unresolved", "ambiguous", "conflict")).select(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("task_key"), F.lit(name).alias("category"), F.lit(severity).alias("severity")) for name, (df, severity) in sources.items()]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["task_key"])


def case_results(cases: DataFrame, names: DataFrame, events: DataFrame, subjects: DataFrame, legs: DataFrame, accounting: DataFrame) -> DataFrame:
    """case_id, case_type, passed of every gold case, of nine types, each by a join.

    cases: case_id, book_id, case_type, left, right (names or titles), most (a segment or a percentage). names: book_id,
    name, cluster_id. events: book_id, event_id, title, ordinal, rank. subjects: book_id, cluster_id (the main one).
    legs: book_id, first_segment. accounting: book_id, and segment_accounting, fact_evidence, quote_integrity (per cent).
    """
    of = lambda side: names.groupBy("book_id", F.col("name").alias(side)).agg(F.collect_set("cluster_id").alias(f"{side}_c"))
    rows = cases.join(of("left"), ["book_id", "left"], "left").join(of("right"), ["book_id", "right"], "left")
    shared = F.coalesce(F.arrays_overlap("left_c", "right_c"), F.lit(False))
    both = F.col("left_c").isNotNull() & F.col("right_c").isNotNull()
    title = lambda side: events.groupBy("book_id", F.col("title").alias(side)).agg(F.min("rank").alias(f"{side}_r"), F.min("ordinal").alias(f"{side}_o"))
    rows = rows.join(title("left"), ["book_id", "left"], "left").join(title("right"), ["book_id", "right"], "left")
    rows = rows.join(subjects.groupBy("book_id").agg(F.min("cluster_id").alias("main_")), "book_id", "left").join(legs.groupBy("book_id").agg(F.min("first_segment").alias("leg_")), "book_id", "left").join(accounting, "book_id", "left")
    kind = F.col("case_type")
    passed = (
        F.when(kind == "identity_same", shared).when(kind == "identity_distinct", both & ~shared)
        .when(kind == "event_present", F.col("left_o") <= F.col("most")).when(kind == "event_before", F.col("left_r") < F.col("right_r"))
        .when(kind == "main_subject", F.array_contains("left_c", F.col("main_"))).when(kind == "journey_start", F.col("leg_") <= F.col("most"))
        .when(kind == "segment_accounting", F.col("segment_accounting") >= F.col("most")).when(kind == "fact_evidence", F.col("fact_evidence") >= F.col("most"))
        .when(kind == "quote_integrity", F.col("quote_integrity") >= F.col("most"))
    )
    return rows.select("case_id", "case_type", F.coalesce(passed, F.lit(False)).alias("passed"))
