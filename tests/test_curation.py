"""Curation, layout, topics and sinks on small rows, odd ones included."""

import math

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions import topics
from loomgraph.operators import curation, evidence, layout
from loomgraph.sources import sinks


def test_mentions_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa ab"), (2, None), (3, "")], "doc_id long, text string")
    names = spark.createDataFrame([("aa",), ("ab",), ("aa",), (None,), ("",), ("zz",)], "name string")
    got = {r.name: (r.n_segments, r.n_mentions) for r in evidence.mentions(docs, names).collect()}
    assert got == {"aa": (1, 2), "ab": (1, 1), "zz": (0, 0)}


def test_layout_keeps_places_apart_and_repeats():
    springs = np.array([(k, k + 1) for k in range(39)])
    a, b = layout.positions(40, springs), layout.positions(40, springs)
    d = np.hypot(*(a[:, None] - a[None]).T)[np.triu_indices(40, 1)]
    assert (a == b).all() and np.isfinite(a).all() and d.min() >= layout.APART - 1


def test_pairs_are_those_of_brute_force(monkeypatch):
    x, y = np.random.default_rng(3).normal(0, 700, (2, 900))
    far = np.hypot(x[:, None] - x, y[:, None] - y)
    monkeypatch.setattr(layout, "CANDIDATES", 5000)
    i, j, dx, dy = layout._pairs(x, y, 200.0)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for a, b in np.argwhere(far <= 200.0).tolist() if a < b]
    assert (dx == x[i] - x[j]).all() and (dy == y[i] - y[j]).all()


def test_books_are_laid_out_in_several_tasks(spark):
    places = spark.range(60).select((F.col("id") % 12).alias("book_id"), F.col("id").alias("place_id"))
    none = spark.createDataFrame([], "book_id long, a long, b long, kind string")
    assert layout.layout(places, none).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_near_places_are_near():
    at = layout.positions(12, np.zeros((0, 2), int), np.array([(0, 11)]))
    assert math.hypot(*(at[0] - at[11])) <= layout.NEAR + 1


def test_layout_of_odd_books(spark):
    places = spark.createDataFrame([(1, 5), (1, 5), (2, 7)], "book_id long, place_id long")
    relations = spark.createDataFrame([(1, 5, 5, "near"), (1, 5, 9, "route"), (3, 1, 2, "route")], "book_id long, a long, b long, kind string")
    assert sorted((r.book_id, r.place_id) for r in layout.layout(places, relations).collect()) == [(1, 5), (2, 7)]


def test_hull_leaves_out_inner_points():
    assert layout.hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0), (0, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert layout.hull([(1, 1), (1, 1)]) == [(1, 1)]


def test_region_groups_cover_every_node_once():
    nodes = list(range(43))
    got = layout.region_groups(nodes, [(k, k + 1) for k in range(39)] + [(41, 42)], {3: 0})
    assert sorted(n for g in got for n in g) == nodes
    assert [40] in got and [41, 42] in got and all(3 <= len(g) <= 10 for g in got[:-2])


def test_labels_avoid_each_other():
    put = layout.place_labels([(100, 100, 60, 20)] * 4, 400, 400)
    assert len(set(put)) == 4 and put[0] == (112, 90)


def test_sentences_said_twice_go():
    assert topics.distinct_sentences("The king is dead; Long live the queen! The king is dead;") == "The king is dead;Long live the queen!"
    assert topics.combined("a storm rises over the bay", "a storm rises over the bay; ships flee") == "a storm rises over the bay; ships flee"
    assert topics.combined("x;", "y") == "x；y" and topics.combined(None, "y") == "y" and topics.combined("", None) == ""


def test_titles_directions_and_texts(spark):
    row = spark.range(1).select(
        topics.canonical_title(F.lit("the magic laws"), {"magic": "arcane"}, [" laws", "laws"]).alias("t"), topics.canonical_title(F.lit("laws"), {}, ["laws"]).alias("s"),
        topics.directed(F.lit("teacher"), F.lit("directed"), F.lit(None).cast("string"), ["sibling"], {"teacher": "pupil"}).alias("d"),
        topics.directed(F.lit("fears"), F.lit("bidirectional"), F.lit(""), ["sibling"], {}).alias("e"),
        topics.unique_texts(F.array(F.lit("At sea。"), F.lit("at  SEA"), F.lit(" "), F.lit("home"))).alias("u"),
        topics.label_width(F.lit("x" * 10 + "海" * 2)).alias("w"), topics.composed(F.lit("war"), F.lit(" "), F.lit("flight"), F.lit(None).cast("string"), F.lit("heir")).alias("c"),
    ).first()
    assert (row.t, row.s, tuple(row.d), tuple(row.e)) == ("the arcane", "laws", ("bidirectional", "pupil"), ("directed", None))
    assert (row.u, row.w, row.c) == (["At sea。", "home"], 96.0, "war；flight；unresolved: heir")


def test_failures_in_a_row_open_the_breaker(spark):
    calls = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1, True), *[("a", f"2024-01-01 00:0{k}:00", k, False) for k in (1, 2, 3)], ("b", "2024-01-01 00:00:00", 9, False)], "provider string, at string, call_id long, ok boolean")
    got = {r.provider: (r.n_in_row, r.rests_until) for r in curation.provider_health(calls.withColumn("at", F.col("at").cast("timestamp_ntz"))).collect()}
    assert got["a"][0] == 3 and str(got["a"][1]) == "2024-01-01 00:33:00" and got["b"] == (1, None)


def test_what_is_left_open_is_closed(spark):
    items = spark.createDataFrame([("merge", "needs_review"), ("contradiction", "open"), ("time", "conflict"), ("merge", "merge")], "kind string, status string")
    assert [r.status for r in curation.closed(items).collect()] == ["auto_separate", "auto_quarantined", "auto_rejected", "merge"]


def test_later_evidence_does_not_count(spark):
    claims = spark.createDataFrame([(1, "original_text", 0), (2, "original_text", 0), (3, "note", 0)], "claim_id long, origin string, first_segment long")
    ev = spark.createDataFrame([(1, 2), (2, 9)], "claim_id long, segment long")
    assert sorted((r.claim_id, r.n_evidence) for r in curation.claim_context(claims, ev, 5).collect()) == [(1, 1), (3, 0)]


def test_gate_of_no_cases_is_shut(spark):
    row = curation.release_gate(spark.createDataFrame([], "book_id long, passed boolean, held_out boolean")).first()
    assert row.n_cases == 0 and row.held_out_share is None and row.gate_open is False


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], keep_old=True).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    segs = spark.createDataFrame([(1, 0, "[person:Ada] met [place:Rome]. Then left."), (1, 1, "[person:Ada ] again"), (2, 0, None)], "book_id long, ordinal long, text string")
    assert sorted((r.kind, r.name, r.first_segment, r.n) for r in sinks.marked_entities(segs).collect()) == [("person", "Ada", 0, 2), ("place", "Rome", 0, 1)]
    assert [r.event for r in sinks.first_sentences(segs).orderBy("book_id", "ordinal").collect()] == ["[person:Ada] met [place:Rome].", "[person:Ada ] again", None]
    counts = sinks.export_book({"segments": segs}, str(tmp_path / "out"), book=1, with_text=False)
    assert counts.first().n == 2 and spark.read.json(str(tmp_path / "out/segments")).columns == ["book_id", "ordinal"]


def test_evidence_moves_to_its_own_book(spark):
    ev = spark.createDataFrame([(1, 10, 100), (2, 10, 200), (3, 10, 201)], "evidence_id long, fact_id long, segment_id long")
    segs = spark.createDataFrame([(100, 1, 0), (200, 2, 0), (201, 2, 1)], "segment_id long, book_id long, ordinal long")
    facts = spark.createDataFrame([(10, 1)], "fact_id long, book_id long")
    assert sorted((r.evidence_id, r.segment_id) for r in sinks.repaired(ev, segs, facts).collect()) == [(1, 100), (2, 100)]


def test_renamed_and_edited_chapters_are_found_by_alike_titles(spark):
    side = "book_id long, ordinal long, title string, content_hash string"
    old = spark.createDataFrame([(1, 0, "The long voyage", "A"), (1, 1, "Home", "B"), (1, 2, None, "C"), (2, 0, "x", "D")], side)
    new = spark.createDataFrame([(1, 0, "Home", "B"), (1, 1, "The longer voyage", "Z"), (1, 2, None, "Y"), (3, 0, "x", "D")], side)
    from loomgraph.operators import incremental

    changes = incremental.plan(old, new)
    assert sorted((r.book_id, r.change) for r in changes.collect()) == [(1, "inserted"), (1, "inserted"), (1, "removed"), (1, "removed"), (1, "unchanged"), (2, "removed"), (3, "inserted")]
    got = incremental.alike_titles(changes, old, new).collect()
    assert sorted((r.book_id, r.old_ordinal, r.new_ordinal, r.change) for r in got if r.change in ("modified", "unchanged")) == [(1, 0, 1, "modified"), (1, 1, 0, "unchanged")]
    assert sorted((r.book_id, r.change) for r in got if r.change in ("removed", "inserted")) == [(1, "inserted"), (1, "removed"), (2, "removed"), (3, "inserted")]
