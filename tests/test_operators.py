"""Operators on small rows of our own, with their properties."""

import io
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as fx
from loomgraph.operators import evidence, graph, incremental, measures, resolve, views
from loomgraph.sources import importers
from loomgraph.streaming import activity


def test_quotes_are_found_white_space_aside(spark):
    texts = ["a b", "ab ab", "a\nb  a b", "ba", "", None, "  a b b\na b"]
    quotes = ["a b", "ab", " a b b ", "b\na", " ", "", "bb", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in evidence.locate(docs, asked, spaces=None).collect()}
    for d, t in enumerate(texts):
        for q, w in enumerate(quotes):
            w, t = (w or "").strip(), t or ""
            flat, r = "".join(w.split()), got.get((d, q))
            assert (r is not None) == (bool(flat) and flat in "".join(t.split())), (t, w)
            if r and w in t:
                assert (r.quote_start, r.quote_end, r.flat_start) == (t.index(w), t.index(w) + len(w), None)
            elif r:
                assert "".join(t[r.quote_start : r.quote_end].split()) == flat and r.flat_start == "".join(t.split()).index(flat)


def test_quotes_in_several_lots(spark, monkeypatch):
    monkeypatch.setattr(evidence, "QUOTE_CHARS", 20)
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    asked = spark.createDataFrame([(k, w) for k, w in enumerate("one two three four five six seven".split())], "item_id long, text string")
    assert sorted(r.item_id for r in evidence.locate(docs, asked).collect()) == [0, 1, 2, 3, 4, 5]
    assert sum(r.n_mentions for r in evidence.mentions(docs, asked.withColumnRenamed("text", "name")).collect()) == 6


def test_rejected_candidates_stay_apart(spark):
    docs = spark.createDataFrame([(1, "the red fox ran"), (2, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, "red  fox"), (8, "blue fox"), (9, None)], "item_id long, text string")
    found = evidence.locate(docs, quotes, spaces=False)
    ok, bad = evidence.gate(quotes, found, ["item_id"])
    assert [(r.item_id, r.quote_start, r.quote_end) for r in ok.collect()] == [(7, 4, 11)]
    assert sorted(r.item_id for r in bad.collect()) == [8, 9]


def test_order_is_acyclic_and_keeps_stronger_edges(spark):
    events = spark.createDataFrame([(1, 1, 50), (1, 2, 1), (1, 3, 2)], "book_id long, event_id long, narrative long")
    edges = spark.createDataFrame([(1, 1, 1, 2, 1.0), (1, 2, 2, 3, 0.9), (1, 3, 3, 1, 0.5)], "book_id long, edge_id long, earlier long, later long, confidence double")
    got = graph.order_events(events, edges).orderBy("story_order").collect()
    assert [r.event_id for r in got] == [1, 2, 3] and {r.n_conflicts for r in got} == {1}


def test_merging_can_be_undone(spark):
    entities = spark.createDataFrame([(1,), (2,), (3,)], "entity_id long")
    decisions = "left_id long, right_id long, verdict string, undone_at string"
    merged = resolve.clusters(entities, spark.createDataFrame([(1, 2, "merge", None), (2, 3, "separate", None)], decisions))
    undone = resolve.clusters(entities, spark.createDataFrame([(1, 2, "merge", "now")], decisions))
    assert {r.entity_id: r.cluster_id for r in merged.collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.entity_id: r.cluster_id for r in undone.collect()} == {1: 1, 2: 2, 3: 3}


def test_conflict_beats_alias(spark):
    pairs = spark.createDataFrame([(True, False, True, 0.9, "a", "a"), (False, False, True, 0.7, "a", "b"), (False, False, False, 0.99, "same text", "same text"), (False, False, False, 0.4, "a", "b")], "conflict boolean, same_key boolean, shared_alias boolean, confidence double, left_summary string, right_summary string")
    assert [(r.verdict, r.verdict_confidence) for r in resolve.verdicts(pairs).collect()] == [("separate", 0.995), ("merge", 0.97), ("merge", 0.99), ("needs_review", 0.5)]


def test_update_classes(spark):
    side = "book_id long, ordinal long, title string, content_hash string"
    old = spark.createDataFrame([(1, 0, "a", "A"), (1, 1, "b", "B"), (1, 2, "c", "C"), (1, 3, "d", "D")], side)
    new = spark.createDataFrame([(1, 0, "a2", "A"), (1, 1, "c", "C"), (1, 2, "b", "B"), (1, 3, "e", "E")], side)
    changes = incremental.plan(old, new)
    assert sorted(r.change for r in changes.collect()) == ["inserted", "removed", "renamed", "reordered", "reordered"]
    assert incremental.reuse_ratio(changes).first().reuse_ratio == 0.75


def test_cost_and_gates(spark):
    row = spark.range(1).select(measures.cost(*[F.lit(1_000_000)] * 3, F.lit(0.07), F.lit(0.27), F.lit(1.1)).alias("a"), measures.cost(*[F.lit(1)] * 3, F.lit(None).cast("double"), F.lit(0.27), F.lit(1.1)).alias("b"), measures.percentage(F.lit(1), F.lit(0)).alias("c")).first()
    assert row.a == 1.44 and row.b is None and row.c is None


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([(1, "100% sure"), (2, "100 times")], "id long, text string")
    assert [r.id for r in views.search([("t", df, "id", "text")], "0%", 5).collect()] == [1]


def test_identity_keys(spark):
    rows = spark.createDataFrame([("Ａnna-Ｍaria ",), ("anna maria",), (None,)], "n string").select(fx.identity_key("n").alias("k")).collect()
    assert [r.k for r in rows] == ["annamaria", "annamaria", None]


def test_importers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Chapter 1\nfirst\nChapter 2\nsecond".encode("utf-16"))
    (tmp_path / "b.html").write_text("<h1>T</h1><script>x</script><p>a&amp;b</p>")
    (tmp_path / "c.zip").write_bytes(b"no")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as book:
        book.writestr("META-INF/container.xml", '<c xmlns="u"><rootfile full-path="o/p.opf"/></c>')
        book.writestr("o/p.opf", '<p xmlns="u"><manifest><item id="1" href="x.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="1"/></spine></p>')
        book.writestr("o/x.xhtml", "<h1>One</h1><p>text</p>")
    (tmp_path / "d.epub").write_bytes(z.getvalue())
    got = {(r.path.rsplit("/", 1)[1], r.chapter): (r.title, r.error) for r in importers.read_books(spark, str(tmp_path)).collect()}
    assert got[("a.txt", 0)][0] == "Chapter 1" and got[("a.txt", 1)][0] == "Chapter 2"
    assert got[("b.html", 0)][0] == "T" and got[("d.epub", 0)][0] == "One" and "unknown format" in got[("c.zip", None)][1]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = activity.activity(activity.arriving(spark, str(tmp_path / "in"), events, 10), late="60 days")
    q = stream.writeStream.outputMode("update").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = activity.activity(events.withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("seen").collect())) == sorted(map(key, want.collect()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500)), min_size=1, max_size=12))
def test_packing_keeps_batches_within_the_limit(sizes):
    at, used, want = -1, 0, []
    for (s,) in sizes:
        if at < 0 or used + s > 400:
            at, used = at + 1, 0
        used += s
        want.append(at)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None and len(sizes) < 3:  # a few go through Spark
        assert spark.range(1).select(views.packed(F.array(*[F.lit(s).cast("long") for (s,) in sizes]), 400).alias("b")).first().b == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_role_conflicts_are_counted_in_place(spark, monkeypatch, kind):
    """Large events: no pair is shuffled, and the pairs are those of the plain way, whatever the blocks and tiles."""
    rng = np.random.default_rng(5)
    rows = [(int(e), int(i), [None, "a", "b", "c"][r]) for e, i, r in zip(rng.integers(0, 9, 3000), rng.integers(0, 300, 3000), rng.integers(0, 4, 3000), strict=True)] + [(None, 1, "a"), (1, None, "a")]
    p = spark.createDataFrame(rows, "event_id long, entity_id long, role string").withColumn("entity_id", F.col("entity_id").cast(kind))
    monkeypatch.setattr(resolve, "BLOCK_ROWS", 700)
    whole = resolve.role_conflicts(p)
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    got, want = (sorted(map(tuple, df.collect())) for df in (whole, resolve.role_conflicts(p, pairs=1e9)))
    assert got == want and len(got) > 10_000
    held = pa.table({"side": [2] * 40, "e": [k % 3 for k in range(40)], "id": list(range(40)), "one": ["ab"[k % 2] for k in range(40)]})
    monkeypatch.setattr(resolve, "TILE", 7)
    tiles = {(min(a, b), max(a, b)): n for t in resolve._tiles(held) for a, b, n in zip(*[c.to_pylist() for c in t.columns], strict=True)}
    assert tiles == {(a, b): 1 for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3 and a % 2 != b % 2}
