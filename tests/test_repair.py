"""Repairs on small rows, odd ones included."""

from pyspark.sql import functions as F

from loomgraph.operators import repair


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_kin_needs_one_owner(spark):
    entities = spark.createDataFrame([(1, "Ann's son"), (2, "Bob's son"), (3, None), (4, "Cy's"), (5, "Ann's son")], "entity_id long, name string")
    persons = spark.createDataFrame([(7, "Ann"), (7, "Ann"), (8, "Bob"), (9, "Bob"), (None, "Cy"), (10, None)], "entity_id long, name string")
    assert got(repair.kin_claims(entities, persons, r"^(\w+)'s (\w+)$").select("source", "target", "predicate")) == [(7, 1, "son"), (7, 5, "son")]


def test_said_relations(spark):
    segments = spark.createDataFrame([(2, "Ann is Bob's pupil. Ann is Bob's pupil"), (1, "Ann is Bob's pupil"), (3, None), (4, ""), (5, "Ann is Ann's pupil")], "segment long, text string")
    known = spark.createDataFrame([("Bob",), ("Bob",), (None,)], "name string")
    assert got(repair.said_relations(segments, r"(\w+) is (\w+)'s (\w+)", 1, 3, 2, known)) == [("Ann", "pupil", "Bob", 1, 3, True, False)]


def test_locations(spark):
    rows = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "a", False), (2, "c", False), (3, None, True), (4, "a", False), (4, "A", False)], "event_id long, place string, titled boolean")
    assert got(repair.repaired_locations(rows, spark.createDataFrame([("A", "a")], "place string, canonical_place string"))) == [(1, "b", "title"), (4, "a", "quote")]
    quotes = spark.createDataFrame([(1, "went to Rome, then to rome"), (2, "went to Rome"), (2, "to Pisa"), (3, None)], "e long, t string")
    assert got(repair.scenes(quotes, "e", "t", r"to (\w+)")) == [(1, "rome")]


def test_windows_touch_and_clip(spark):
    hits = spark.createDataFrame([(1, 7, 300, 310, 2000), (1, 8, 780, 790, 2000), (1, 9, 1900, 1950, 2000), (2, 7, 0, 5, 10), (2, 7, 5, 9, 10)], "segment long, target long, start long, end long, length long")
    assert got(repair.mention_windows(hits, least=1)) == [(1, 60, 1030, 2), (1, 1660, 2000, 1), (2, 0, 10, 1)]
    assert got(repair.mention_windows(hits)) == [(1, 60, 1030, 2)]


def test_audits(spark):
    rows = spark.createDataFrame([(1, "related", 0.6), (1, None, 0.9), (2, "isolated", 0.8), (2, None, None), (3, "isolated", 0.8), (3, "isolated", 0.7), (4, "isolated", 0.8), (4, "unclear", 0.1)], "node long, verdict string, confidence double")
    assert [(r[0], r[1], r[2]) for r in got(repair.audited(rows))] == [(1, "connected", 0.6), (2, "pending", 0.8), (3, "isolated", 0.7), (4, "ambiguous", 0.1)]


def test_moves(spark):
    evidence = spark.createDataFrame([(1, "q"), (2, "q"), (2, "r"), (None, "q")], "target long, quote string")
    mapping = spark.createDataFrame([(2, 1)], "old long, new long")
    assert {tuple(r) for r in repair.moved(evidence, mapping, "target").collect()} == {(1, "q"), (1, "r"), (None, "q")}
    units = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "unit long, world long")
    moves = spark.createDataFrame([(3, 1, 5), (3, 9, 6), (1, 2, 1), (1, 1, 0)], "unit long, to_world long, at long")
    assert got(repair.reparented(units, units.select("world"), moves)) == [(1, 2), (2, 1), (3, 1)]
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 6), (6, 5)], "folder long, parent long")
    asked = spark.createDataFrame([(1, 1, 3), (2, 3, 4), (3, 2, 2), (4, 2, 4), (5, 1, 5)], "move_id long, folder long, new_parent long")
    assert got(repair.cyclic_moves(parents, asked).select("move_id")) == [(1,), (3,)]  # 5 and 6 form a loop of old, which ends the climb


def test_digest_and_titles(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k long, v string")
    b = spark.createDataFrame([(2, None), (1, "y"), (1, "x"), (1, "x")], "k long, v string")
    one, two = ({r.k: r.digest for r in repair.content_digest(d, "k", ["v"]).collect()} for d in (a, b))
    assert one[2] == two[2] and one[1] != two[1]
    books = spark.createDataFrame([(1, 1, "T"), (2, 1, "T"), (3, 2, "T"), (4, 1, None)], "id long, f long, t string")
    assert {r.id: r.shown_title for r in repair.numbered_titles(books, "f", "t", "id").collect()} == {1: "T", 2: "T (2)", 3: "T", 4: None}
    assert repair.hidden(a, F.col("k") == 1, ["v"]).where("v is not null").count() == 0
    decided = spark.createDataFrame([(1, 1, "a"), (1, 2, "?"), (2, 1, None)], "k long, o long, d string")
    assert got(repair.settled(decided, {"a": "done"}, "k", "o", "d")) == [(1, "done"), (2, "open")]
