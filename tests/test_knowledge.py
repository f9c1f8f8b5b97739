"""Chapters, parsing, scopes, narrative, ledger and assessment on small rows: odd ones, order, and what must not happen."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import parsing
from loomgraph.operators import assess, ledger, narrative, scope
from loomgraph.plans.registry import ORACLE_SQL, QUERIES
from loomgraph.sources import chapters, importers
from loomgraph.streaming import activity


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pieces_lose_nothing_and_fit():
    rng = random.Random(4)
    for _ in range(300):
        text = "\n\n".join("".join(rng.choice("ab c") for _ in range(rng.choice([0, 3, 9, 10, 11, 25, 40]))) for _ in range(rng.randint(0, 6)))
        parts = chapters.pieces(text, 10)
        assert all(len(p) <= 10 for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())
    assert chapters.pieces("aaaa\n\nbbbb\n\ncc", 10) == ["aaaa\n\nbbbb", "cc"]
    assert chapters.pieces("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert chapters.pieces("", 10) == [] and chapters.pieces(None, 10) == []


def test_chunks_never_cross_a_chapter(spark):
    rows = [("b", 0, "t" * 200, "one\n\ntwo"), ("b", 1, None, None), ("b", 2, "x", "y" * 12), ("c", 0, "z", "")]
    out = chapters.chunked(spark.createDataFrame(rows, "book_id string, chapter int, title string, text string"), target=5).orderBy("book_id", "ordinal").collect()
    assert [(r.ordinal, r.text, r.char_start, r.char_end) for r in out] == [(0, "one", 0, 3), (1, "two", 4, 7), (2, "yyyyy", 8, 13), (3, "yyyyy", 14, 19), (4, "yy", 20, 22)]
    assert len(out[0].title) == 160 and out[0].anchor.startswith("seg-0-")


def test_wrappers(spark):
    start, end = "*** START OF THE PROJECT GUTENBERG EBOOK A ***", "*** END OF THE PROJECT GUTENBERG EBOOK A ***"
    texts = [None, "plain", f"x\n{start}\nbody\n{end}\ny", f"{end}\nbody\n{start}", f"{start}\nbody", f"{start}\nProduced by me\n\nChapter 1\nbody\nEnd of Project Gutenberg's A\n{end}", f"{start}\nEnd of Project Gutenberg's A\n" + "word " * 400 + f"\n{end}"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", chapters.unwrapped(F.col("t")).alias("u")).orderBy("k")
    out = [r.u for r in df.collect()]
    assert out[:5] == [None, "plain", "body", texts[3], texts[4]] and out[5] == "Chapter 1\nbody"
    assert out[6].startswith("End of Project") and out[6].endswith("word")


def test_manifests_publishing_and_snapshots(spark, tmp_path):
    path = f"{tmp_path}/m.json"
    assert chapters.manifest(spark, path, "a int").count() == 0
    open(path, "w").write('[{"a": 1}, {"a": 2}]')
    assert got(chapters.manifest(spark, path, "a int")) == [(1,), (2,)]
    open(path, "w").write("{broken")
    assert chapters.manifest(spark, path, "a int").count() == 0
    to = f"{tmp_path}/table"
    for n in (3, 5):
        chapters.published(spark.range(n), to)
        assert spark.read.parquet(to).count() == n
    chapters.published(spark.read.parquet(to).where("id > 1"), to)  # what is replaced may be read meanwhile
    assert spark.read.parquet(to).count() == 3 and len(list(tmp_path.iterdir())) == 2
    version = chapters.snapshot({"a": spark.range(2), "b": spark.range(4)}, f"{tmp_path}/copies")
    assert (tmp_path / "copies" / version / "_DONE").exists() and spark.read.parquet(f"{tmp_path}/copies/{version}/b").count() == 4


def test_rules_as_a_provider(spark):
    segments = spark.createDataFrame([("b", 0, "Ann met Bob"), ("b", 1, None)], "book_id string, ordinal int, text string")
    rule = lambda s: s.select("book_id", "ordinal", F.lit("person").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1))).alias("name")).withColumn("quote", F.col("name"))
    made = chapters.RuleProvider(rule, rule).extract(segments)
    assert got(made.select("name")) == [("Ann",), ("Bob",)]
    facts = made.withColumn("quote", F.when(F.col("name") == "Ann", "Ann met").otherwise("Bob met"))
    assert got(chapters.RuleProvider(rule).review(facts, segments).select("name", "holds")) == [("Ann", True), ("Bob", False)]


def test_what_files_say_of_themselves():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/core.xml", '<c xmlns:d="x"><d:title> A  Book </d:title><d:creator>Ann</d:creator></c>')
        z.writestr("word/document.xml", "<w/>")
    assert importers.about("a/b.docx", out.getvalue()) == ("A Book", "Ann")
    assert importers.about("a/b.html", b"<title>T &amp; U</title><meta name='author' content='Bob'>") == ("T & U", "Bob")
    assert importers.about("a/b.txt", b"x") == ("b", "")
    assert importers.decode("<meta charset=shift_jis>①".encode("cp932")) == "<meta charset=shift_jis>①"
    assert importers.decode("<meta charset=rot13>é".encode()) == "<meta charset=rot13>é"


def test_replies(spark):
    replies = ['```json\n{"items": [{"name": "a", "quote": "q"}, {"name": "b"}, {"name": "c", "quote": ""}]}\n```', "no json", None, '{"items": 3}', json.dumps({"items": [{"name": str(k), "quote": "q"} for k in range(300)]})]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, r string")
    items = parsing.good_items(F.col("r"), "items", "name string, quote string", "quote")
    assert [r.n for r in df.select("k", F.size(items).alias("n")).orderBy("k").collect()] == [1, 0, 0, 0, 200]
    deep = spark.createDataFrame([('{"evidence_quote": "a", "x": [{"evidence_quote": "b"}, {"evidence_quote": 3}]}',), ("[",), (None,), ('```json\n[{"evidence_quote": "c"}]\n```',)], "r string")
    assert [r.q for r in deep.select(parsing.nested("evidence_quote")(F.col("r")).alias("q")).collect()] == [["a", "b"], [], [], ["c"]]


def test_scopes(spark):
    names = spark.createDataFrame([("a*b",), ("a.b",), ("axb\nc",), (None,)], "n string")
    assert [r.g for r in names.select(scope.glob(F.col("n"), "a?b*").alias("g")).collect()] == [True, True, True, None]
    assert [r.g for r in names.select(scope.glob(F.col("n"), "a[.*]b").alias("g")).collect()] == [True, True, False, None]
    rows = spark.createDataFrame([(1, "x%y"), (2, "xzy"), (3, None)], "id int, t string")
    assert got(scope.where_all(rows, {"id": None}, "%", ["t"])) == [(1, "x%y")] and scope.where_all(rows, {}).count() == 3
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (5, "b"), (7, "c"), (7, "c")], "unit_id int, entity_id string")
    assert got(scope.merged_groups(members)) == [(1, 1), (2, 1), (5, 1), (7, 7)]
    tails = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "x array<int>").select(scope.tail(F.col("x"), 2).alias("t")).collect()
    assert [r.t for r in tails] == [[2, 3], [1], []]


def test_folds_see_rows_in_order(spark):
    rng = random.Random(1)
    rows = [(k % 5, k, rng.randint(0, 9)) for k in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, at long, v int").repartition(7)
    out = got(narrative.folded(df, "key", ["at"], list, lambda s, r: [*s, r.at][-3:], lambda k, s: (k, s), "key long, last array<long>"))
    assert out == [(k, [1985 + k, 1990 + k, 1995 + k]) for k in range(5)]


def test_states_keep_twelve(spark):
    rows = [(1, k, k, None, "", [f"s{k % 14}"]) for k in range(14)] + [(1, 20, 20, None, "", ["s0"]), (1, 21, 21, "p", "g", None)]
    r = narrative.states(spark.createDataFrame(rows, "subject long, event_id long, story_order long, place string, goal string, changes array<string>")).collect()[0]
    assert r.states == [f"s{k}" for k in range(3, 14)] + ["s0"] and (r.place, r.goal, r.through_event) == ("p", "g", 21) and len(r.source_events) == 16


def test_memory_states_match_sql_on_odd_events(spark, sf, tmp_path):
    """Pairs that a subject's first event leaves on the edge of its memory; events without subject, time, kind or k."""
    con = duckdb.connect()
    odd = {"user_id": "event_id % 37 = 5", "ts": "event_id % 41 = 3", "event_type": "event_id % 43 = 7", "props": "event_id % 47 = 9"}
    cols = ", ".join(f"CASE WHEN {when} THEN NULL ELSE {c} END AS {c}" for c, when in odd.items())
    drawn = """SELECT event_id + i * 1000 AS event_id, ts, user_id + i * 15 AS user_id, event_type, value, '{"k": ' || hash(event_id, i) % 100 || '}' AS props"""
    con.execute(f"COPY (SELECT * REPLACE ({cols}) FROM ({drawn} FROM '{sf}/events.parquet', range(40) t(i))) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    df = QUERIES["memory_states"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['memory_states']})").fetchall()
    assert got(df) == sorted(want, key=str) and len(want) == 601


def test_prices_in_force_are_the_last_known_ones(spark):
    """A null price hides none before it; uses without provider, model or time; equal uses stay; many prices of one key."""
    listed = [("p", "m", 5, 1.0), ("p", "m", 9, None), ("p", "*", 3, 7.0), ("p", "*", 3, 6.0), ("p", "n", None, 2.0), (None, "m", 1, 3.0), ("p", None, 1, 4.0), ("q", "*", 8, 5.0)]
    uses = [(1, "p", "m", 4), (2, "p", "m", 5), (3, "p", "m", 12), (4, "p", "x", 2), (5, "p", None, 9), (6, None, "m", 9), (7, "p", "m", None), (8, "q", "m", 7), (9, "p", "m", 12), (10, "q", "*", 8)]
    table = spark.createDataFrame(listed, "provider string, model string, from_at long, price double")
    out = ledger.prices(spark.createDataFrame(uses, "id long, provider string, model string, at long"), table)
    assert {r.id: r.price for r in out.collect()} == {1: 7.0, 2: 1.0, 3: 1.0, 4: None, 5: 7.0, 6: None, 7: None, 8: None, 9: 1.0, 10: 5.0}
    many = spark.range(200_000).select(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.col("id").alias("from_at"), F.col("id").cast("double").alias("price"))
    used = spark.range(200_000).select(F.lit("p").alias("provider"), F.lit("m").alias("model"), (F.col("id") * 7 % 200_000).alias("at"))
    assert ledger.prices(used, many).where("price = at").count() == 200_000  # 40 billion pairs of one key


def test_units_need_a_title_and_disjoint_people(spark):
    segments = spark.createDataFrame([("b", k, t) for k, t in enumerate(["One", "Two", "Chapter 3", "Four", None])], "book_id string, ordinal int, title string")
    members = spark.createDataFrame([("b", 0, 1), ("b", 1, 2), ("b", 2, 3), ("b", 3, 3)], "book_id string, ordinal int, entity_id int")
    assert got(narrative.units(segments, members).select("ordinal", "unit_id")) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_gated_edits(spark):
    segments = spark.createDataFrame([(1, "b", "the red\nfox"), (2, "c", "the red fox")], "segment_id int, book_id string, text string")
    edits = spark.createDataFrame([(k, *r) for k, r in enumerate([("b", 1, "original_text", "red fox"), ("b", 2, "original_text", "red fox"), ("b", 1, "original_text", " "), ("b", 9, "inference", None), ("b", 1, "original_text", None)])], "edit_id int, book_id string, segment_id int, origin string, quote string")
    good, bad = ledger.gated(edits, segments)
    assert got(good.select("edit_id")) == [(0,), (3,)] and got(bad.select("edit_id")) == [(1,), (2,), (4,)]


def test_candidates_of_common_names_are_a_star(spark):
    people = spark.createDataFrame([("b", "person", k, "ann", k) for k in range(50)] + [("b", "person", 90, "zed", 0), ("b", "person", 91, "", 0)], "book_id string, kind string, entity_id int, key string, first_segment int")
    aliases = spark.createDataFrame([(90, "ann"), (90, "lord"), (3, "lord")], "entity_id int, key string")
    out = ledger.candidates(people, aliases, spark.createDataFrame([("lord",)], "key string"))
    assert out.count() == 50 and got(out.where("reason = 'alias'")) == [(0, 90, "alias", 0.75)]


def test_updates_applied(spark):
    changes = spark.createDataFrame([("b", 0, 0, "unchanged"), ("b", 1, 1, "modified"), ("b", 2, 5, "reordered")], "book_id string, old_ordinal int, new_ordinal int, change string")
    facts = spark.createDataFrame([(1, "b", "model"), (2, "b", "model"), (3, "b", "human")], "fact_id int, book_id string, created_by string")
    evidence = spark.createDataFrame([(1, "b", 1), (1, "b", 2), (2, "b", 1), (3, "b", 1)], "fact_id int, book_id string, ordinal int")
    kept, left = assess.applied(changes, facts, evidence)
    assert got(kept.select("fact_id", "first_segment", "n_evidence")) == [(1, 5, 1), (3, None, 0)] and got(left.select("fact_id", "ordinal")) == [(1, 5)]


def test_sink_and_running_states(spark, tmp_path):
    rows = [(k, k % 3, "view" if k % 2 else "click", float(k)) for k in range(12)]
    schema = "event_id long, user_id long, event_type string, value double"
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4] + rows[:1], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write = activity.upsert_sink(f"{tmp_path}/out", ["event_id"])
    stream().writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    assert got(spark.read.parquet(f"{tmp_path}/out").select("event_id")) == sorted(((k,) for k in range(12)), key=str)
    write(spark.createDataFrame(rows[8:], schema), 2)  # a batch that runs again
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 12 and spark.read.parquet(f"{tmp_path}/out").select("event_id").distinct().count() == 12
    seen = {}
    states = activity.running_states(stream().where("event_id >= 0"))
    q = states.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({r.user_id: (r.n_events, r.last_event, r.total) for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {k: v[1] for k, v in seen.items()} == {0: 9, 1: 10, 2: 11} and sum(v[0] for v in seen.values()) == 15


@pytest.mark.parametrize("width,want", [(3, "abc|def|gh…"), (4, "abcd|efgh|ij"), (20, "abcdefghij")])
def test_labels_wrap(spark, width, want):
    assert spark.range(1).select(F.array_join(assess.wrapped(F.lit("abcdefghij"), width), "|").alias("x")).first().x == want
