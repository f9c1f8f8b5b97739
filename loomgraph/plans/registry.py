"""All queries of the engine over the tables at hand, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as fx
from loomgraph.functions import topics
from loomgraph.operators import chronology, curation, evidence, graph, incremental, layout, measures, repair, resolve, views
from loomgraph.sources import adapters, sinks
from loomgraph.sources.adapters import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PROGRESS, QUERY, LIMIT = 3, "th", 60
TOKEN_CHARS = 4


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.story_events(table(spark, sf, "events"))


EVENTS = """ev AS (SELECT event_id, user_id AS subject, ts, event_type AS kind, value,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS place, CAST(json_extract(props, '$.k') AS BIGINT) AS target FROM events)"""


# Evidence


@query("SELECT d.doc_id, b.item_id, CAST(instr(d.text, trim(b.text)) - 1 AS BIGINT) AS quote_start, CAST(instr(d.text, trim(b.text)) - 1 + length(trim(b.text)) AS BIGINT) AS quote_end FROM documents d JOIN benchmark b ON instr(d.text, trim(b.text)) > 0")
def evidence_locate(spark, sf):
    return evidence.locate(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("flat_start")


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents), b AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS q FROM benchmark)
SELECT doc_id, item_id, CAST(instr(t, q) - 1 AS BIGINT) AS flat_start FROM d JOIN b ON instr(t, q) > 0""")
def evidence_locate_ws(spark, sf):
    quotes = table(spark, sf, "benchmark").withColumn("text", F.regexp_replace("text", " ", " \n"))
    return evidence.locate(table(spark, sf, "documents"), quotes, spaces=False).select("doc_id", "item_id", "flat_start")


@query("""WITH h AS (SELECT b.item_id, count(*) AS links FROM documents d JOIN benchmark b ON instr(d.text, trim(b.text)) > 0 GROUP BY 1)
SELECT count(*) AS n_quotes, count(links) AS n_located, round(100.0 * count(links) / count(*), 2) AS coverage_pct, CAST(coalesce(sum(links), 0) AS BIGINT) AS n_links FROM benchmark LEFT JOIN h USING (item_id)""")
def evidence_coverage(spark, sf):
    quotes = table(spark, sf, "benchmark")
    return evidence.coverage(quotes, evidence.locate(table(spark, sf, "documents"), quotes))


@query("SELECT b.item_id, CAST(min(d.doc_id) AS BIGINT) AS first_segment, count(*) AS n_evidence FROM documents d JOIN benchmark b ON instr(d.text, trim(b.text)) > 0 GROUP BY 1")
def reanchor_min(spark, sf):
    return incremental.reanchor(evidence.locate(table(spark, sf, "documents"), table(spark, sf, "benchmark")), "item_id", "doc_id")


@query("""WITH n AS (SELECT DISTINCT regexp_extract(text, '^[^ ]+') AS name FROM benchmark), m AS (
  SELECT name, CAST((length(text) - length(replace(text, name, ''))) / length(name) AS BIGINT) AS k FROM documents, n WHERE length(name) > 0)
SELECT name, count(*) FILTER (WHERE k > 0) AS n_segments, CAST(sum(k) AS BIGINT) AS n_mentions FROM m GROUP BY 1""")
def dictionary_mentions(spark, sf):
    return evidence.mentions(table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.regexp_extract("text", "^[^ ]+", 0).alias("name")))


# Sources


@query("""WITH s AS (SELECT doc_id AS book_id, unnest(range(0, len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT book_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(length(text) AS BIGINT) AS n_chars, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY book_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM s""")
def segments_split(spark, sf):
    return adapters.segments(table(spark, sf, "documents")).select("book_id", "ordinal", F.length("text").cast("long").alias("n_chars"), "char_start")


@query("""WITH s AS (SELECT doc_id AS book_id, unnest(range(0, len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT book_id, CAST(ordinal AS BIGINT) AS ordinal, 'seg-' || ordinal || '-' || substr(sha256(text), 1, 12) AS anchor FROM s""")
def segment_anchor(spark, sf):
    return adapters.anchored(adapters.segments(table(spark, sf, "documents"))).select("book_id", "ordinal", "anchor")


@query("SELECT doc_id, sha256(text) AS source_hash, CAST(min(doc_id) OVER (PARTITION BY sha256(text)) AS BIGINT) AS canonical_id, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents")
def import_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))
    first = docs.groupBy("source_hash").agg(F.min("doc_id").alias("canonical_id"))
    return docs.join(first, "source_hash").withColumn("is_duplicate", F.col("doc_id") != F.col("canonical_id"))


@query(r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS title,
  trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages)
SELECT page_id, title, CAST(length(body) AS BIGINT) AS n_chars, sha256(body) AS text_hash FROM t""")
def html_visible_text(spark, sf):
    html = F.col("html")
    title = F.trim(F.regexp_replace(F.regexp_extract(html, "(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    body = F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    body = F.trim(F.regexp_replace(body, r"[ \t\r\n]+", " "))
    return table(spark, sf, "pages").select("page_id", title.alias("title"), body.alias("b")).select("page_id", "title", F.length("b").cast("long").alias("n_chars"), F.sha2("b", 256).alias("text_hash"))


# Views


@query(f"SELECT conv_id, count(*) AS n_visible, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations WHERE turn <= {PROGRESS} GROUP BY 1")
def spoiler_view(spark, sf):
    rows = views.visible(table(spark, sf, "conversations"), PROGRESS, "turn")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_visible"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH c AS (SELECT conv_id, count(*) AS segment_count FROM conversations GROUP BY 1)
SELECT conv_id, count(*) AS n_segments, count(DISTINCT role) AS n_roles, count(*) FILTER (WHERE role = 'user') AS n_user, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations JOIN c USING (conv_id) WHERE turn <= least({PROGRESS}, greatest(0, segment_count - 1)) GROUP BY 1""")
def overview_counts(spark, sf):
    rows = table(spark, sf, "conversations")
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("segment_count"))
    seen = views.visible(rows, PROGRESS, "turn", "conv_id", counts)
    return seen.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("role").alias("n_roles"), F.count_if(F.col("role") == "user").alias("n_user"), F.max(F.length("text")).cast("long").alias("longest"))


def _snippet(col: str) -> str:
    return f"substr({col}, CAST(greatest(instr(lower({col}), '{QUERY}') - 50, 1) AS BIGINT), {140 + len(QUERY)})"


@query(f"""WITH a AS (SELECT 0 AS source_rank, 'part' AS source, CAST(p_partkey AS BIGINT) AS id, {_snippet("p_name")} AS snippet FROM part WHERE p_name ILIKE '%{QUERY}%' ORDER BY id LIMIT {LIMIT}),
b AS (SELECT 1 AS source_rank, 'nation' AS source, CAST(n_nationkey AS BIGINT) AS id, {_snippet("n_name")} AS snippet FROM nation WHERE n_name ILIKE '%{QUERY}%' ORDER BY id LIMIT {LIMIT}),
c AS (SELECT 2 AS source_rank, 'documents' AS source, CAST(doc_id AS BIGINT) AS id, {_snippet("text")} AS snippet FROM documents WHERE text ILIKE '%{QUERY}%' ORDER BY id LIMIT {LIMIT})
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY source_rank, id LIMIT {LIMIT}""")
def search_cascade(spark, sf):
    return views.search([("part", table(spark, sf, "part"), "p_partkey", "p_name"), ("nation", table(spark, sf, "nation"), "n_nationkey", "n_name"), ("documents", table(spark, sf, "documents"), "doc_id", "text")], QUERY, LIMIT)


@query("SELECT facet, item, count(*) AS n FROM (SELECT 'p_brand' AS facet, p_brand AS item FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part) GROUP BY 1, 2")
def facets(spark, sf):
    return views.facets(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query("""SELECT category, label, min(scheme) AS scheme, count(*) AS n_sources FROM (
  SELECT 'part' AS scheme, p_brand AS category, p_type AS label FROM part UNION ALL
  SELECT 'nation', r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT 'supplier', 'supplier', s_name FROM supplier) WHERE label IS NOT NULL GROUP BY 1, 2""")
def concept_projection(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return views.concepts([("part", table(spark, sf, "part"), F.col("p_brand"), F.col("p_type")), ("nation", nations, F.col("r_name"), F.col("n_name")), ("supplier", table(spark, sf, "supplier"), F.lit("supplier"), F.col("s_name"))])


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n_revisions FROM events GROUP BY 1, 2")
def version_latest(spark, sf):
    return views.latest_version(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("""WITH r AS (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY revenue DESC, l_partkey) AS pos FROM r)
SELECT l_suppkey, l_partkey, revenue, CAST(pos AS INTEGER) AS pos FROM k WHERE pos <= 2""")
def top2_per_group(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return views.top_per_group(sums, "l_suppkey", [F.desc("revenue"), F.col("l_partkey")], 2).withColumnRenamed("at", "pos")


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), b AS (
  SELECT conv_id, turn, i, n AS used, 0 AS batch FROM s WHERE i = 1 UNION ALL
  SELECT s.conv_id, s.turn, s.i, CASE WHEN b.used + s.n > 400 THEN s.n ELSE b.used + s.n END, CASE WHEN b.used + s.n > 400 THEN b.batch + 1 ELSE b.batch END FROM b JOIN s ON s.conv_id = b.conv_id AND s.i = b.i + 1)
SELECT conv_id, CAST(batch AS BIGINT) AS batch, count(*) AS n_turns FROM b GROUP BY 1, 2""")
def greedy_batches(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("t"))
    packs = turns.select("conv_id", F.explode(views.packed(F.transform("t", lambda x: x["n"]), 400)).alias("batch"))
    return packs.groupBy("conv_id", F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n_turns"))


@query("SELECT r_name, count(*) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS aliases FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def listagg_aliases(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("aliases"))


# Joins and resolution


@query("""WITH k AS (SELECT n_nationkey AS id, n_regionkey AS fs, n_name AS name FROM nation UNION ALL SELECT n_nationkey, n_regionkey, substr(n_name, 1, 2) FROM nation), w AS (SELECT DISTINCT substr(c_name, 1, 2) AS name FROM customer UNION SELECT n_name FROM nation UNION SELECT substr(n_name, 1, 2) FROM nation)
SELECT w.name, CAST(arg_min(k.id, (k.fs, k.id)) AS BIGINT) AS entity_id FROM w LEFT JOIN k USING (name) GROUP BY 1""")
def name_or_alias_lookup(spark, sf):
    n = table(spark, sf, "nation")
    names = n.select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("name"), F.array(F.substring("n_name", 1, 2)).alias("aliases"), F.col("n_regionkey").alias("first_segment"))
    wanted = table(spark, sf, "customer").select(F.substring("c_name", 1, 2).alias("name")).union(n.select("n_name")).union(n.select(F.substring("n_name", 1, 2)))
    return resolve.lookup(names, wanted)


@query("""WITH p AS (SELECT DISTINCT date_trunc('hour', ts) AS e, user_id, event_type FROM events)
SELECT l.user_id AS left_id, r.user_id AS right_id, count(DISTINCT l.e) AS n_events FROM p l JOIN p r ON l.e = r.e AND l.user_id < r.user_id AND l.event_type <> r.event_type GROUP BY 1, 2""")
def role_conflict_pairs(spark, sf):
    p = table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("event_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("role"))
    return resolve.role_conflicts(p)


@query("SELECT least(l_partkey, l_suppkey) AS left_id, greatest(l_partkey, l_suppkey) AS right_id, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2")
def unordered_pairs(spark, sf):
    return resolve.unordered(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _claims(spark, sf):
    return _events(spark, sf).select(F.col("event_id").alias("claim_id"), F.col("subject").alias("source"), "target", F.col("kind").alias("predicate"), F.round(F.abs("value") % 1, 6).alias("confidence"))


@query(f"WITH {EVENTS} SELECT subject AS source, target, kind AS predicate, min(event_id) AS keep_id, count(*) - 1 AS n_removed FROM ev GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_claims(spark, sf):
    return resolve.duplicate_claims(_claims(spark, sf))


@query(f"WITH {EVENTS} SELECT least(subject, target) AS left_id, greatest(subject, target) AS right_id, count(DISTINCT kind) AS n_predicates FROM ev GROUP BY 1, 2 HAVING count(DISTINCT kind) >= 3")
def multi_relation_pairs(spark, sf):
    return resolve.multi_relation_pairs(_claims(spark, sf))


@query(f"""WITH {EVENTS}, c AS (SELECT event_id, subject - subject % 5 AS source, target - target % 5 AS target, kind AS predicate, round(abs(value) % 1, 6) AS confidence FROM ev), k AS (
  SELECT *, row_number() OVER (PARTITION BY source, target, predicate ORDER BY confidence DESC, event_id) AS pos FROM c WHERE source <> target)
SELECT source, target, predicate, confidence, event_id AS claim_id FROM k WHERE pos = 1""")
def canonical_claims(spark, sf):
    claims = _claims(spark, sf)
    ids = claims.select(F.col("source").alias("entity_id")).union(claims.select("target")).dropDuplicates()
    return resolve.canonical_claims(claims, ids.withColumn("cluster_id", F.col("entity_id") - F.col("entity_id") % 5))


@query("""WITH RECURSIVE g AS (SELECT o_custkey AS a, lag(o_custkey) OVER (PARTITION BY o_orderdate, o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS b FROM orders), e AS (
  SELECT a, b FROM g WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM g WHERE b IS NOT NULL AND a <> b), r AS (
  SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def connected_components(spark, sf):
    w = Window.partitionBy("o_orderdate", "o_orderpriority", "o_orderstatus").orderBy("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), F.lag("o_custkey").over(w).alias("b"))
    return graph.components(rows.where("b is not null"))


@query("""WITH p AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT node, parent AS ancestor, 1 AS depth FROM p UNION ALL SELECT a.node, b.parent, 2 FROM p a JOIN p b ON b.node = a.parent""")
def containment_depth(spark, sf):
    def edges(name, node, parent, a, b):
        return table(spark, sf, name).select(F.concat(F.lit(a), F.col(node)).alias("node"), F.concat(F.lit(b), F.col(parent)).alias("parent"))

    return graph.containment(edges("customer", "c_custkey", "c_nationkey", "c", "n").unionByName(edges("supplier", "s_suppkey", "s_nationkey", "s", "n")).unionByName(edges("nation", "n_nationkey", "n_regionkey", "n", "r")))


@query("SELECT c_custkey, count(o_orderkey) AS degree, count(o_orderkey) = 0 AS isolated FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def degree_and_isolated(spark, sf):
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (-F.col("o_orderkey") - 1).alias("b"))
    return graph.degrees(edges, table(spark, sf, "customer"), "c_custkey")


# Chronology


@query(f"WITH {EVENTS} SELECT subject, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(kind, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS value FROM ev GROUP BY 1")
def latest_state(spark, sf):
    return chronology.latest_state(_events(spark, sf))


LOCATED = f"""WITH {EVENTS}, l AS (SELECT *, last_value(place IGNORE NULLS) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS effective_place FROM ev)"""


@query(LOCATED + " SELECT subject, event_id, place, effective_place, CASE WHEN place IS NOT NULL THEN 'explicit' WHEN effective_place IS NOT NULL THEN 'inherited' ELSE 'unresolved' END AS status FROM l")
def effective_location(spark, sf):
    return chronology.effective_location(_events(spark, sf))


LEGS = f"""WITH {EVENTS}, g AS (SELECT *, sum(CASE WHEN place IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gaps FROM ev),
h AS (SELECT *, lag(place) OVER w AS from_place, CAST(gaps - lag(gaps) OVER w AS BIGINT) AS n_between FROM g WHERE place IS NOT NULL WINDOW w AS (PARTITION BY subject ORDER BY ts, event_id)),
legs AS (SELECT subject, event_id, from_place, place AS to_place, n_between, CASE WHEN n_between = 0 THEN 'direct' ELSE 'unknown_path' END AS gap_status, CASE WHEN n_between = 0 THEN 0.95 ELSE 0.55 END AS confidence FROM h WHERE from_place IS NOT NULL AND from_place <> place)"""


@query(LEGS + " SELECT subject, event_id, from_place, to_place, n_between, gap_status, CAST(confidence AS DOUBLE) AS confidence FROM legs")
def derived_journey(spark, sf):
    return chronology.journeys(_events(spark, sf))


@query(LEGS + """ SELECT ev.subject, ev.event_id, CAST(row_number() OVER (PARTITION BY ev.subject ORDER BY ts, ev.event_id) - 1 AS BIGINT) AS canonical_index, CASE WHEN place IS NULL THEN 'unlocated' ELSE 'located' END AS location_state, from_place, to_place, gap_status FROM ev LEFT JOIN legs ON legs.event_id = ev.event_id""")
def story_map_steps(spark, sf):
    events = _events(spark, sf)
    return chronology.map_steps(events, chronology.journeys(events))


@query(f"""WITH {EVENTS}, r AS (SELECT subject, event_id, row_number() OVER (PARTITION BY subject ORDER BY event_id) - 1 AS narrative_rank, row_number() OVER (PARTITION BY subject ORDER BY ts, event_id) - 1 AS story_rank FROM ev)
SELECT *, narrative_rank <> story_rank AS nonlinear FROM r""")
def story_rank(spark, sf):
    return chronology.story_ranks(_events(spark, sf))


@query(f"""WITH {EVENTS}, p AS (SELECT *, CASE WHEN lag(ts) OVER w IS NOT NULL AND (epoch(ts) - epoch(lag(ts) OVER w)) > 21600 THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY subject ORDER BY ts, event_id)),
u AS (SELECT *, CAST(sum(b) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS unit FROM p)
SELECT subject, unit, count(*) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event FROM u GROUP BY 1, 2""")
def islands_partition(spark, sf):
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return chronology.islands(_events(spark, sf), F.col("prev_ts").isNotNull() & (seconds("ts") - seconds("prev_ts") > 21600))


@query("""WITH i AS (SELECT event_type, epoch_us(ts) - 900000000 AS s, epoch_us(ts) + 900000000 AS e FROM events), r AS (SELECT *, max(e) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM r)
SELECT event_type, min(s) AS "start", max(e) AS "end", count(*) AS n FROM g GROUP BY event_type, grp""")
def merge_intervals(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("event_type", (us - 900_000_000).alias("start"), (us + 900_000_000).alias("end"))
    return chronology.merge_intervals(rows, "event_type")


@query(f"""WITH {EVENTS}, d AS (SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM ev), b AS (SELECT min(day) AS first, max(day) AS last FROM d), u AS (SELECT CAST(i AS BIGINT) AS unit_id, first + i * 5 AS first_day, first + i * 5 + 6 AS last_day FROM b, (SELECT unnest(range(0, 2000)) AS i) WHERE first + i * 5 <= last)
SELECT unit_id, count(*) AS n_events, count(DISTINCT subject) AS n_subjects FROM u JOIN d ON day BETWEEN first_day AND last_day GROUP BY 1""")
def unit_range_join(spark, sf):
    events = _events(spark, sf).withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long"))
    span = events.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    units = span.where("a is not null").select("a", F.posexplode(F.sequence("a", "b", F.lit(5).cast("long"))).alias("i", "first_day")).select(F.col("i").cast("long").alias("unit_id"), "first_day", (F.col("first_day") + 6).alias("last_day"))
    return chronology.in_units(events, units)


@query(f"""WITH {EVENTS}, o AS (SELECT subject, arg_max(kind, (ts, event_id)) AS last_kind, arg_max(event_id, (ts, event_id)) AS last_id, arg_max(event_id, (ts, event_id)) FILTER (WHERE kind = 'error') AS opened_event FROM ev WHERE kind IN ('error', 'purchase') GROUP BY 1)
SELECT subject, CASE WHEN last_kind = 'error' THEN 'open' ELSE 'resolved' END AS status, opened_event, CASE WHEN last_kind = 'purchase' THEN last_id END AS resolved_event FROM o WHERE opened_event IS NOT NULL""")
def thread_status(spark, sf):
    return chronology.threads(_events(spark, sf), "error", "purchase")


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS back FROM ev)
SELECT subject, count(*) AS n_events, arg_max(event_id, (ts, event_id)) AS through_event, arg_max(place, (ts, event_id)) FILTER (WHERE place IS NOT NULL) AS last_place, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (WHERE back <= 12) AS recent_events FROM r GROUP BY 1""")
def character_state_fold(spark, sf):
    return chronology.character_states(_events(spark, sf))


@query(f"""WITH {EVENTS}, f AS (SELECT subject, count(DISTINCT event_id) * 5 + sum(round(c_acctbal, 2)) * 2 + greatest(0, 30 - min(epoch_us(ts) // 86400000000 - 19000)) AS score, count(*) AS n FROM ev JOIN customer ON c_custkey = subject GROUP BY 1)
SELECT subject, round(score, 2) AS score, n FROM f ORDER BY score DESC, subject LIMIT 20""")
def main_subject_score(spark, sf):
    # The sum runs over joined rows, so a subject's balance counts once for each event: meant so.
    rows = _events(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.col("subject") == F.col("c_custkey"))
    first = F.min(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000) - 19000)
    score = F.countDistinct("event_id") * 5 + F.sum(F.round("c_acctbal", 2)) * 2 + F.greatest(F.lit(0), F.lit(30) - first)
    return rows.groupBy("subject").agg(F.round(score, 2).alias("score"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"), "subject").limit(20)


@query()
def chronology_dag(spark, sf):
    events = _events(spark, sf)
    w = Window.partitionBy("subject").orderBy("event_id")
    edges = events.select("subject", F.col("event_id").alias("edge_id"), F.col("event_id").alias("earlier"), F.lead("event_id", 2).over(w).alias("later"), (F.abs("value") % 1).alias("confidence"), F.lag("event_id", 3).over(w).alias("back"))
    edges = edges.select("subject", "edge_id", "earlier", F.when(F.col("edge_id") % 7 == 0, F.col("back")).otherwise(F.col("later")).alias("later"), "confidence").where("later is not null")
    narrative = F.row_number().over(Window.partitionBy("subject").orderBy("ts", "event_id"))
    return graph.order_events(events.select("subject", "event_id", narrative.cast("long").alias("narrative")), edges, "subject")


# Measures


@query(f"""WITH {EVENTS}, a AS (SELECT count(*) AS events, count(place) AS located, count(*) FILTER (WHERE target IS NULL) AS unlinked, count(DISTINCT subject) AS subjects FROM ev), b AS (SELECT count(*) AS docs, count(DISTINCT text) AS distinct_texts FROM documents), c AS (SELECT count(*) AS labelled, sum(quality) AS good, sum(toxic) AS toxic FROM labels)
SELECT 'events' AS metric, CAST(events AS DOUBLE) AS value FROM a UNION ALL SELECT 'location_coverage_pct', round(located / events * 100, 2) FROM a UNION ALL SELECT 'unlinked_events', unlinked FROM a UNION ALL SELECT 'subjects', subjects FROM a
UNION ALL SELECT 'documents', docs FROM b UNION ALL SELECT 'distinct_text_pct', round(distinct_texts / docs * 100, 2) FROM b UNION ALL SELECT 'labelled', labelled FROM c UNION ALL SELECT 'good_pct', round(good / labelled * 100, 2) FROM c UNION ALL SELECT 'toxic_pct', round(toxic / labelled * 100, 2) FROM c""")
def quality_report(spark, sf):
    n = F.count(F.lit(1))
    a = measures.stacked(_events(spark, sf), {"events": n, "location_coverage_pct": measures.percentage(F.count("place"), n), "unlinked_events": F.count_if(F.col("target").isNull()), "subjects": F.countDistinct("subject")})
    b = measures.stacked(table(spark, sf, "documents").select("text"), {"documents": n, "distinct_text_pct": measures.percentage(F.countDistinct(F.sha2("text", 256)), n)})
    c = measures.stacked(table(spark, sf, "labels"), {"labelled": n, "good_pct": measures.percentage(F.sum("quality"), n), "toxic_pct": measures.percentage(F.sum("toxic"), n)})
    return measures.report(a, b, c)


@query("""WITH c AS (SELECT d.source AS suite, d.n_chars = length(d.text) AND l.quality = 1 AS passed, l.toxic = 1 AS critical FROM labels l JOIN documents d USING (doc_id)), g AS (
  SELECT suite, count(*) AS n_cases, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS n_passed, CAST(sum(CASE WHEN critical AND NOT passed THEN 1 ELSE 0 END) AS BIGINT) AS n_critical_failures FROM c GROUP BY 1)
SELECT *, round(n_passed / n_cases * 100, 2) AS accuracy_pct, n_cases >= 25 AND round(n_passed / n_cases * 100, 2) >= 95.0 AND n_critical_failures = 0 AS gate_open FROM g""")
def benchmark_eval(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") == F.length("text")).alias("whole"))
    cases = table(spark, sf, "labels").join(docs, "doc_id").select(F.col("source").alias("suite"), (F.col("whole") & (F.col("quality") == 1)).alias("passed"), (F.col("toxic") == 1).alias("critical"))
    return measures.evaluation(cases)


@query(f"""WITH t AS (SELECT conv_id, CAST(sum(CASE WHEN role = 'system' THEN ceil(length(text) / {TOKEN_CHARS}) ELSE 0 END) AS BIGINT) AS hit, CAST(sum(CASE WHEN role = 'user' THEN ceil(length(text) / {TOKEN_CHARS}) ELSE 0 END) AS BIGINT) AS miss, CAST(sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / {TOKEN_CHARS}) ELSE 0 END) AS BIGINT) AS out FROM conversations GROUP BY 1)
SELECT conv_id, hit, miss, out, round((hit * 0.07 + miss * 0.27 + out * 1.1) / 1000000, 8) AS cost_usd FROM t""")
def cost_ledger(spark, sf):
    n = F.ceil(F.length("text") / TOKEN_CHARS)
    of = lambda role: F.sum(F.when(F.col("role") == role, n).otherwise(0)).cast("long")
    sums = table(spark, sf, "conversations").groupBy("conv_id").agg(of("system").alias("hit"), of("user").alias("miss"), of("assistant").alias("out"))
    return sums.withColumn("cost_usd", measures.cost(F.col("hit"), F.col("miss"), F.col("out"), F.lit(0.07), F.lit(0.27), F.lit(1.1)))


@query("""WITH r AS (SELECT lang, ceil(length(text) / 4) / greatest(len(string_split(text, ' ')), 1) AS r FROM documents)
SELECT lang, count(*) AS n_samples, round(median(r), 6) AS median_ratio, round(quantile_cont(r, 0.9), 6) AS p90_ratio FROM r GROUP BY 1""")
def cost_forecast(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    words = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    return measures.ratios(docs, ["lang"], F.ceil(F.length("text") / 4) / F.greatest(words, F.lit(1)))


@query("""WITH e AS (SELECT doc_id, CAST(ceil(length(text) * CAST(1.1 AS DOUBLE)) AS BIGINT) AS body, CAST(ceil(n_chars * CAST(0.65 AS DOUBLE)) AS BIGINT) AS ctx FROM documents)
SELECT doc_id, greatest(1200, body + ctx + 20000) AS input_tokens, least(greatest(body + 1600, 1200), 10240) AS output_tokens, (body + ctx + 20000) * 1.2 <= 30000 AS within_budget FROM e""")
def cost_estimate(spark, sf):
    tokens_in, tokens_out = measures.estimate(F.length("text"), F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens")).withColumn("within_budget", measures.within_budget(F.col("input_tokens"), F.lit(30000)))


# Incremental updates


VERSIONS = """old AS (SELECT conv_id AS book_id, CAST(turn AS BIGINT) AS ordinal, 't' || turn AS title, sha256(conv_id || ':' || turn || text) AS h FROM conversations),
new AS (SELECT book_id, ordinal, CASE WHEN ordinal % 5 = 1 THEN title || '*' ELSE title END AS title, CASE WHEN ordinal % 7 = 3 THEN h || 'x' ELSE h END AS h FROM old WHERE NOT (book_id % 4 = 0 AND ordinal = 2)
  UNION ALL SELECT DISTINCT book_id, CAST(1000 AS BIGINT), 'added', 'new' FROM old WHERE book_id % 3 = 0)"""


def _versions(spark, sf):
    rows = table(spark, sf, "conversations")
    old = rows.select(F.col("conv_id").alias("book_id"), F.col("turn").cast("long").alias("ordinal"), F.concat(F.lit("t"), "turn").alias("title"), F.sha2(F.concat("conv_id", F.lit(":"), "turn", "text"), 256).alias("content_hash"))
    new = old.where("not (book_id % 4 = 0 and ordinal = 2)").withColumn("title", F.when(F.col("ordinal") % 5 == 1, F.concat("title", F.lit("*"))).otherwise(F.col("title"))).withColumn("content_hash", F.when(F.col("ordinal") % 7 == 3, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    added = old.where("book_id % 3 = 0").select("book_id").dropDuplicates().select("book_id", F.lit(1000).cast("long").alias("ordinal"), F.lit("added").alias("title"), F.lit("new").alias("content_hash"))
    return old, new.unionByName(added)


@query(f"""WITH {VERSIONS}, j AS (SELECT coalesce(o.book_id, n.book_id) AS book_id, o.ordinal AS old_ordinal, n.ordinal AS new_ordinal, o.title AS ot, n.title AS nt, o.h AS oh, n.h AS nh FROM old o FULL JOIN new n ON n.book_id = o.book_id AND n.ordinal = o.ordinal)
SELECT book_id, old_ordinal, new_ordinal, CASE WHEN old_ordinal IS NULL THEN 'inserted' WHEN new_ordinal IS NULL THEN 'removed' WHEN oh = nh AND ot = nt THEN 'unchanged' WHEN oh = nh THEN 'renamed' WHEN ot = nt THEN 'modified' END AS change FROM j""")
def update_plan(spark, sf):
    return incremental.plan(*_versions(spark, sf))


@query(f"""WITH {VERSIONS}, d AS (SELECT coalesce(o.book_id, n.book_id) AS book_id, coalesce(o.ordinal, n.ordinal) AS ordinal, o.h IS NOT DISTINCT FROM n.h AS same FROM old o FULL JOIN new n ON n.book_id = o.book_id AND n.ordinal = o.ordinal)
SELECT book_id, coalesce(min(ordinal) FILTER (WHERE NOT same), count(*)) AS n_common FROM d GROUP BY 1""")
def common_prefix(spark, sf):
    return incremental.common_prefix(*_versions(spark, sf))


@query("""WITH c AS (SELECT conv_id, turn FROM conversations WHERE length(text) % 7 = 0)
SELECT DISTINCT a.conv_id, a.turn FROM conversations a JOIN c ON c.conv_id = a.conv_id AND abs(c.turn - a.turn) <= 1""")
def neighbour_scope(spark, sf):
    return incremental.neighbours(table(spark, sf, "conversations"), F.length("text") % 7 == 0, "conv_id", "turn")


@query("""WITH o AS (SELECT DISTINCT 'doc:' || doc_id AS task_key, CASE WHEN doc_id % 2 = 0 THEN 'done' ELSE 'open' END AS was FROM labels WHERE quality = 0), n AS (SELECT 'doc:' || doc_id AS task_key, CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END AS severity FROM labels WHERE toxic = 1)
SELECT coalesce(o.task_key, n.task_key) AS task_key, severity, CASE WHEN n.task_key IS NULL THEN 'auto_closed' WHEN was IS NULL THEN 'open' ELSE was END AS status FROM o FULL JOIN n ON n.task_key = o.task_key""")
def review_task_sync(spark, sf):
    labels = table(spark, sf, "labels")
    key = F.concat(F.lit("doc:"), F.col("doc_id")).alias("task_key")
    old = labels.where("quality = 0").select(key, F.when(F.col("doc_id") % 2 == 0, "done").otherwise("open").alias("status")).dropDuplicates()
    new = labels.where("toxic = 1").select(key, F.when(F.col("toxic") == 1, "high").otherwise("low").alias("severity"))
    return incremental.sync_tasks(old, new)


# Geometry and similarity


XY = "p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 1000.0 AS x, CAST(embedding[2] AS DOUBLE) * 1000.0 AS y FROM embeddings), q AS (SELECT *, lead(x) OVER (ORDER BY vec_id) - x AS dx, lead(y) OVER (ORDER BY vec_id) - y AS dy FROM p)"


def _steps(spark, sf):
    p = table(spark, sf, "embeddings").select("vec_id", (F.col("embedding")[0] * F.lit(1000.0)).alias("x"), (F.col("embedding")[1] * F.lit(1000.0)).alias("y"))
    nxt = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return p.join(nxt, "vec_id").select("vec_id", (F.col("nx") - F.col("x")).alias("dx"), (F.col("ny") - F.col("y")).alias("dy"))


@query(f"WITH {XY} SELECT vec_id, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dy / sqrt(dx * dx + dy * dy) END, 6) AS cosine, dy / sqrt(dx * dx + dy * dy) >= 0.15 AS holds FROM q WHERE dx IS NOT NULL")
def direction_gate(spark, sf):
    return _steps(spark, sf).select("vec_id", F.round(graph.cosine_to(F.col("dx"), F.col("dy"), 0.0, 1.0), 6).alias("cosine"), graph.direction_holds(F.col("dx"), F.col("dy"), 0.0, 1.0).alias("holds"))


@query(f"WITH {XY} SELECT vec_id, round(sqrt(dx * dx + dy * dy), 4) AS distance, sqrt(dx * dx + dy * dy) <= 280 AS holds FROM q WHERE dx IS NOT NULL")
def near_gate(spark, sf):
    return _steps(spark, sf).select("vec_id", F.round(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), 4).alias("distance"), graph.near_holds(F.col("dx"), F.col("dy")).alias("holds"))


@query("SELECT s_suppkey, round(76.0 + 0 * s_suppkey, 1) AS margin, round((CAST(CAST('0x' || substr(sha256(s_name), 1, 8) AS BIGINT) AS DOUBLE) * 4294967296.0 + CAST('0x' || substr(sha256(s_name), 9, 8) AS BIGINT)) / 18446744073709551615.0, 9) AS unit FROM supplier")
def stable_unit_hash(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.lit(76.0).alias("margin"), F.round(fx.unit_float(F.col("s_name")), 9).alias("unit"))


@query(r"""WITH t AS (SELECT item_id, lower(regexp_replace(text, '\s+', '', 'g')) AS s FROM benchmark), g AS (SELECT DISTINCT item_id, substr(s, i, 3) AS gram FROM (SELECT item_id, s, unnest(range(1, greatest(length(s) - 1, 1))) AS i FROM t)), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.item_id AS left_id, b.item_id AS right_id, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND b.item_id = a.item_id + 1 GROUP BY 1, 2)
SELECT x.item_id AS left_id, x.item_id + 1 AS right_id, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 6) AS similarity FROM n x JOIN n y ON y.item_id = x.item_id + 1 LEFT JOIN p ON p.left_id = x.item_id""")
def trigram_jaccard(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", fx.trigrams(F.col("text")).alias("g"))
    nxt = t.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return t.join(nxt, "item_id").select(F.col("item_id").alias("left_id"), (F.col("item_id") + 1).alias("right_id"), F.round(fx.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


# Curation, ledgers and maps


@query("""WITH e AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'part' ELSE 'supplier' END AS target_type, CAST(json_extract(props, '$.k') AS BIGINT) AS target_id, user_id % 50 AS segment_id, CASE WHEN value > 20 THEN event_id END AS run_id FROM events),
r AS (SELECT user_id % 50 AS segment_id, arg_max(event_id, (ts, event_id)) AS late FROM events WHERE event_type = 'error' AND user_id % 50 < 40 GROUP BY 1),
s AS (SELECT target_type, target_id, count(*) AS n, count(coalesce(run_id, late)) AS t FROM e LEFT JOIN r USING (segment_id) GROUP BY 1, 2),
f AS (SELECT 'part' AS target_type, p_partkey AS target_id FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier)
SELECT target_type, target_id, coalesce(n, 0) AS n_evidence, coalesce(t, 0) AS n_traced, CASE WHEN n IS NULL THEN 'none' WHEN n = t THEN 'complete' ELSE 'legacy' END AS trace_status FROM f LEFT JOIN s USING (target_type, target_id)""")
def evidence_drill_down(spark, sf):
    ev = _events(spark, sf)
    segment = (F.col("subject") % 50).alias("segment_id")
    evidence_ = ev.select(F.when(F.col("kind").isin("view", "click"), "part").otherwise("supplier").alias("target_type"), F.col("target").alias("target_id"), segment, F.when(F.col("value") > 20, F.col("event_id")).alias("run_id"))
    results = ev.where("kind = 'error' and subject % 50 < 40").select(segment, F.struct("ts", "event_id").alias("at"), F.col("event_id").alias("run_id"))
    facts = table(spark, sf, "part").select(F.lit("part").alias("target_type"), F.col("p_partkey").alias("target_id")).unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("target_type"), F.col("s_suppkey").alias("target_id")))
    return curation.drill_down(facts, evidence_, results)


@query("""WITH n AS (SELECT p_partkey AS claim_id, CASE WHEN p_size % 2 = 0 THEN 'original_text' ELSE 'note' END AS origin, p_size AS fs FROM part), e AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS claim_id, count(*) AS k FROM events WHERE user_id <= 30 GROUP BY 1)
SELECT claim_id, origin, coalesce(k, 0) AS n_evidence FROM n LEFT JOIN e USING (claim_id) WHERE fs <= 30 AND (origin <> 'original_text' OR k > 0)""")
def claim_context(spark, sf):
    claims = table(spark, sf, "part").select(F.col("p_partkey").alias("claim_id"), F.when(F.col("p_size") % 2 == 0, "original_text").otherwise("note").alias("origin"), F.col("p_size").alias("first_segment"))
    return curation.claim_context(claims, _events(spark, sf).select(F.col("target").alias("claim_id"), F.col("subject").alias("segment")), 30)


@query("""WITH n AS (SELECT p_partkey AS note_id, CASE WHEN p_partkey % 10 = 0 THEN 'synthesis' ELSE 'raw' END AS origin, p_size AS fs FROM part), c AS (SELECT p_partkey AS raw_id, p_partkey - p_partkey % 10 AS synthesis_id FROM part WHERE p_partkey % 10 BETWEEN 1 AND 4)
SELECT note_id, origin FROM n WHERE fs <= 30 AND note_id NOT IN (SELECT raw_id FROM c JOIN n ON note_id = synthesis_id WHERE fs <= 30)""")
def visible_notes(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    notes = p.select(k.alias("note_id"), F.when(k % 10 == 0, "synthesis").otherwise("raw").alias("origin"), F.col("p_size").alias("first_segment"))
    covers = p.where((k % 10).between(1, 4)).select(k.alias("raw_id"), (k - k % 10).alias("synthesis_id"))
    return curation.visible_notes(notes, covers, 30).select("note_id", "origin")


@query("""WITH r AS (SELECT o_orderkey, o_orderdate AS f, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 90 DAY END AS t FROM orders)
SELECT o_orderkey FROM r WHERE f <= TIMESTAMP '1996-06-01' AND (t IS NULL OR t >= TIMESTAMP '1996-06-01')""")
def effective_interval(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("effective_from"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("effective_to"))
    return curation.effective(rows, F.lit("1996-06-01").cast("timestamp_ntz")).select("o_orderkey")


@query("""SELECT p_brand AS cluster_id, max(p_size) AS importance, CAST(min(p_partkey) AS BIGINT) AS first_segment, count(*) AS n_evidence, arg_max(p_name, (p_size, -p_partkey)) AS name, arg_min(p_type, (-length(p_type), p_type)) AS summary,
  coalesce(array_to_string(list_sort(list_filter(list_distinct(list(p_name)), lambda x: x <> arg_max(p_name, (p_size, -p_partkey)))), '; '), '') AS aliases FROM part GROUP BY 1""")
def merged_attributes(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_size").alias("importance"), F.col("p_partkey").alias("first_segment"), F.lit(1).alias("n_evidence"), F.col("p_type").alias("summary"))
    return curation.merge_attributes(p)


@query("SELECT * FROM (SELECT user_id AS subject, event_id AS earlier, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events) WHERE later IS NOT NULL")
def adjacent_pairs(spark, sf):
    return curation.adjacent_pairs(_events(spark, sf), "subject", "ts", "event_id")


@query("""SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) + 1 AS BIGINT) AS part, CAST(ceil(count(*) OVER (PARTITION BY conv_id) / 3) AS BIGINT) AS n_parts FROM conversations""")
def parts_of(spark, sf):
    return curation.parts(table(spark, sf, "conversations"), "conv_id", "turn", 3)


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS o1, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS n1, c_nationkey AS o2, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS n2 FROM customer)
SELECT c_custkey, 'c_mktsegment' AS field, o1 AS old_value, n1 AS new_value FROM c WHERE o1 IS DISTINCT FROM n1 UNION ALL SELECT c_custkey, 'c_nationkey', CAST(o2 AS VARCHAR), CAST(n2 AS VARCHAR) FROM c WHERE o2 IS DISTINCT FROM n2""")
def correction_log(spark, sf):
    old = table(spark, sf, "customer")
    k = F.col("c_custkey")
    new = old.withColumn("c_mktsegment", F.when(k % 7 != 0, F.col("c_mktsegment"))).withColumn("c_nationkey", F.when(k % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return curation.field_changes(old, new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("""WITH c AS (SELECT event_type AS provider, ts, event_id, value <= 100 AS ok FROM events), g AS (SELECT provider, max((ts, event_id)) AS good FROM c WHERE ok GROUP BY 1),
h AS (SELECT provider, count(*) AS n_calls, count(*) FILTER (WHERE NOT ok) AS n_failed, count(*) FILTER (WHERE NOT ok AND (good IS NULL OR (ts, event_id) > good)) AS n_in_row, max(ts) AS t FROM c LEFT JOIN g USING (provider) GROUP BY 1)
SELECT provider, n_calls, n_failed, n_in_row, CASE WHEN n_in_row >= 1 THEN epoch_us(t + INTERVAL 30 MINUTE) END AS rests_until_us FROM h""")
def provider_health(spark, sf):
    calls = _events(spark, sf).select(F.col("kind").alias("provider"), F.col("ts").alias("at"), F.col("event_id").alias("call_id"), (F.col("value") <= 100).alias("ok"))
    got = curation.provider_health(calls, failures=1)
    return got.withColumn("rests_until_us", F.unix_micros(F.col("rests_until").cast("timestamp"))).drop("rests_until")


@query("""WITH l AS (SELECT o_custkey AS job_id, count(*) AS n, CAST(sum(o_orderkey % 100) AS BIGINT) AS t, count(*) FILTER (WHERE o_orderkey % 9 <> 0) AS p, sum(CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 1000) / 8.0 END) AS c FROM orders GROUP BY 1)
SELECT c_custkey AS job_id, coalesce(n, 0) AS n_calls, coalesce(t, 0) AS tokens, round(CASE WHEN n > 0 AND n = p THEN c ELSE c_nationkey / 4.0 END, 8) AS cost FROM customer LEFT JOIN l ON job_id = c_custkey""")
def job_rollup(spark, sf):
    k = F.col("o_orderkey")
    calls = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), (k % 100).alias("tokens"), F.when(k % 9 != 0, (k % 1000) / 8.0).alias("cost"))
    return curation.job_rollup(table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_nationkey") / 4.0).alias("estimate")), calls)


@query("""WITH r AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id % 17 + 1 AS p, event_id % 23 + 1 AS a FROM events), u AS (SELECT subject, median(a / p) AS m FROM r WHERE pos <= 10 GROUP BY 1),
l AS (SELECT subject, count(*) AS n_held_out, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(a) AS DOUBLE) AS a FROM r WHERE pos BETWEEN 11 AND 50 GROUP BY 1)
SELECT subject, n_held_out, round(m, 6) AS ratio, round(abs(p * m - a) / a, 6) AS error, abs(p * m - a) / a <= 0.25 AS holds FROM l JOIN u USING (subject)""")
def forecast_backtest(spark, sf):
    rows = _events(spark, sf).withColumn("p", F.col("event_id") % 17 + 1).withColumn("a", F.col("event_id") % 23 + 1)
    return curation.backtest(rows, "subject", ["ts", "event_id"], "p", "a")


@query("""WITH c AS (SELECT source AS book_id, quality = 1 AS passed, doc_id % 4 = 0 AS h FROM labels JOIN documents USING (doc_id)), b AS (SELECT book_id, count(*) AS n, count(*) FILTER (WHERE h) AS h, count(*) FILTER (WHERE h AND passed) AS ok FROM c GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_cases, count(*) AS n_books, min(n) AS least_per_book, round(sum(h) / sum(n), 6) AS held_out_share, round(sum(ok) / sum(h), 6) AS held_out_accuracy, sum(n) >= 300 AND count(*) >= 12 AND min(n) >= 25 AND sum(h) / sum(n) >= 0.2 AND sum(ok) / sum(h) >= 0.95 AS gate_open FROM b""")
def release_gate(spark, sf):
    cases = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("book_id")), "doc_id")
    return curation.release_gate(cases.select("book_id", (F.col("quality") == 1).alias("passed"), (F.col("doc_id") % 4 == 0).alias("held_out")))


@query("""WITH t AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'), s AS (SELECT s_suppkey AS node, s_nationkey FROM supplier)
SELECT node, CASE WHEN node IN (SELECT k FROM t) THEN 'connected' WHEN s_nationkey % 3 = 0 AND node % 2 = 0 THEN 'isolated' ELSE 'pending' END AS state FROM s""")
def connectivity_states(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey")
    t = _events(spark, sf).where("kind = 'purchase'").select(F.col("target").alias("a"), F.col("target").alias("b"))
    reviews = s.where("s_nationkey % 3 = 0").select("node", F.lit("isolated").alias("verdict"), F.when(F.col("node") % 2 == 0, 5).otherwise(4).alias("n_segments"))
    return curation.connectivity(s, t, reviews, 5)


@query("""WITH k AS (SELECT user_id AS entity_id, max(event_id) AS l FROM events GROUP BY 1) SELECT event_id AS decision_id, l = event_id AS can_undo FROM events JOIN k ON entity_id = user_id""")
def undoable_merges(spark, sf):
    ev = _events(spark, sf).select(F.col("event_id").alias("decision_id"), F.col("subject").alias("entity_id"))
    return curation.undoable(ev, ev)


@query("""WITH e AS (SELECT user_id AS book_id, event_id, event_type AS title FROM events), m AS (SELECT e.book_id, e.event_id, e.title, CASE WHEN e.event_id % 3 = 0 THEN 'before' ELSE 'after' END AS rel, max(o.event_id) AS other FROM e JOIN e o ON o.book_id = e.book_id AND o.title = e.title AND o.event_id <> e.event_id WHERE e.event_id % 3 < 2 GROUP BY ALL)
SELECT book_id, CASE WHEN rel = 'before' THEN event_id ELSE other END AS earlier, CASE WHEN rel = 'before' THEN other ELSE event_id END AS later FROM m""")
def reference_edges(spark, sf):
    ev = _events(spark, sf).select(F.col("subject").alias("book_id"), "event_id", F.col("kind").alias("title"))
    k = F.col("event_id") % 3
    return curation.reference_edges(ev.withColumn("relation", F.when(k == 0, "before").when(k == 1, "after").otherwise("same")), ev)


@query("""SELECT CAST(c_nationkey AS BIGINT) AS book_id, c_mktsegment AS name, CAST(min(c_custkey) AS BIGINT) AS first_segment, 0.65 AS importance FROM customer WHERE NOT (c_nationkey % 2 = 0 AND c_mktsegment LIKE 'A%') GROUP BY 1, 2""")
def missing_places(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("book_id"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("segment"))
    return curation.missing_places(c, c.where("book_id % 2 = 0 and name like 'A%'"))


@query("""SELECT p_partkey, greatest(68.0, least(190.0, w * 12.0 + (n - w) * 7.2)) AS width FROM (SELECT p_partkey, length(p_name) AS n, length(regexp_replace(p_name, '[\\x00-\\x7F]', '', 'g')) AS w FROM part)""".replace("\\\\", "\\"))
def label_widths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", topics.label_width(F.col("p_name")).alias("width"))


@query("""WITH b AS (SELECT s_suppkey AS i, s_suppkey * 37 % 1000 * 1.0 AS x, s_suppkey * 91 % 997 * 1.0 AS y, 60.0 + s_suppkey % 13 AS w FROM supplier)
SELECT a.i AS left_id, b.i AS right_id, round((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.w, b.y + b.w) - greatest(a.y, b.y)) / least(a.w * a.w, b.w * b.w), 6) AS ratio
FROM b a JOIN b ON a.i < b.i AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.w, b.y + b.w) > greatest(a.y, b.y)""")
def box_overlaps(spark, sf):
    k = F.col("s_suppkey")
    b = table(spark, sf, "supplier").select(k.alias("box_id"), (k * 37 % 1000).cast("double").alias("x0"), (k * 91 % 997).cast("double").alias("y0"), (F.lit(60.0) + k % 13).alias("w"))
    return layout.overlaps(b.select("box_id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("w")).alias("y1")), 80.0)


@query()
def map_layout(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("book_id"), F.col("s_suppkey").alias("place_id"))
    nxt = F.lead("place_id").over(Window.partitionBy("book_id").orderBy("place_id"))
    return layout.layout(s, s.select("book_id", F.col("place_id").alias("a"), nxt.alias("b"), F.when(F.col("place_id") % 5 == 0, "near").otherwise("route").alias("kind")).where("b is not null"))


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name, c_nationkey + 1, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 = 0""")
def keyed_upsert(spark, sf):
    c = table(spark, sf, "customer")
    return sinks.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_nationkey", F.col("c_nationkey") + 1), ["c_custkey"])


@query("""SELECT doc_id AS book_id, CAST(0 AS BIGINT) AS ordinal, trim(regexp_extract(coalesce(text, ''), '^\\s*([^.!?。！？]*[.!?。！？]?)', 1)) AS event FROM documents""".replace("\\\\", "\\"))
def offline_events(spark, sf):
    return sinks.first_sentences(table(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), F.lit(0).cast("long").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text")))


@query("""SELECT CAST(i AS BIGINT) AS ordinal, CAST(i % 60 AS BIGINT) AS lead, CAST((i + 1) % 60 AS BIGINT) AS partner, CAST(i % 12 AS BIGINT) AS from_place, CAST((i + 1) % 12 AS BIGINT) AS to_place, i % 7 = 3 AS flashback, CASE WHEN i % 7 = 3 THEN greatest(0, i - 12) + 0.25 ELSE i END AS story_order FROM range(120) t(i)""")
def generated_book(spark, sf):
    return sinks.generated_book(spark, 120).select("ordinal", "lead", "partner", "from_place", "to_place", "flashback", "story_order")


# Repairs


@query("""WITH p AS (SELECT CAST(s_nationkey AS VARCHAR) AS name, min(s_suppkey) AS id FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1)
SELECT CAST(-1 - id AS BIGINT) AS source, CAST(n_nationkey AS BIGINT) AS target, regexp_extract(n_name, '^([A-Z]+)_', 1) AS predicate, CAST(0.98 AS DOUBLE) AS confidence FROM nation JOIN p ON regexp_extract(n_name, '_([0-9]+)$', 1) = name""")
def kin_claims(spark, sf):
    entities = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("name"))
    persons = table(spark, sf, "supplier").select((F.lit(-1) - F.col("s_suppkey")).cast("long").alias("entity_id"), F.col("s_nationkey").cast("string").alias("name"))
    return repair.kin_claims(entities, persons, r"^([A-Z]+)_([0-9]+)$", owner=2, kin=1)


SAID = "([A-Za-z]+) (of|in|and) ([A-Za-z]+)"


@query(f"""WITH s AS (SELECT conv_id, unnest(regexp_extract_all(text, '{SAID}')) AS x FROM conversations), p AS (SELECT conv_id, regexp_extract(x, '{SAID}', 1) AS source, regexp_extract(x, '{SAID}', 2) AS predicate, regexp_extract(x, '{SAID}', 3) AS target FROM s),
k AS (SELECT DISTINCT regexp_extract(text, '^[^ ]+') AS name FROM benchmark)
SELECT source, predicate, target, CAST(min(conv_id) AS BIGINT) AS first_segment, count(*) AS n_evidence, source NOT IN (SELECT name FROM k) AS new_source, target NOT IN (SELECT name FROM k) AS new_target FROM p WHERE source <> target GROUP BY 1, 2, 3""")
def said_relations(spark, sf):
    segments = table(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("segment"), "text")
    return repair.said_relations(segments, SAID, 1, 2, 3, table(spark, sf, "benchmark").select(F.regexp_extract("text", "^[^ ]+", 0).alias("name")))


@query("SELECT d.doc_id, CAST(min(b.item_id) AS BIGINT) AS item_id FROM documents d JOIN benchmark b ON instr(d.text, trim(b.text)) > 0 GROUP BY 1 HAVING count(DISTINCT b.item_id) = 1")
def location_backfill(spark, sf):
    return repair.sole_value(evidence.locate(table(spark, sf, "documents"), table(spark, sf, "benchmark")), "doc_id", "item_id")


@query("""WITH s AS (SELECT conv_id, lower(unnest(regexp_extract_all(text, ' at ([A-Za-z]+)', 1))) AS place FROM conversations) SELECT conv_id, min(place) AS place FROM s GROUP BY 1 HAVING count(DISTINCT place) = 1""")
def scene_places(spark, sf):
    return repair.scenes(table(spark, sf, "conversations"), "conv_id", "text", " at ([A-Za-z]+)")


@query("""WITH c AS (SELECT CAST(user_id * 100 + day(ts) AS BIGINT) AS event_id, CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS p, value > 150 AS titled FROM events), g AS (SELECT event_id, bool_or(titled) AS t FROM c GROUP BY 1)
SELECT event_id, min(p) AS place, CASE WHEN t THEN 'title' ELSE 'quote' END AS basis FROM c JOIN g USING (event_id) WHERE titled = t GROUP BY event_id, t HAVING count(DISTINCT p) = 1""")
def repaired_locations(spark, sf):
    c = table(spark, sf, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).cast("long").alias("event_id"), F.col("event_type").alias("place"), (F.col("value") > 150).alias("titled"))
    return repair.repaired_locations(c, spark.createDataFrame([("click", "view")], "place string, canonical_place string"))


@query("""WITH m AS (SELECT c_custkey AS old, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS new FROM customer)
SELECT DISTINCT CAST(coalesce(new, o_custkey) AS BIGINT) AS target_id, o_orderpriority AS quote FROM orders LEFT JOIN m ON o_custkey = old""")
def moved_evidence(spark, sf):
    c = table(spark, sf, "customer")
    least = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").cast("long").alias("new"))
    mapping = c.join(least, ["c_nationkey", "c_mktsegment"]).select(F.col("c_custkey").cast("long").alias("old"), "new")
    return repair.moved(table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("target_id"), F.col("o_orderpriority").alias("quote")), mapping, "target_id")


HITS = "h AS (SELECT d.doc_id, b.item_id, instr(d.text, trim(b.text)) - 1 AS s, instr(d.text, trim(b.text)) - 1 + length(trim(b.text)) AS e, length(d.text) AS n, d.text FROM documents d JOIN benchmark b ON instr(d.text, trim(b.text)) > 0)"


@query(f"""WITH {HITS}, w AS (SELECT doc_id, item_id, greatest(s - 240, 0) AS s, least(e + 240, n) AS e FROM h), f AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY doc_id ORDER BY s, e, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS f FROM w),
g AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY s, e, item_id ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT doc_id AS segment, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", count(DISTINCT item_id) AS n_targets FROM g GROUP BY doc_id, g""")
def mention_windows(spark, sf):
    docs = table(spark, sf, "documents")
    found = evidence.locate(docs, table(spark, sf, "benchmark"))
    hits = docs.select("doc_id", F.length("text").cast("long").alias("length")).join(found, "doc_id")
    return repair.mention_windows(hits.select(F.col("doc_id").alias("segment"), F.col("item_id").alias("target"), F.col("quote_start").alias("start"), F.col("quote_end").alias("end"), "length"), least=1)


@query(f"""WITH {HITS}, r AS (SELECT item_id, doc_id, substr(text, greatest(s - 90, 0) + 1, s - greatest(s - 90, 0) + 260) AS quote, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM h) SELECT item_id, doc_id, quote, rank FROM r WHERE rank <= 8""")
def completion_candidates(spark, sf):
    docs = table(spark, sf, "documents")
    found = repair.first_per_key(evidence.locate(docs, table(spark, sf, "benchmark")), "item_id", "doc_id", 8)
    start = F.greatest(F.col("quote_start") - 90, F.lit(0))
    return docs.join(found, "doc_id").select("item_id", "doc_id", F.substring("text", (start + 1).cast("int"), (F.col("quote_start") - start + 260).cast("int")).alias("quote"), "rank")


@query("""WITH v AS (SELECT o_custkey AS node, CASE WHEN o_orderstatus = 'P' THEN 'related' WHEN o_orderstatus = 'O' THEN 'isolated' WHEN o_totalprice > 150000 THEN 'unclear' END AS verdict, round(o_totalprice / 1000000, 6) AS c FROM orders)
SELECT CAST(node AS BIGINT) AS node, CASE WHEN bool_or(coalesce(verdict = 'related', false)) THEN 'connected' WHEN count(verdict) < count(*) THEN 'pending' WHEN bool_and(verdict = 'isolated') THEN 'isolated' ELSE 'ambiguous' END AS state,
  coalesce(max(c) FILTER (WHERE verdict = 'related'), min(c)) AS confidence, count(*) AS n_parts FROM v GROUP BY node""")
def audited_nodes(spark, sf):
    verdict = F.when(F.col("o_orderstatus") == "P", "related").when(F.col("o_orderstatus") == "O", "isolated").when(F.col("o_totalprice") > 150000, "unclear")
    return repair.audited(table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("node"), verdict.alias("verdict"), F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence")))


@query("""SELECT p_brand AS suite, count(*) AS n_cases, count(*) FILTER (WHERE p_size > 10) AS n_confirmed, count(*) FILTER (WHERE p_partkey % 5 = 0) AS n_held_out,
  CASE WHEN count(*) FILTER (WHERE p_size > 10) > 0 THEN round(100.0 * count(*) FILTER (WHERE p_size > 10 AND p_retailprice > 905) / count(*) FILTER (WHERE p_size > 10), 1) END AS accuracy FROM part GROUP BY 1""")
def suite_summary(spark, sf):
    p = table(spark, sf, "part")
    return repair.suites(p.select(F.col("p_brand").alias("suite"), F.when(F.col("p_size") > 10, "confirmed").otherwise("candidate").alias("status"), (F.col("p_partkey") % 5 == 0).alias("held_out"), (F.col("p_retailprice") > 905).alias("passed")))


@query("""WITH m AS (SELECT o_custkey AS unit, arg_max(o_orderkey % 40, o_orderkey) AS w FROM orders WHERE o_orderkey % 40 IN (SELECT n_nationkey FROM nation) GROUP BY 1)
SELECT CAST(coalesce(w, c_nationkey) AS BIGINT) AS world, count(*) AS n_units FROM customer LEFT JOIN m ON c_custkey = unit GROUP BY 1""")
def reparented_worlds(spark, sf):
    units = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").cast("long").alias("world"))
    worlds = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("world"))
    moves = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), (F.col("o_orderkey") % 40).cast("long").alias("to_world"), F.col("o_orderkey").alias("at"))
    return repair.reparented(units, worlds, moves).groupBy("world").agg(F.count(F.lit(1)).alias("n_units"))


@query("""WITH d AS (SELECT user_id, arg_max(CASE event_type WHEN 'click' THEN 'contextual' WHEN 'purchase' THEN 'false_positive' WHEN 'error' THEN 'quarantined' END, event_id) FILTER (WHERE event_type IN ('click', 'purchase', 'error')) AS s FROM events GROUP BY 1) SELECT user_id, coalesce(s, 'open') AS status FROM d""")
def settled_conflicts(spark, sf):
    return repair.settled(table(spark, sf, "events"), {"click": "contextual", "purchase": "false_positive", "error": "quarantined"}, "user_id", "event_id", "event_type")


@query("""WITH n AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer) SELECT c_custkey, CASE WHEN n = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || n || ')' END AS shown_title FROM n""")
def numbered_titles(spark, sf):
    return repair.numbered_titles(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment", "c_custkey").select("c_custkey", "shown_title")


@query("""WITH r AS (SELECT c_nationkey, CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR) || '␟' || c_mktsegment), 1, 15) AS BIGINT) AS h FROM customer)
SELECT c_nationkey, count(*) AS n_rows, sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(h) AS VARCHAR)) AS digest FROM r GROUP BY 1""")
def content_digest(spark, sf):
    return repair.content_digest(table(spark, sf, "customer"), "c_nationkey", ["c_custkey", "c_mktsegment"])


@query("""WITH RECURSIVE f AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer), up AS (SELECT k AS move_id, k // 3 AS folder, k AS pos FROM f WHERE k % 4 <> 1 UNION ALL SELECT k, k // 2 + 5, k FROM f WHERE k % 4 = 1
  UNION ALL SELECT move_id, folder, pos // 2 FROM up WHERE pos > 0)
SELECT move_id, folder, move_id AS new_parent FROM up GROUP BY 1, 2 HAVING bool_or(pos = folder)""")
def cyclic_moves(spark, sf):
    k = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    folder = F.when(F.col("k") % 4 != 1, F.expr("k div 3")).otherwise(F.expr("k div 2") + 5)
    return repair.cyclic_moves(k.select(F.col("k").alias("folder"), F.when(F.col("k") > 0, F.expr("k div 2")).alias("parent")), k.select(F.col("k").alias("move_id"), folder.alias("folder"), F.col("k").alias("new_parent")))


@query(f"WITH {HITS}, n AS (SELECT CAST(item_id // 5 AS BIGINT) AS request, doc_id, count(*) AS n_hits FROM h GROUP BY 1, 2) SELECT request, arg_max(doc_id, (n_hits, -doc_id)) AS doc_id, max(n_hits) AS n_hits FROM n GROUP BY 1")
def ledger_replay(spark, sf):
    hits = evidence.locate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return repair.best_segments(hits.withColumn("request", F.expr("item_id div 5")), "request", "doc_id")


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_type END AS p_type, CASE WHEN p_size <= 10 THEN p_retailprice END AS p_retailprice FROM part")
def sealed_answers(spark, sf):
    return repair.hidden(table(spark, sf, "part"), F.col("p_size") > 10, ["p_type", "p_retailprice"]).select("p_partkey", "p_type", "p_retailprice")
