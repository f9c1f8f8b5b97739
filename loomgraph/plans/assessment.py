"""Queries of assessment, updates and repairs over the tables at hand, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import assess, curation, graph
from loomgraph.plans.knowledge import STORY, _story
from loomgraph.plans.registry import VERSIONS, _versions, query
from loomgraph.sources.adapters import table

NOW = "2024-01-20 00:00:00"


@query(f"WITH {STORY}, s AS (SELECT event_id, CASE WHEN kind <> 'view' THEN kind END AS status, CASE WHEN k % 5 = 0 THEN k END AS archived FROM st) SELECT event_id, status FROM s WHERE (status IS NULL OR status <> 'error') AND status IN ('click', 'signup') AND archived IS NULL")
def status_filters(spark, sf):
    rows = _story(spark, sf).select("event_id", F.when(F.col("kind") != "view", F.col("kind")).alias("status"), F.when(F.col("k") % 5 == 0, F.col("k")).alias("archived"))
    return assess.standing(rows, ["click", "signup"], ["error"], archived="archived").drop("archived")


@query(f"""WITH {STORY}, c AS (SELECT 'p' || (entity_id % 60) AS provider, ts, event_id, kind <> 'error' AND k % 3 <> 0 AS ok FROM st), g AS (SELECT provider, max((ts, event_id)) FILTER (WHERE ok) AS good FROM c GROUP BY 1),
h AS (SELECT provider, count(*) FILTER (WHERE NOT ok AND (good IS NULL OR (ts, event_id) > good)) AS n, max(ts) AS last FROM c JOIN g USING (provider) GROUP BY 1), r AS (SELECT 'p' || i AS provider, i % 4 <> 0 AS enabled, i % 7 <> 1 AS eligible FROM (SELECT unnest(range(0, 70)) AS i))
SELECT provider FROM r LEFT JOIN h USING (provider) WHERE enabled AND eligible AND NOT coalesce(n >= 3 AND last + INTERVAL 30 MINUTE > TIMESTAMP '{NOW}', FALSE)""")
def eligible_routes(spark, sf):
    calls = _story(spark, sf).select(F.concat(F.lit("p"), F.col("entity_id") % 60).alias("provider"), F.col("ts").alias("at"), F.col("event_id").alias("call_id"), ((F.col("kind") != "error") & (F.col("k") % 3 != 0)).alias("ok"))
    routes = spark.range(70).select(F.concat(F.lit("p"), "id").alias("provider"), (F.col("id") % 4 != 0).alias("enabled"), (F.col("id") % 7 != 1).alias("eligible"))
    return assess.eligible(routes, curation.provider_health(calls), F.lit(NOW).cast("timestamp_ntz"))


@query(f"""WITH {STORY}, c AS (SELECT 'p' || (entity_id % 40) AS provider, kind = 'purchase' AND entity_id % 40 > 2 AS ok, k * 10.0 AS ms, confidence AS cost FROM st)
SELECT provider, count(*) AS n_calls, round(count(*) FILTER (WHERE ok) / count(*) * 100, 2) AS success_pct, round(median(ms) FILTER (WHERE ok), 3) AS median_ms, CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN round(sum(cost) / count(*) FILTER (WHERE ok), 6) END AS cost_per_ok, count(*) FILTER (WHERE ok) > 0 OR count(*) < 3 AS in_race FROM c GROUP BY 1""")
def provider_race(spark, sf):
    calls = _story(spark, sf).select(F.concat(F.lit("p"), F.col("entity_id") % 40).alias("provider"), ((F.col("kind") == "purchase") & (F.col("entity_id") % 40 > 2)).alias("ok"), (F.col("k") * 10.0).alias("ms"), F.col("confidence").alias("cost"))
    return assess.race(calls)


COUNTS = {
    "n_events": "n", "n_edges": "n div (1 + b % 6)", "n_places": "b % 3", "n_place_edges": "b % 2", "n_pending": "b div 30", "n_nodes": "n", "n_connected": "n - b % 4", "n_isolated": "case when b % 5 = 0 then 0 else b % 4 end", "n_unresolved": "0",
    "n_facts": "n", "n_evidenced": "n - b div 20", "n_conflicts": "b % 2", "n_cases": "n", "n_passed": "n - b % 8", "n_critical_failed": "case when b % 9 = 0 then 1 else 0 end",
}


@query("WITH e AS (SELECT user_id % 40 AS b, count(*) AS n FROM events GROUP BY 1), m AS (SELECT b AS book_id, " + ", ".join(f"{v.replace(' div ', ' // ')} AS {k}" for k, v in COUNTS.items()) + """ FROM e)
SELECT book_id, 'structure' AS gate, (n_events < 5 OR n_edges * 4 >= n_events) AND (n_places < 2 OR n_place_edges > 0) AND n_pending = 0 AND n_connected + n_isolated = n_nodes AND n_unresolved = 0 AS open FROM m
UNION ALL SELECT book_id, 'evidence', n_evidenced = n_facts FROM m UNION ALL SELECT book_id, 'conflicts', n_conflicts = 0 FROM m UNION ALL SELECT book_id, 'accuracy', n_cases >= 20 AND n_passed * 100 >= n_cases * 95 AND n_critical_failed = 0 FROM m""")
def quality_gates(spark, sf):
    counts = table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return assess.gates(counts.select(F.col("b").alias("book_id"), *[F.expr(v).alias(k) for k, v in COUNTS.items()]))


@query(f"""WITH {STORY}, n AS (SELECT c_custkey AS node FROM customer), l AS (SELECT DISTINCT entity_id AS node FROM st WHERE kind = 'purchase' AND k % 9 = 0 UNION SELECT DISTINCT k + 1000 FROM st WHERE kind = 'purchase' AND k % 9 = 0), s AS (SELECT entity_id AS node, min(kind) AS v, min(kind) <> max(kind) AS d FROM st WHERE k = 7 GROUP BY 1)
SELECT n.node, CASE WHEN l.node IS NOT NULL THEN 'connected' WHEN d THEN 'ambiguous' ELSE coalesce(v, 'pending') END AS state FROM n LEFT JOIN l USING (node) LEFT JOIN s USING (node)""")
def scan_states(spark, sf):
    st = _story(spark, sf)
    edges = st.where("kind = 'purchase' and k % 9 = 0").select(F.col("entity_id").alias("a"), (F.col("k") + 1000).alias("b"))
    scans = st.select(F.col("entity_id").alias("node"), F.col("kind").alias("verdict"), F.col("k").alias("n_segments"))
    return assess.scan_states(table(spark, sf, "customer").select(F.col("c_custkey").alias("node")), edges, scans, 7)


@query(f"""WITH {STORY}, al AS (SELECT DISTINCT book_id, entity_id, 'a' || (k % 4) AS alias FROM st), a AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY entity_id, alias) AS pos FROM al), e AS (SELECT book_id, event_id, row_number() OVER w AS pos, lead(event_id) OVER w AS nx FROM st WINDOW w AS (PARTITION BY book_id ORDER BY ordinal, event_id)),
f AS (SELECT book_id, event_id, CASE WHEN pos < 48 THEN nx END AS nx FROM e WHERE pos <= 48), c AS (SELECT book_id, 'identity:' || entity_id || ':' || alias AS case_key, 'identity_same' AS case_type, ['entity:' || entity_id] AS t FROM a WHERE pos <= 40
  UNION ALL SELECT book_id, 'present:' || event_id, 'event_present', ['event:' || event_id] FROM f UNION ALL SELECT book_id, 'order:' || event_id || ':' || nx, 'event_before', ['event:' || event_id, 'event:' || nx] FROM f WHERE nx IS NOT NULL
  UNION ALL SELECT book_id, x, x, [] FROM (SELECT DISTINCT book_id FROM st), (SELECT unnest(['segment_accounting', 'fact_evidence', 'quote_integrity']) AS x)),
q AS (SELECT target, least(count(DISTINCT quote), 2) AS q FROM (SELECT 'entity:' || entity_id AS target, k % 3 AS quote FROM st UNION ALL SELECT 'event:' || event_id, k FROM st WHERE k % 2 = 0) GROUP BY 1), u AS (SELECT case_key, book_id, unnest(t) AS target FROM c), s AS (SELECT book_id, case_key, sum(q) AS n FROM u JOIN q USING (target) GROUP BY 1, 2)
SELECT c.book_id, c.case_key, case_type, CAST(coalesce(n, 0) AS BIGINT) AS n_quotes FROM c LEFT JOIN s ON s.book_id = c.book_id AND s.case_key = c.case_key""")
def mined_cases(spark, sf):
    st = _story(spark, sf)
    aliases = st.select("book_id", "entity_id", F.concat(F.lit("a"), F.col("k") % 4).alias("alias")).dropDuplicates()
    quotes = st.select(F.concat(F.lit("entity:"), "entity_id").alias("target"), (F.col("k") % 3).alias("quote")).unionAll(st.where("k % 2 = 0").select(F.concat(F.lit("event:"), "event_id"), "k"))
    return assess.mined_cases(aliases, st.select("book_id", "event_id", "ordinal"), quotes)


@query(f"""WITH {STORY}, s AS (SELECT 'm' || (entity_id % 12) AS model, event_id, k + 1 AS chars, (k + 1) * (1 + confidence) AS ti, (k + 1) * confidence AS ca, k * confidence / 2 AS t_o FROM st WHERE entity_id % 12 <> 3 AND (entity_id % 12 <> 4 OR event_id < 60)), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY event_id DESC, chars DESC) AS pos FROM s),
g AS (SELECT model, count(*) AS n, median(ti / chars) AS i5, quantile_cont(ti / chars, 0.9) AS i9, median(t_o / chars) AS o5, quantile_cont(t_o / chars, 0.9) AS o9, sum(ca) / sum(ti) AS c FROM r WHERE pos <= 400 GROUP BY 1), m AS (SELECT 'm' || i AS model, 1000 * (i + 1) AS chars FROM (SELECT unnest(range(0, 14)) AS i)),
x AS (SELECT model, chars, coalesce(n, 0) AS n, coalesce(n, 0) >= 3 AS k, i5, i9, o5, o9, c FROM m LEFT JOIN g USING (model))
SELECT model, n AS n_samples, CASE WHEN n >= 40 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS confidence, CAST(ceil(round(chars * CASE WHEN k THEN i5 ELSE 1.8::DOUBLE END, 6)) AS BIGINT) AS tokens_in, CAST(ceil(round(chars * CASE WHEN k THEN i9 ELSE 3.2::DOUBLE END, 6)) AS BIGINT) AS tokens_in_p90,
  CAST(ceil(round(chars * CASE WHEN k THEN o5 ELSE 0.42::DOUBLE END, 6)) AS BIGINT) AS tokens_out, CAST(ceil(round(chars * CASE WHEN k THEN o9 ELSE 1.05::DOUBLE END, 6)) AS BIGINT) AS tokens_out_p90, CASE WHEN k THEN round(least(c, 0.95), 6) ELSE 0.0 END::DOUBLE AS cached_share FROM x""")
def token_forecast(spark, sf):
    st = _story(spark, sf).where("entity_id % 12 <> 3 and (entity_id % 12 <> 4 or event_id < 60)")
    samples = st.select(F.concat(F.lit("m"), F.col("entity_id") % 12).alias("model"), F.col("event_id").alias("at"), (F.col("k") + 1).alias("chars"), ((F.col("k") + 1) * (F.col("confidence") + 1)).alias("tokens_in"), ((F.col("k") + 1) * F.col("confidence")).alias("cached"), (F.col("k") * F.col("confidence") / 2).alias("tokens_out"))
    return assess.forecast(samples, spark.range(14).select(F.concat(F.lit("m"), "id").alias("model"), ((F.col("id") + 1) * 1000).alias("chars")))


@query("SELECT o_orderkey, round(least(o_totalprice / 317 * 1.2::DOUBLE, 1000.0), 4) AS limit_usd, CAST(least(ceil(o_orderkey * 40000 * 1.2::DOUBLE), 500000000) AS BIGINT) AS limit_in, CAST(least(ceil(o_custkey * 90000 * 1.2::DOUBLE), 100000000) AS BIGINT) AS limit_out FROM orders")
def adaptive_limits(spark, sf):
    made = assess.limits(F.col("o_totalprice") / 317, F.col("o_orderkey") * 40000, F.col("o_custkey") * 90000)
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(k) for k, c in made.items()])


@query(f"""WITH {VERSIONS}, j AS (SELECT coalesce(o.book_id, n.book_id) AS book_id, coalesce(o.ordinal, n.ordinal) AS ordinal, o.h AS a, n.h AS b FROM old o FULL JOIN new n ON o.book_id = n.book_id AND o.ordinal = n.ordinal),
g AS (SELECT book_id, count(a) AS n_old, count(b) AS n_new, CAST(coalesce(min(ordinal) FILTER (WHERE a IS DISTINCT FROM b), count(*)) AS BIGINT) AS n_common FROM j GROUP BY 1) SELECT book_id, CASE WHEN n_common >= n_old THEN 'append' ELSE 'full' END AS mode, n_common, n_new, FALSE AS conflict FROM g""")
def update_preview(spark, sf):
    return assess.preview(*_versions(spark, sf))


@query(f"""WITH {STORY}, c AS (SELECT b AS book_id, i AS old_ordinal, i + 3 AS new_ordinal, ['unchanged', 'modified', 'renamed', 'removed', 'reordered'][1 + (b + i) % 5] AS change FROM (SELECT unnest(range(0, 10)) AS b), (SELECT unnest(range(0, 720)) AS i)),
v AS (SELECT st.k AS fact_id, st.book_id, c.new_ordinal AS ordinal FROM st JOIN c ON c.book_id = st.book_id AND c.old_ordinal = st.ordinal WHERE change IN ('unchanged', 'renamed', 'reordered') AND st.k % 10 = st.book_id), g AS (SELECT fact_id, min(ordinal) AS first_segment, count(*) AS n FROM v GROUP BY 1),
f AS (SELECT i AS fact_id, i % 10 AS book_id, CASE WHEN i % 6 = 0 THEN 'human' ELSE 'model' END AS created_by FROM (SELECT unnest(range(0, 130)) AS i)) SELECT f.*, first_segment, coalesce(n, 0) AS n_evidence FROM f LEFT JOIN g USING (fact_id) WHERE created_by <> 'model' OR n IS NOT NULL""")
def applied_update(spark, sf):
    kinds = F.array(*map(F.lit, ("unchanged", "modified", "renamed", "removed", "reordered")))
    changes = spark.range(7200).select((F.col("id") % 10).alias("book_id"), F.expr("id div 10").alias("old_ordinal")).select("*", (F.col("old_ordinal") + 3).alias("new_ordinal"), F.element_at(kinds, ((F.col("book_id") + F.col("old_ordinal")) % 5 + 1).cast("int")).alias("change"))
    facts = spark.range(130).select(F.col("id").alias("fact_id"), (F.col("id") % 10).alias("book_id"), F.when(F.col("id") % 6 == 0, "human").otherwise("model").alias("created_by"))
    evidence = _story(spark, sf).where("k % 10 = book_id").select(F.col("k").alias("fact_id"), "book_id", "ordinal")
    return assess.applied(changes, facts, evidence)[0]


@query(f"""WITH {STORY}, q AS (SELECT entity_id AS job_id, arg_max(ordinal, event_id) AS s FROM st WHERE kind = 'view' GROUP BY 1) SELECT event_id, st.entity_id AS job_id, coalesce(s, k) AS segment_id FROM st LEFT JOIN q ON q.job_id = st.entity_id WHERE kind = 'error'""")
def repointed_evidence(spark, sf):
    st = _story(spark, sf)
    return assess.repointed(st.where("kind = 'error'").select("event_id", F.col("entity_id").alias("job_id"), F.col("k").alias("segment_id")), st.where("kind = 'view'").select(F.col("entity_id").alias("job_id"), F.col("ordinal").alias("segment_id"), F.col("event_id").alias("queue_id")))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'queued' ELSE o_orderstatus END AS status, count(*) AS n_jobs, count(*) FILTER (WHERE o_custkey % 7 <> o_orderkey % 7) AS n_routes FROM orders GROUP BY 1")
def requeued_jobs(spark, sf):
    o = table(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "running").otherwise(F.col("o_orderstatus")))
    jobs, routes = assess.requeued(o.select("o_orderkey", "status"), o.select("o_orderkey", (F.col("o_custkey") % 7).alias("from_id"), (F.col("o_orderkey") % 7).alias("to_id")))
    return jobs.join(routes.select("o_orderkey", F.lit(1).alias("r")), "o_orderkey", "left").groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"), F.count("r").alias("n_routes"))


RELATIONS = """re AS (SELECT event_id AS relation_id, CASE WHEN event_type = 'view' THEN 'inside' WHEN event_type = 'click' THEN 'contains' ELSE 'near' END AS kind, user_id AS source, CAST(json_extract(props, '$.k') AS BIGINT) AS target FROM events),
pa AS (SELECT node, arg_max(parent, relation_id) AS parent FROM (SELECT relation_id, CASE WHEN kind = 'inside' THEN source ELSE target END AS node, CASE WHEN kind = 'inside' THEN target ELSE source END AS parent FROM re WHERE kind <> 'near') WHERE node <> parent GROUP BY 1)"""


def _parents(spark, sf):
    st = _story(spark, sf)
    return assess.last_parents(st.select(F.col("event_id").alias("relation_id"), F.when(F.col("kind") == "view", "inside").when(F.col("kind") == "click", "contains").otherwise("near").alias("kind"), F.col("entity_id").alias("source"), F.col("k").alias("target")))


@query(f"""WITH RECURSIVE {RELATIONS}, w AS (SELECT node, parent AS ancestor, 1 AS depth, [node, parent] AS path FROM pa UNION ALL SELECT w.node, pa.parent, depth + 1, list_append(path, pa.parent) FROM w JOIN pa ON pa.node = w.ancestor WHERE depth < 12 AND NOT list_contains(path, pa.parent)) SELECT node, ancestor, depth FROM w""")
def containment_last(spark, sf):
    return graph.containment(_parents(spark, sf))


BOX = "(x % 31) * 2 AS x0, (x % 17) * 3 AS y0, (x % 31) * 2 + x % 40 AS x1, (x % 17) * 3 + x % 50 AS y1"


@query(f"WITH {RELATIONS}, bo AS (SELECT x AS node, {BOX} FROM (SELECT unnest(range(0, 140)) AS x)) SELECT pa.node, pa.parent, coalesce(a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1, FALSE) AS holds FROM pa LEFT JOIN bo a ON a.node = pa.node LEFT JOIN bo b ON b.node = pa.parent")
def containment_gate(spark, sf):
    return assess.contained(_parents(spark, sf), spark.range(140).withColumnRenamed("id", "x").selectExpr("x AS node", *BOX.split(", ")))


@query(f"""WITH {STORY}, p AS (SELECT book_id, event_id AS place_id, k % 50 AS x, ordinal % 40 AS y FROM st), h AS (SELECT book_id, count(*) AS n, sum(CAST(CAST('0x' || substr(sha256(concat_ws('␟', place_id, x, y)), 1, 15) AS BIGINT) AS DECIMAL(38, 0))) AS s FROM p GROUP BY 1)
SELECT p.book_id, count(*) AS n_places, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, sha256(n || ':' || s) AS source_hash, p.book_id % 2 = 0 AS current FROM p JOIN h USING (book_id) GROUP BY p.book_id, n, s""")
def map_snapshot(spark, sf):
    places = _story(spark, sf).select("book_id", F.col("event_id").alias("place_id"), (F.col("k") % 50).alias("x"), (F.col("ordinal") % 40).alias("y"))
    was = assess.map_snapshot(places, spark.createDataFrame([], "book_id long, source_hash string")).where("book_id % 2 = 0").select("book_id", "source_hash")
    return assess.map_snapshot(places, was)


@query("SELECT p_brand AS suite, 'gold-' || count(*) || '-' || substr(sha256(string_agg(p_partkey || ':' || p_name, chr(10) ORDER BY p_partkey)), 1, 12) AS version FROM part WHERE p_size > 10 GROUP BY 1")
def suite_version(spark, sf):
    return assess.suite_version(table(spark, sf, "part").select(F.col("p_brand").alias("suite"), F.col("p_partkey").alias("case_id"), F.col("p_name").alias("expected"), (F.col("p_size") > 10).alias("confirmed")))


@query(f"""WITH {STORY}, s AS (SELECT entity_id % 30 AS b, entity_id AS c, round(sum(confidence), 4) AS score, min(ordinal) AS f FROM st GROUP BY 1, 2), o AS (SELECT b, min(c) AS own FROM s WHERE c % 4 = 1 AND b % 3 = 0 GROUP BY 1)
SELECT b AS book_id, coalesce(own, best) AS cluster_id FROM (SELECT b, arg_max(c, (score, -f, -c)) AS best FROM s GROUP BY 1) LEFT JOIN o USING (b)""")
def main_subjects(spark, sf):
    scores = _story(spark, sf).groupBy((F.col("entity_id") % 30).alias("book_id"), F.col("entity_id").alias("cluster_id")).agg(F.round(F.sum("confidence"), 4).alias("score"), F.min("ordinal").alias("first_segment"))
    chosen = scores.where("cluster_id % 4 = 1").select("book_id", "cluster_id", F.when(F.col("book_id") % 3 == 0, "human").otherwise("auto").alias("created_by"))
    return assess.main_subjects(scores, chosen)


@query("SELECT conv_id, arg_min(text, (-length(text), turn)) AS text FROM conversations GROUP BY 1")
def longest_texts(spark, sf):
    return assess.longest(table(spark, sf, "conversations"), "conv_id", "text", "turn")


@query("""SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN rtrim(substr(text, 1, 20) || '|' || substr(text, 21, 20) || '|' || substr(text, 41, 20), '|') ELSE substr(text, 1, 20) || '|' || substr(text, 21, 20) || '|' || substr(text, 41, 19) || '…' END AS lines FROM conversations""")
def label_lines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(assess.wrapped(F.col("text"), 20), "|").alias("lines"))


@query("""WITH u AS (SELECT c_custkey AS unit_id, c_nationkey AS book_id, 'w' || c_nationkey || '-' || (c_custkey % 3) AS world FROM customer), m AS (SELECT o_orderkey AS move_id, ['split', 'move', 'merge'][1 + o_orderkey % 3] AS kind, o_custkey AS unit_id, 'w' || (o_custkey % 25) || '-' || (o_orderkey % 4) AS world, 'w' || (o_orderkey % 30) || '-' || (o_orderkey % 5) AS too FROM orders WHERE o_orderkey % 10 < 4),
l AS (SELECT unit_id, arg_max(t, move_id) AS t FROM (SELECT unit_id, move_id, 'split-' || unit_id AS t FROM m WHERE kind = 'split' UNION ALL SELECT m.unit_id, move_id, too FROM m JOIN u USING (unit_id) WHERE kind = 'move' AND EXISTS (SELECT 1 FROM u x WHERE x.book_id = u.book_id AND x.world = too)) GROUP BY 1),
g AS (SELECT world, arg_max(too, move_id) AS i FROM m WHERE kind = 'merge' AND too IN (SELECT world FROM u) GROUP BY 1) SELECT u.unit_id, u.book_id, coalesce(g.i, coalesce(l.t, u.world)) AS world FROM u LEFT JOIN l USING (unit_id) LEFT JOIN g ON g.world = coalesce(l.t, u.world)""")
def world_moves(spark, sf):
    units = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("book_id"), F.concat(F.lit("w"), "c_nationkey", F.lit("-"), F.col("c_custkey") % 3).alias("world"))
    kind = F.element_at(F.array(F.lit("split"), F.lit("move"), F.lit("merge")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    moves = table(spark, sf, "orders").where("o_orderkey % 10 < 4").select(F.col("o_orderkey").alias("move_id"), kind.alias("kind"), F.col("o_custkey").alias("unit_id"), F.concat(F.lit("w"), F.col("o_custkey") % 25, F.lit("-"), F.col("o_orderkey") % 4).alias("world"), F.concat(F.lit("w"), F.col("o_orderkey") % 30, F.lit("-"), F.col("o_orderkey") % 5).alias("to"))
    return assess.world_moves(units, moves)


@query(f"""WITH {STORY}, p AS (SELECT DISTINCT event_id, entity_id FROM st UNION SELECT event_id, k FROM st), c AS (SELECT o_orderkey AS claim_id, o_custkey AS entity_id, ['accepted', 'parallel', 'rejected'][1 + o_orderkey % 3] AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'original_text' ELSE 'inference' END AS origin FROM orders),
s AS (SELECT entity_id, count(*) AS c, count(*) FILTER (WHERE status = 'parallel') AS p FROM c WHERE status <> 'rejected' AND (origin <> 'original_text' OR claim_id IN (SELECT l_orderkey FROM lineitem)) GROUP BY 1)
SELECT event_id, CAST(sum(coalesce(c, 0)) AS BIGINT) AS n_claims, CAST(sum(coalesce(s.p, 0)) AS BIGINT) AS n_parallel, count(*) FILTER (WHERE c IS NULL) AS n_unexplained FROM p LEFT JOIN s USING (entity_id) GROUP BY 1""")
def context_capsule(spark, sf):
    st = _story(spark, sf)
    people = st.select("event_id", "entity_id").unionAll(st.select("event_id", "k"))
    status = F.element_at(F.array(F.lit("accepted"), F.lit("parallel"), F.lit("rejected")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    claims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("entity_id"), status.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "original_text").otherwise("inference").alias("origin"))
    return assess.capsule(people, claims, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id")))


@query("""WITH s AS (SELECT 'part' AS source, p_type AS category, trim(p_name) AS label, p_size AS e FROM part UNION ALL SELECT 'customer', CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, trim(CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE 'red ring' END), c_nationkey FROM customer)
SELECT CASE WHEN category IN ('ECONOMY', 'MACHINERY') THEN category ELSE 'other' END AS category, label, count(DISTINCT source) AS n_sources, CAST(sum(e) AS BIGINT) AS n_evidence, coalesce(category IN ('ECONOMY', 'MACHINERY'), FALSE) = FALSE AS needs_classification FROM s WHERE label <> '' GROUP BY 1, 2, 5""")
def synced_concepts(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("label"), F.col("p_size").alias("n_evidence"))
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("category"), F.when(F.col("c_custkey") % 50 == 0, " ").otherwise("red ring").alias("label"), F.col("c_nationkey").alias("n_evidence"))
    return assess.synced_concepts({"part": p, "customer": c}, ["ECONOMY", "MACHINERY"])


@query(f"""WITH {STORY}, f AS (SELECT event_id AS fact_id, entity_id, kind, k % 20 AS t, ordinal // 30 AS segment_id, min(event_id) OVER (PARTITION BY entity_id, kind, k % 20) AS kept FROM st)
SELECT kept AS fact_id, entity_id, kind, t, count(DISTINCT segment_id) AS n_evidence FROM f GROUP BY 1, 2, 3, 4""")
def unique_facts(spark, sf):
    st = _story(spark, sf)
    facts = st.select(F.col("event_id").alias("fact_id"), "entity_id", "kind", (F.col("k") % 20).alias("t"))
    return assess.unique_facts(facts, ["entity_id", "kind", "t"], st.select(F.col("event_id").alias("fact_id"), F.floor(F.col("ordinal") / 30).alias("segment_id")))
