"""The registered queries of the corpus operators, with production parameters, over whole tables; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import ann, hmm, mixing, quality, secrets, sharding, simhash, spm, toxicity, warc

SHARD_BYTES = 16 << 20
MIX_SEED = 13


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"), seed=MIX_SEED, keep=["doc_id", "source", "lang"])
    return got.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), with_text=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    got = toxicity.score(docs, model)
    return got.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", hmm.held_out().alias("held_out"))
    model, counts = hmm.base_model(docs.where("not held_out"))
    parts = hmm.encoded(docs, model, keep=["doc_id", "held_out"])
    hmm.train(model, parts.where("not held_out"))
    return hmm.score_parts(parts, model, counts).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("span_list")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_sentencepiece, op3_mixing, op4_quality, op5_toxicity, op6_nearest, op7_warc, op8_hmm, op9_secrets, op10_simhash, pipeline)}

_BLANK = r"[\x20\x09-\x0D]"
_SYMBOLS = "[^" + "".join(quality.SYMBOLS) + "]"
_BOILER = " OR ".join(f"contains(low, '{p}')" for p in quality.BOILERPLATE)
_LEGAL = " OR ".join(f"contains(lower(t), '{x}')" for x in mixing.LEGAL)
_LINKS = " OR ".join(f"contains(t, '{x}')" for x in mixing.LINKS)
_DIMENSIONS = ("source", "lang", "topic")
_GOALS = ", ".join(f"pow(sum(n) OVER (PARTITION BY {d}) / sum(n) OVER (), {mixing.TEMPER}) AS p_{d}" for d in _DIMENSIONS)
#: Each step fits one dimension; a hundred rounds are far more than the weights need to settle to six digits.
_SHARE = "CASE i % 3 " + " ".join(f"WHEN {k} THEN g_{d} * whole / nullif(sum(w * n) OVER (PARTITION BY {d}), 0)" for k, d in enumerate(_DIMENSIONS)) + " END"
_NOT_WORD = r"[^\p{L}\p{N}_]"

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": f"""
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, coalesce(strlen(text), 0) AS b FROM documents
), s AS (
  SELECT t.depth, d.h >> (60 - t.depth) AS prefix, sum(b) AS bytes, count(*) AS n
  FROM d, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth) t GROUP BY 1, 2
), f AS (
  SELECT d.doc_id, d.h, min(s.depth) AS depth FROM d, s
  WHERE s.prefix = d.h >> (60 - s.depth) AND (s.bytes <= {SHARD_BYTES} OR s.n = 1) GROUP BY d.doc_id, d.h
)
SELECT f.doc_id, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(s.prefix), f.depth, '0') END AS shard, f.depth AS depth, CAST(s.bytes AS BIGINT) AS shard_bytes, s.n AS shard_rows
FROM f JOIN s ON s.depth = f.depth AND s.prefix = f.h >> (60 - f.depth)""",
    "op3_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents
), x AS (
  SELECT doc_id, source, lang, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, CASE WHEN length(t) < 200 THEN 'note' WHEN {_LEGAL} THEN 'legal'
    WHEN {_LINKS} OR regexp_matches(t, '[A-Za-z0-9._-]@[A-Za-z0-9-]+[.][a-z]') THEN 'contact' WHEN regexp_matches(t, '[{{}};=]') THEN 'code' ELSE 'prose' END AS topic FROM d
), c AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM x GROUP BY ALL
), p AS (
  SELECT *, sum(n) OVER () AS whole, {_GOALS} FROM c
), v AS (
  SELECT (SELECT sum(a) FROM (SELECT DISTINCT source, p_source AS a FROM p)) AS s_source, (SELECT sum(a) FROM (SELECT DISTINCT lang, p_lang AS a FROM p)) AS s_lang, (SELECT sum(a) FROM (SELECT DISTINCT topic, p_topic AS a FROM p)) AS s_topic
), r AS (
  SELECT 0 AS i, source, lang, topic, n, whole, p_source / s_source AS g_source, p_lang / s_lang AS g_lang, p_topic / s_topic AS g_topic, CAST(1 AS DOUBLE) AS w FROM p, v
  UNION ALL
  SELECT i + 1, source, lang, topic, n, whole, g_source, g_lang, g_topic, w * coalesce({_SHARE}, 1) FROM r WHERE i < 300
), f AS (
  SELECT source, lang, topic, w, least(1, w / max(w) FILTER (WHERE n > 0) OVER ()) AS q FROM r WHERE i = 300
)
SELECT x.doc_id, x.source, x.lang, x.topic, x.n_tokens, round(w, 6) AS weight, round(q, 6) AS probability,
  CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(x.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < q AS kept
FROM x JOIN f ON f.source IS NOT DISTINCT FROM x.source AND f.lang IS NOT DISTINCT FROM x.lang AND f.topic = x.topic""",
    "op4_quality": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x : x <> '') AS w FROM d
), b AS (
  SELECT doc_id, t, len(w) AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, length(regexp_replace(t, '{_SYMBOLS}', '', 'g')) AS n_symbols FROM w
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g
), r AS (
  SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least(5, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 5)) AS step FROM h WHERE c > 1) GROUP BY 1
), l AS (
  SELECT doc_id, line, lower(line) AS low, list_filter(string_split_regex(line, '{_BLANK}+'), lambda x : x <> '') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
), m AS (
  SELECT doc_id, line, low, len(w) AS n, length(regexp_replace(line, '{_BLANK}', '', 'g')) AS chars, len(list_distinct(w)) AS kinds, list_max(list_transform(list_distinct(w), lambda x : len(list_filter(w, lambda y : y = x)))) AS most,
    count(*) OVER (PARTITION BY doc_id, line) AS times, length(regexp_replace(line, '{_SYMBOLS}', '', 'g')) AS marks, length(regexp_replace(line, '[\p{{L}}\p{{N}}_\s\p{{Z}}\x0b\x1c-\x1f\x85]', '', 'g')) AS odd,
    length(regexp_replace(line, '[^|»›·]', '', 'g')) AS bars FROM l WHERE len(w) > 0
), f AS (
  SELECT doc_id, n, (NOT contains(line, '|') AND marks > 0.12 * chars) OR odd > 0.3 * chars OR (n >= 8 AND regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}]'))
    OR (bars >= 3 AND bars > 0.15 * n) OR regexp_full_match(line, '(?i){_NOT_WORD}*{quality.NAVIGATION}({_NOT_WORD}+{quality.NAVIGATION})*{_NOT_WORD}*')
    OR times > 2 OR {_BOILER} OR (n >= 8 AND kinds <= 1 + n * 0.5 AND most > 0.5 * n) AS fails FROM m
), x AS (
  SELECT doc_id, count(*) FILTER (WHERE fails) AS gone, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM f GROUP BY 1
), y AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM m GROUP BY 1
), z AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, coalesce(dup, 0) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone, 0) AS gone, CAST(coalesce(lost, 0) AS BIGINT) AS lost
  FROM b LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.5 * n_words AS kept, gone AS n_lines_removed, lost AS n_words_removed FROM z""",
    "op7_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
  SELECT hex, n, min(page_id) AS first_id FROM p GROUP BY hex, n
), b AS (
  SELECT p.page_id, p.n, p.hex, k.first_id, unnest(range(0, 32)) AS i FROM p JOIN k USING (hex, n)
), c AS (
  SELECT page_id, n, first_id, i, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex || '0', 1 + (5 * i) // 4, 2) AS BIGINT) >> (3 - (5 * i) % 4)) & 31 AS INTEGER), 1) AS ch FROM b
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, string_agg(ch, '' ORDER BY i) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, TRUE AS intact
FROM c GROUP BY page_id, n, first_id""",
}
