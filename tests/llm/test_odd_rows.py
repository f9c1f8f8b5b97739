"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: for every operator and stage."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import ann, hmm, mixing, quality, secrets, sharding, simhash, spm, toxicity, warc
from loomgraph.llm.queries import tokenizer_path

TEXTS = ["", None, " \n", "one two three", "one two three", "w" * 1_000_000, "many words here " * 70_000, "　日本 😀 ▁x", "password = abcdefghijkl1", None]
#: Names that operators use, in other cases, and one with a dot.
CLASHES = ["Shard", "DEPTH", "N_Tokens", "Weight", "Kept", "SCORE", "Predicted", "Passages", "N_known", "Base_Score", "Spans", "FP", "Root", "Component_id", "Topic", "a.b", "Rid_", "Symbols_", "Size", "cell", "top", "prefix"]


def table(spark, texts=TEXTS):
    rows = [(None if k == 7 else k, t, None if k % 3 else "en", "s", None if t is None else len(t), *[f"{c}-{k}" for c in CLASHES]) for k, t in enumerate(texts)]
    rows += rows[3:4]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows[: len(rows) if texts else 0], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).limit(0)


NET = secrets.Network()
OPERATORS = {
    "sharding": (lambda d, k: sharding.shards(d, 1000, keep=k), {"shard", "depth", "shard_bytes", "shard_rows"}),
    "spm": (lambda d, k: spm.round_trip(d, tokenizer_path(), keep=k), {"n_tokens", "ids_sha256", "decoded_sha256"}),
    "mixing": (lambda d, k: mixing.mix(d, keep=k), {"topic", "n_tokens", "weight", "probability", "kept"}),
    "quality": (lambda d, k: quality.assess(d, keep=k), {f.name for f in quality.FIELDS}),
    "toxicity": (lambda d, k: toxicity.score(d, toxicity.Scorer({}), keep=k), {"score", "predicted", "passages"}),
    "hmm": (lambda d, k: hmm.score(d, *hmm.fit(d, rounds=1), keep=k), set(hmm.OUTPUTS)),
    "secrets": (lambda d, k: secrets.scan(d, NET, keep=k), {"n_assign", "n_access", "n_hex", "base_sha256", "spans", "span_list"}),
    "simhash": (lambda d, k: simhash.near_duplicates(d, keep=k), {"fp", "fingerprint", "root", "component_id"}),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(odd, none, name):
    f, outputs = OPERATORS[name]
    keep = ["doc_id", *CLASHES]
    got = f(odd, keep)
    stay = [c for c in keep if c.lower() not in outputs]
    assert {c.lower() for c in got.columns} == {c.lower() for c in stay} | outputs
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    cols = [F.col(f"`{c}`") for c in stay]
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(map(tuple, odd.select(*cols).collect()))
    left = f(none, keep)
    assert left.columns == got.columns and left.count() == 0


def test_pages(odd, none):
    pages = lambda d: d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.when(F.col("page_id") % 2 == 0, "http://a.b/x"))
    got = warc.archive(pages(odd)).collect()
    assert len(got) == len(TEXTS) + 1 and all(r.intact for r in got)
    first = {}
    for k, t in enumerate(TEXTS):
        if k != 7:
            first.setdefault(t or "", k)
    for r in got:
        body = (TEXTS[7 if r.page_id is None else r.page_id] or "").encode()
        assert r.payload_bytes == len(body) and r.payload_digest == warc.digest(body)
        want = first.get(body.decode(), None)
        assert (r.record_type, r.refers_to) == (("response", None) if want in (r.page_id, None) else ("revisit", want))
    assert warc.archive(pages(none)).count() == 0


def test_vectors(spark):
    schema = "Vec_ID long, embedding array<double>, `a.b` int, rep long"
    made = lambda rows: ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0)
    assert made([]).count() == 0
    v = [1.0, 2.0]
    got = made([(0, v, 1, 1), (0, v, 1, 1), (3, v, 1, 1), (2, v, 1, 1), (4, [1.0, 4.0], 1, 1), (5, [9.0], 1, 1), (None, v, 1, 1), (6, None, 1, 1), (7, [0.0, 0.0], 1, 1)]).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 4, 2.0)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, none, sf, name, stage):
    got = stage(spark, odd, sf)
    if name == "sentencepiece":
        assert got.count() == odd.count() and stage(spark, none, sf).count() == 0
        return
    assert got.columns == odd.columns
    rows, kept = odd.collect(), got.collect()
    assert stage(spark, none, sf).count() == 0 and len(kept) <= len(rows)
    plain = lambda r: tuple(v for c, v in zip(odd.columns, r, strict=True) if name != "secrets" or c not in ("text", "n_chars"))
    assert not Counter(map(plain, kept)) - Counter(map(plain, rows))
    if name == "near_duplicates":
        texts = [None if r.text in (None, "", " \n") else r.text for r in kept]
        assert len(texts) == len(set(texts)) == 6  # empty ones are one group, repeated ones another
    if name == "secrets":
        assert len(kept) == len(rows) and not any("abcdefghijkl1" in (r.text or "") for r in kept)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)


def test_run_on_an_empty_table(spark, none, tmp_path, sf):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shards_of_one_key_keep_all_rows_and_the_limit(spark):
    for others in (0, 3):
        rows = spark.range(5000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(10).alias("size")).unionByName(spark.range(others).select(F.col("id").alias("doc_id"), F.lit(7).alias("size")))
        got = sharding.shards(rows, 10, size=F.col("size")).collect()
        assert len(got) == 5000 + others and all(r.shard_bytes <= 10 for r in got)
        assert Counter(r.shard for r in got) == {r.shard: r.shard_rows for r in got}


def test_long_words_are_the_librarys():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    coder = spm.Coder(open(tokenizer_path(), "rb").read())
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdethinerso"), 5000)), "ab" * 3000, "aab" * 999, "".join(rng.choice(["the", "ing", "er", "日本", "é", "00"], 2000)), "a" * 2500]
    assert coder.encode(words) == sp.encode(words)
    assert [hashlib.sha256(sp.decode(i).encode()).hexdigest() for i in sp.encode(words)] == coder.digests(words)[2]
