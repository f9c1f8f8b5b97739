"""Rows that a shorter job would lose: null and repeated ids, repeated rows, long and short candidates, long lines."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import ann, quality, secrets, simhash, toxicity


def test_deduplicate_keeps_components_of_null_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    a, b, c, d = (" ".join(str(x) for x in rng.integers(0, 10**6, 60)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (9, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(df).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (7, c), (7, d)], key=str)
    assert simhash.near_duplicates(df).select("root").distinct().count() == 4


def test_repeated_rows_take_no_places_of_other_ids(spark):
    hot, far = [1.0] * 8, [2.0] * 8
    rows = [(1, hot)] * 11 + [(k, hot) for k in range(2, 14) for _ in range(2)] + [(100, hot), (50, far)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 100).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(k, 0.0) for k in range(1, 11)]


def test_a_smaller_model_scores_each_word_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    full = {}
    whole = toxicity.Scorer.prune

    def watched(self):
        full.update(self.odds)
        whole(self)

    toxicity.Scorer.prune = watched
    try:
        model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    finally:
        toxicity.Scorer.prune = whole
    before = toxicity.Scorer({})
    before.odds = full
    words = [k.rstrip("~") for k in full] + [k.rstrip("~") + "zzzz" for k in full]
    assert any(-toxicity.DRIFT < v < 0 for v in full.values())
    assert [model.token(w) for w in words] == [before.token(w) for w in words]


def test_secrets_that_overlap_a_fixed_rule_are_masked_whole():
    net = secrets.Network()
    net.probability = lambda x: np.ones(len(x))
    run, rest = "0123456789abcdef", "KTXWMQPLZRKTXW0QPLZRMV"
    for body in (rest + run + rest, f"{run}/{rest}", f"{rest}/{run}"):
        text = f"see {body} there"
        spans = secrets.Scanner(net).spans([text])[0]
        assert (4, "model", 4 + len(body)) in spans and any(k == "hex" for _, k, _ in spans)
        masked = secrets.redacted(text, spans)
        assert rest not in masked and run not in masked and masked.endswith(" there")
    assert [k for _, k, _ in secrets.Scanner(net).spans([f"see {run} there"])[0]] == ["hex"]


def test_the_network_sees_short_candidates_and_the_middle_of_long_ones():
    net = secrets.trained()
    scanner = secrets.Scanner(net)
    path = "/".join(["terminos"] * 6)
    keys = ["kT9xW2mQ7pLz", "kTxWqmQpLzRbNvA", "Zq8Lw3Xv9Rt2Bn7KpD4f"]
    texts = [f"pwd = {keys[0]}", f"bearer: {keys[1]} ok", f"see {path}/{keys[2]}/{path} end"]
    for text, key, found in zip(texts, keys, scanner.spans(texts), strict=True):
        assert any(k == "model" and a <= text.index(key) and b >= text.index(key) + len(key) for a, k, b in found), text
    assert scanner.spans([f"see {path}/{path} and internationalisation"]) == [[]]
    a, b = 3, 203
    assert {k for s, e in secrets.views(a, b)[1:] for k in range(s, e)} == set(range(a, b))
    net.set_limit(np.array([0.1] * 50 + [0.9] * 50), 0.98)
    assert net.threshold == 0.1


def test_the_network_leaves_ordinary_words_alone():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    found = secrets.Scanner(secrets.trained()).spans(texts)
    words = sum(t[a:b].isalpha() for t, f in zip(texts, found, strict=True) for a, k, b in f if k == "model")
    assert words <= 0.02 * sum(len(secrets.candidates(t)) for t in texts)


def test_long_navigation_lines_fail():
    line = " ".join(["Home Menu Login Search Contact"] * 12)
    assert len(line.replace(" ", "")) >= 200
    prose = "\n".join("the river ran past old mills %d while nobody was there to see it" % k for k in range(3))
    judge = quality.Judge(quality.Rules()).judge
    assert quality.Judge(quality.Rules()).line_fails(line, line.split(), 1, False, False) == "navigation"
    assert judge(f"{prose}\n{line}")[7] == 1 and judge(f"{prose}\n{line} riverside")[7] == 0
