"""Toxic passages as maximum-scoring segments of token log-odds.

Training (bounded): the log-odds of a token between toxic and other texts, with Dirichlet priors in a chain: the
prior of a word is what its first six letters say, theirs what the first four say, theirs the class totals. So a word
never seen still gets the log-odds of its longest known beginning.

Scoring (every whole text): the log-odds less a drift make a random walk that falls in ordinary text. One linear scan
finds all maximal segments, those that no shorter or longer one beats, and each top score is calibrated by the
extreme-value law of such walks: P(max >= s) = 1 - exp(-K n exp(-lambda s)). Calibrated evidence becomes a
probability by logistic regression on labelled rows that took no part in the counts.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import MEMO, col, crc, map_texts, stored

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
SAMPLE = 24_000
#: Texts of either class under which the model warns.
LEAST_LABELS = 100
#: A token or beginning counts if this many training texts hold it.
LEAST_TEXTS = 3
#: Weight of a prior, in texts.
PRIOR = 6.0
DRIFT = 0.9
STARTS = (4, 6)
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def keys_of(word: str) -> list[str]:
    """The beginnings of a word from short to long, then the word itself."""
    return [f"{word[:k]}~" for k in STARTS if len(word) > k] + [word]


def fit_odds(counts: dict[str, tuple[float, float]], n_toxic: float, n_other: float) -> dict[str, float]:
    """Log-odds of each key; counts: texts of either class that hold it."""
    n_toxic, n_other = max(n_toxic, 1.0), max(n_other, 1.0)
    base = n_toxic / n_other
    share: dict[str, float] = {}

    def rate(key: str) -> float:
        """Share of toxic texts among those that hold the key, shrunk to that of its beginning; classes weigh alike."""
        if key not in share:
            if key.endswith("~"):
                up = [f"{key[:k]}~" for k in STARTS if k < len(key) - 1]
            else:
                up = [f"{key[:k]}~" for k in STARTS if k < len(key)]
            prior = rate(up[-1]) if up and up[-1] in counts else 0.5
            t, o = counts[key]
            share[key] = (t / base + PRIOR * prior) / (t / base + o + PRIOR)
        return share[key]

    return {k: math.log(max(rate(k), 1e-4) / max(1 - rate(k), 1e-4)) for k in counts}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order: linear-time scan over the positive scores.

    Brute-force meaning: segments whose every proper prefix and suffix is positive and that no other one such contains.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float]] = []  # start, end, sums before start and at end
    before: list[int] = []  # for each, the last one whose left sum is smaller
    for i in np.flatnonzero(scores > 0).tolist():
        start, left, right = i, float(total[i]), float(total[i + 1])
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = before[j]
            if j < 0 or held[j][3] >= right:
                del before[len(held) :]
                held.append((start, i + 1, left, right))
                before.append(j)
                break
            start, left = held[j][0], held[j][2]
            j = before[j]
            del held[_index(held, start) :]
            del before[len(held) :]
    return [(a, b, r - x) for a, b, x, r in held]


def _index(held: list[tuple[int, int, float, float]], start: int) -> int:
    low, high = 0, len(held)
    while low < high:
        mid = (low + high) // 2
        if held[mid][0] < start:
            low = mid + 1
        else:
            high = mid
    return low


class Scorer:
    """A fitted model: odds, extreme-value parameters and logistic weights; all of bounded size."""

    def __init__(self, odds: dict[str, float]):
        self.odds = {k: v - DRIFT for k, v in odds.items()}
        self.memo: dict[str, float] = {}
        self.rate, self.log_k = 1.0, 0.0
        self.weights = np.array([-3.0, 1.0, 0.0, 0.0])

    def token(self, raw: str) -> float:
        """Of all that one blank-separated word holds: the largest score of its letter runs."""
        best = -DRIFT
        for w in _WORD.findall(raw):
            for k in reversed(keys_of(w)):
                if k in self.odds:
                    best = max(best, self.odds[k])
                    break
        return best

    def prune(self) -> None:
        """Takes out each key whose words score the same without it: what the next shorter known key, or nothing, says."""
        level = {k: max(-DRIFT, v) for k, v in self.odds.items()}

        def shorter(key: str) -> float:
            up = keys_of(key)[:-1] if not key.endswith("~") else [f"{key[:k]}~" for k in STARTS if k < len(key) - 1]
            return next((level[k] for k in reversed(up) if k in level), -DRIFT)

        self.odds = {k: v for k, v in self.odds.items() if level[k] != shorter(k)}
        self.memo = {}

    def walk(self, text: str) -> np.ndarray:
        memo = self.memo
        words = text.lower().split()
        try:
            return np.array([memo[w] for w in words])
        except KeyError:
            if len(memo) > MEMO // 2:
                memo.clear()
            for w in set(words).difference(memo):
                memo[w] = self.token(w)
            return np.array([memo[w] for w in words])

    def evidence(self, score: float, n: int) -> float:
        """-log P(a text of n ordinary tokens has a segment of this score), by the extreme-value law."""
        x = self.log_k + math.log(n + 1) - self.rate * score
        return -x if x < -30 else -math.log(-math.expm1(-math.exp(min(x, 30.0))) + 1e-300)

    def look(self, text: str) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        scores = self.walk(text)
        found = segments(scores) if len(scores) else []
        n = len(scores)
        ev = [self.evidence(s, n) for _, _, s in found]
        strong = [(a, b, s) for (a, b, s), e in zip(found, ev, strict=True) if e > 3.0]
        x = np.array([1.0, min(max(ev, default=0.0), 40.0), math.log1p(sum(s for _, _, s in strong)), math.log1p(1000.0 * sum(s for _, _, s in strong) / (n + 50))])
        return x, strong

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        x, strong = self.look(text)
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, float(x @ self.weights)))))), strong

    def top(self, text: str) -> tuple[int, float]:
        """Tokens, and the largest segment score (0: none)."""
        w = self.walk(text)
        return len(w), max((x for _, _, x in segments(w)), default=0.0) if len(w) else 0.0

    def set_law(self, sizes: Sequence[int], tops: Sequence[float]) -> None:
        """Fits the extreme-value law on texts that aren't toxic: their tokens and largest segment scores."""
        if len(tops) < 20:
            return
        top, size = np.array(tops), np.log(np.array(sizes) + 1.0)
        cut = top <= np.quantile(top, 0.98)  # a few wrong labels shall not set the law
        slope = np.polyfit(size[cut], top[cut], 1)[0] if size[cut].std() > 0 else 0.0
        spread = float(np.std(top[cut] - slope * size[cut])) or 1.0
        self.rate = min(1 / max(slope, 1e-3), math.pi / math.sqrt(6) / spread)
        self.log_k = self.rate * float(np.mean(top[cut] - size[cut] / self.rate)) - 0.5772

    def set_weights(self, x: np.ndarray, toxic: Sequence[int]) -> None:
        """Logistic regression on what look() says of labelled texts."""
        y = np.array(toxic, float)
        w = np.zeros(4)
        ridge = np.diag([1e-3, 0.1, 0.1, 0.1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + ridge @ w
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(4)
            step = np.linalg.solve(h, g)
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-7:
                break
        if len(y):
            self.weights = w


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where labels may not be used: the remainder of the id's crc32 by 4 is 2. A null id is not held out."""
    return F.coalesce(crc(doc_id) % 4 == 2, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Fits on at most `sample` labelled rows that aren't held out. Of several labels of an id the largest counts, of several texts the smallest.

    Null labels and ids are left out, null texts are empty. Texts stay on the executors: keys are counted and calibration
    texts are scored there. Warns if fewer than LEAST_LABELS labels of either class are at hand; with none at all (empty
    tables) every text gets the score of no evidence.
    """
    known = labels.where(col(label).isNotNull() & col(doc_id).isNotNull() & ~held_out(col(doc_id))).groupBy(col(doc_id).alias("id")).agg(F.max(col(label).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` small rows, so it may be broadcast
    rows = df.select(col(doc_id).alias("id"), F.coalesce(col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
    one = rows.groupBy("id", "y").agg(F.min("t").alias("t"))
    part = stored(one.select("t", "y", (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("calibrates")), "toxic-sample")
    keyed = part.where(~F.col("calibrates"))

    def count(batches):
        import pyarrow as pa

        seen = {0: Counter(), 1: Counter()}
        texts = Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = int(y > 0)
                texts[y] += 1
                seen[y].update({k for w in set(_WORD.findall(t.lower())) for k in keys_of(w)})
        keys = list(seen[0].keys() | seen[1].keys())
        cols = [["", *keys], [texts[1], *(seen[1][k] for k in keys)], [texts[0], *(seen[0][k] for k in keys)]]
        for a in range(0, len(cols[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000], type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["k", "toxic", "other"])

    counted = keyed.select("t", "y").mapInArrow(count, "k string, toxic long, other long").groupBy("k").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    got = counted.where((F.col("toxic") + F.col("other") >= LEAST_TEXTS) | (F.col("k") == "")).toArrow().to_pydict()  # keys that several texts of the sample hold
    counts = {k: (float(t), float(o)) for k, t, o in zip(got["k"], got["toxic"], got["other"], strict=True)}
    toxic, other = counts.pop("", (0.0, 0.0))
    model = Scorer(fit_odds(counts, toxic, other))
    model.prune()
    if min(toxic, other) < LEAST_LABELS:
        warnings.warn(f"toxicity learns from {toxic:.0f} toxic and {other:.0f} other texts only: scores will hardly tell them apart", stacklevel=2)
    rest = part.where("calibrates").select("t", "y")  # a quarter of the sample

    def told(what, schema: str) -> dict[str, list]:
        """what(model, text) of every calibration text: a few numbers for each."""
        shared = df.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                got = [what(shared.value, t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_pylist([{"y": int(y > 0), "x": list(map(float, g))} for y, g in zip(b.column(1).to_pylist(), got, strict=True)], schema=pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))]))

        return rest.mapInArrow(run, schema).toArrow().to_pydict()

    tops = told(lambda m, t: m.top(t), "y int, x array<double>")
    plain = [x for y, x in zip(tops["y"], tops["x"], strict=True) if not y and x[0]]
    model.set_law([n for n, _ in plain], [top for _, top in plain])
    seen = told(lambda m, t: m.look(t)[0], "y int, x array<double>")
    model.set_weights(np.array(seen["x"]).reshape(-1, 4), seen["y"])
    return model


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score(df: DataFrame, model: Scorer, text: str = "text", keep: Sequence[str] = ("doc_id",), keep_text: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """`keep`, score (0 to 1), predicted, and passages: token ranges of the toxic segments; a row for each row.

    Null and empty texts get the score of no evidence and no passages; very long ones are walked whole, in linear time;
    repeated rows get equal scores; an empty table gives no rows; columns of `keep` named like an output are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", SPAN)]

    def make():
        scorer = shared.value

        def run(texts):
            got = [scorer.score(t) for t in texts]
            return [s for s, _ in got], [int(s >= threshold) for s, _ in got], [[{"start": a, "end": b, "score": s} for a, b, s in found] for _, found in got]

        return run

    return map_texts(df, make, fields, text, keep, keep_text)
