"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens are summed by cell (source, language, topic). Raking scales the cells until the marginals of all three agree with
their targets; targets of values that have no tokens are spread over the others. A document's keeping probability is
its cell's weight divided by the largest weight, so that expected token shares are the targets exactly and no document
is kept twice. Whether it is kept depends on a hash of its id and the seed only: the same on every run and cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import besides, col, fresh, stored

#: Cells that the driver rakes at most (they are combinations of labels, not rows); more raise an error.
MOST_CELLS = 2_000_000
#: Cells that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
TEMPER = 0.85
OUTPUTS = ("topic", "n_tokens", "weight", "probability", "kept")
#: Cues of legal texts, in any case, and of links.
LEGAL = ("licensed under", "license, version", "permission is hereby granted", "copyright")
LINKS = ("http://", "https://", "www.")


def topic(text: Column) -> Column:
    """A topic from surface cues, for tables without one: the first that applies."""
    t = F.coalesce(text, F.lit(""))
    holds = lambda c, cues: reduce(Column.__or__, [c.contains(x) for x in cues])
    mail = t.contains("@") & t.rlike("[A-Za-z0-9._-]@[A-Za-z0-9-]+[.][a-z]")  # plain searches are cheaper than patterns
    return (
        F.when(F.length(t) < 200, "note").when(holds(F.lower(t), LEGAL), "legal")
        .when(holds(t, LINKS) | mail, "contact").when(holds(t, "{};="), "code").otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words between blanks, counted without splitting; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def tempered(totals: Mapping[str, float], power: float = TEMPER) -> dict[str, float]:
    """Targets that draw shares towards each other: share ** power, normalised."""
    whole = sum(totals.values()) or 1.0
    raised = {k: (v / whole) ** power for k, v in totals.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(cells: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], tolerance: float = 1e-10, rounds: int = 500) -> np.ndarray:
    """Weights of cells such that weighted tokens have the target shares in each dimension.

    cells: tokens; codes: the value of each cell in each dimension; targets: share of each value. If the targets
    contradict each other the last round's weights are returned, which fit the last dimension.
    """
    total = cells.sum()
    w = np.ones(len(cells))
    if total <= 0:
        return w
    goal = []
    for code, target in zip(codes, targets, strict=True):
        there = np.bincount(code, cells, len(target)) > 0
        t = np.where(there, target, 0.0)
        goal.append(t / t.sum() if t.sum() > 0 else there / there.sum())
    for _ in range(rounds):
        worst = 0.0
        for code, t in zip(codes, goal, strict=True):
            share = np.bincount(code, w * cells, len(t)) / total
            factor = np.divide(t, share, out=np.ones_like(t), where=share > 0)
            worst = max(worst, float(np.abs(share - t).max()))
            w = w * factor[code]
        if worst < tolerance:
            break
    return w


def weigh(df: DataFrame, dimensions: Sequence[str], size: str, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """One row for each cell: the dimensions (null as it is), n_tokens, weight and probability.

    targets: for each dimension shares by value; a dimension without targets gets tempered shares of the table.
    """
    spark = df.sparkSession
    cells = df.groupBy(*dimensions).agg(F.sum(size).alias("n_tokens")).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of labels")
    cells.sort(key=lambda r: tuple((r[d] is None, str(r[d])) for d in dimensions))
    count = np.array([r["n_tokens"] or 0 for r in cells], float)
    codes, goals = [], []
    for d in dimensions:
        values = sorted({r[d] for r in cells}, key=lambda v: (v is None, str(v)))
        at = {v: k for k, v in enumerate(values)}
        code = np.array([at[r[d]] for r in cells], np.int64)
        given = (targets or {}).get(d)
        if given is None:
            sums = np.bincount(code, count, len(values)) if len(values) else np.zeros(0)
            given = tempered(dict(zip(values, sums.tolist(), strict=True)), temper)
        codes.append(code)
        goals.append(np.array([given.get(v, 0.0) for v in values], float))
    w = rake(count, codes, goals)
    used = w[count > 0]
    top = float(used.max()) if used.size else 1.0
    rows = [(*(r[d] for d in dimensions), int(c), float(v), float(min(1.0, v / top)) if top > 0 else 0.0) for r, c, v in zip(cells, count, w, strict=True)]
    schema = T.StructType([*(df.schema[d] for d in dimensions), T.StructField("n_tokens", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("probability", T.DoubleType())])
    return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))


def chance(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed only. A null id counts as the empty text."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(df: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang", topics: Column | None = None, seed: int = 13, temper: float = TEMPER, keep: Sequence[str] | None = None) -> DataFrame:
    """`keep` (all columns by default), topic, n_tokens, weight, probability and kept for every row.

    Null and empty texts have no tokens: they have weight like their cell and move no shares. Null labels are a value of
    their own. Rows that repeat an id are kept or left together; a null id counts as the empty text. An empty table
    gives no rows; columns of `keep` named like an output are replaced.
    """
    keep = besides(df.columns if keep is None else keep, OUTPUTS)
    s, g, t, n, i = (fresh(c, [*keep, *OUTPUTS]) for c in ("source_", "lang_", "topic_", "tokens_", "id_"))
    rows = df.select(*[col(c) for c in keep], col(doc_id).alias(i), col(source).cast("string").alias(s), col(lang).cast("string").alias(g), (topic(col(text)) if topics is None else topics).alias(t), tokens(col(text)).alias(n))
    whole = any(c.lower() == text.lower() for c in keep)
    slim = stored(rows.select(s, g, t, n).groupBy(s, g, t).agg(F.sum(n).alias(n)), "mix-cells") if whole else (rows := stored(rows, "mix-rows"))
    named = {s: (targets or {}).get("source"), g: (targets or {}).get("lang"), t: (targets or {}).get("topic")}
    cells = weigh(slim, [s, g, t], n, {k: v for k, v in named.items() if v is not None}, temper)
    inner = [fresh(f"{c}cell", [*keep, *OUTPUTS]) for c in (s, g, t)]
    cells = cells.select(*[F.col(c).alias(x) for c, x in zip((s, g, t), inner, strict=True)], F.col("weight").alias("weight"), "probability")
    if cells.count() <= BROADCAST_CELLS:  # else texts would be dealt out to meet a few weights
        cells = F.broadcast(cells)
    at = [F.col(c).eqNullSafe(F.col(x)) for c, x in zip((s, g, t), inner, strict=True)]
    joined = rows.join(cells, at[0] & at[1] & at[2], "left")
    return joined.select(*[col(c) for c in keep], F.col(t).alias("topic"), F.col(n).alias("n_tokens"), "weight", "probability", (chance(F.col(i), seed) < F.col("probability")).alias("kept"))
