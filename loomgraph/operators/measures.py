"""Quality gates, benchmark results, costs and forecasts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """Null where the whole is 0."""
    return F.when(whole > 0, F.round(part / whole * 100, digits))


def stacked(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """(metric, value): all metrics in one aggregation of df."""
    one = df.agg(*[c.cast("double").alias(k) for k, c in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("m")).select("m.metric", "m.value")


def report(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluation(cases: DataFrame, least_cases: int = 25, least_accuracy: float = 95.0) -> DataFrame:
    """By suite: cases, passed, critical failures, accuracy, and whether the gate is open. cases: suite, passed, critical."""
    n, ok = F.count(F.lit(1)), F.sum(F.when(F.col("passed"), 1).otherwise(0))
    bad = F.sum(F.when(F.col("critical") & ~F.col("passed"), 1).otherwise(0))
    rows = cases.groupBy("suite").agg(n.alias("n_cases"), ok.alias("n_passed"), bad.alias("n_critical_failures"))
    accuracy = F.round(F.col("n_passed") / F.col("n_cases") * 100, 2)
    return rows.withColumn("accuracy_pct", accuracy).withColumn("gate_open", (F.col("n_cases") >= least_cases) & (F.col("accuracy_pct") >= least_accuracy) & (F.col("n_critical_failures") == 0))


def cost(hit: Column, miss: Column, out: Column, hit_price: Column, miss_price: Column, out_price: Column) -> Column:
    """Of tokens at prices a million, to eight digits; null if a price is."""
    return F.round((hit * hit_price + miss * miss_price + out * out_price) / 1_000_000, 8)


def estimate(length: Column, context: Column) -> tuple[Column, Column]:
    """Conservative input and output tokens for a segment and its context, in characters."""
    body = F.ceil(length * 1.1)
    tokens_in = F.greatest(F.lit(1200), body + F.ceil(context * 0.65) + 20000)
    return tokens_in.cast("long"), F.least(F.greatest(body + 1600, F.lit(1200)), F.lit(10240)).cast("long")


def ratios(samples: DataFrame, by: list[str], ratio: Column) -> DataFrame:
    """n, median and 90th percentile of a ratio, exact, by linear interpolation."""
    return samples.withColumn("r_", ratio).groupBy(*by).agg(F.count("r_").alias("n_samples"), F.round(F.median("r_"), 6).alias("median_ratio"), F.round(F.percentile("r_", F.lit(0.9)), 6).alias("p90_ratio"))


def within_budget(projected: Column, cap: Column, headroom: float = 1.2) -> Column:
    return F.coalesce(projected * headroom <= cap, F.lit(True))
