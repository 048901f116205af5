"""Retrieval quality: recall, precision, hit rate, MRR, nDCG, reports and their comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("recall", "precision", "hit_rate", "mrr", "ndcg")


def metrics_at_k(rankings: DataFrame, judgments: DataFrame, k: int, query: str = "query_id", key: str = "record_id", digits: int = 6) -> DataFrame:
    """A row a judged query. `rankings` has (query, key, rank), `judgments` (query, key,
    relevance). Precision divides by k; a query without relevant judgments has recall 1
    and, with an ideal gain of 0, nDCG 1."""
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    best = judgments.withColumn("__i", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("relevance"), key)))
    ideal = best.groupBy(query).agg(F.sum(F.when(F.col("__i") <= k, gain(F.col("relevance"), F.col("__i"))).otherwise(0.0)).alias("__ideal"), F.count_if(F.col("relevance") > 0).alias("__relevant"))
    hits = rankings.where(F.col("rank") <= k).join(judgments, [query, key], "left").withColumn("__g", F.coalesce("relevance", F.lit(0)))
    got = hits.groupBy(query).agg(F.count_if(F.col("__g") > 0).alias("__hits"), F.sum(gain(F.col("__g"), F.col("rank"))).alias("__dcg"), F.min(F.when(F.col("__g") > 0, F.col("rank"))).alias("__first"))
    joined = ideal.join(got, query, "left")
    n = F.coalesce("__hits", F.lit(0))
    r = lambda c: F.round(c, digits)
    return joined.select(
        query,
        r(F.when(F.col("__relevant") == 0, 1.0).otherwise(n / F.greatest("__relevant", F.lit(1)))).alias("recall"),
        r(n / F.lit(float(k))).alias("precision"),
        (n > 0).cast("double").alias("hit_rate"),
        r(F.coalesce(F.lit(1.0) / F.col("__first"), F.lit(0.0))).alias("mrr"),
        r(F.when(F.col("__ideal") == 0, 1.0).otherwise(F.coalesce("__dcg", F.lit(0.0)) / F.nullif("__ideal", F.lit(0.0)))).alias("ndcg"),
    )


def report(metrics: DataFrame, digits: int = 6) -> DataFrame:
    return metrics.agg(F.count("*").cast("long").alias("queries"), *[F.round(F.avg(m), digits).alias(m) for m in METRICS])


def check(rankings: DataFrame, judgments: DataFrame, query: str = "query_id") -> None:
    """Every judged query has a ranking, and every ranking is of a judged query."""
    a, b = rankings.select(query).distinct(), judgments.select(query).distinct()
    if not b.join(a, query, "left_anti").isEmpty() or not a.join(b, query, "left_anti").isEmpty():
        raise ValueError("rankings and judgments are of different queries")


def compare(baseline: DataFrame, candidate: DataFrame, query: str = "query_id", digits: int = 6) -> DataFrame:
    """Mean differences, and queries improved, regressed and unchanged by nDCG."""
    both = baseline.alias("b").join(candidate.alias("c"), query)
    delta = F.col("c.ndcg") - F.col("b.ndcg")
    return both.agg(
        F.count_if(delta > 1e-12).cast("long").alias("improved"), F.count_if(delta < -1e-12).cast("long").alias("regressed"), F.count_if(F.abs(delta) <= 1e-12).cast("long").alias("unchanged"),
        *[F.round(F.avg(F.col(f"c.{m}") - F.col(f"b.{m}")), digits).alias(f"{m}_delta") for m in METRICS],
    )


def recall(found: DataFrame, exact: DataFrame, query: str = "query_id", key: str = "record_id") -> DataFrame:
    """query, recall: what share of the exact neighbours was found; with none, 1."""
    hits = exact.select(query, key).join(found.select(query, key).withColumn("__f", F.lit(1)), [query, key], "left")
    return hits.groupBy(query).agg((F.count("__f") / F.count("*")).alias("recall"))


def percentile(values: list[float], p: float) -> float:
    ordered = sorted(values)
    return ordered[math.ceil((len(ordered) - 1) * p / 100)]
