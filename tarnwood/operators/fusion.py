"""Fusion of ranked lists: hybrid queries and several collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.model import MAX_CANDIDATES, RRF_K, InvalidRequest


def check_depths(top_k: int, dense_k: int, lexical_k: int, rrf_k: int = RRF_K) -> None:
    if min(top_k, dense_k, lexical_k, rrf_k) <= 0 or dense_k < top_k or lexical_k < top_k or dense_k + lexical_k > MAX_CANDIDATES:
        raise InvalidRequest("depths are positive, at least top_k, and 10 000 together at most")


def with_rank(hits: DataFrame, metric: str, key: str, name: str = "rank") -> DataFrame:
    """1-based ranks of a bounded list (a top k), so one task may order it."""
    score = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return hits.withColumn(name, F.row_number().over(Window.orderBy(score, F.col(key))))


def reciprocal_rank(dense: DataFrame, lexical: DataFrame, metric: str, top_k: int, key: str = "record_id", rrf_k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """key, score, dense_rank, dense_score, lexical_rank, lexical_score of the best sums of
    1 / (rrf_k + rank); both inputs are top-k lists under the same predicate."""
    d = with_rank(dense, metric, key).select(key, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    x = with_rank(lexical, "dot", key).select(key, F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    part = lambda c: F.coalesce(F.lit(1.0) / (rrf_k + F.col(c)), F.lit(0.0))
    total = part("dense_rank") + part("lexical_rank")
    both = d.join(x, key, "full_outer").withColumn("score", total if digits is None else F.round(total, digits))
    return both.orderBy(F.desc("score"), F.asc(key)).limit(top_k)


def fuse(hits: DataFrame, final_limit: int, strategy: str = "rrf", dedup: bool = True, rrf_k: int = RRF_K, prefer_recent: bool = False, key: str = "record_id", digits: int | None = None) -> DataFrame:
    """Fuses the hits of several collections (columns source_order, source, rank, key, score,
    timestamp): key, fusion_score, source, source_order, rank of the representative, n_sources,
    provenance, fusion_rank.

    Scores add up, whatever the metric: under l2, where less is better, that inverts the
    order, as the reference behaviour does. The representative is the first by (source,
    rank) or, with `prefer_recent`, the newest."""
    if strategy not in ("rrf", "score_sum") or final_limit <= 0:
        raise InvalidRequest("unknown strategy or no limit")
    gain = F.lit(1.0) / (rrf_k + F.col("rank")) if strategy == "rrf" else F.col("score").cast("double")
    group = [key] if dedup else [key, "source_order"]
    own = hits.withColumn("__gain", gain)
    order = F.struct("source_order", "rank")
    first = F.min_by(F.struct("source", "source_order", "rank", "timestamp"), order)
    if prefer_recent:
        first = F.max_by(F.struct("source", "source_order", "rank", "timestamp"), F.struct(F.coalesce("timestamp", F.lit(-1)), -F.col("source_order"), -F.col("rank")))
    total = F.sum("__gain")
    out = own.groupBy(*group).agg((total if digits is None else F.round(total, digits)).alias("fusion_score"), first.alias("__r"), F.count("*").alias("n_sources"), F.sort_array(F.collect_list(F.struct("source_order", "rank", "source", "score", F.col("__gain").alias("contribution")))).alias("provenance"))
    out = out.select(key, "fusion_score", "__r.source", F.col("__r.source_order").alias("source_order"), F.col("__r.rank").alias("rank"), F.col("__r.timestamp").alias("timestamp"), "n_sources", "provenance")
    by = [F.desc("fusion_score")] + ([F.desc_nulls_last("timestamp")] if prefer_recent else []) + [F.asc("source_order"), F.asc("rank"), F.asc(key)]
    top = out.orderBy(*by).limit(final_limit)
    return top.withColumn("fusion_rank", F.row_number().over(Window.orderBy(*by)))


def search_many(targets: list[tuple[str, DataFrame | Exception]], key: str = "record_id") -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Unions the collections' ranked hits; one that failed becomes a status, the others go on."""
    out, status = None, []
    for i, (name, hits) in enumerate(targets):
        if isinstance(hits, Exception):
            status.append((name, f"error: {hits}"))
            continue
        status.append((name, "ok"))
        columns = [F.lit(i).alias("source_order"), F.lit(name).alias("source"), "rank", key, "score", F.col("timestamp") if "timestamp" in hits.columns else F.lit(None).cast("long").alias("timestamp")]
        part = hits.select(*columns)
        out = part if out is None else out.unionByName(part)
    return out, status


def freshness(hits: DataFrame, seq: str = "seq") -> DataFrame:
    """Orders by score, then the newer source, then the sequence."""
    return hits.orderBy(F.desc("score"), F.desc_nulls_last("timestamp"), F.asc(seq))
