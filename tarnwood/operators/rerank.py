"""Reranking of a short candidate list by a pluggable scorer."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.model import MAX_TOP_K, InvalidRequest


class Reranker(Protocol):
    name: str

    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]: ...


class Overlap:
    """The share of the query's words that a text has."""

    name = "overlap"

    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        q = set(query.lower().split())
        return [(i, len(q & set(t.lower().split())) / len(q) if q else 0.0) for i, t in enumerate(texts)]


def overlap_score(query: str, text: Column) -> Column:
    """`Overlap` as an expression, for lists of any length."""
    words = sorted(set(query.lower().split()))
    own = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""))
    return F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in words]))) / F.lit(float(max(1, len(words))))


def text_of(fields: list[Column]) -> Column:
    """The non-blank fields, a line each; a hit with none fails the query."""
    parts = [F.when(F.trim(f.cast("string")) != "", f.cast("string")) for f in fields]
    joined = F.concat_ws("\n", *parts)
    return F.when(joined == "", F.raise_error(F.lit("no text to rerank")).cast("string")).otherwise(joined)


def check_scores(scores: list[tuple[int, float]], count: int) -> dict[int, float]:
    if len(scores) != count or {i for i, _ in scores} != set(range(count)) or not all(math.isfinite(s) for _, s in scores):
        raise InvalidRequest("a reranker gives one finite score for each candidate")
    return dict(scores)


def rerank(hits: DataFrame, reranker: Reranker, query: str, top_k: int, key: str = "record_id", text: str = "text", preserve_order: bool = False) -> tuple[DataFrame, bool]:
    """The hits (ranked, MAX_TOP_K at most) by the reranker's scores, then by original rank;
    and whether it was applied. A failing call keeps the order if `preserve_order`; wrong
    scores always fail."""
    rows = hits.orderBy("rank").limit(MAX_TOP_K).collect()  # a bounded list
    schema = T.StructType([*hits.schema.fields, T.StructField("rerank_score", T.DoubleType()), T.StructField("original_rank", T.IntegerType())])
    spark = hits.sparkSession
    try:
        scores = reranker.rerank(query, [r[text] for r in rows])
    except Exception:
        if not preserve_order:
            raise
        return spark.createDataFrame([(*r, None, i + 1) for i, r in enumerate(rows[:top_k])], schema), False
    held = check_scores(scores, len(rows))
    order = sorted(range(len(rows)), key=lambda i: (-held[i], i))[:top_k]
    return spark.createDataFrame([(*rows[i], float(held[i]), i + 1) for i in order], schema), True
