"""Exact nearest neighbours: scores, top k, keyset pages, and batches of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.model import METRICS, InvalidRequest, check_vector

#: Queries that one pass over the records answers; more are answered block by block.
QUERY_BLOCK = 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """A zero norm on either side is an error, not a score."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.raise_error(F.lit("zero-norm vector")).cast("double")).otherwise(dot(a, b) / scale)


def cosine_or_null(a: Column, b: Column) -> Column:
    """Null for different lengths, empty vectors, values that aren't finite and zero norms; within -1 and 1."""
    scale = norm(a) * norm(b)
    value = dot(a, b) / scale
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fit, F.when((scale > 0) & ~F.isnan(value) & (F.abs(value) != math.inf), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))))


def score(vector: Column, query: list[float], metric: str) -> Column:
    if metric not in METRICS:
        raise InvalidRequest("unknown metric")
    q = F.array(*[F.lit(v) for v in query])
    if metric == "dot":
        return dot(vector, q)
    if metric == "l2":
        return l2(vector, q)
    size = math.sqrt(sum(v * v for v in query))
    if size == 0:
        raise InvalidRequest("zero-norm vector")
    own = norm(vector)  # the query's norm is a constant
    return F.when(own == 0, F.raise_error(F.lit("zero-norm vector")).cast("double")).otherwise(dot(vector, q) / (own * F.lit(size)))


def ranked(metric: str, score_col: str, key: str) -> list[Column]:
    """Similarities descend, distances ascend; equal scores by id."""
    return [F.col(score_col).asc() if metric == "l2" else F.col(score_col).desc(), F.col(key).asc()]


def search(records: DataFrame, query, metric: str, top_k: int, key: str = "record_id", vector: str = "vector", predicate: Column | None = None, after: tuple[float, object] | None = None, digits: int | None = None) -> DataFrame:
    """The top k by one scan: the filter first, then scores, then a bounded sort a task.

    `after` is the (score, id) of the last row of the page before. `digits` rounds scores
    before they order."""
    query = check_vector(query)
    if top_k <= 0:
        raise InvalidRequest("top_k must be positive")
    rows = records if predicate is None else records.where(predicate)
    value = score(F.col(vector), query, metric)
    rows = rows.withColumn("score", value if digits is None else F.round(value, digits))
    if after is not None:
        s, k = after
        beyond = F.col("score") > s if metric == "l2" else F.col("score") < s
        rows = rows.where(beyond | ((F.col("score") == s) & (F.col(key) > F.lit(k))))
    return rows.orderBy(*ranked(metric, "score", key)).limit(top_k)


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    held: list = []
    for row in queries.select(key, vector).toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield [r[0] for r in held], np.array([r[1] for r in held], float)
            held = []
    if held:
        yield [r[0] for r in held], np.array([r[1] for r in held], float)


def batch_search(records: DataFrame, queries: DataFrame, metric: str, top_k: int, key: str = "record_id", vector: str = "vector", query_key: str = "query_id", digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """(query, key, score, rank) of the top k of every query.

    The queries go out in blocks of QUERY_BLOCK; each task multiplies its batches with a
    block as matrices and passes on k rows a query and batch, so what is shuffled is bounded
    by tasks, not by rows; the final ranks are a window over those."""
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, records.schema[key].dataType), T.StructField("score", T.DoubleType())])
    out = None
    for names, matrix in _blocks(queries, query_key, vector):
        held = records.sparkSession.sparkContext.broadcast((names, matrix))  # QUERY_BLOCK vectors at most

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, q = held.value
            for batch in batches:
                if not len(batch):
                    continue
                x = np.array(batch[vector].tolist(), float)
                ids = batch[key].to_numpy()
                product = q @ x.T
                if metric == "cosine":
                    product /= np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                elif metric == "l2":
                    product = -np.sqrt(np.maximum((q**2).sum(1)[:, None] - 2 * product + (x**2).sum(1)[None, :], 0))
                product = np.round(product, digits)
                for at, name in enumerate(names):
                    row = product[at] if not exclude_self else np.where(ids == name, -np.inf, product[at])
                    if len(row) > top_k:
                        edge = np.partition(row, len(row) - top_k)[len(row) - top_k]
                        over = np.flatnonzero(row > edge)
                        level = np.flatnonzero(row == edge)
                        level = level[np.argsort(ids[level], kind="stable")][: top_k - len(over)]
                        keep = np.r_[over, level]
                    else:
                        keep = np.arange(len(row))
                    keep = keep[np.isfinite(row[keep])]
                    yield pd.DataFrame({query_key: [name] * len(keep), key: ids[keep], "score": -row[keep] if metric == "l2" else row[keep]})

        part = records.select(key, vector).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return records.sparkSession.createDataFrame([], schema.add("rank", T.LongType()))
    order = Window.partitionBy(query_key).orderBy(*ranked(metric, "score", key))
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)
