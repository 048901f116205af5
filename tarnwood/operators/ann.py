"""Approximate neighbours: an inverted file with exact rescoring, tuned to a measured recall."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.operators import vector as exact

#: Vectors that the cells are fitted on, those of the least id hash; every row is indexed.
SAMPLE_ROWS = 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def k_means(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centers = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)[None, :]).argmin(1)
        for c in range(len(centers)):
            if (own == c).any():
                centers[c] = x[own == c].mean(0)
    return centers


@dataclass
class Index:
    centers: np.ndarray
    rows: DataFrame  # key, vector, cell
    key: str
    vector: str
    metric: str
    probes: int = 1

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        return _unit(x) if self.metric == "cosine" else x

    def nearest_cells(self, queries: list, probes: int) -> list[list[int]]:
        q = self._prepared(np.array(queries, float))
        if self.metric == "dot":
            away = -(q @ self.centers.T)
        else:
            away = -2 * q @ self.centers.T + (self.centers**2).sum(1)[None, :]
        return np.argsort(away, axis=1, kind="stable")[:, :probes].tolist()

    def search(self, queries: DataFrame, top_k: int, query_key: str = "query_id", probes: int | None = None, digits: int = 6) -> DataFrame:
        """(query, key, score, rank) among the rows of each query's nearest cells, scored exactly.

        Queries go out in blocks. A task takes the rows of its batch that lie in a query's
        cells and passes on k of them a query and batch."""
        probes = probes or self.probes
        schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(self.key, self.rows.schema[self.key].dataType), T.StructField("score", T.DoubleType())])
        out, key, vector, metric = None, self.key, self.vector, self.metric
        for names, matrix in exact._blocks(queries, query_key, vector):
            cells = self.nearest_cells(matrix, probes)
            by_cell: dict[int, list[int]] = {}
            for i, own in enumerate(cells):
                for c in own:
                    by_cell.setdefault(c, []).append(i)
            held = self.rows.sparkSession.sparkContext.broadcast((names, matrix, by_cell))  # a block of queries

            def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
                names, q, by_cell = held.value
                for batch in batches:
                    for c, rows in batch.groupby("cell"):
                        wanted = by_cell.get(int(c), [])
                        if not wanted:
                            continue
                        x, ids = np.array(rows[vector].tolist(), float), rows[key].to_numpy()
                        for at in wanted:
                            if metric == "l2":
                                s = np.sqrt(((x - q[at]) ** 2).sum(1))
                            else:
                                s = x @ q[at]
                                if metric == "cosine":
                                    s = s / (np.linalg.norm(x, axis=1) * np.linalg.norm(q[at]))
                            s = np.round(s, digits)
                            keep = np.lexsort((ids, s if metric == "l2" else -s))[:top_k]
                            yield pd.DataFrame({query_key: [names[at]] * len(keep), key: ids[keep], "score": s[keep]})

            part = self.rows.where(F.col("cell").isin(*by_cell)).select(key, vector, "cell").mapInPandas(run, schema)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.rows.sparkSession.createDataFrame([], schema.add("rank", T.LongType()))
        order = Window.partitionBy(query_key).orderBy(*exact.ranked(metric, "score", key))
        return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)

    def tune(self, sample: DataFrame, top_k: int, target: float, query_key: str = "query_id") -> Index:
        """Doubles the probes until the recall on `sample`, against exact search, reaches the target."""
        from tarnwood.operators.evaluate import recall

        truth = exact.batch_search(self.rows, sample, self.metric, top_k, self.key, self.vector, query_key)
        probes = max(1, len(self.centers) // 8)
        while probes < len(self.centers):
            got = recall(self.search(sample, top_k, query_key, probes), truth, query_key, self.key).agg(F.avg("recall")).first()[0]
            if got is None or got >= target:
                break
            probes = min(len(self.centers), int(probes * 1.5) + 1)
        return Index(self.centers, self.rows, self.key, self.vector, self.metric, probes)


def build(records: DataFrame, metric: str, cells: int = 32, key: str = "record_id", vector: str = "vector", sample: int = SAMPLE_ROWS) -> Index:
    """Fits the cells on a bounded sample and assigns every row to its nearest one."""
    x = np.array([r[0] for r in records.select(vector, key).orderBy(F.xxhash64(key), key).limit(sample).collect()], float)
    if not len(x):
        return Index(np.zeros((1, 1)), records.select(key, vector).withColumn("cell", F.lit(0)), key, vector, metric)
    centers = k_means(_unit(x) if metric == "cosine" else x, cells)
    schema = T.StructType([T.StructField(key, records.schema[key].dataType), T.StructField(vector, T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.array(b[vector].tolist(), float)
                u = _unit(v) if metric == "cosine" else v
                own = ((centers**2).sum(1)[None, :] - 2 * u @ centers.T).argmin(1)
                yield pd.DataFrame({key: b[key], vector: v.tolist(), "cell": own.astype("int32")})

    return Index(centers, records.select(key, vector).mapInPandas(assign, schema), key, vector, metric)
