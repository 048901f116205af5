"""Re-embedding: stage vectors of a new model, catch up, cut over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.operators import embedding


def stage(live: DataFrame, provider, dimension: int, key: str = "record_id", text: str = "text") -> DataFrame:
    """(key, source_seq, vector) of the live records that have text."""
    rows = live.where(F.col(text).isNotNull())
    return embedding.embed(rows, provider, dimension, key, text).join(rows.select(key, F.col("seq").alias("source_seq")), key)


def difference(staged: DataFrame, live: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, state): keep, embed (new or newer) or removed."""
    both = staged.select(key, "source_seq").join(live.select(key, "seq"), key, "full_outer")
    state = F.when(F.col("seq").isNull(), "removed").when(F.col("source_seq").eqNullSafe(F.col("seq")), "keep").otherwise("embed")
    return both.select(key, state.alias("state"))


def ready(staged: DataFrame, live: DataFrame, key: str = "record_id") -> bool:
    return difference(staged, live, key).where("state != 'keep'").isEmpty()


def cutover(staged: DataFrame, live: DataFrame, key: str = "record_id") -> DataFrame:
    """New versions of the live records with the staged vectors; a drift is refused."""
    if not ready(staged, live, key):
        raise RuntimeError("the staged vectors don't match the live records")
    return live.drop("vector", "seq").join(staged.select(key, "vector"), key)


def recover(staged: DataFrame, published: DataFrame, prepared: bool, key: str = "record_id") -> str:
    """What a cutover that broke off has left: committed, ready (nothing published) or failed."""
    n, done = staged.count(), staged.join(published.select(key, F.col("vector").alias("__v")), key).where(F.col("vector") == F.col("__v")).count()
    return "committed" if done == n else "ready" if done == 0 and prepared else "failed"
