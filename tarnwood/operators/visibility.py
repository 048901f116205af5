"""The visibility fold: which version of a record counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions.shared import written


def latest(log: DataFrame, key: str = "record_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """The last version of each key, tombstones included; at one sequence an upsert wins.

    One aggregate with map-side folding, whatever the number of versions; no window."""
    rest = [c for c in log.columns if c != key]
    order = F.struct(F.col(seq), (F.col(op) == "upsert").cast("int"))
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__v")).select(key, "__v.*")


def visible(log: DataFrame, key: str = "record_id", seq: str = "seq", op: str = "op") -> DataFrame:
    return latest(log, key, seq, op).where(F.col(op) == "upsert")


def state_counts(log: DataFrame, key: str = "record_id", seq: str = "seq", op: str = "op") -> DataFrame:
    last = latest(log.select(key, seq, op), key, seq, op)
    return last.agg(F.count_if(F.col(op) == "upsert").alias("live"), F.count_if(F.col(op) == "delete").alias("tombstones"))


def overlay(sealed: DataFrame, tail: DataFrame) -> DataFrame:
    """Sealed segments and the unsealed tail: reads see the writer's own writes."""
    return sealed.unionByName(tail, allowMissingColumns=True)


def compact(log: DataFrame, key: str = "record_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """One row a key; tombstones are retained."""
    return latest(log, key, seq, op)


def segment(batch: DataFrame, segment_id: int, key: str = "record_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """An immutable run from a batch of mutations; duplicate sequences are an error."""
    twice = batch.groupBy(seq).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"sequence {twice[0][0]} is used twice")
    return latest(batch, key, seq, op).withColumn("segment_id", F.lit(segment_id))


def fetch(records: DataFrame, ids: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(found, missing) for `ids` with columns (ordinal, key); an id asked for twice is given twice."""
    found = ids.join(records, key).select("ordinal", key, *[c for c in records.columns if c != key])
    return found, ids.join(records.select(key), key, "left_anti")


def check_batch(batch: DataFrame, dimension: int) -> DataFrame:
    """Fails the whole batch on a wrong dimension or a value that isn't finite."""
    bad = (F.col("op") == "upsert") & ((F.size("vector") != dimension) | F.exists("vector", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))))
    return batch.where(F.when(bad, F.raise_error(F.lit("invalid vector in batch")).cast("boolean")).otherwise(F.lit(True)))


def sequenced(batch: DataFrame, base: int, order: list[str]) -> DataFrame:
    """Consecutive sequence numbers from `base` + 1 in the order of `order`. Ranks are made
    by range partition: a sort, counts a partition, and the sum of those before it.

    Partitions differ between two runs of one plan (bounds are sampled anew, and partitions
    may be coalesced), so the sorted rows are written once, with their partition and place,
    and counts and numbers are made of what was written."""
    ranged = batch.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(ranged.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "sequenced")
    counts = kept.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("__first"))
    start = counts.select("__p", "__first", (F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__start"))  # one row a partition
    return kept.join(F.broadcast(start), "__p").withColumn("seq", F.lit(base) + F.col("__start") + (F.col("__m") - F.col("__first")) + 1).drop("__p", "__m", "__first", "__start")
