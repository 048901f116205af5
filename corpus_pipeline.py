"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwood.llm import common, decontaminate, line_dedup, near_dedup, packing, queries, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the model learns from the labels of `docs` that aren't held out."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and with them documents that consist of such lines only."""
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.remove(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as sequences of at most 4096 tokens: a row a piece, with its ids."""
    pieces = tokens.pieces(docs, queries.vocabulary("word_bpe_49k.json"), with_ids=True)
    return packing.pack(pieces, n_docs=docs.count())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and greedy packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
