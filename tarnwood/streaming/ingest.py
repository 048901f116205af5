"""Continuous ingestion: envelopes from a stream into the mutation log, poison aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ENVELOPE = "version int, op string, id struct<type string, value string>, vector array<double>, metadata string, text string, source string"


def decode(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds envelope and error_class (null where the envelope is good): missing_payload,
    invalid_json, unsupported_version or invalid_envelope, the first that applies."""
    raw = F.col(payload).cast("string")
    parsed = F.try_parse_json(raw)
    env = F.from_json(raw, ENVELOPE)
    out = messages.withColumn("envelope", env).withColumn("__json", parsed.isNotNull())
    e = lambda n: F.col(f"envelope.{n}")
    good_id = (e("id.type") == "string") & (F.length(e("id.value")) > 0) | (e("id.type") == "u64") & e("id.value").rlike(r"^\d{1,20}$")
    shape = e("op").isin("upsert", "delete", "document") & good_id & F.when(e("op") == "upsert", F.size(e("vector")) > 0).when(e("op") == "document", F.length(e("text")) > 0).otherwise(F.lit(True))
    error = (
        F.when(raw.isNull(), "missing_payload")
        .when(~F.col("__json"), "invalid_json")
        .when(~F.coalesce(e("version") == 1, F.lit(False)), "unsupported_version")
        .when(~F.coalesce(shape, F.lit(False)), "invalid_envelope")
    )
    return out.withColumn("error_class", error).drop("__json")


def check_batch(messages: DataFrame) -> DataFrame:
    """Per partition: rows, least and greatest offset, whether offsets repeat."""
    return messages.groupBy("partition").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"), (F.count("*") != F.count_distinct("offset")).alias("repeats"))


def mutations(good: DataFrame) -> DataFrame:
    """The log's rows of decoded messages; redelivery repeats (partition, offset), which is dropped."""
    one = good.dropDuplicates(["partition", "offset"])
    key = F.concat(F.col("envelope.id.type"), F.lit(":"), F.col("envelope.id.value"))
    op = F.when(F.col("envelope.op") == "delete", "delete").otherwise("upsert")
    return one.select("partition", "offset", key.alias("record_id"), op.alias("op"), F.col("envelope.vector").alias("vector"), F.col("envelope.metadata").alias("metadata"), F.col("envelope.text").alias("text"))


def dead_letter(topic: Column) -> Column:
    return F.concat_ws(":", topic, F.col("partition").cast("string"), F.col("offset").cast("string"))


class Ingestion:
    """A managed stream: JSON lines here, any source with partition, offset and payload.

    `policy` block: a poison message stops the stream and nothing of its batch is
    written. dead_letter: good messages are applied, poison goes to `dlq`; a message
    without payload stops the stream under either policy."""

    def __init__(self, spark: SparkSession, source: str, log: str, dlq: str, checkpoint: str, policy: str = "dead_letter", topic: str = "records", source_format: str = "json"):
        self.spark, self.source, self.log, self.dlq, self.checkpoint, self.policy, self.topic, self.format = spark, source, log, dlq, checkpoint, policy, topic, source_format
        self.query: StreamingQuery | None = None

    def _apply(self, batch: DataFrame, number: int) -> None:
        rows = decode(batch)
        held = {r["error_class"]: r["count"] for r in rows.groupBy("error_class").count().collect()}
        stop = {k for k in held if k} if self.policy == "block" else {k for k in held if k == "missing_payload"}
        if stop:
            raise ValueError(f"poison messages: {sorted(stop)}")
        # a batch that is run again overwrites its own folder: applied once
        mutations(rows.where("error_class is null")).write.mode("overwrite").parquet(f"{self.log}/batch={number}")
        bad = rows.where("error_class is not null").select(dead_letter(F.lit(self.topic)).alias("key"), F.lit(self.topic).alias("topic"), "partition", "offset", "error_class", "payload")
        bad.write.mode("overwrite").parquet(f"{self.dlq}/batch={number}")

    def start(self, once: bool = True) -> StreamingQuery:
        if self.query is not None and self.query.isActive:
            raise RuntimeError("already running")
        stream = self.spark.readStream.schema("partition int, offset long, payload string").format(self.format).load(self.source)
        writer = stream.writeStream.foreachBatch(self._apply).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
        return self.query

    def pause(self) -> None:
        if self.query is None or not self.query.isActive:
            raise RuntimeError("not running")
        self.query.stop()

    resume = start
