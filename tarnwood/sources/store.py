"""A collection on shared storage: an append-only log, sealed segments, a manifest.

Layout: log/batch=N (mutations), segments/segment_id=N (sealed runs), manifests/N (JSON
lines; the greatest is current). Data is written before the manifest that names it, so a
writer that dies leaves files no reader looks at. One writer a collection."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.model import Collection
from tarnwood.operators import visibility

RECORD = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType())])


class AlreadyExists(RuntimeError):
    pass


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    sequence: int = 0  # the last one written
    covered: int = 0  # the last one in a segment
    batches: tuple[int, ...] = ()
    segments: tuple[int, ...] = ()


class Store:
    def __init__(self, spark: SparkSession, path: str, collection: Collection):
        self.spark, self.path, self.collection = spark, path.rstrip("/"), collection

    # --- files, through Hadoop's file systems only

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    # --- manifests

    @property
    def manifest(self) -> Manifest:
        versions = [int(n) for n in self._names("manifests") if n.isdigit()]
        if not versions:
            return Manifest()
        held = json.loads(self.spark.read.text(f"{self.path}/manifests/{max(versions)}").first()[0])
        return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})

    def _publish(self, manifest: Manifest) -> Manifest:
        new = replace(manifest, version=manifest.version + 1)
        self.spark.createDataFrame([(json.dumps(asdict(new)),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/manifests/{new.version}")
        return new

    # --- writing

    def append(self, batch: DataFrame, order: list[str]) -> Manifest:
        """A whole batch or nothing: checked, numbered from the last sequence on, written, then named."""
        now = self.manifest
        rows = visibility.sequenced(visibility.check_batch(batch, self.collection.dimension), now.sequence, order)
        number = now.version + 1
        rows.select(*[F.col(f.name).cast(f.dataType) for f in RECORD]).write.mode("errorifexists").parquet(f"{self.path}/log/batch={number}")
        last, n, different = self.spark.read.schema(RECORD).parquet(f"{self.path}/log/batch={number}").agg(F.max("seq"), F.count("*"), F.count_distinct("seq")).first()
        if n != batch.count() or different != n or (n and last != now.sequence + n):
            self._delete(f"log/batch={number}")
            raise RuntimeError(f"the batch came out with {n} rows and {different} sequences")
        return self._publish(replace(now, sequence=last or now.sequence, batches=(*now.batches, number)))

    def _read(self, kind: str, numbers: tuple[int, ...]) -> DataFrame:
        paths = [f"{self.path}/{kind}={n}" for n in numbers]
        return self.spark.read.schema(RECORD).parquet(*paths) if paths else self.spark.createDataFrame([], RECORD)

    def tail(self) -> DataFrame:
        return self._read("log/batch", self.manifest.batches)

    def sealed(self) -> DataFrame:
        return self._read("segments/segment_id", self.manifest.segments)

    def log(self) -> DataFrame:
        return visibility.overlay(self.sealed(), self.tail())

    def records(self) -> DataFrame:
        return visibility.visible(self.log())

    def seal(self) -> Manifest:
        """The log's batches as one segment; then the log is given back."""
        now = self.manifest
        if not now.batches:
            return now
        number = now.version + 1
        visibility.latest(self._read("log/batch", now.batches)).select(*RECORD.names).write.mode("errorifexists").parquet(f"{self.path}/segments/segment_id={number}")
        new = self._publish(replace(now, covered=now.sequence, batches=(), segments=(*now.segments, number)))
        self.collect_garbage()
        return new

    def compact(self) -> Manifest:
        """Seals, then folds all segments into one; tombstones stay."""
        now = self.seal()
        if len(now.segments) < 2:
            return now
        number = now.version + 1
        visibility.compact(self._read("segments/segment_id", now.segments)).select(*RECORD.names).write.mode("errorifexists").parquet(f"{self.path}/segments/segment_id={number}")
        new = self._publish(replace(now, segments=(number,)))
        self.collect_garbage()
        return new

    def collect_garbage(self) -> None:
        """Files that the manifest doesn't name."""
        now = self.manifest
        for kind, live in (("log", now.batches), ("segments", now.segments)):
            for name in self._names(kind):
                if int(name.split("=")[1]) not in live:
                    self._delete(f"{kind}/{name}")

    # --- information, integrity, backup

    def info(self) -> dict:
        now, counts = self.manifest, visibility.state_counts(self.log()).first()
        return {"name": self.collection.name, "dimension": self.collection.dimension, "metric": self.collection.metric, "live": counts["live"], "tombstones": counts["tombstones"], "segments": len(now.segments), "pending": len(now.batches), "sequence": now.sequence}

    def verify(self) -> DataFrame:
        """(code, class, outcome): authoritative faults are corrupt, others degraded."""
        now, log = self.manifest, self.log()
        dimension = self.collection.dimension
        checks = log.agg(
            F.count_if(F.col("record_id").isNull() | F.col("seq").isNull() | ~F.col("op").isin("upsert", "delete")).alias("malformed_mutation"),
            F.count_if((F.col("op") == "upsert") & (F.size("vector") != dimension)).alias("wrong_dimension"),
            F.count_if(F.col("seq") > now.sequence).alias("sequence_beyond_manifest"),
        ).first()
        stale = self.sealed().where(F.col("seq") > now.covered).count()
        rows = [(code, "authoritative", "ok" if not n else "corrupt") for code, n in checks.asDict().items()]
        rows.append(("segment_beyond_checkpoint", "authoritative", "ok" if not stale else "corrupt"))
        return self.spark.createDataFrame(rows, "code string, class string, outcome string")

    def backup(self, target: str) -> dict:
        """Copies the live files with a digest of their rows; a corrupt source is refused."""
        if self.verify().where("outcome != 'ok'").count():
            raise RuntimeError("the collection is corrupt")
        log = self.log()
        log.write.mode("errorifexists").parquet(f"{target}/data")
        told = {"manifest": asdict(self.manifest), "digest": _digest(log)}
        self.spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{target}/manifest")
        return told

    def restore(self, source: str) -> Manifest:
        """Into an empty place only, after the digest is checked."""
        if self._names("manifests"):
            raise AlreadyExists("the target isn't empty")
        told = json.loads(self.spark.read.text(f"{source}/manifest").first()[0])
        rows = self.spark.read.schema(RECORD).parquet(f"{source}/data")
        if _digest(rows) != told["digest"]:
            raise RuntimeError("the backup's digest is wrong")
        rows.write.mode("errorifexists").parquet(f"{self.path}/segments/segment_id=1")
        last = told["manifest"]["sequence"]
        return self._publish(Manifest(0, last, last, (), (1,)))


def _digest(rows: DataFrame) -> str:
    """Independent of the rows' order and files."""
    own = F.sha2(F.to_json(F.struct(*[F.col(c) for c in RECORD.names])), 256)
    one = rows.select(F.conv(F.substring(own, 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n")).first()
    return f"{one['n']}:{one['s']}"
