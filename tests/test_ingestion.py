"""Chunking, provenance, embedding, the store, streams and re-embedding."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwood.model import CharPolicy, Collection, InvalidRequest, SemanticPolicy, TokenPolicy
from tarnwood.operators import chunking, embedding, provenance, reembed
from tarnwood.sources.store import AlreadyExists, Store
from tarnwood.streaming.ingest import Ingestion, check_batch, decode


def test_char_chunks(spark):
    rows = spark.createDataFrame([(1, "abcdefghij"), (2, "äb"), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["end"], r["text"]) for r in chunking.char_chunks(rows, CharPolicy(5, 2)).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, 0, 5, "abcde"), (1, 3, 8, "defgh"), (1, 6, 10, "ghij"), (2, 0, 2, "äb")]
    with pytest.raises(InvalidRequest):
        CharPolicy(5, 5)


def test_token_chunks():
    texts = lambda t, p: [c[4] for c in chunking.token_chunk(t, p)]
    got = texts("one two three four five six seven eight", TokenPolicy(4, 1))
    assert len(got) == 3 and got[1].startswith("four")
    assert texts("One two three. Four five six seven.", TokenPolicy(5, 0, "sentence"))[0] == "One two three."
    assert texts("alpha beta\n\ngamma delta epsilon", TokenPolicy(4, 0, "paragraph"))[0] == "alpha beta"
    assert texts("intro words\n# Heading\nnext words here", TokenPolicy(5, 0, "markdown"))[0] == "intro words"
    assert len(texts("<p>alpha beta</p><p>gamma delta</p>", TokenPolicy(8, 0, "html"))) >= 2
    assert chunking.token_chunk("é x", TokenPolicy(1, 0))[1][1:3] == (3, 4)  # bytes
    assert chunking.token_chunk("", TokenPolicy(4)) == []


def test_semantic_chunks():
    text = "a a a b b b a a a c c c"
    got = chunking.semantic_chunk(text, SemanticPolicy(6, 3, 0.5))
    assert len(got) >= 2 and all(c[3] <= 6 for c in got)
    assert chunking.semantic_chunk("One. Two.", SemanticPolicy(2, 1, 0.5), lambda a, b: None) == chunking.token_chunk("One. Two.", TokenPolicy(2, 0, "sentence"))


def test_hash_change_and_provenance(spark):
    rows = spark.createDataFrame([("a\r\nb\r", "a\nb\n")], "x string, y string")
    a, b = rows.select(provenance.content_hash(F.col("x")), provenance.content_hash(F.col("y"))).first()
    assert a == b and a.startswith("911169dd") and a.endswith("e5aa59a2")
    states = spark.createDataFrame([(None, "h", "v1", "v1"), ("h", "h", "v1", "v1"), ("h", "h", "v1", "v2"), ("h", "g", "v1", "v1"), ("h", "h", None, None)], "o string, n string, ov string, nv string")
    got = [r[0] for r in states.select(provenance.change(F.col("o"), F.col("n"), [F.col("ov")], [F.col("nv")])).collect()]
    assert got == ["new", "unchanged", "changed", "changed", "unchanged"]
    m = spark.createDataFrame([({"a": "b"}, {"_tw_x": "y"}, "t")], "ok map<string,string>, bad map<string,string>, t string")
    assert set(m.select(provenance.with_provenance(F.col("ok"), F.col("t"))).first()[0]) == {"a", "_tw_content"}
    with pytest.raises(Exception, match="reserved"):
        m.select(provenance.with_provenance(F.col("bad"), F.col("t"))).collect()


def test_deterministic_embedding(spark):
    assert [round(v, 6) for v in embedding.Deterministic(4).embed(["hello"])[0]] == [0.282741, 0.68794, -0.942766, -0.40583]
    many = embedding.Deterministic(3).embed(["", "a", "hello", "hé"])
    assert many == [embedding.Deterministic(3).embed([t])[0] for t in ("", "a", "hello", "hé")]
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "doc_id long, text string")
    cache = spark.createDataFrame([], "hash string, vector array<double>")
    got, fresh = embedding.embed_cached(rows, cache, embedding.Deterministic(2), 2)
    assert got.count() == 3 and fresh.count() == 2
    registry = embedding.Registry()
    registry.register("p", embedding.Deterministic(2))
    with pytest.raises(InvalidRequest):
        registry.register("p", embedding.Deterministic(2))


def batch(spark, rows):
    return spark.createDataFrame(rows, "record_id string, op string, vector array<double>, metadata string")


def test_store_lifecycle(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c", Collection("c", 2))
    store.append(batch(spark, [("a", "upsert", [1.0, 2.0], "{}"), ("b", "upsert", [3.0, 4.0], "{}")]), ["record_id"])
    assert {r["record_id"] for r in store.records().collect()} == {"a", "b"}
    with pytest.raises(Exception, match="invalid vector"):
        store.append(batch(spark, [("x", "upsert", [1.0], "{}")]), ["record_id"])
    assert store.manifest.sequence == 2  # nothing of the bad batch
    store.seal()
    store.append(batch(spark, [("a", "delete", None, None), ("c", "upsert", [5.0, 6.0], "{}")]), ["record_id"])
    assert {r["record_id"] for r in store.records().collect()} == {"b", "c"}  # reads its own writes
    before = sorted(map(tuple, store.records().select("record_id", "seq").collect()))
    store.compact()
    assert sorted(map(tuple, store.records().select("record_id", "seq").collect())) == before
    assert store.info() == {"name": "c", "dimension": 2, "metric": "cosine", "live": 2, "tombstones": 1, "segments": 1, "pending": 0, "sequence": 4}
    assert store.verify().where("outcome != 'ok'").count() == 0
    store.backup(f"file://{tmp_path}/backup")
    other = Store(spark, f"file://{tmp_path}/d", Collection("d", 2))
    other.restore(f"file://{tmp_path}/backup")
    assert sorted(map(tuple, other.records().select("record_id", "seq").collect())) == before
    with pytest.raises(AlreadyExists):
        other.restore(f"file://{tmp_path}/backup")


def good(op="upsert", **more):
    return json.dumps({"version": 1, "op": op, "id": {"type": "string", "value": "doc-1"}, "vector": [1.0], **more})


def test_decode(spark):
    payloads = [good(), good("delete"), None, "{", json.dumps({"version": 99}), good("other"), good(id={"type": "string", "value": ""}), good("document", text="t")]
    rows = spark.createDataFrame([(0, i, p) for i, p in enumerate(payloads)], "partition int, offset long, payload string")
    assert [r["error_class"] for r in decode(rows).orderBy("offset").collect()] == [None, None, "missing_payload", "invalid_json", "unsupported_version", "invalid_envelope", "invalid_envelope", None]
    assert check_batch(rows.unionByName(rows)).first()["repeats"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("".join(json.dumps({"partition": 3, "offset": 40 + i, "payload": p}) + "\n" for i, p in enumerate([good(), good(), "{", good("delete")])))
    make = lambda name, policy: Ingestion(spark, str(source), f"{tmp_path}/{name}/log", f"{tmp_path}/{name}/dlq", f"{tmp_path}/{name}/cp", policy)
    run = make("dead", "dead_letter")
    run.start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/dead/log").count() == 3
    assert [r["key"] for r in spark.read.parquet(f"{tmp_path}/dead/dlq").collect()] == ["records:3:42"]
    run.resume().awaitTermination()  # nothing new: nothing twice
    assert spark.read.parquet(f"{tmp_path}/dead/log").count() == 3
    with pytest.raises(Exception, match="poison"):
        make("block", "block").start().awaitTermination()
    assert not (tmp_path / "block/log").exists()


def test_reembedding(spark):
    live = spark.createDataFrame([("a", 1, "x", [0.0]), ("b", 2, "y", [0.0])], "record_id string, seq long, text string, vector array<double>")
    staged = reembed.stage(live, embedding.Deterministic(2), 2)
    assert reembed.ready(staged, live) and reembed.cutover(staged, live).count() == 2
    later = live.withColumn("seq", F.when(F.col("record_id") == "a", 9).otherwise(F.col("seq")).cast("long")).where("record_id = 'a'")
    assert {r["record_id"]: r["state"] for r in reembed.difference(staged, later).collect()} == {"a": "embed", "b": "removed"}
    with pytest.raises(RuntimeError):
        reembed.cutover(staged, later)
    assert reembed.recover(staged, staged, True) == "committed" and reembed.recover(staged, staged.limit(0), True) == "ready" and reembed.recover(staged, staged.limit(1), True) == "failed"


def test_append_keeps_every_row(spark, tmp_path):
    from pyspark.sql import functions as F

    from tarnwood.model import Collection
    from tarnwood.sources.store import RECORD, Store

    source = str(tmp_path / "rows")
    rows = spark.range(200_000).select(F.concat(F.lit("r"), F.col("id")).alias("record_id"), F.lit("upsert").alias("op"), F.array(F.rand(1).cast("float"), F.lit(1.0).cast("float")).alias("vector"), F.repeat(F.lit("x"), 40).alias("metadata"), F.xxhash64("id").alias("at"))
    rows.write.parquet(source)
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            store = Store(spark, str(tmp_path / f"store-{adaptive}"), Collection("c", 2, "dot"))
            manifest = store.append(spark.read.parquet(source), ["at"])
            got = store.tail().agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq"), F.count_distinct("record_id")).first()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert tuple(got) == (200_000, 200_000, 1, 200_000, 200_000)
        assert manifest.sequence == 200_000 and [f.name for f in store.tail().schema] == RECORD.names
