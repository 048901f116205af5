"""The registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.functions.shared import shared_dir
from tarnwood.model import CharPolicy, SemanticPolicy, TokenPolicy
from tarnwood.operators import ann, chunking, context, embedding, evaluate, fusion, lexical, predicate, provenance, reembed, rerank, vector, visibility

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TEXT = "the and thing of that"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")


def first_vector(spark, sf_dir) -> list[float]:
    return [float(v) for v in dense(spark, sf_dir).where("vec_id = 0").first()["vector"]]


# --- dense retrieval

_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_DOT = "list_inner_product(embedding::DOUBLE[], q)"
_COSINE = f"{_DOT} / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q, q)))"
_L2 = "sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _knn(metric: str, score: str, where: str = "", extra: str = "LIMIT 10") -> str:
    return f"SELECT vec_id, label, round({score}, 6) AS score FROM embeddings, {_Q} {where} ORDER BY score {'ASC' if metric == 'l2' else 'DESC'}, vec_id {extra}"


def _top(spark, sf_dir, metric, k=10, **more):
    return vector.search(dense(spark, sf_dir), first_vector(spark, sf_dir), metric, k, "vec_id", digits=6, **more).select("vec_id", "label", "score")


@query(_knn("cosine", _COSINE))
def dense_cosine(spark, sf_dir):
    return _top(spark, sf_dir, "cosine")


@query(_knn("dot", _DOT))
def dense_dot(spark, sf_dir):
    return _top(spark, sf_dir, "dot")


@query(_knn("l2", _L2))
def dense_l2(spark, sf_dir):
    return _top(spark, sf_dir, "l2")


@query(_knn("cosine", _COSINE, "WHERE label < 5"))
def dense_filtered(spark, sf_dir):
    where = predicate.lower(predicate.parse({"op": "lt", "path": ["label"], "value": 5}), predicate.Typed({"label": "int"}))
    return _top(spark, sf_dir, "cosine", predicate=where)


@query(_knn("cosine", _COSINE, extra="LIMIT 10 OFFSET 10"))
def dense_keyset_page2(spark, sf_dir):
    last = _top(spark, sf_dir, "cosine").collect()[-1]
    return _top(spark, sf_dir, "cosine", after=(last["score"], last["vec_id"]))


def _hundredth(spark, sf_dir):
    return dense(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")


@query("""
SELECT query_id, vec_id, score, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10""")
def dense_batch_knn(spark, sf_dir):
    return vector.batch_search(dense(spark, sf_dir).withColumnRenamed("vec_id", "vec_id"), _hundredth(spark, sf_dir), "dot", 10, "vec_id")


@query()
def knn_recall(spark, sf_dir):
    """Recall of the tuned index against exact search, a row a query."""
    rows, queries = dense(spark, sf_dir), _hundredth(spark, sf_dir)
    index = ann.build(rows, "cosine", 32, "vec_id").tune(queries, 10, 0.95)
    exact = vector.batch_search(rows, queries, "cosine", 10, "vec_id")
    return evaluate.recall(index.search(queries, 10), exact, key="vec_id").withColumn("probes", F.lit(index.probes))


# --- the filter language over events.props

_K = "json_extract(props, '$.k')"


def _where(spark, sf_dir, wire) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("__m", F.try_parse_json("props"))
    return events.where(predicate.lower(predicate.parse(wire), predicate.Variant(F.col("__m")))).select("event_id", "props")


def _events(where: str) -> str:
    return f"SELECT event_id, props FROM events WHERE {where}"


def _predicate(name: str, wire: dict, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _where(spark, sf_dir, wire)
    SQL[name] = _events(where)


_predicate("pred_eq", {"op": "eq", "path": ["k"], "value": 7}, f"coalesce({_K}::DOUBLE = 7, false)")
_predicate("pred_ne", {"op": "ne", "path": ["k"], "value": 7}, f"coalesce({_K}::DOUBLE <> 7, false)")
_predicate("pred_range", {"op": "and", "predicates": [{"op": "gte", "path": ["k"], "value": 10}, {"op": "lt", "path": ["k"], "value": 60}]}, f"coalesce({_K}::DOUBLE >= 10 AND {_K}::DOUBLE < 60, false)")
_predicate("pred_in", {"op": "in", "path": ["k"], "values": [1, 2, 3, "4"]}, f"coalesce({_K}::DOUBLE IN (1, 2, 3), false)")
_predicate("pred_exists", {"op": "exists", "path": ["k"]}, f"{_K} IS NOT NULL")
_predicate("pred_not_missing", {"op": "not", "predicate": {"op": "eq", "path": ["absent"], "value": 1}}, "true")
_predicate(
    "pred_and_or_not",
    {"op": "or", "predicates": [{"op": "and", "predicates": [{"op": "gt", "path": ["k"], "value": 90}, {"op": "not", "predicate": {"op": "eq", "path": ["k"], "value": 95}}]}, {"op": "lte", "path": ["k"], "value": 3}]},
    f"coalesce(({_K}::DOUBLE > 90 AND {_K}::DOUBLE <> 95) OR {_K}::DOUBLE <= 3, false)",
)


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src1'")
def pred_contains(spark, sf_dir):
    """Array membership: the row's tags are its language and source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    tree = predicate.Tree("or", (predicate.Leaf("contains", ("tags",), "de"), predicate.Leaf("contains", ("tags",), "src1")))
    return rows.where(predicate.lower(tree, predicate.Typed({"tags": "array<string>"}))).select("doc_id")


@query("WITH e AS (SELECT event_id, epoch_ns(ts) // 1000000 AS observed FROM events) SELECT event_id, observed FROM e WHERE observed > (SELECT round(avg(observed))::BIGINT FROM e)")
def temporal_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("observed"))
    middle = events.agg(F.round(F.avg("observed")).cast("long")).first()[0]
    tree = predicate.temporal(None, after=middle, path=("observed",))
    return events.where(predicate.lower(tree, predicate.Typed({"observed": "bigint"})))


@query("SELECT doc_id, to_json({'lang': lang}) AS kept FROM documents")
def metadata_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    metadata = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("_tw_content"), F.lit("x"))
    return rows.select("doc_id", F.to_json(predicate.project(metadata, ["lang", "_tw_content"])).alias("kept"))


# --- lexical retrieval


def index_of(spark, sf_dir) -> DataFrame:
    return lexical.postings(table(spark, sf_dir, "documents"), ["text"], "doc_id")


def _bm25(fields: str = "text", where: str = "", k: int = 10, text: str = TEXT) -> str:
    terms = ", ".join(f"'{t}'" for t in sorted(set(text.split())))
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower({fields}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT unnest([{terms}]) AS w),
f AS (SELECT w, count(*) FILTER (WHERE list_contains(t, w)) AS df FROM q, d GROUP BY w),
c AS (SELECT doc_id, w, len(list_filter(t, lambda x: x = w)) AS tf, len(t) AS l FROM d, q),
r AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM c JOIN f USING (w), s WHERE tf > 0 GROUP BY doc_id)
SELECT doc_id, score FROM r {where} ORDER BY score DESC, doc_id LIMIT {k}"""


@query(_bm25())
def bm25_top(spark, sf_dir):
    return lexical.search(index_of(spark, sf_dir), TEXT, 10, "doc_id", digits=6)


@query(_bm25(where="WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')"))
def bm25_filtered(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").where("lang = 'de'")
    return lexical.search(index_of(spark, sf_dir), TEXT, 10, "doc_id", allowed, digits=6)


@query(_bm25(fields="text || ' ' || source || ' ' || lang", text="the src1 de"))
def bm25_multifield(spark, sf_dir):
    index = lexical.postings(table(spark, sf_dir, "documents"), ["text", "source", "lang"], "doc_id")
    return lexical.search(index, "the src1 de", 10, "doc_id", digits=6)


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f"SELECT count(*)::BIGINT AS n, sum(len({_TOKENS}))::BIGINT AS total, round(avg(len({_TOKENS})), 6) AS avg_length FROM documents")
def bm25_stats(spark, sf_dir):
    return lexical.statistics(index_of(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


@query(f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf_dir):
    return lexical.document_frequencies(index_of(spark, sf_dir))


# --- hybrid and several collections


def _hybrid(depth: int) -> str:
    return f"""
WITH j AS (SELECT vec_id AS doc_id, embedding FROM embeddings SEMI JOIN documents ON vec_id = doc_id),
de AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS dense_rank FROM (SELECT doc_id, round({_COSINE}, 6) AS score FROM j, {_Q} ORDER BY score DESC, doc_id LIMIT {depth})),
le AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS lexical_rank FROM ({_bm25(k=depth).replace("FROM documents)", "FROM documents SEMI JOIN embeddings ON vec_id = doc_id)")}))
SELECT coalesce(de.doc_id, le.doc_id) AS doc_id, dense_rank, lexical_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 6) AS score
FROM de FULL JOIN le ON de.doc_id = le.doc_id ORDER BY score DESC, 1 LIMIT 10"""


def _hybrid_hits(spark, sf_dir, depth):
    documents = table(spark, sf_dir, "documents")
    joined = dense(spark, sf_dir).join(documents.select("doc_id", "text"), F.col("vec_id") == F.col("doc_id")).select("doc_id", "vector", "text")
    d = vector.search(joined.select("doc_id", "vector"), first_vector(spark, sf_dir), "cosine", depth, "doc_id", digits=6)
    x = lexical.search(lexical.postings(joined, ["text"], "doc_id"), TEXT, depth, "doc_id", digits=6)
    hits = fusion.reciprocal_rank(d, x, "cosine", 10, "doc_id", digits=6)
    return hits.select("doc_id", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("lexical_rank").cast("long").alias("lexical_rank"), "score")


@query(_hybrid(10))
def hybrid_rrf(spark, sf_dir):
    return _hybrid_hits(spark, sf_dir, 10)


@query(_hybrid(40))
def hybrid_expanded(spark, sf_dir):
    return _hybrid_hits(spark, sf_dir, 40)


def _two_collections(spark, sf_dir):
    q = first_vector(spark, sf_dir)
    parts = []
    for name, where in (("low", "label < 6"), ("high", "label >= 3")):
        hits = vector.search(dense(spark, sf_dir).where(where), q, "cosine", 20, "vec_id", digits=6)
        parts.append((name, fusion.with_rank(hits, "cosine", "vec_id")))
    return fusion.search_many(parts, "vec_id")[0]


def _fused(gain: str) -> str:
    side = lambda i, where: f"SELECT {i} AS o, vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ({_knn('cosine', _COSINE, f'WHERE {where}', 'LIMIT 20')})"
    return f"""
WITH h AS ({side(0, "label < 6")} UNION ALL {side(1, "label >= 3")}),
g AS (SELECT vec_id, round(sum({gain}), 6) AS fusion_score, min((o, r)) AS f, count(*)::BIGINT AS n_sources FROM h GROUP BY vec_id)
SELECT vec_id, fusion_score, n_sources FROM g ORDER BY fusion_score DESC, f, vec_id LIMIT 15"""


@query(_fused("1.0::DOUBLE / (60 + r)"))
def fusion_rrf_many(spark, sf_dir):
    return fusion.fuse(_two_collections(spark, sf_dir), 15, "rrf", key="vec_id", digits=6).select("vec_id", "fusion_score", "n_sources")


@query(_fused("score"))
def fusion_score_sum(spark, sf_dir):
    return fusion.fuse(_two_collections(spark, sf_dir), 15, "score_sum", key="vec_id", digits=6).select("vec_id", "fusion_score", "n_sources")


_QUERY_WORDS = "the thing that works"


@query(f"""
WITH q AS (SELECT list_distinct(string_split('{_QUERY_WORDS}', ' ')) AS q),
s AS (SELECT doc_id, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\s+')), q)) / 4.0::DOUBLE, 6) AS score FROM documents, q)
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def rerank_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.round(rerank.overlap_score(_QUERY_WORDS, F.col("text")), 6).alias("score"))
    return rows.orderBy(F.desc("score"), "doc_id").limit(20)


# --- versions: events as a mutation log


def mutation_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "value")


_LAST = "(SELECT user_id AS record_id, event_id AS seq, value, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)"


@query(f"SELECT record_id, seq, value FROM {_LAST} WHERE rn = 1 AND op = 'upsert'")
def visible_fold(spark, sf_dir):
    return visibility.visible(mutation_log(spark, sf_dir)).select("record_id", "seq", "value")


@query(f"SELECT count(*) FILTER (WHERE op = 'upsert')::BIGINT AS live, count(*) FILTER (WHERE op = 'delete')::BIGINT AS tombstones FROM {_LAST} WHERE rn = 1")
def live_tombstone_counts(spark, sf_dir):
    return visibility.state_counts(mutation_log(spark, sf_dir))


@query(f"SELECT record_id, seq, op, value FROM {_LAST} WHERE rn = 1")
def compact(spark, sf_dir):
    return visibility.compact(mutation_log(spark, sf_dir)).select("record_id", "seq", "op", "value")


@query(f"SELECT record_id, seq, op FROM (SELECT * FROM {_LAST.replace('FROM events', 'FROM events WHERE event_id < 500')} WHERE rn = 1 UNION ALL SELECT * FROM {_LAST.replace('FROM events', 'FROM events WHERE event_id >= 500')} WHERE rn = 1) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) = 1")
def sealed_overlay(spark, sf_dir):
    """Two segments and the fold over them."""
    log = mutation_log(spark, sf_dir)
    parts = visibility.segment(log.where("seq < 500"), 1), visibility.segment(log.where("seq >= 500"), 2)
    return visibility.latest(visibility.overlay(*parts)).select("record_id", "seq", "op")


_ASKED = [3, 1, 3, 99999999, 7]


def _asked(spark):
    return spark.createDataFrame(list(enumerate(_ASKED)), "ordinal long, vec_id long")


@query(f"SELECT ordinal, vec_id, label FROM (SELECT unnest(range(0, {len(_ASKED)})) AS ordinal, unnest({_ASKED})::BIGINT AS vec_id) JOIN embeddings USING (vec_id)")
def record_fetch(spark, sf_dir):
    return visibility.fetch(table(spark, sf_dir, "embeddings").select("vec_id", "label"), _asked(spark), "vec_id")[0]


@query("SELECT 3::BIGINT AS ordinal, 99999999::BIGINT AS vec_id")
def record_fetch_missing(spark, sf_dir):
    return visibility.fetch(table(spark, sf_dir, "embeddings").select("vec_id", "label"), _asked(spark), "vec_id")[1]


@query("SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def sequence_assignment(spark, sf_dir):
    return visibility.sequenced(table(spark, sf_dir, "events").select("event_id", "ts"), 1000, ["ts", "event_id"]).select("event_id", "seq")


# --- ingestion

_CHARS = "SELECT doc_id, o AS ordinal, o * 700 AS start, least(o * 700 + 800, length(text)) AS \"end\", substr(text, o * 700 + 1, 800) AS chunk FROM documents, LATERAL (SELECT unnest(range(0, greatest(1, ceil((length(text) - 100) / 700.0))::BIGINT)) AS o) WHERE length(text) > 0"


@query(f"SELECT doc_id, ordinal::BIGINT AS ordinal, start::BIGINT AS start, \"end\"::BIGINT AS \"end\", chunk FROM ({_CHARS})")
def chunk_chars(spark, sf_dir):
    return chunking.char_chunks(table(spark, sf_dir, "documents"), CharPolicy(800, 100)).withColumnRenamed("text", "chunk")


def _structure(name: str, policy, source: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    QUERIES[name] = lambda spark, sf_dir: chunking.chunks(table(spark, sf_dir, source), policy, key, text)


_structure("chunk_tokens", TokenPolicy(128, 16))
_structure("chunk_sentences", TokenPolicy(128, 16, "sentence"))
_structure("chunk_paragraphs", TokenPolicy(256, 0, "paragraph"))
_structure("chunk_markdown", TokenPolicy(256, 0, "markdown"))
_structure("chunk_html", TokenPolicy(256, 0, "html"), "pages", "page_id", "html")
_structure("chunk_semantic", SemanticPolicy(192, 48, 0.2))


@query(f"""
SELECT '_tw_chunk:u:' || doc_id || ':' || ordinal AS chunk_id FROM ({_CHARS})
EXCEPT SELECT '_tw_chunk:u:' || doc_id || ':' || ordinal FROM ({_CHARS.replace("FROM documents", "FROM (SELECT doc_id, substr(text, 1, length(text) // 2) AS text FROM documents)")})""")
def chunk_reconcile(spark, sf_dir):
    """Chunks that vanish when each document is halved."""
    documents, policy = table(spark, sf_dir, "documents"), CharPolicy(800, 100)
    half = documents.withColumn("text", F.substring("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int")))
    ids = [chunking.char_chunks(d, policy).select(chunking.chunk_id(F.col("doc_id"), F.col("ordinal")).alias("chunk_id")) for d in (documents, half)]
    return chunking.reconcile(*ids)


@query("SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", provenance.content_hash(F.col("text")).alias("content_hash"))


@query("""
SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.text = b.text AND a.source = b.source THEN 'unchanged' ELSE 'changed' END AS state
FROM documents a LEFT JOIN (SELECT doc_id, CASE WHEN lang = 'de' THEN text || '.' ELSE text END AS text, source FROM documents WHERE lang <> 'fr') b ON a.doc_id = b.doc_id""")
def source_change(spark, sf_dir):
    now = table(spark, sf_dir, "documents")
    before = now.where("lang != 'fr'").select(F.col("doc_id").alias("b_id"), provenance.content_hash(F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("b_hash"), F.col("source").alias("b_source"))
    joined = now.select("doc_id", provenance.content_hash(F.col("text")).alias("hash"), "source").join(before, F.col("doc_id") == F.col("b_id"), "left")
    return joined.select("doc_id", provenance.change(F.col("b_hash"), F.col("hash"), [F.col("b_source")], [F.col("source")]).alias("state"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query(f"""
WITH t AS (SELECT conv_id, turn, {_WORDS.format("text")} AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t)
SELECT conv_id, turn, round(len(list_intersect(w, n))::DOUBLE / (len(w) + len(n) - len(list_intersect(w, n))), 6) AS score FROM p WHERE n IS NOT NULL AND len(w) + len(n) > 0""")
def jaccard_boundary(spark, sf_dir):
    """How alike each turn is to the next one."""
    from pyspark.sql import Window

    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"))
    pair = own.withColumn("n", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("n is not null and size(w) + size(n) > 0")
    return pair.select("conv_id", "turn", F.round(F.size(F.array_intersect("w", "n")) / F.size(F.array_union("w", "n")), 6).alias("score"))


@query()
def embed_deterministic(spark, sf_dir):
    return embedding.embed(table(spark, sf_dir, "documents"), embedding.Deterministic(16), 16)


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'removed' WHEN source = 'src1' OR lang = 'es' THEN 'embed' ELSE 'keep' END AS state FROM documents")
def reembed_diff(spark, sf_dir):
    """Staged before Spanish documents came, src1 changed and French ones went."""
    d = table(spark, sf_dir, "documents")
    live = d.where("lang != 'fr'").select("doc_id", F.when(F.col("source") == "src1", F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("seq"))
    staged = d.where("lang != 'es'").select("doc_id", F.col("doc_id").alias("source_seq"))
    return reembed.difference(staged, live, "doc_id")


# --- evaluation: benchmark items as queries, documents judged by labels


def _rankings(spark, sf_dir, descending: bool) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("query_id"), "doc_id", "n_chars")
    order = F.desc("n_chars") if descending else F.asc("n_chars")
    return rows.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "doc_id")).alias("rank")).where("rank <= 20")


def _judgments(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("lang").alias("query_id"), "doc_id", (F.col("quality") * 2 - F.col("toxic") * F.col("quality")).cast("int").alias("relevance"))


def _metrics_sql(name: str, order: str) -> str:
    return f"""
{name}_r AS (SELECT query_id, doc_id, rank FROM (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars {order}, doc_id) AS rank FROM j) WHERE rank <= 10),
{name}_g AS (SELECT r.query_id, count(*) FILTER (WHERE rel > 0) AS hits, sum((2.0::DOUBLE ** rel - 1) / log2(rank + 1)) AS dcg, min(rank) FILTER (WHERE rel > 0) AS first FROM {name}_r r JOIN j ON r.doc_id = j.doc_id GROUP BY r.query_id),
{name} AS (SELECT i.query_id, round(CASE WHEN relevant = 0 THEN 1.0::DOUBLE ELSE coalesce(hits, 0)::DOUBLE / relevant END, 6) AS recall, round(coalesce(hits, 0) / 10.0::DOUBLE, 6) AS "precision", (coalesce(hits, 0) > 0)::INT::DOUBLE AS hit_rate, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(CASE WHEN ideal = 0 THEN 1.0::DOUBLE ELSE coalesce(dcg, 0) / ideal END, 6) AS ndcg FROM i LEFT JOIN {name}_g USING (query_id))"""


_JUDGED = """
WITH j AS (SELECT d.doc_id, lang, n_chars, quality * 2 - toxic * quality AS rel FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
i AS (SELECT lang AS query_id, sum(CASE WHEN rn <= 10 THEN (2.0::DOUBLE ** rel - 1) / log2(rn + 1) ELSE 0 END) AS ideal, count(*) FILTER (WHERE rel > 0) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rel DESC, doc_id) AS rn FROM j) GROUP BY lang),"""


@query(f"{_JUDGED}{_metrics_sql('a', 'DESC')} SELECT * FROM a")
def eval_metrics(spark, sf_dir):
    return evaluate.metrics_at_k(_rankings(spark, sf_dir, True), _judgments(spark, sf_dir), 10, key="doc_id")


@query(f"""{_JUDGED}{_metrics_sql('a', 'ASC')},{_metrics_sql('b', 'DESC')}
SELECT count(*) FILTER (WHERE b.ndcg - a.ndcg > 1e-12)::BIGINT AS improved, count(*) FILTER (WHERE b.ndcg - a.ndcg < -1e-12)::BIGINT AS regressed, count(*) FILTER (WHERE abs(b.ndcg - a.ndcg) <= 1e-12)::BIGINT AS unchanged,
round(avg(b.recall - a.recall), 6) AS recall_delta, round(avg(b."precision" - a."precision"), 6) AS precision_delta, round(avg(b.hit_rate - a.hit_rate), 6) AS hit_rate_delta, round(avg(b.mrr - a.mrr), 6) AS mrr_delta, round(avg(b.ndcg - a.ndcg), 6) AS ndcg_delta FROM a JOIN b USING (query_id)""")
def eval_compare(spark, sf_dir):
    judged = _judgments(spark, sf_dir)
    a, b = (evaluate.metrics_at_k(_rankings(spark, sf_dir, d), judged, 10, key="doc_id") for d in (False, True))
    return evaluate.compare(a, b)


@query()
def context_budget(spark, sf_dir):
    """Each conversation's turns into 60 tokens."""
    rows = table(spark, sf_dir, "conversations").withColumn("document", F.concat_ws(":", "conv_id", "turn"))
    return context.assemble_groups(rows, "conv_id", "turn", "turn", "document", "text", context.Budget(60, 2_000, 4))


@query("SELECT 'u64:' || event_id AS record_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def store_append(spark, sf_dir):
    from tarnwood.model import Collection
    from tarnwood.sources.store import Store

    batch = table(spark, sf_dir, "events").select(F.concat(F.lit("u64:"), "event_id").alias("record_id"), F.lit("upsert").alias("op"), F.array(F.col("value").cast("float")).alias("vector"), F.col("event_type").alias("metadata"), "ts", "event_id")
    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", Collection("events", 1, "dot"))
    store.append(batch, ["ts", "event_id"])
    return store.tail().select("record_id", "seq")


# --- streams: events as messages, written to the shared folder first


def _stream(spark, sf_dir):
    from tarnwood.streaming.ingest import Ingestion

    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    good = F.to_json(F.struct(F.lit(1).alias("version"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.struct(F.lit("u64").alias("type"), F.col("user_id").cast("string").alias("value")).alias("id"), F.array(F.col("value").cast("double")).alias("vector")))
    payload = F.when(F.col("event_id") % 50 == 7, F.lit("{broken")).when(F.col("event_id") % 50 == 9, F.lit(json.dumps({"version": 99}))).otherwise(good)
    messages = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), payload.alias("payload"))
    messages.write.json(f"{base}/in")
    run = Ingestion(spark, f"{base}/in", f"{base}/log", f"{base}/dlq", f"{base}/checkpoint")
    run.start().awaitTermination()
    return base


@query("SELECT user_id % 4 AS \"partition\", event_id AS \"offset\", 'u64:' || user_id AS record_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events WHERE event_id % 50 NOT IN (7, 9)")
def stream_apply(spark, sf_dir):
    out = spark.read.parquet(f"{_stream(spark, sf_dir)}/log")
    return out.select(F.col("partition").cast("long").alias("partition"), "offset", "record_id", "op")


@query("SELECT 'records:' || (user_id % 4) || ':' || event_id AS key, CASE WHEN event_id % 50 = 7 THEN 'invalid_json' ELSE 'unsupported_version' END AS error_class FROM events WHERE event_id % 50 IN (7, 9)")
def stream_dlq(spark, sf_dir):
    return spark.read.parquet(f"{_stream(spark, sf_dir)}/dlq").select("key", "error_class")
