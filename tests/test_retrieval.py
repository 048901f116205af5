"""Operators held against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from tarnwood.model import Collection, InvalidRequest, Request, Rerank, string_id, unsigned_id
from tarnwood.operators import ann, context, evaluate, fusion, lexical, predicate, rerank, vector, visibility
from tarnwood.plans.engine import Engine, Profiles, StaleCursor, decode_cursor, encode_cursor, resolved, strategy


def vectors(spark, rows):
    return spark.createDataFrame(rows, "record_id long, vector array<double>")


@pytest.mark.parametrize(("metric", "order", "scores"), [("cosine", [1, 2, 3], [1, 0.707107, 0]), ("dot", [1, 2, 3], [1, 0.5, 0]), ("l2", [1, 2, 3], [0, 0.707107, 1.414214])])
def test_exact_order_and_scores(spark, metric, order, scores):
    rows = vectors(spark, [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 1.0])])
    got = vector.search(rows, [1, 0], metric, 3).collect()
    assert [r["record_id"] for r in got] == order
    assert [round(r["score"], 6) for r in got] == scores


def test_ties_by_id_and_invalid_queries(spark):
    rows = vectors(spark, [(2, [1.0]), (1, [1.0])])
    assert vector.search(rows, [1], "dot", 1).first()["record_id"] == 1
    for bad in ([], [float("nan")]):
        with pytest.raises(InvalidRequest):
            vector.search(rows, bad, "dot", 1)
    with pytest.raises(InvalidRequest):
        vector.search(rows, [1], "dot", 0)
    with pytest.raises(Exception, match="zero-norm"):
        vector.search(vectors(spark, [(1, [0.0])]), [1], "cosine", 1).collect()


def test_typed_ids_sort_strings_first(spark):
    rows = spark.range(1).select(F.explode(F.array(unsigned_id(F.lit(1)), string_id(F.lit("42")), unsigned_id(F.lit(42)))).alias("id"))
    assert [(r["id"]["kind"], r["id"]["s"], r["id"]["u"] and int(r["id"]["u"])) for r in rows.orderBy("id").collect()] == [(0, "42", None), (1, None, 1), (1, None, 42)]


def test_batch_search_equals_single_searches(spark):
    import random

    r = random.Random(5)
    rows = vectors(spark, [(i, [round(r.uniform(-1, 1), 1) for _ in range(4)]) for i in range(300)]).repartition(5)
    queries = rows.where("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), "vector")
    for metric in ("dot", "cosine", "l2"):
        got = {}
        for x in vector.batch_search(rows, queries, metric, 7).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append(x["record_id"])
        for q in queries.collect():
            assert got[q["query_id"]] == [x["record_id"] for x in vector.search(rows, q["vector"], metric, 7, digits=6).collect()]


def test_visibility(spark):
    log = spark.createDataFrame([(1, 1, "upsert", 1.0), (1, 2, "delete", None), (1, 3, "upsert", 3.0), (2, 4, "upsert", 4.0), (2, 5, "delete", None)], "record_id long, seq long, op string, v double")
    assert [tuple(r) for r in visibility.visible(log).collect()] == [(1, 3, "upsert", 3.0)]
    assert visibility.visible(log.where("seq <= 2")).count() == 0
    assert tuple(visibility.state_counts(log).first()) == (1, 1)
    with pytest.raises(ValueError, match="twice"):
        visibility.segment(log.unionByName(log), 1)


META = '{"price":120,"active":true,"nullable":null,"tags":["rust"],"product":{"category":"book"},"n5":"5"}'


@pytest.mark.parametrize(
    ("wire", "want"),
    [
        ({"op": "eq", "path": ["price"], "value": 120}, True),
        ({"op": "eq", "path": ["price"], "value": "120"}, False),
        ({"op": "eq", "path": ["n5"], "value": 5}, False),
        ({"op": "eq", "path": ["nullable"], "value": None}, True),
        ({"op": "eq", "path": ["absent"], "value": None}, False),
        ({"op": "ne", "path": ["absent"], "value": 1}, False),
        ({"op": "not", "predicate": {"op": "eq", "path": ["absent"], "value": 1}}, True),
        ({"op": "ne", "path": ["price"], "value": "x"}, True),
        ({"op": "lt", "path": ["price"], "value": 121}, True),
        ({"op": "gte", "path": ["price"], "value": 120}, True),
        ({"op": "lt", "path": ["absent"], "value": 1}, False),
        ({"op": "exists", "path": ["nullable"]}, True),
        ({"op": "exists", "path": ["price", "x"]}, False),
        ({"op": "in", "path": ["price"], "values": ["a", 120]}, True),
        ({"op": "in", "path": ["price"], "values": []}, False),
        ({"op": "contains", "path": ["tags"], "value": "rust"}, True),
        ({"op": "contains", "path": ["n5"], "value": "5"}, False),
        ({"op": "eq", "path": ["tags"], "value": ["rust"]}, True),
        ({"op": "eq", "path": ["product"], "value": {"category": "book"}}, True),
        ({"op": "eq", "path": ["product", "category"], "value": "book"}, True),
        ({"op": "and", "predicates": []}, True),
        ({"op": "or", "predicates": []}, False),
        ({"op": "and", "predicates": [{"op": "eq", "path": ["price"], "value": 1}, {"op": "lt", "path": ["price"], "value": "200"}]}, False),
        ({"op": "or", "predicates": [{"op": "exists", "path": ["price"]}, {"op": "lt", "path": ["active"], "value": 2}]}, True),
    ],
)
def test_predicates(spark, wire, want):
    rows = spark.createDataFrame([(META,)], "m string").select(F.parse_json("m").alias("m"))
    assert rows.select(predicate.lower(predicate.parse(wire), predicate.Variant(F.col("m")))).first()[0] is want


def test_ordering_between_types_fails(spark):
    rows = spark.createDataFrame([(META,)], "m string").select(F.parse_json("m").alias("m"))
    for wire in ({"op": "lt", "path": ["price"], "value": "200"}, {"op": "gt", "path": ["nullable"], "value": 1}, {"op": "gt", "path": ["price"], "value": True}):
        with pytest.raises(Exception, match="ordering"):
            rows.select(predicate.lower(predicate.parse(wire), predicate.Variant(F.col("m")))).collect()


def test_typed_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).alias("label")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).where(predicate.lower(predicate.parse({"op": "and", "predicates": [{"op": "gt", "path": ["label"], "value": 3}, {"op": "eq", "path": ["id"], "value": 5}]}), predicate.Typed({"label": "bigint", "id": "bigint"})))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 1
    assert "label" in plan.split("PushedFilters")[1]


def test_bm25(spark):
    rows = spark.createDataFrame([(1, "python database"), (2, "rust rust search")], "record_id long, body string")
    index = lexical.postings(rows, ["body"])
    assert [(r["record_id"], round(r["score"], 6)) for r in lexical.search(index, "rust", 5).collect()] == [(2, 0.902322)]
    assert [r["record_id"] for r in lexical.search(index, "python", 5).collect()] == [1]
    with pytest.raises(InvalidRequest):
        lexical.search(index, "--", 5)
    assert {r["term"]: (r["df"], r["tf"]) for r in lexical.document_frequencies(index).collect()}["rust"] == (1, 2)


def test_hybrid_both_first(spark):
    rows = spark.createDataFrame([(1, [10.0], "rust guide"), (2, [1.0], "other")], "record_id long, vector array<double>, body string")
    d, x = vector.search(rows, [10], "dot", 2), lexical.search(lexical.postings(rows, ["body"]), "rust", 2)
    got = fusion.reciprocal_rank(d, x, "dot", 2).collect()
    assert [(r["record_id"], round(r["score"], 7), r["dense_rank"], r["lexical_rank"]) for r in got] == [(1, 0.0327869, 1, 1), (2, 0.016129, 2, None)]
    for bad in ((1, 0, 1), (5, 4, 5), (1, 6000, 6000)):
        with pytest.raises(InvalidRequest):
            fusion.check_depths(*bad)


def test_fusion_dedup_recent_and_failures(spark):
    hits = lambda rows: spark.createDataFrame(rows, "rank int, record_id string, score double, timestamp long")
    union, status = fusion.search_many([("a", hits([(1, "shared", 0.5, 100), (2, "a", 0.4, 100)])), ("b", hits([(1, "shared", 0.5, 200), (2, "b", 0.4, 200)])), ("c", RuntimeError("down"))])
    assert [s for _, s in status] == ["ok", "ok", "error: down"]
    got = fusion.fuse(union, 10).orderBy("fusion_rank").collect()
    assert [r["record_id"] for r in got] == ["shared", "a", "b"]
    assert [p["source"] for p in got[0]["provenance"]] == ["a", "b"]
    assert fusion.fuse(union, 1, prefer_recent=True).first()["source"] == "b"
    assert [r["record_id"] for r in fusion.fuse(union, 10, "score_sum", dedup=False, prefer_recent=True).orderBy("fusion_rank").collect()][:2] == ["shared", "shared"]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "rank int, record_id string, text string")

    class Fake:
        name = "fake"

        def __init__(self, scores):
            self.scores = scores

        def rerank(self, query, texts):
            if self.scores is None:
                raise OSError("down")
            return self.scores

    got, applied = rerank.rerank(hits, Fake([(0, 0.1), (1, 1.0), (2, 2.0)]), "q", 2)
    assert applied and [(r["record_id"], r["original_rank"], r["rerank_score"]) for r in got.collect()] == [("c", 3, 2.0), ("b", 2, 1.0)]
    got, applied = rerank.rerank(hits, Fake(None), "q", 2, preserve_order=True)
    assert not applied and [r["record_id"] for r in got.collect()] == ["a", "b"]
    for bad in ([(0, 1.0)], [(0, 1.0), (1, 1.0), (1, 1.0)], [(0, 1.0), (1, 1.0), (2, math.nan)]):
        with pytest.raises(InvalidRequest):
            rerank.rerank(hits, Fake(bad), "q", 2, preserve_order=True)


def test_context():
    got = context.assemble([(1, "d", "one two three four"), (2, "e", "more")], context.Budget(3))
    assert [(b[2], b[5]) for b in got.blocks] == [("one two three", True)] and got.omitted == 1
    assert got.text == "[ctx-1]\none two three"
    assert context.cut("äö ü", 9, 3) == ("ä", 1, True)
    assert context.assemble([(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, "a", "")], context.Budget(9, 99, 1)).omitted == 2


def test_metrics(spark):
    judged = spark.createDataFrame([("q", i, g) for i, g in enumerate((3, 2, 0, 0))] + [("empty", 9, 0)], "query_id string, record_id long, relevance int")
    ranks = lambda order: spark.createDataFrame([("q", r, i + 1) for i, r in enumerate(order)], "query_id string, record_id long, rank int")
    row = {r["query_id"]: r for r in evaluate.metrics_at_k(ranks([0, 1]), judged, 2).collect()}
    assert (row["q"]["ndcg"], row["q"]["recall"], row["q"]["precision"], row["q"]["mrr"]) == (1.0, 1.0, 1.0, 1.0)
    assert (row["empty"]["recall"], row["empty"]["ndcg"], row["empty"]["precision"]) == (1.0, 1.0, 0.0)
    back = evaluate.metrics_at_k(ranks([1, 0]), judged, 2)
    assert {r["query_id"]: r["ndcg"] for r in back.collect()}["q"] == 0.833991
    same = evaluate.compare(evaluate.metrics_at_k(ranks([0, 1]), judged, 2), back).first()
    assert (same["improved"], same["regressed"], same["unchanged"]) == (0, 1, 1)
    assert evaluate.percentile([4, 1, 3, 2], 50) == 3
    with pytest.raises(ValueError):
        evaluate.check(ranks([0]), judged)


def test_index_reaches_its_recall(spark):
    rows = vectors(spark, [(i, [math.sin(i * 0.37 + d) for d in range(4)]) for i in range(400)])
    queries = rows.where("record_id % 40 = 0").select(F.col("record_id").alias("query_id"), "vector")
    for metric in ("cosine", "l2", "dot"):
        index = ann.build(rows, metric, 16).tune(queries, 10, 0.95)
        exact = vector.batch_search(rows, queries, metric, 10)
        assert evaluate.recall(index.search(queries, 10), exact).agg(F.avg("recall")).first()[0] >= 0.9
        assert index.rows.count() == 400


def engine(spark, **more):
    rows = spark.createDataFrame([(f"r{i}", i, [float(i), 1.0], f"text number{i} word", i % 2, {"k": "v", "_tw_source": "s"}) for i in range(1, 9)], "record_id string, seq long, vector array<double>, body string, parity int, metadata map<string,string>")
    return Engine(Collection("c", 2, "dot", ("body",)), rows, predicate.Typed({"parity": "int"}), **more)


def test_engine_modes_and_projection(spark):
    e = engine(spark)
    r = Request(vector=[1, 0], top_k=3)
    assert [x["record_id"] for x in e.query(r).orderBy("rank").collect()] == ["r8", "r7", "r6"]
    assert r.explain["mode"] == "dense" and r.explain["reason"] == "no_index"
    got = e.query(Request(text="number3 word", top_k=1)).first()
    assert got["record_id"] == "r3" and got["metadata"] == {"k": "v"}
    odd = predicate.parse({"op": "eq", "path": ["parity"], "value": 1})
    hybrid = e.query(Request(vector=[1, 0], text="number3", top_k=2, predicate=odd, include_provenance=True)).orderBy("rank").collect()
    assert hybrid[0]["record_id"] == "r3" and all(x["parity"] == 1 for x in hybrid) and "_tw_source" in hybrid[0]["metadata"]
    assert e.query(Request(vector=[1, 0], include_metadata=False)).first()["metadata"] == {}
    for bad in (Request(), Request(vector=[1, 0], top_k=1001), Request(vector=[1, 0], text="a", paginate=True)):
        with pytest.raises(InvalidRequest):
            e.query(bad)
    reranked = engine(spark, rerankers={"o": rerank.Overlap()}).query(Request(vector=[1, 0], top_k=1, rerank=Rerank("o", ("body",), 8, "number2")))
    assert reranked.first()["record_id"] == "r2"


def test_pages_cover_all_rows_once(spark):
    e, seen, cursor = engine(spark), [], None
    while True:
        r = Request(vector=[0, 1], top_k=3, paginate=True, cursor=cursor)
        seen += [x["record_id"] for x in e.query(r).collect()]
        cursor = r.explain["cursor"]
        if not cursor:
            break
    assert seen == [f"r{i}" for i in range(1, 9)]


def test_cursors():
    token = encode_cursor({"binding": "b", "sequence": 3, "score": 1.0, "id": "x"}, now=1000)
    assert decode_cursor(token, "b", 3, now=1010)["id"] == "x"
    with pytest.raises(StaleCursor):
        decode_cursor(token, "b", 4, now=1010)
    for args in (("c", 3, 1010), ("b", 3, 2000), ("b", 3, 900)):
        with pytest.raises(InvalidRequest):
            decode_cursor(token, args[0], args[1], now=args[2])
    with pytest.raises(InvalidRequest):
        decode_cursor("x" * 9000, "b", 3)


def test_profiles_and_strategy():
    p = Profiles()
    assert p.create("fast", top_k=5) == "fast@1" and p.create("fast", top_k=7) == "fast@2"
    assert resolved(Request(text="a", profile="fast"), p).top_k == 7
    assert resolved(Request(text="a", profile="fast@1", top_k=10), p).top_k == 5  # the default counts as unset
    assert resolved(Request(text="a", profile="fast@1", top_k=3), p).top_k == 3
    assert strategy("auto", False, True, 5000, 10) == ("ann", "ann_threshold_reached")
    assert strategy("auto", True, True, 5000, 10)[0] == strategy("auto", False, True, 5, 10)[0] == strategy("auto", False, False, 5000, 10)[0] == "exact"
    assert strategy("ann", True, True, 5, 10)[0] == "ann_post_filter"
    with pytest.raises(InvalidRequest):
        strategy("auto", False, True, 5000, 65)
