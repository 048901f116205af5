"""A request into a plan: modes, depths, profiles, strategy, pages."""

from __future__ import annotations

import base64
import hashlib
import json
import time
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwood.model import ANN_THRESHOLD, DEFAULT_EF_SEARCH, MAX_CANDIDATES, MAX_TIMEOUT_S, MAX_TOP_K, RESERVED, RRF_K, Collection, InvalidRequest, Request
from tarnwood.operators import ann, fusion, lexical, predicate, rerank, vector

CURSOR_SECONDS, SKEW_SECONDS, CURSOR_CHARS = 900, 60, 8_192


class StaleCursor(InvalidRequest):
    pass


# --- profiles


class Profiles:
    """Immutable name@version policies; the bare name is the latest, `default` the built-in one."""

    def __init__(self):
        self._held: dict[str, dict[int, dict]] = {}

    def create(self, name: str, **policy) -> str:
        versions = self._held.setdefault(name, {})
        versions[len(versions) + 1] = policy
        return f"{name}@{len(versions)}"

    def get(self, selector: str) -> tuple[str, dict]:
        if selector == "default":
            return "default", {}
        name, _, version = selector.partition("@")
        versions = self._held.get(name)
        if not versions or (version and int(version) not in versions):
            raise InvalidRequest(f"unknown profile {selector}")
        at = int(version) if version else max(versions)
        return f"{name}@{at}", versions[at]


def resolved(request: Request, profiles: Profiles | None = None) -> Request:
    """The profile's values where the request has the default, then the defaults."""
    pinned, policy = (profiles or Profiles()).get(request.profile or "default")
    fallback = {"top_k": 10, "rrf_k": RRF_K, "execution": "auto"}
    values = {k: (policy.get(k, d) if getattr(request, k) in (None, d) else getattr(request, k)) for k, d in fallback.items()}
    for k in ("dense_k", "lexical_k", "rerank"):
        values[k] = getattr(request, k) if getattr(request, k) is not None else policy.get(k)
    return replace(request, profile=pinned, **values)


def admit(request: Request) -> None:
    depth = max(request.top_k, request.dense_k or 0, request.lexical_k or 0, request.rerank.top_n if request.rerank else 0)
    if not 0 < request.top_k <= MAX_TOP_K or depth > MAX_CANDIDATES or not 0 < request.timeout_s <= MAX_TIMEOUT_S:
        raise InvalidRequest("top_k, candidates or timeout out of bounds")


def strategy(execution: str, filtered: bool, indexed: bool, size: int, depth: int, ef: int = DEFAULT_EF_SEARCH) -> tuple[str, str]:
    """(strategy, reason). Filtered or small collections, and those without index, are searched exactly."""
    if execution not in ("auto", "exact", "ann"):
        raise InvalidRequest("unknown execution")
    if execution == "exact" or not indexed and execution == "auto":
        return "exact", "requested" if execution == "exact" else "no_index"
    if execution == "auto" and filtered:
        return "exact", "filtered"
    if execution == "auto" and size < ANN_THRESHOLD:
        return "exact", "small_corpus"
    if not indexed:
        raise InvalidRequest("no index")
    if ef < depth:
        raise InvalidRequest("ef_search is smaller than the depth")
    return ("ann_post_filter", "requested") if filtered else ("ann", "ann_threshold_reached" if execution == "auto" else "requested")


# --- cursors


def encode_cursor(told: dict, now: float | None = None) -> str:
    body = json.dumps({"version": 1, "issued": int(now if now is not None else time.time()), **told}, sort_keys=True)
    return base64.urlsafe_b64encode(json.dumps({"body": body, "sum": hashlib.sha256(body.encode()).hexdigest()}).encode()).decode()


def decode_cursor(token: str, binding: str, sequence: int, now: float | None = None) -> dict:
    now = now if now is not None else time.time()
    if len(token) > CURSOR_CHARS:
        raise InvalidRequest("the cursor is too long")
    try:
        outer = json.loads(base64.urlsafe_b64decode(token.encode()))
        body = json.loads(outer["body"])
        whole = hashlib.sha256(outer["body"].encode()).hexdigest() == outer["sum"]
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidRequest("the cursor can't be read") from e
    if not whole or body.get("version") != 1 or body["issued"] > now + SKEW_SECONDS or body["issued"] + CURSOR_SECONDS < now:
        raise InvalidRequest("the cursor is damaged or expired")
    if body["binding"] != binding:
        raise InvalidRequest("the cursor belongs to another query")
    if body["sequence"] != sequence:
        raise StaleCursor("the collection has changed")
    return body


# --- the engine


@dataclass
class Engine:
    """Queries over one collection: `records` has record_id, seq, vector, the lexical fields
    and, as a map, metadata. `fields` says how the filter language reads metadata."""

    collection: Collection
    records: DataFrame
    fields: predicate.Variant | predicate.Typed
    profiles: Profiles | None = None
    index: ann.Index | None = None
    postings: DataFrame | None = None
    rerankers: dict | None = None

    def _binding(self, request: Request) -> str:
        told = [self.collection.name, self.collection.metric, request.execution, request.profile, request.vector, repr(request.predicate)]
        return hashlib.sha256(repr(told).encode()).hexdigest()

    def _filter(self, request: Request) -> Column | None:
        return None if request.predicate is None else predicate.lower(request.predicate, self.fields)

    def query(self, request: Request) -> DataFrame:
        """Hits in order, with score, ranks and per-source scores, and the metadata asked for."""
        request = resolved(request, self.profiles)
        admit(request)
        mode, explain, metric = request.mode, request.explain, self.collection.metric
        if request.paginate and (mode != "dense" or request.execution == "ann" or request.rerank):
            raise InvalidRequest("only dense, exact queries without rerank have pages")
        depth = max(request.top_k, request.rerank.top_n if request.rerank else 0)
        dense_k, lexical_k = max(request.dense_k or 0, depth), max(request.lexical_k or 0, depth)
        where = self._filter(request)
        explain |= {"mode": mode, "profile": request.profile}
        if request.paginate:
            return self._page(request, where)
        dense = self._dense(request, where, dense_k) if mode != "lexical" else None
        text = self._lexical(request, where, lexical_k) if mode != "dense" else None
        if mode == "hybrid":
            fusion.check_depths(depth, dense_k, lexical_k, request.rrf_k)
            hits = fusion.reciprocal_rank(dense, text, metric, depth, "record_id", request.rrf_k)
        else:
            hits = (dense if mode == "dense" else text).select("record_id", "score")
        hits = hits.join(self.records, "record_id")
        ordered = fusion.with_rank(hits, metric if mode == "dense" else "dot", "record_id")
        if request.rerank:
            r = request.rerank
            ordered = ordered.withColumn("__text", rerank.text_of([F.col("metadata")[f] if f not in self.records.columns else F.col(f) for f in r.fields])).where(F.col("rank") <= r.top_n)
            ordered, explain["reranked"] = rerank.rerank(ordered, (self.rerankers or {})[r.profile], r.query or request.text or "", request.top_k, "record_id", "__text", r.on_failure == "preserve_order")
            ordered = ordered.drop("__text").withColumn("score", F.coalesce("rerank_score", "score"))
        else:
            ordered = ordered.where(F.col("rank") <= request.top_k)
        return self._projected(ordered, request)

    def _dense(self, request: Request, where: Column | None, k: int) -> DataFrame:
        size = self.records.count() if request.execution == "auto" and self.index is not None else 0
        plan, why = strategy(request.execution, where is not None, self.index is not None, size, k)
        request.explain.update(strategy=plan, reason=why)
        if plan == "exact":
            return vector.search(self.records, request.vector, self.collection.metric, k, predicate=where)
        one = self.records.sparkSession.createDataFrame([(0, [float(v) for v in request.vector])], "query_id int, vector array<double>")
        found = self.index.search(one, max(k, DEFAULT_EF_SEARCH)).select("record_id", "score")
        if where is not None:  # may leave fewer than k
            found = found.join(self.records.where(where).select("record_id"), "record_id", "left_semi")
        return found.orderBy(*vector.ranked(self.collection.metric, "score", "record_id")).limit(k)

    def _lexical(self, request: Request, where: Column | None, k: int) -> DataFrame:
        held = self.postings if self.postings is not None else lexical.postings(self.records, list(self.collection.lexical_fields), "record_id", self.collection.analyzer)
        allowed = None if where is None else self.records.where(where)
        return lexical.search(held, request.text, k, "record_id", allowed, self.collection.analyzer)

    def _page(self, request: Request, where: Column | None) -> DataFrame:
        sequence = self.records.agg(F.max("seq")).first()[0] or 0
        after, binding = None, self._binding(request)
        if request.cursor:
            held = decode_cursor(request.cursor, binding, sequence)
            after = held["score"], held["id"]
        rows = vector.search(self.records, request.vector, self.collection.metric, request.top_k + 1, predicate=where, after=after).collect()  # a page and one
        page = rows[: request.top_k]
        more = len(rows) > request.top_k
        request.explain.update(strategy="exact_cursor", cursor=encode_cursor({"binding": binding, "sequence": sequence, "score": page[-1]["score"], "id": page[-1]["record_id"]}) if more else None)
        out = self.records.sparkSession.createDataFrame(page, self.records.schema.add("score", "double") if "score" not in self.records.columns else self.records.schema)
        return self._projected(out, request)

    def _projected(self, hits: DataFrame, request: Request) -> DataFrame:
        if "metadata" not in hits.columns or dict(hits.dtypes)["metadata"].startswith("map") is False:
            return hits
        if not request.include_metadata:
            return hits.withColumn("metadata", F.map_filter("metadata", lambda k, v: F.lit(False)))
        if request.include_provenance:
            return hits
        return hits.withColumn("metadata", F.map_filter("metadata", lambda k, v: ~k.startswith(RESERVED)))
