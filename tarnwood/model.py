"""Collections, records, policies and requests."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")
MAX_TOP_K, MAX_CANDIDATES, DEFAULT_TIMEOUT_S, MAX_TIMEOUT_S = 1_000, 10_000, 30, 60
ANN_THRESHOLD, DEFAULT_EF_SEARCH, SEAL_THRESHOLD, RRF_K = 1_024, 64, 1_000, 60
#: Metadata keys that start so are the engine's own.
RESERVED = "_tw_"
_NAME = re.compile(r"[a-z0-9_-]{1,128}")


class InvalidRequest(ValueError):
    """A request that no plan is made for."""


def collection_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise InvalidRequest("a collection's name has 1 to 128 characters of a-z, 0-9, _ and -")
    return name


def string_id(value: Column) -> Column:
    """A typed id: strings sort before unsigned numbers, and "42" is not 42."""
    return F.struct(F.lit(0).cast("tinyint").alias("kind"), value.cast("string").alias("s"), F.lit(None).cast("decimal(20,0)").alias("u"))


def unsigned_id(value: Column) -> Column:
    return F.struct(F.lit(1).cast("tinyint").alias("kind"), F.lit(None).cast("string").alias("s"), value.cast("decimal(20,0)").alias("u"))


@dataclass(frozen=True)
class Analyzer:
    lowercase: bool = True


@dataclass(frozen=True)
class CharPolicy:
    max_chars: int
    overlap: int = 0

    def __post_init__(self):
        if self.max_chars <= 0 or not 0 <= self.overlap < self.max_chars:
            raise InvalidRequest("max_chars must be positive and overlap smaller")


@dataclass(frozen=True)
class TokenPolicy:
    max_tokens: int
    overlap: int = 0
    structure: str = "none"  # none, sentence, paragraph, markdown, html

    def __post_init__(self):
        if self.max_tokens <= 0 or not 0 <= self.overlap < self.max_tokens:
            raise InvalidRequest("max_tokens must be positive and overlap smaller")
        if self.structure not in ("none", "sentence", "paragraph", "markdown", "html"):
            raise InvalidRequest("unknown structure")


@dataclass(frozen=True)
class SemanticPolicy:
    max_tokens: int
    min_tokens: int
    threshold: float

    def __post_init__(self):
        if not 0 < self.min_tokens <= self.max_tokens or not 0 <= self.threshold <= 1:
            raise InvalidRequest("0 < min_tokens <= max_tokens and 0 <= threshold <= 1")


@dataclass(frozen=True)
class Collection:
    name: str
    dimension: int
    metric: str = "cosine"
    lexical_fields: tuple[str, ...] = ()
    analyzer: Analyzer = Analyzer()
    policy: CharPolicy | TokenPolicy | SemanticPolicy | None = None
    embedding_profile: str = "default"
    index_chunk_text: bool = False

    def __post_init__(self):
        collection_name(self.name)
        if self.dimension <= 0 or self.metric not in METRICS:
            raise InvalidRequest("dimension must be positive and the metric known")
        fields = set(self.lexical_fields) | ({f"{RESERVED}chunk.text"} if self.index_chunk_text else set())
        object.__setattr__(self, "lexical_fields", tuple(sorted(fields)))


def check_vector(vector, dimension: int | None = None) -> list[float]:
    values = [float(v) for v in vector]
    if not values or not all(map(math.isfinite, values)):
        raise InvalidRequest("a vector is not empty and has finite values only")
    if dimension is not None and len(values) != dimension:
        raise InvalidRequest(f"expected {dimension} dimensions, got {len(values)}")
    return values


@dataclass(frozen=True)
class Rerank:
    profile: str
    fields: tuple[str, ...]
    top_n: int = 50
    query: str | None = None
    on_failure: str = "fail"  # or preserve_order


@dataclass(frozen=True)
class Request:
    """None means: not set by the caller, so that a profile's value applies."""

    vector: list[float] | None = None
    text: str | None = None
    top_k: int | None = None
    dense_k: int | None = None
    lexical_k: int | None = None
    rrf_k: int | None = None
    execution: str | None = None  # auto, exact, ann
    predicate: object | None = None
    include_metadata: bool = True
    include_provenance: bool = False
    rerank: Rerank | None = None
    cursor: str | None = None
    paginate: bool = False
    profile: str | None = None
    timeout_s: float = DEFAULT_TIMEOUT_S
    explain: dict = field(default_factory=dict, compare=False)

    @property
    def mode(self) -> str:
        if self.vector is None and self.text is None:
            raise InvalidRequest("a vector, a text or both")
        return "hybrid" if self.vector is not None and self.text is not None else "dense" if self.vector is not None else "lexical"
