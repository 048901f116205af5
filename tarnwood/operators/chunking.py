"""Chunking of documents: by characters, tokens, structure and similarity."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.functions.arrow import map_columns
from tarnwood.model import RESERVED, CharPolicy, SemanticPolicy, TokenPolicy

#: A run of letters, digits and underscores, or any other character that is no white space.
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Where chunks should end, as what stands before the boundary.
BOUNDARY = {
    "none": None,
    "sentence": re.compile(r"[.!?](?:\s+|\Z)"),
    "paragraph": re.compile(r"\n{2,}"),
    "markdown": re.compile(r"\n{2,}|\n(?=[^\S\n]*(?:#|[-*>] |```))"),
    "html": re.compile(r"</(?:p|div|section|article|li|ul|ol|h[123])>", re.I),
}
CHUNK = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("token_count", T.LongType()), T.StructField("text", T.StringType())])


def char_chunks(df: DataFrame, policy: CharPolicy, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of max_chars code points, each `overlap` back from the last; the first that
    reaches the end is the last. Native: a sequence of starts, exploded."""
    n, size, step = F.char_length(text), policy.max_chars, policy.max_chars - policy.overlap
    count = F.greatest(F.lit(1), F.ceil((n - policy.overlap) / F.lit(step)).cast("int"))
    rows = df.where(n > 0).select(key, F.col(text).alias("__t"), F.posexplode(F.sequence(F.lit(0), (count - 1) * step, F.lit(step))).alias("ordinal", "start"))
    return rows.select(key, F.col("ordinal").cast("long").alias("ordinal"), F.col("start").cast("long").alias("start"), F.least(F.col("start") + size, F.char_length("__t")).cast("long").alias("end"), F.substring("__t", F.col("start") + 1, F.lit(size)).alias("text"))


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def greedy(text: str, found: list[tuple[int, int]], breaks: list[int], most: int, least: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """Chunks of at most `most` tokens; each ends at the last of `breaks` (token numbers,
    sorted) that leaves it `least` tokens, else at the most. Byte offsets in UTF-8."""
    out, start, n = [], 0, len(found)
    bytes_to = (lambda i: i) if text.isascii() else (lambda i: len(text[:i].encode()))
    while start < n:
        end = min(start + most, n)
        if end < n:
            at = bisect_right(breaks, end) - 1
            if at >= 0 and breaks[at] >= min(start + least, end):
                end = breaks[at]
        a, b = found[start][0], found[end - 1][1]
        first = bytes_to(a)
        out.append((len(out), first, first + len(text[a:b].encode()), end - start, text[a:b]))
        if end == n:
            break
        start = end - overlap if end - overlap > start else end
    return out


def token_chunk(text: str, policy: TokenPolicy) -> list[tuple]:
    found = spans(text)
    pattern = BOUNDARY[policy.structure]
    starts = [a for a, _ in found]
    breaks = sorted({bisect_left(starts, m.end()) for m in pattern.finditer(text)} - {0, len(found)}) if pattern else []
    return greedy(text, found, breaks, policy.max_tokens, 1, policy.overlap)


def jaccard(left: str, right: str) -> float:
    a, b = set(left.lower().split()), set(right.lower().split())
    return len(a & b) / len(a | b) if a or b else 1.0


def semantic_chunk(text: str, policy: SemanticPolicy, scorer: Callable[[str, str], float | None] = jaccard) -> list[tuple]:
    """Breaks where the words before and after a place are less alike than the threshold;
    places come every min_tokens. A scorer that fails or has no answer leaves token chunks."""
    found = spans(text)
    k = policy.min_tokens
    cut = lambda a, b: text[found[a][0] : found[b - 1][1]]
    breaks = []
    try:
        for at in range(k, len(found), k):
            value = scorer(cut(at - k, at), cut(at, min(at + k, len(found))))
            if value is None:
                raise ValueError("no similarity")
            if value < policy.threshold:
                breaks.append(at)
    except Exception:  # noqa: BLE001  a scorer is a plug-in
        return token_chunk(text, TokenPolicy(policy.max_tokens, 0, "sentence"))
    return greedy(text, found, breaks, policy.max_tokens, k, 0)


def chunks(df: DataFrame, policy: TokenPolicy | SemanticPolicy, key: str = "doc_id", text: str = "text", scorer: Callable[[str, str], float | None] = jaccard) -> DataFrame:
    """A row a chunk: key, ordinal, start, end (bytes), token_count, text."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *CHUNK.fields])

    def work(columns):
        out = [[] for _ in schema.fields]
        for k, t in zip(*columns, strict=True):
            for row in token_chunk(t or "", policy) if isinstance(policy, TokenPolicy) else semantic_chunk(t or "", policy, scorer):
                for held, v in zip(out, (k, *row), strict=True):
                    held.append(v)
        return out

    return map_columns(df, [key, text], schema, work)


def chunk_id(parent: Column, ordinal: Column, numeric: bool = True) -> Column:
    name = F.concat(F.lit("u:"), parent.cast("string")) if numeric else F.concat(F.lit("s:"), F.lower(F.hex(F.encode(parent.cast("string"), "UTF-8"))))
    return F.concat(F.lit(f"{RESERVED}chunk:"), name, F.lit(":"), ordinal.cast("string"))


def fingerprint(policy) -> str:
    return f"{type(policy).__name__}:" + ":".join(str(v) for v in vars(policy).values())


def reconcile(before: DataFrame, now: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that a re-ingested document no longer has: they become tombstones."""
    return before.join(now.select(key), key, "left_anti")
