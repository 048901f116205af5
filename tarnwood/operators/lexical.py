"""BM25 over string fields."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwood.model import Analyzer, InvalidRequest

K1, B = 1.2, 0.75


def tokens(text: Column, analyzer: Analyzer = Analyzer()) -> Column:
    """Runs of letters and digits, lower-cased by default; no stemming, no stop words."""
    value = F.coalesce(text, F.lit(""))
    value = F.lower(value) if analyzer.lowercase else value
    return F.filter(F.split(value, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def analyze(text: str, analyzer: Analyzer = Analyzer()) -> list[str]:
    value = text.lower() if analyzer.lowercase else text
    return "".join(c if c.isalnum() else " " for c in value).split()


def postings(records: DataFrame, fields: list[str], key: str = "record_id", analyzer: Analyzer = Analyzer()) -> DataFrame:
    """(key, terms, length): a row a record, its terms with their frequencies as a map; the
    fields' texts count as one document, a record without text has length 0."""
    if not fields:
        raise InvalidRequest("at least one lexical field")
    text = F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    own = records.select(F.col(key), tokens(text, analyzer).alias("terms"))
    return own.select(key, "terms", F.size("terms").cast("long").alias("length"))


def statistics(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").cast("long").alias("n"), F.sum("length").cast("long").alias("total"), F.avg("length").alias("avg_length"))


def document_frequencies(index: DataFrame) -> DataFrame:
    """term, df (records that have it) and tf (all its occurrences)."""
    first = F.transform(F.array_distinct("terms"), lambda x: F.struct(x.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("tf")))
    every = F.transform("terms", lambda x: F.struct(x.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("tf")))
    each = index.select(F.explode(F.concat(first, every)).alias("t")).select("t.*")
    return each.groupBy("term").agg(F.sum("df").cast("long").alias("df"), F.sum("tf").cast("long").alias("tf"))


def search(index: DataFrame, text: str, top_k: int, key: str = "record_id", allowed: DataFrame | None = None, analyzer: Analyzer = Analyzer(), digits: int | None = None) -> DataFrame:
    """(key, score): any query term suffices; order by score, then key.

    Two scans and no join of postings: the first makes N, the average length and the few
    terms' document frequencies in one aggregate; the second scores each row from its own
    terms. `allowed` restricts the rows after scoring, so the statistics are the whole
    collection's."""
    terms = sorted(set(analyze(text, analyzer)))
    if not terms or top_k <= 0:
        raise InvalidRequest("the text has no tokens or top_k isn't positive")
    counts = [F.count_if(F.array_contains("terms", t)).alias(f"df{i}") for i, t in enumerate(terms)]
    stats = index.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), *counts).first()
    n, avg = stats["n"], stats["avg"] or 0.0
    value = F.lit(0.0)
    for i, t in enumerate(terms):
        df = stats[f"df{i}"]
        idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        tf = F.size(F.filter("terms", _equals(t))).cast("double")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(avg if avg else 1.0)))
        value = value + F.when(tf > 0, part).otherwise(0.0)
    hit = F.arrays_overlap("terms", F.array(*[F.lit(t) for t in terms]))
    rows = index.where(hit)
    if allowed is not None:
        rows = rows.join(allowed.select(key), key, "left_semi")
    rows = rows.select(key, (value if digits is None else F.round(value, digits)).alias("score"))
    return rows.orderBy(F.desc("score"), F.asc(key)).limit(top_k)


def _equals(term: str):
    return lambda x: x == F.lit(term)


def fingerprint(collection: str, sequence: int, segments: list[int], fields: list[str], analyzer: Analyzer = Analyzer()) -> str:
    """What a stored index was built from; another one makes it stale."""
    told = [collection, sequence, sorted(segments), sorted(fields), analyzer.lowercase, K1, B]
    return hashlib.sha256(repr(told).encode()).hexdigest()
