"""Order MinHash fingerprints, in DataFrame operations only.

A text's k-mers are its runs of K words. Each is numbered by its occurrence, hashed with
that number, and dealt by the hash into BUCKETS; a bucket's TUPLE least ones, put in text
order, hash to the bucket's entry. Moving or replacing text changes which k-mers meet and
in which order, so that the share of equal entries falls with edit distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64  # a power of two
TUPLE = 2
#: Bits of a k-mer's place; later places of a text of more words wrap round.
PLACE_BITS = 24
#: Rows that a window of neighbours holds, on average, and the most windows.
WINDOW_ROWS, MOST_WINDOWS, MOST_BOUNDS = 2_000, 65_536, 256

_MASK = (1 << PLACE_BITS) - 1
_SHIFT = 64 - int(math.log2(BUCKETS))


def _pack(hash_: Column, place: Column) -> Column:
    """The hash's upper 40 bits over the place."""
    return F.shiftleft(F.shiftrightunsigned(hash_, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_MASK)))


def _bucket(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, _SHIFT)


def with_entries(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: an array with the bucket (upper half) and the 32-bit hash (lower half) of
    each entry. K is 2 words, the first word of a text standing alone too; words are cut at
    spaces, tabs and line breaks. A null or empty text has no entries.

    The steps are separate columns because each is read more than once."""
    w, h, s, q, kept = (f"__tw_{n}" for n in ("words", "kmers", "starts", "order", "kept"))
    names = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*names, F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\r\n", "   "), " "), lambda x: x != "").alias(w))
    # sorted by k-mer, then place: primitive longs
    step = step.select(*names, F.sort_array(F.transform(F.col(w), lambda x, i: _pack(F.xxhash64(F.get(F.col(w), i - 1), x), i))).alias(h))
    same = lambda x, y: F.shiftrightunsigned(x, PLACE_BITS) == F.shiftrightunsigned(y, PLACE_BITS)
    places = F.sequence(F.lit(0), F.size(h) - 1)
    step = step.select(*names, h, F.when(F.size(h) > 0, F.filter(places, lambda i: (i == 0) | ~same(F.get(h, i), F.get(h, F.greatest(i - 1, F.lit(0)))))).alias(s))
    numbered = lambda at, r: F.transform(
        F.sequence(F.lit(0), F.coalesce(F.get(F.col(s), r + 1), F.size(h)) - at - 1),
        lambda o: _pack(F.xxhash64(F.shiftrightunsigned(F.get(h, at), PLACE_BITS), o), F.get(h, at + o)),
    )
    step = step.select(*names, F.coalesce(F.sort_array(F.flatten(F.transform(F.col(s), numbered))), F.array().cast("array<bigint>")).alias(q))
    # signed order keeps each bucket's run together
    first = F.filter(F.col(q), lambda x, i: (i < TUPLE) | (_bucket(F.get(q, F.greatest(i - TUPLE, F.lit(0)))) != _bucket(x)))
    step = step.select(*names, first.alias(kept))
    place = lambda x: x.bitwiseAND(F.lit(_MASK))

    def entry(x: Column, i: Column) -> Column:
        mate = F.get(kept, i + 1)
        pair = mate.isNotNull() & (_bucket(mate) == _bucket(x))
        a, b = F.shiftrightunsigned(x, PLACE_BITS), F.shiftrightunsigned(mate, PLACE_BITS)
        hashed = F.when(~pair, F.xxhash64(a)).when(place(x) < place(mate), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        head = (i == 0) | (_bucket(F.get(kept, F.greatest(i - 1, F.lit(0)))) != _bucket(x))
        return F.when(head, F.shiftleft(_bucket(x), 32).bitwiseOR(F.shiftrightunsigned(hashed, 32)))

    entries = F.filter(F.transform(F.col(kept), entry), lambda x: x.isNotNull())
    return step.select(*names, entries.alias(out))


def printed(entries: Column) -> Column:
    """The entries as hex, joined by points; of an empty text the empty string."""
    return F.array_join(F.transform(entries, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Equal entries over the buckets that either fills; two empty texts are alike (1)."""
    buckets = F.size(F.array_union(F.transform(a, lambda x: F.shiftrightunsigned(x, 32)), F.transform(b, lambda x: F.shiftrightunsigned(x, 32))))
    return F.when(buckets == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / buckets)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, entries and fingerprint of every row; other columns are not read."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__tw_text"))
    out = with_entries(rows, "__tw_text", "entries")
    return out.select(id_col, F.char_length("__tw_text").cast("long").alias("n_chars"), "entries", printed(F.col("entries")).alias("fingerprint"))


def with_next(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Adds `next_<column>`: the values of the row that follows by id; the last row is
    followed by the first.

    Ids are cut at quantiles into windows of about WINDOW_ROWS rows; the first row of each
    window also goes, marked, to the end of the window before it, so one shuffle suffices
    and no task sees more than its windows. The driver holds a few numbers a window,
    MOST_WINDOWS at most. Null ids come first; rows with the same id are ordered by their columns."""
    n = df.count()
    if not n:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    windows = min(MOST_WINDOWS, max(1, n // WINDOW_ROWS))
    bounds_n = min(windows, MOST_BOUNDS)
    fine = math.ceil(windows / bounds_n)
    key = F.col(id_col).cast("long")
    got = df.select(F.percentile_approx(key, [i / bounds_n for i in range(1, bounds_n)] or [0.5], 10_000), F.min(key), F.max(key)).first()
    if got[1] is None:
        edges = [0, 1]
    else:
        edges = sorted({int(got[1]), *map(int, (got[0] or []) if bounds_n > 1 else []), int(got[2]) + 1})
    edge = F.array(*[F.lit(e).cast("long") for e in edges])
    at = F.greatest(F.lit(1), F.coalesce(F.size(F.filter(edge, lambda e: e <= key)), F.lit(1)))
    low, high = F.element_at(edge, at), F.element_at(edge, F.least(at + 1, F.size(edge)))
    part = F.least(F.lit(fine - 1), F.coalesce(F.floor((key - low) / F.greatest(F.lit(1), high - low) * fine), F.lit(0)).cast("int"))
    window = F.when(key.isNull(), F.lit(0)).otherwise((at - 1) * fine + part).cast("int")
    firsts = sorted(df.select(window.alias("w"), key.alias("k")).groupBy("w").agg(F.min(F.struct(F.col("k").isNotNull().alias("set"), "k")).alias("m")).collect(), key=lambda r: r["w"])
    before = {(r["m"]["k"]): firsts[i - 1]["w"] for i, r in enumerate(firsts)}  # of the first window: the last
    target = df.sparkSession.createDataFrame([(k, w) for k, w in before.items()], "__tw_k long, __tw_before int")
    placed = df.withColumn("__tw_w", window).join(F.broadcast(target), key.eqNullSafe(F.col("__tw_k")), "left")
    copies = F.when(F.col("__tw_before").isNull(), F.array(F.struct(F.col("__tw_w").alias("w"), F.lit(0).alias("mark")))).otherwise(
        F.array(F.struct(F.col("__tw_w").alias("w"), F.lit(0).alias("mark")), F.struct(F.col("__tw_before").alias("w"), F.lit(1).alias("mark")))
    )
    from pyspark.sql import Window

    spread = placed.withColumn("__tw_at", F.explode(copies))
    over = Window.partitionBy("__tw_at.w").orderBy("__tw_at.mark", key.asc_nulls_first(), *columns)
    led = spread.select("*", *[F.lead(c).over(over).alias(f"next_{c}") for c in columns])
    return led.where(F.col("__tw_at.mark") == 0).select(*df.columns, *[f"next_{c}" for c in columns])


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's, by ascending id. A null text is empty; two empty
    texts are alike (1), an empty and another one are not (0). Rows that repeat an id are
    ordered by text; extra columns are not read; an empty table gives an empty result."""
    rows = df.select(F.col(id_col).alias("__tw_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__tw_text"))
    led = with_next(with_entries(rows, "__tw_text", "__tw_own"), "__tw_id", ["__tw_text", "__tw_own"])
    n = F.char_length("__tw_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("__tw_text"), F.lit(1), n - half), F.substring(F.col("next___tw_text"), F.lit(1), half))
    cut = led.select("__tw_id", n.cast("long").alias("n_chars"), "__tw_own", F.col("next___tw_own").alias("__tw_next"), edited.alias("__tw_edited"))
    out = with_entries(cut, "__tw_edited", "__tw_new")
    own, new, nxt = F.col("__tw_own"), F.col("__tw_new"), F.col("__tw_next")
    return out.select(
        F.col("__tw_id").alias(id_col), "n_chars", F.sha2(F.encode("__tw_edited", "UTF-8"), 256).alias("edited_sha256"), printed(own).alias("fingerprint"), printed(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"), likeness(own, nxt).alias("near_next"),
    )
