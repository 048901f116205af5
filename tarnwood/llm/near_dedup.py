"""Near-duplicate documents by HyperMinHash: banded compressed registers, collision-corrected
estimates, verification on full shingle sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnwood.llm import common
from tarnwood.llm.components import components

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Registers (a power of two), rows of a band; the bands use as many registers as fill them.
REGISTERS, ROWS = 64, 3
BANDS = REGISTERS // ROWS
#: A register keeps this many bits after the leading one, and six bits of leading zeros.
MANTISSA = 10
#: A register's value has 64 - 6 bits.
_VALUE_BITS = 58
#: Pairs whose estimate is under this aren't verified: 4.5 standard errors under PERCENT.
LEAST_ESTIMATE = 0.5
#: Rounds in which each bucket that holds several components gets another pivot.
ROUNDS = 2
#: Rows of a block of a family in the last step, about; a group holds two blocks.
BLOCK_ROWS = 1_024
#: Shingles that are compared at a time as bits, pairs that are.
_BITS, _PAIRS = 1 << 16, 2_048
_PART = 1 << 14
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: list[str | None], limit: int = common.PORTION) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, text number, shingle hash), some `limit` characters and at most 2^14
    texts at a time; rows are distinct, in order of text and hash; the hash has 50 bits."""
    for begin, portion in common.portions(texts, limit):
        for skip in range(0, len(portion), _PART):
            part = portion[skip : skip + _PART]
            yield (begin + skip, len(part), *_shingles(part))


def _shingles(part: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    h, places, _, stops = common.hashed_words(part)
    owner = np.searchsorted(stops, places)
    count = np.bincount(owner, minlength=len(part))
    starts = np.cumsum(count) - count
    ends = starts + count
    with np.errstate(over="ignore"):
        n = len(h) - SHINGLE + 1
        rolled = sum((h[i : i + max(n, 0)] * _ODD[i] for i in range(SHINGLE)), np.zeros(max(n, 0), np.uint64))
    place = np.arange(len(h)) - starts[owner]
    ok = place[: max(n, 0)] + SHINGLE <= count[owner[: max(n, 0)]]
    text, value = owner[: max(n, 0)][ok], common.mix(rolled[ok])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):  # the whole sequence as one shingle
        with np.errstate(over="ignore"):
            own = np.array([np.bitwise_xor.reduce(common.mix(h[starts[i] : ends[i]] * _ODD[4] + np.arange(count[i], dtype=np.uint64) + np.uint64(int(count[i]) << 8))) for i in short], np.uint64)
        text, value = np.r_[text, short], np.r_[value, common.mix(own)]
    key = np.sort((text.astype(np.uint64) << np.uint64(50)) | (value >> np.uint64(14)))
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint64(50)).astype(np.int64), key & np.uint64((1 << 50) - 1)


def registers(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS compressed minima. The hash's upper bits choose the register, the least
    rest in it is kept as leading zeros and MANTISSA bits; an empty register takes the
    value of the first full one on a walk that depends on its number alone."""
    mixed = common.mix(value)
    bucket = (mixed & np.uint64(REGISTERS - 1)).astype(np.int64)
    least = np.full(n * REGISTERS, np.uint64(1 << _VALUE_BITS), np.uint64)
    np.minimum.at(least, text * REGISTERS + bucket, mixed >> np.uint64(6))
    full = least < np.uint64(1 << _VALUE_BITS)
    fraction, power = np.frexp((least | np.uint64(1)).astype(np.float64))
    zeros = np.clip(_VALUE_BITS - power, 0, 63)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out = ((zeros << MANTISSA) | np.clip(mantissa, 0, (1 << MANTISSA) - 1)).astype(np.uint16).reshape(n, REGISTERS)
    full = full.reshape(n, REGISTERS)
    any_ = full.any(1)
    rows, cols = np.nonzero(~full & any_[:, None])
    source, step = out.copy(), 0
    while len(rows):
        step += 1
        to = (common.mix(cols.astype(np.uint64) * _ODD[1] + np.uint64(step)) & np.uint64(REGISTERS - 1)).astype(np.int64) if step < 600 else full[rows].argmax(1)
        hit = full[rows, to]
        out[rows[hit], cols[hit]] = source[rows[hit], to[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    used = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)[None, :] * _ODD[0]
        for i in range(ROWS):
            key = common.mix(key ^ (used[:, :, i] * _ODD[i + 1] + _ODD[i]))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, less the share that chance makes equal:
    two values agree in their zeros (1 of 3) and in MANTISSA bits."""
    chance = 1 / 3 / (1 << MANTISSA)
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


def signatures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, the set's 128-bit digest (h1, h2), registers and band keys of every row."""
    schema = T.StructType([common.field(documents, id_col, "id"), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("regs", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def make():
        def work(columns):
            ids, texts = columns
            out = [[] for _ in range(5)]
            for _, n, text, value in shingle_sets(texts):
                size = np.bincount(text, minlength=n)
                sums = []
                for salt in (3, 5):
                    total = np.zeros(n, np.uint64)
                    with np.errstate(over="ignore"):
                        if len(text):
                            at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                            total[text[at]] = np.add.reduceat(common.mix(value * np.uint64(salt) + _ODD[salt - 2]), at)
                    sums.append(total.view(np.int64))
                regs = registers(text, value, n)
                keys = band_keys(regs)
                out[0] += size.tolist()
                out[1] += sums[0].tolist()
                out[2] += sums[1].tolist()
                out[3] += [r.tobytes() for r in regs]
                out[4] += [k if s else [] for k, s in zip(keys.tolist(), size.tolist(), strict=True)]
            return ids, *out

        return work

    return common.map_arrow(documents, [id_col, text_col], schema, make)


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Adds the estimate to pairs (a, b) and keeps those that may link."""
    left = reps.select(F.col("rep").alias("a"), F.col("regs").alias("ra"))
    right = reps.select(F.col("rep").alias("b"), F.col("regs").alias("rb"))
    joined = common.joined(common.joined(pairs, left, "a"), right, "b")
    schema = T.StructType([common.field(joined, "a"), common.field(joined, "b"), T.StructField("estimate", T.DoubleType())])

    def make():
        def work(columns):
            a, b, ra, rb = columns
            if not a:
                return a, b, []
            x, y = (np.frombuffer(b"".join(r), np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
            value = estimate(x, y)
            keep = np.flatnonzero(value >= LEAST_ESTIMATE)
            return [a[i] for i in keep], [b[i] for i in keep], value[keep]

        return work

    return common.map_arrow(joined, ["a", "b", "ra", "rb"], schema, make)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets link. `texts`: id, text of the documents concerned."""
    joined = common.joined(pairs, texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    joined = common.joined(joined, texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    schema = T.StructType([common.field(joined, "a"), common.field(joined, "b")])

    def make():
        def work(columns):
            a, b, ta, tb = columns
            both = [t for pair in zip(ta, tb, strict=True) for t in pair]
            keep = []
            for at in range(0, len(both), 512):
                ((_, n, t, v),) = shingle_sets(both[at : at + 512], 1 << 62)
                size = np.bincount(t, minlength=n).reshape(-1, 2).sum(1)
                key = np.sort(((t >> 1).astype(np.uint64) << np.uint64(50)) | v)
                shared = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(50)).astype(np.int64), minlength=n // 2)
                union = size - shared
                keep += (at // 2 + np.flatnonzero((100 * shared >= PERCENT * union) & (union > 0))).tolist()
            return [a[i] for i in keep], [b[i] for i in keep]

        return work

    return common.map_arrow(joined, ["a", "b", "ta", "tb"], schema, make)


def _alike(n: str, m: str) -> Column:
    """Whether sets of these sizes may link."""
    return F.expr(f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})")


def _mixed(rows: DataFrame) -> DataFrame:
    """key, rows, and the largest component of the buckets that hold several; folded map-side."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    both = parts.groupBy("key").agg(F.sum("n").alias("rows"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("largest"))
    return both.where("parts > 1").select("key", "rows", F.col("largest.component").alias("largest"))


def _pivoted(rows: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """(a, b): each row's likeliest partner among the pivots, one to a bucket, drawn by hash,
    that are in another component. A pivot is a row of the bucket's largest component, from the second round on."""
    if salt:
        rows = common.joined(rows, _mixed(rows), "key")
        drawn = F.struct((F.col("component") != F.col("largest")).alias("small"), F.xxhash64("rep", "key", F.lit(salt)).alias("o"), "rep", "component", "n")
    else:
        drawn = F.struct(F.lit(False).alias("small"), F.xxhash64("rep", "key").alias("o"), "rep", "component", "n")
    pivots = rows.groupBy("key").agg(F.min(drawn).alias("p"), F.count("*").alias("rows")).where("rows > 1").select("key", F.col("p.rep").alias("b"), F.col("p.component").alias("cb"), F.col("p.n").alias("nb"))
    pairs = common.joined(rows.select("key", F.col("rep").alias("a"), "component", "n"), pivots, "key").where((F.col("component") != F.col("cb")) & _alike("n", "nb"))
    found = common.written(_estimated(pairs.select("a", "b").distinct(), nodes), "stars")
    return found.groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b"))


def _sets(texts: DataFrame) -> DataFrame:
    """rep and its shingles, 50 bits each, in order."""
    schema = T.StructType([common.field(texts, "id", "rep"), T.StructField("set", T.BinaryType())])

    def make():
        def work(columns):
            ids, texts = columns
            out = []
            for _, n, text, value in shingle_sets(texts):
                at = np.searchsorted(text, np.arange(n + 1))
                out += [value[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return ids, out

        return work

    return common.map_arrow(texts, ["id", "text"], schema, make)


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    value, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    owner, number = owner[often[number]], (np.cumsum(often) - 1)[number[often[number]]]
    out = np.zeros(len(i), np.int64)
    for at in range(0, int(often.sum()), _BITS):
        here = (number >= at) & (number < at + _BITS)
        bits = np.zeros((len(sets), _BITS // 8), np.uint8)
        place = number[here] - at
        np.bitwise_or.at(bits, (owner[here], place >> 3), np.uint8(1) << (place & 7).astype(np.uint8))
        words = -(-min(_BITS, int(often.sum()) - at) // 64)
        bits = bits.view(np.uint64)[:, :words]
        for k in range(0, len(i), _PAIRS):
            out[k : k + _PAIRS] += np.bitwise_count(bits[i[k : k + _PAIRS]] & bits[j[k : k + _PAIRS]]).sum(1, dtype=np.int64)
    return out


def _joined_in(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): rows of pairs that link, enough of them to join all that do."""
    component = np.unique(group["component"].combine_chunks().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    rank = np.unique(group["rep"].combine_chunks().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    n, own = (group[c].to_numpy() for c in ("n", "own"))
    is_small = group["small"].to_numpy(zero_copy_only=False).astype(bool)
    small, mingled = np.flatnonzero(is_small), group["mingled"][0].as_py()
    one = len(np.unique(own)) == 1
    regs = np.frombuffer(b"".join(group["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    bands = band_keys(regs)
    sets = [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()]
    out, step = ([], []), max(1, 40_000 // len(n))
    for at in range(0, len(small), step):
        some = small[at : at + step]
        low, high = np.minimum(n[some, None], n[None]), np.maximum(n[some, None], n[None])
        keep = (component[some, None] != component[None]) & (100 * low >= PERCENT * high)
        if mingled:
            keep &= ~is_small[None]
        else:
            keep &= (rank[some, None] < rank[None]) & (one | (own[some, None] != own[None]))
        i, j = np.nonzero(keep)
        i = some[i]
        keep = (bands[i] == bands[j]).any(1)
        i, j = i[keep], j[keep]
        keep = estimate(regs[i], regs[j]) >= LEAST_ESTIMATE
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        rows, places = np.unique(np.r_[i, j], return_inverse=True)
        both = _shared([sets[r] for r in rows.tolist()], places[: len(i)], places[len(i) :])
        linked = 100 * both >= PERCENT * (n[i] + n[j] - both)
        for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
            if component[x] != component[y]:
                component[component == component[y]] = component[x]
                out[0].append(x)
                out[1].append(y)
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def _residue(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between rows of a bucket that are in different components still; enough
    of them to join all that link. All pairs that neither the sizes nor the estimate rule out
    are held against each other on full sets.

    Buckets that share rows are a family. Its largest component and its other rows are cut
    into blocks, and every two blocks meet in a group but those of the largest component: so
    what is linked already costs a row for each block of the others, a group has a bounded
    number of rows, and no pair leaves a task but a link that joins two components. A
    family of m rows that aren't linked costs m * m / BLOCK_ROWS rows."""
    mixed = common.joined(rows, _mixed(rows).select("key"), "key").select("key", "rep", "component", "n")
    mixed = common.written(mixed, "mixed")
    least = mixed.groupBy("key").agg(F.min("rep").alias("b"))
    family = components(common.joined(mixed.select("key", F.col("rep").alias("a")), least, "key").select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    held = common.joined(mixed.select("rep", "component", "n").dropDuplicates(["rep"]), family, "rep")
    held = common.written(held, "families")
    parts = held.groupBy("family", "component").agg(F.count("*").alias("k"))
    sizes = parts.groupBy("family").agg(F.sum("k").alias("k"), F.max(F.struct("k", "component")).alias("largest"))
    blocks = lambda k: F.ceil(k / BLOCK_ROWS).cast("long")
    sizes = sizes.select("family", "largest.component", blocks(F.col("largest.k")).alias("qm"), blocks(F.col("k") - F.col("largest.k")).alias("qs")).withColumnRenamed("component", "largest")
    held = common.joined(held, sizes, "family").withColumn("small", F.col("component") != F.col("largest"))
    held = held.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("small"), F.col("qs")).otherwise(F.col("qm"))))
    alike = F.expr("transform(sequence(0L, qs - 1), k -> struct(false as mingled, least(own, k) * qs + greatest(own, k) as cell))")
    mingled = F.expr("transform(sequence(0L, qm - 1), k -> struct(true as mingled, own * qm + k as cell))")
    major = F.expr("transform(sequence(0L, qs - 1), k -> struct(true as mingled, k * qm + own as cell))")
    held = held.withColumn("at", F.explode(F.when(F.col("small"), F.concat(alike, mingled)).otherwise(major)))
    dealt = common.joined(common.joined(held.select("family", "at.*", "own", "small", "rep", "component", "n"), nodes, "rep"), _sets(texts), "rep")
    dealt = dealt.select("family", "mingled", "cell", "own", "small", "rep", "component", "n", "regs", "set")
    schema = T.StructType([common.field(rows, "rep", "a"), common.field(rows, "rep", "b")])
    arrow = to_arrow_schema(schema)

    def link(group: pa.Table) -> pa.Table:
        a, b = _joined_in(group)
        reps = group["rep"].combine_chunks()
        return pa.table([reps.take(pa.array(a)), reps.take(pa.array(b))], schema=arrow)

    return dealt.groupBy("family", "mingled", "cell").applyInArrow(link, schema)


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(rep, component) of all rows that are linked, after more links between rows."""
    if labels is None:
        return common.written(components(links).withColumnRenamed("node", "rep"), "components")
    edges = links
    for end in ("a", "b"):
        edges = common.joined(edges, labels.select(F.col("rep").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    merged = common.written(components(edges.select("a", "b")), "merged")
    old = common.joined(labels, merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("rep", F.coalesce("to", "component").alias("component"))
    new = common.joined(merged.withColumnRenamed("node", "rep"), labels, "rep", "left_anti").select("rep", "component")
    return common.written(old.unionByName(new), "components")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id reachable) and kept (id = component_id).

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's
    set has its distinct runs of five words, or with fewer words the whole sequence; without
    words, or with a null text, it is empty and links with nothing.

    1. Documents with equal sets are one class, found by a 128-bit digest: copies cost one
       row each and no pairs.
    2. In each band's bucket one class, drawn by hash, is the pivot; every other one of
       another component is paired with it, estimated, and verified against its best pivot
       on full sets. The links' components are made. Buckets that hold several components
       get another pivot, ROUNDS times in all.
    3. Rows of buckets that still hold several components are held against those of the
       others; all pairs that the estimate doesn't rule out are verified.
    With 21 bands of 3 registers a pair of Jaccard 0.75 shares no band with probability 1e-5.

    Rows that repeat an id are each given; they are one node. A null id is never a
    component's least id: a class of such rows alone has a null component and is kept.
    Other columns are not read; an empty table gives an empty result."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = common.written(signatures(source, "id", "text"), "signatures")
    classes = rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    reps = common.written(classes.where("rep is not null"), "classes")
    # a class may share its least id with another one where an id is repeated: one node
    nodes = reps.groupBy("rep").agg(F.first("regs").alias("regs"))
    exploded = reps.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    exploded = common.written(common.joined(exploded, shared, "key"), "buckets")  # other rows meet nothing
    concerned = exploded.select(F.col("rep").alias("id")).distinct()
    texts = common.written(common.joined(source.where("id is not null"), concerned, "id", "left_semi").dropDuplicates(["id"]), "texts")
    labels = None

    def labelled() -> DataFrame:
        if labels is None:
            return exploded.withColumn("component", F.col("rep"))
        return common.joined(exploded, labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    for salt in range(ROUNDS):
        links = common.written(_verified(_pivoted(labelled(), nodes, salt), texts), "links")
        if links.isEmpty():
            break
        labels = _relabelled(labels, links)
    links = common.written(_residue(labelled(), nodes, texts), "more-links")
    if labels is None or not links.isEmpty():
        labels = _relabelled(labels, links)
    final = common.joined(reps.select("h1", "h2", "n", "rep"), labels, "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    joined = common.joined(rows.select("id", "n", "h1", "h2"), final, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, all columns as they were: rows whose id is the
    component's least; rows that repeat an id go or stay together."""
    found = near_duplicates(documents, id_col, text_col).where("kept").select(F.col(id_col).alias("__tw_id")).distinct()
    return common.joined(documents, found, F.col(id_col).eqNullSafe(F.col("__tw_id")), "left_semi")
