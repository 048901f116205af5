"""Line deduplication as an exact set-similarity join: tokens by rarity, prefix, positional
and length filters, Jaccard verification, later matches removed."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnwood.llm import common
from tarnwood.llm.components import components

#: Lines match from a Jaccard similarity of 3/4 on. The filters below are written for it:
#: of sizes a and b, 4 * min >= 3 * max, and the overlap is at least ceil(3 (a + b) / 7).
NUMERATOR, DENOMINATOR = 3, 4
#: Tokens whose exact counts go to every task, the most frequent ones; all others rank before
#: them, in the order of their hashes. The order decides the work, never the result.
HEAD, CELLS_LOG2 = 1 << 19, 23
#: A prefix token of more rows is a key only together with the next token of a line that two
#: matching lines may share. Such a pair of more than GROUP_ROWS / PAIR_SHARE rows takes a
#: third token; a triple of more than GROUP_ROWS rows deals its lines to parts, of about so
#: many. A key's rows are estimated from one line in GROUP_ROWS / SAMPLE_SHARE, and never
#: taken for more than its last token's count. They decide the work, never the result.
GROUP_ROWS, PAIR_SHARE, SAMPLE_SHARE, HEAVY_LOG2 = 20_000, 8, 160, 20
#: Rows of prefixes that a part of the join holds, about.
PART_ROWS = 400_000
#: Partners of a line that are verified in the first round, at most: of all but certain ones, of others.
SURE_PARTNERS, PARTNERS = 3, 32
#: Bits of the maps that say which lines or keys a pass concerns, at most; fewer let more through.
MAP_BITS_LOG2 = 27
#: Pairs that are verified together, about; bounds a worker's memory, never results.
PAIRS = 100_000
#: Classes of lines that a task remembers, to give a class's prefix once and not for each copy.
REMEMBERED = 200_000
#: Tokens of pairs that are compared together, about.
_TOKENS = 1 << 20
_LINES = 4_096
#: The least sizes that are (4/3)^k or more: of two sizes that may match, the places differ by one at most.
_SIZES = np.array([-(-(4**k) // 3**k) for k in range(140)])
_HASH_BITS, _NEAR = 44, 64
_TOKEN_MASK = np.uint64((1 << 52) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_CROSS, _SALTED, _PROBE = 1, 2, 4
#: By the bits in which two sketches differ: tokens in which the sets differ, as good as surely
#: at most (the mean of throws into 128 cells that leaves so many odd, and three deviations).
_SURE = np.array([a if a < 2 else m + 3 * math.sqrt(max(0.0, m * m / 128)) if (m := math.log1p(-min(a, 63) / 64) / math.log1p(-1 / 64)) < 127 else 1 << 30 for a in range(129)])


def lines_of(texts: list[str | bytes | None]):
    """(line number of each word, its hash, text of each line, place of each line in its text)."""
    h, places, data, stops = common.hashed_words(texts)
    breaks = np.flatnonzero(data >= common.LINE_END[0])
    owner = np.searchsorted(stops, breaks)
    first = np.searchsorted(owner, np.arange(len(texts)))
    words = np.diff(np.r_[0, np.searchsorted(places, breaks)])
    return np.repeat(np.arange(len(breaks)), words), h, owner, np.arange(len(owner)) - first[owner]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def _sequences(h: np.ndarray, at: np.ndarray, both: bool) -> tuple[np.ndarray, ...]:
    """64-bit hashes, one or two, of the sequences of words that begin at `at`."""
    if not len(at):
        return (np.zeros(0, np.uint64),) * 2
    with np.errstate(over="ignore"):
        pos = np.arange(len(h), dtype=np.uint64) - np.repeat(at.astype(np.uint64), np.diff(np.r_[at, len(h)]))
        mixed = common.mix(h + pos * _STEP[2])
        return np.add.reduceat(mixed, at), np.add.reduceat(mixed * (mixed >> np.uint64(32)), at) if both else None


def _line_hash(ids: pa.Array, owner: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Of lines, whose id is the one that `owner` numbers."""
    if pa.types.is_integer(ids.type):
        own = common.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + _STEP[1])
    else:
        own = np.fromiter((xxhash.xxh3_64_intdigest(str(i)) for i in ids.to_pylist()), np.uint64, len(ids))
    with np.errstate(over="ignore"):
        return common.mix(own[owner] + lines.astype(np.uint64) * _STEP[0])


def _parts(spark: SparkSession, rows: int = 0) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


#: Kinds of rows of a survey: token counts, lines that are the first of a class in their task, other lines, words of some of the first ones.
_COUNTED, _FIRST, _EQUAL, _SAMPLED = 0, 1, 2, 3


def _sample() -> int:
    """One line in so many is looked at for the sizes of groups."""
    return max(1, GROUP_ROWS // SAMPLE_SHARE)


def survey(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts; its rows hold arrays: kind, part, data, ids. Token counts,
    folded by task: the tokens' hashes and counts. Lines with words: a class is by 128 bits
    of the sequence of words; a task gives a class's first line with these bits and place,
    and of its other lines, which equal an earlier one, the places. Of some of the first
    lines, chosen by a hash, the hashes of the words too, and the line's number for each."""
    parts, sample = 4 * _parts(documents.sparkSession), np.uint64(_sample())
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("ids", T.ArrayType(documents.schema[id_col].dataType))])
    arrow = to_arrow_schema(schema)

    def packed(kind: int, by: np.ndarray, columns: list[np.ndarray], ids: pa.Array | None = None) -> pa.RecordBatch:
        part = ((by >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        at = _starts(part[order])
        columns = [c[order] for c in columns]
        blobs = [b"".join(c[s].tobytes() for c in columns) for s in map(slice, at.tolist(), [*at[1:].tolist(), len(part)])]
        lists = pa.nulls(len(at), arrow.field(3).type) if ids is None else _lists(ids.take(pa.array(order)), at, arrow.field(3).type)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(part[order][at]), pa.array(blobs, pa.binary()), lists], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lines, some, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            token, n = _summed(counts)
            yield packed(_COUNTED, token, [token, n])
            c1, c2, line = (np.concatenate(c) for c in list(zip(*lines, strict=True))[:3])
            ids = pa.concat_arrays([x[3] for x in lines])
            first = _first(c1, c2, ids, line)
            yield packed(_FIRST, c1[first], [c1[first], c2[first], line[first]], ids.take(pa.array(np.flatnonzero(first))))
            yield packed(_EQUAL, c1[~first], [line[~first]], ids.take(pa.array(np.flatnonzero(~first))))
            ends = np.cumsum([0, *(len(x[0]) for x in lines)])
            h = np.concatenate([x[0] for x in some])
            own = np.concatenate([n + e for (_, n), e in zip(some, ends[:-1], strict=True)])
            keep = first[own]
            if keep.any():
                yield packed(_SAMPLED, np.zeros(1, np.uint64), [np.r_[h[keep], own[keep].astype(np.uint64)][None]])

        for batch in batches:
            for piece in common.slices(batch):
                number, h, owner, place = lines_of(common.encoded(piece.column(1)))
                if not len(h):
                    continue
                counts.append(np.unique(h, return_counts=True))
                size += len(counts[-1][0])
                at = _starts(number)
                lines.append((*_sequences(h, at, True), place[number[at]].astype(np.int32), piece.column(0).take(pa.array(owner[number[at]]))))
                nth = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(h)]))
                mine = (_line_hash(piece.column(0), owner[number[at]], place[number[at]]) % sample == 0)[nth]
                some.append((h[mine], nth[mine]))
                if size > 4_000_000:
                    yield from flush()
                    counts, lines, some, size = [], [], [], 0
        if counts:
            yield from flush()
        del counts, lines, some
        common.trim()

    return documents.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).mapInArrow(run, schema)


def _lists(values: pa.Array, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values as lists that begin at `at`."""
    return pa.ListArray.from_arrays(pa.array(np.r_[at, len(values)].astype(np.int32)), values).cast(kind)


def _ranks(ids: pa.Array) -> np.ndarray:
    """Integers in the order of the ids."""
    values = ids.to_numpy(zero_copy_only=False)
    return values if values.dtype.kind in "iu" else np.unique(values, return_inverse=True)[1]


def _first(c1: np.ndarray, c2: np.ndarray, ids: pa.Array, line: np.ndarray) -> np.ndarray:
    """Which lines are the first of their class. Lines that repeat an id and a place are one."""
    rank = _ranks(ids)
    order = np.lexsort((line, rank, c2, c1))
    c1, c2, rank, line = (v[order] for v in (c1, c2, rank, line))
    at = _starts(c1) if not len(c1) else np.flatnonzero(np.r_[True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
    head = np.repeat(at, np.diff(np.r_[at, len(c1)]))
    out = np.zeros(len(order), bool)
    out[order] = (rank == rank[head]) & (line == line[head])
    return out


def equal_lines(surveyed: DataFrame) -> DataFrame:
    """(id, line) of lines that equal an earlier one. A class meets in one task, with a row
    for each task that has it, however many lines it has."""
    kind = surveyed.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), T.StructField("line", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made() -> pa.RecordBatch:
            c1, c2, line = (np.concatenate(c) for c in list(zip(*held, strict=True))[:3])
            ids = pa.concat_arrays([x[3] for x in held])
            rest = np.flatnonzero(~_first(c1, c2, ids, line))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rest)), pa.array(line[rest])], schema=arrow)

        for batch in batches:
            data, lists = batch.column(2).to_pylist(), batch.column(3)
            for i, (kind, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if part != now and held:
                    yield made()
                    held = []
                ids, now = lists[i].values, part
                m = len(ids)
                if kind == _EQUAL:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(data[i], np.int32))], schema=arrow)
                else:
                    held.append((np.frombuffer(data[i], np.uint64, m), np.frombuffer(data[i], np.uint64, m, 8 * m), np.frombuffer(data[i], np.int32, m, 16 * m), ids))
        if held:
            yield made()
        common.trim()

    lines = surveyed.where(F.col("kind").isin(_FIRST, _EQUAL))
    return lines.repartition(_parts(surveyed.sparkSession), "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts) of several such, the tokens in order."""
    token, n = np.concatenate([t for t, _ in held]), np.concatenate([n for _, n in held])
    order = np.argsort(token)
    at = _starts(token[order])
    return token[order][at], np.add.reduceat(n[order], at) if len(at) else n


#: The greatest counts that the ranks stand for: six ranks to a doubling, 0 for the rest.
_COUNTS = np.r_[0, (2.0 ** (np.arange(1, 256) / 6)).astype(np.int64)]


class Head(NamedTuple):
    """The ranks of the most frequent tokens by their exact counts, in cells by the upper bits
    of their hashes; a cell has the greatest rank. A rare token may so pass for a frequent one,
    for one in sixteen at most; it does everywhere, and the order decides the work alone.
    `total` is the number of words of all texts, of tokens that occur twice. `heavy` has, as
    ranks and in cells by the upper bits too, the rows of the largest keys, by estimate;
    without it, any key may have as many as its last token has occurrences."""

    cells: np.ndarray
    total: int
    heavy: np.ndarray | None = None

    @classmethod
    def of(cls, token: np.ndarray, n: np.ndarray, total: int) -> Head:
        cells = np.zeros(1 << CELLS_LOG2, np.uint8)
        np.maximum.at(cells, (token >> np.uint64(64 - CELLS_LOG2)).astype(np.int64), np.searchsorted(_COUNTS[:-1], n).astype(np.uint8))
        return cls(cells, total)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The tokens' ranks, rarer ones first, 0 for those not in the head."""
        return self.cells[(h >> np.uint64(64 - CELLS_LOG2)).astype(np.int32)].astype(np.uint64)

    def rows(self, key: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How many rows keys have, about, the last token of which has such counts."""
        if self.heavy is None:
            return last
        return np.minimum(last, _COUNTS[self.heavy[(key >> np.uint64(64 - HEAVY_LOG2)).astype(np.int32)]])


def token_counts(surveyed: DataFrame) -> Head:
    """Exact counts over all texts. Each part of the tokens is summed by one task; of the sums
    a histogram of 64 cells at most and HEAD tokens at most reach the driver."""
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made():
            token, n = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], schema=arrow)

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and held:
                    yield made()
                    held = []
                now, m = part, len(blob) // 16
                held.append((np.frombuffer(blob, np.uint64, m), np.frombuffer(blob, np.int64, m, 8 * m)))
                if len(held) % 64 == 0:
                    held = [_summed(held)]
        if held:
            yield made()
        common.trim()

    blobs = surveyed.where(F.col("kind") == _COUNTED).select("part", "data")
    counts = common.written(blobs.repartition(_parts(surveyed.sparkSession), "part").sortWithinPartitions("part").mapInArrow(run, schema), "token-counts")
    cells = counts.groupBy(F.floor(F.log2("n")).alias("log2")).agg(F.count("*").alias("tokens"), F.sum("n").alias("words")).orderBy(F.desc("log2")).collect()
    least, room = 62, HEAD
    for cell in cells:
        room -= cell["tokens"]
        if room < 0:
            break
        least = cell["log2"]
    top = counts.where(F.col("n") >= F.lit(1 << least)).toArrow()
    head = Head.of(top["token"].to_numpy().view(np.uint64), top["n"].to_numpy(), sum(c["words"] for c in cells))
    return head._replace(heavy=_heavy(surveyed, head))


def _heavy(surveyed: DataFrame, head: Head) -> np.ndarray:
    """The rows of the keys of frequent tokens, of one to three, estimated from the lines sampled,
    as ranks in cells; 0 for keys that need no further token and no parts. A cell has the greatest."""
    held = surveyed.sparkSession.sparkContext.broadcast(head)
    most, sample = GROUP_ROWS, _sample()
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                h, own = np.frombuffer(blob, np.uint64).reshape(2, -1)
                number, keys = np.cumsum(np.r_[False, own[1:] != own[:-1]]), []
                for _ in _prefixes(number, h, held.value, most, lambda lines, words: np.ones(len(lines), bool), frequent=keys):
                    if sum(map(len, keys)) > 1_000_000:
                        yield counted(keys)
                        keys.clear()
                if keys:
                    yield counted(keys)
        common.trim()

    def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], schema=arrow)

    keys = surveyed.where(F.col("kind") == _SAMPLED).select("data").mapInArrow(run, schema).groupBy("key").agg((F.sum("n") * sample).alias("n"))
    cells = keys.where(F.col("n") * PAIR_SHARE > most).groupBy(F.shiftrightunsigned("key", 64 - HEAVY_LOG2).cast("int").alias("cell")).agg(F.max("n").alias("n")).toArrow()
    heavy = np.zeros(1 << HEAVY_LOG2, np.uint8)
    heavy[cells["cell"].to_numpy()] = np.searchsorted(_COUNTS[:-1], cells["n"].to_numpy()).astype(np.uint8)
    return heavy


class Map:
    """A set of 64-bit hashes by some of their bits, packed; has them all, and few others."""

    def __init__(self, rows: DataFrame, column: str, n: int):
        """`n` hashes. Built by parts of 4 KB, folded map-side; 16 MB at most reach the driver."""
        self.bits = min(MAP_BITS_LOG2, max(15, (32 * n).bit_length()))
        place = F.shiftrightunsigned(column, 64 - self.bits) + 1  # buckets count from 1
        parts = rows.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
        self.bytes = np.zeros(1 << (self.bits - 3), np.uint8)
        for k, bits in parts:
            self.bytes[4_096 * (k - 1) : 4_096 * k] = np.frombuffer(bits, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class _Prefixes(NamedTuple):
    """Rows of prefixes of some lines: key, its first token, line's number, a hash of its words, its size, its tokens that can't be
    common to a match found by the key, two halves of a parity sketch, the part it is dealt to, of how many, and 32 bits of each token of its set."""

    key: np.ndarray
    token: np.ndarray
    line: np.ndarray
    words: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    b0: np.ndarray
    b1: np.ndarray
    part: np.ndarray
    parts: np.ndarray
    set: np.ndarray


def _prefixes(number: np.ndarray, h: np.ndarray, head: Head, most: int, new, with_sets: bool = False, frequent: list | None = None) -> Iterator[_Prefixes]:
    """Of lines by their words, some lines at a time. `new` says of the lines (numbers, hashes
    of the sequences of words) which to give.

    Of n tokens in order of rarity the first n - t + 1 are keys, where t = ceil(3 n / 4) is the
    least overlap with any match. Two matching lines have t tokens in common, and the k-th of
    these is among the first n - t + k of each: so a token of more rows than `most` is a key with
    each later one of the first n - t + 2, and if that pair is frequent too, with each later one
    of the first n - t + 3. What is frequent is the same for all lines, as the key alone says it.
    Lines of one or two tokens match equal sets only: their set is the key. `frequent` is given
    the keys whose last token is frequent, also those that another one follows."""
    cuts = np.searchsorted(number, np.arange(0, int(number[-1]) + 1 + _LINES, _LINES)) if len(number) else [0]
    for k in range(len(cuts) - 1):
        s = slice(cuts[k], cuts[k + 1])
        if cuts[k] == cuts[k + 1]:
            continue
        local = (number[s] - k * _LINES).astype(np.uint64)
        at = _starts(local)
        words = _sequences(h[s], at, False)[0]
        given = new(k * _LINES + local[at].astype(np.int64), words)
        if not given.any():
            continue
        take = np.repeat(given, np.diff(np.r_[at, len(local)]))
        local, mine, words = local[take], h[s][take], words[given]
        sort = (local << np.uint64(52)) | (head.ranks(mine) << np.uint64(_HASH_BITS)) | (mine >> np.uint64(64 - _HASH_BITS))
        sort.sort()
        sort = sort[_starts(sort)]
        own, token = (sort >> np.uint64(52)).astype(np.int64), sort & _TOKEN_MASK
        at = _starts(own)
        n = np.diff(np.r_[at, len(own)])
        bit = np.uint64(1) << (token & np.uint64(63))
        low = ((token >> np.uint64(6)) & np.uint64(1)) == 0
        b0, b1 = (np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), at) for half in (low, ~low))
        mixed, count = common.mix(token), _COUNTS[(token >> np.uint64(_HASH_BITS)).astype(np.int64)]
        with np.errstate(over="ignore"):
            whole = common.mix(np.add.reduceat(mixed, at) + n.astype(np.uint64))
        lines = k * _LINES + own[at]
        small = n <= 2
        prefix = np.where(small, 1, n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1)
        row = np.repeat(np.arange(len(n)), prefix)
        first = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        short = small[row]
        key, often, last, token = np.where(short, whole[row], mixed[first]), np.where(short, 0, head.rows(mixed[first], count[first])), first, mixed[first]
        if frequent is not None:
            frequent.append(key[often > most])
        done = []
        for level, limit in ((1, most), (2, max(1, most // PAIR_SHARE))):
            hot = often > limit
            done.append((row[~hot], last[~hot] - level + 1, key[~hot], often[~hot], token[~hot]))
            row, key, last, token = row[hot], key[hot], last[hot], token[hot]
            # the later tokens, as far as the prefix of this level goes
            more = at[row] + prefix[row] + level - 1 - last
            copies = np.repeat(np.arange(len(row)), more)
            after = last[copies] + 1 + np.arange(len(copies)) - np.repeat(np.cumsum(more) - more, more)
            with np.errstate(over="ignore"):
                key = common.mix(key[copies] * _STEP[1] + mixed[after])
            row, last, often, token = row[copies], after, head.rows(key, count[after]), token[copies]
            if frequent is not None:
                frequent.append(key[often > most // PAIR_SHARE])
        done.append((row, last - 2, key, often, token))
        row, before, key, often, token = map(np.concatenate, zip(*done, strict=True))
        parts = np.maximum(1, -(-often // most))
        with np.errstate(over="ignore"):
            part = (common.mix(whole[row] * _STEP[2] + lines[row].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
        short = mixed.astype(np.uint32)
        sets = np.empty(len(n), object)
        if with_sets:
            for i, (begin, k) in enumerate(zip(at.tolist(), n.tolist(), strict=True)):
                sets[i] = short[begin : begin + k]
        yield _Prefixes(key, token, lines[row], words[row], n[row], before - at[row], b0[row], b1[row], part, parts, sets[row])


def _token_keys(h: np.ndarray, head: Head) -> np.ndarray:
    """The key that each word is, as the first token of one."""
    return common.mix((head.ranks(h) << np.uint64(_HASH_BITS)) | (h >> np.uint64(64 - _HASH_BITS)))


def _sizes_place(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_SIZES, n, "right")


def _sized(key: np.ndarray, n: np.ndarray, step: int = 0) -> np.ndarray:
    """Hashes of keys with the places of lines' sizes, or places beside them."""
    with np.errstate(over="ignore"):
        return common.mix(key + (_sizes_place(n) + step).astype(np.uint64) * _STEP[2])


def prefix_rows(documents: DataFrame, id_col: str, text_col: str, head: Head, parts: int, wanted: Map | None = None, tokens: Map | None = None, probes: Map | None = None, everything: bool = False, with_sets: bool = False) -> DataFrame:
    """The rows of all lines' prefixes, packed by part of the join: part, data, ids.

    A line is given once a task, with its copies' least id and place, as far as the task
    remembers. `wanted` has the keys wanted, with their sizes, `tokens` the tokens they begin with; lines in `probes`, or `everything`, are marked and
    go to all parts of a frequent key, other lines to one. `with_sets` packs the tokens too,
    behind all other columns."""
    held = documents.sparkSession.sparkContext.broadcast((head, wanted, tokens, probes))  # of bounded sizes
    most = GROUP_ROWS
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("ids", T.ArrayType(documents.schema[id_col].dataType))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, wanted, tokens, probes = held.value
        seen, waiting, size = {}, [], 0
        for batch in batches:
            for piece in common.slices(batch):
                ids = piece.column(0)
                keys = ids.to_pylist()
                number, h, owner, place = lines_of(common.encoded(piece.column(1)))
                marked = np.full(len(owner), everything)
                if probes is not None:
                    marked = probes.has(_line_hash(ids, owner, place))

                if tokens is not None:  # other lines have no wanted key
                    some = np.zeros(len(owner), bool)
                    some[number[tokens.has(_token_keys(h, head))]] = True
                    number, h = number[some[number]], h[some[number]]

                def new(lines, words, keys=keys, owner=owner, place=place, marked=marked):
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    give = marked[lines]
                    for i, (c, o, p) in enumerate(zip(words.tolist(), owner[lines].tolist(), place[lines].tolist(), strict=True)):
                        before, mine = seen.get(c), (keys[o], p)
                        if before is None or mine < before:
                            seen[c] = mine
                            give[i] = True
                    return give

                for rows in _prefixes(number, h, head, most, new, with_sets):
                    mark = marked[rows.line]
                    if wanted is not None:
                        take = wanted.has(_sized(rows.key, rows.n))
                        rows, mark = _Prefixes(*(v[take] for v in rows)), mark[take]
                    copies = np.repeat(np.arange(len(mark)), np.where(mark, rows.parts, 1))
                    cell = np.where(mark[copies], np.arange(len(copies)) - np.searchsorted(copies, copies), rows.part[copies])
                    salted = rows.parts[copies] > 1
                    with np.errstate(over="ignore"):
                        key = np.where(salted, common.mix(rows.key[copies] + (cell + 1).astype(np.uint64) * _STEP[1]), rows.key[copies])
                    flags = (cell != rows.part[copies]) * _CROSS + salted * _SALTED + mark[copies] * _PROBE
                    line = rows.line[copies]
                    fit = lambda v, c=copies: np.minimum(v[c], 65_535).astype(np.uint16)
                    waiting.append(((key >> np.uint64(32)) % np.uint64(parts), key.astype(np.uint32), place[line].astype(np.int32), rows.words[copies].astype(np.uint32), fit(rows.n), fit(rows.pos), flags.astype(np.uint8), rows.b0[copies], rows.b1[copies], rows.set[copies], ids.take(pa.array(owner[line]))))
                    size += len(key)
                if size > 500_000:
                    yield packed(waiting)
                    waiting, size = [], 0
        if waiting:
            yield packed(waiting)
        del waiting, seen
        common.trim()

    def packed(waiting: list) -> pa.RecordBatch:
        part, *columns = (np.concatenate(c) for c in list(zip(*waiting, strict=True))[:-1])
        order = np.argsort(part, kind="stable")
        at = _starts(part[order])
        columns = [c[order] for c in columns]
        ids = pa.concat_arrays([w[-1] for w in waiting]).take(pa.array(order))
        *columns, sets = columns
        blobs = []
        for s in map(slice, at.tolist(), [*at[1:].tolist(), len(order)]):
            tail = [np.fromiter(map(len, sets[s]), np.int32, s.stop - s.start), *sets[s]] if with_sets else []
            blobs.append(b"".join([np.int64(s.stop - s.start).tobytes(), *(c[s].tobytes() for c in columns), *(t.tobytes() for t in tail)]))
        return pa.RecordBatch.from_arrays([pa.array(part[order][at].astype(np.int32)), pa.array(blobs, pa.binary()), _lists(ids, at, arrow.field(2).type)], schema=arrow)

    return documents.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).mapInArrow(run, schema)


_ROW = tuple((np.dtype(t), np.dtype(t).itemsize) for t in (np.uint32, np.int32, np.uint32, np.uint16, np.uint16, np.uint8, np.uint64, np.uint64))


class _Group:
    """The rows of a part, by key and size. A key's only row is left out, but with `lone` not
    that of a frequent key, whose other rows may lie in other parts."""

    def __init__(self, blobs: list[bytes], ids: pa.Array, lone: bool = False):
        columns, sizes, tokens = [[] for _ in _ROW], [], []
        for blob in blobs:
            m, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
            for held, (kind, size) in zip(columns, _ROW, strict=True):
                held.append(np.frombuffer(blob, kind, m, at))
                at += m * size
            if at < len(blob):
                sizes.append(np.frombuffer(blob, np.int32, m, at))
                tokens.append(np.frombuffer(blob, np.uint32, -1, at + 4 * m))
        key, *rest = map(np.concatenate, columns)
        order = np.argsort(key)
        sorted_ = key[order]
        first = np.r_[True, sorted_[1:] != sorted_[:-1]]
        keep = ~(first & np.r_[first[1:], True])
        if lone:
            keep |= rest[4][order] & _SALTED > 0
        rows = order[keep]
        line, words, n, pos, flags, b0, b1 = (v[rows] for v in rest)
        taken = ids.take(pa.array(rows))
        rank = _ranks(taken)
        place, group = np.empty(len(rows), np.int64), np.cumsum(first[keep])
        if len(rows) and int(rank.max()) - int(rank.min()) < 1 << 40 and int(line.max()) < 1 << 23:
            by = np.argsort((rank - rank.min()).astype(np.int64) << 23 | line)
        else:
            by = np.lexsort((line, rank))
        # lines that repeat an id and a place are one
        place[by] = np.cumsum(np.r_[False, (rank[by][1:] != rank[by][:-1]) | (line[by][1:] != line[by][:-1])])[: len(by)]
        order = np.argsort(group << 43 | n.astype(np.int64) << 27 | place) if len(rows) < 1 << 20 else np.lexsort((place, n, group))
        self.key, self.line, self.place, self.b0, self.b1 = key[rows][order], line[order], place[order], b0[order], b1[order]
        self.n, self.pos = n[order].astype(np.int32), pos[order].astype(np.int32)
        self.cross, self.salted, self.probe = (flags[order] & f > 0 for f in (_CROSS, _SALTED, _PROBE))
        self.words, self.ids, self.order = words[order], taken, order
        if sizes:
            size = np.concatenate(sizes).astype(np.int64)
            self.size, self.begin, self.tokens = size[rows][order], (np.cumsum(size) - size)[rows][order], np.concatenate(tokens)
        # the greatest size that a larger set may have, three times: no common token precedes the key's
        self.most = np.where(self.n == 65_535, 1 << 30, DENOMINATOR * self.n - 7 * self.pos)
        ends = np.r_[_starts(self.key), len(self.key)]
        self.stop = np.repeat(ends[1:], np.diff(ends))

    def take(self, rows: np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(self.order[rows]))

    def passing(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of rows, the smaller set first, those that no filter rules out: (x, y, the
        bits in which their sketches differ, the tokens in which matching sets may differ),
        y the later line. No common token precedes a key's in a pair that must be found there,
        so what follows bounds the overlap. Sizes and places of 65 535 stand for any greater
        ones too, and filter nothing."""
        na, nb = self.n[a], self.n[b]
        large = nb == 65_535
        overlap = (3 * (na + nb) + 6) // 7
        keep = (np.minimum(na - self.pos[a], nb - self.pos[b]) >= overlap) | large
        a, b, slack, large = a[keep], b[keep], (na + nb - 2 * overlap)[keep], large[keep]
        if large.any():
            slack = np.where(large, 1 << 20, slack)
        apart = np.bitwise_count(self.b0[a] ^ self.b0[b]).astype(np.int32) + np.bitwise_count(self.b1[a] ^ self.b1[b])
        keep = apart <= slack
        a, b, apart, slack = a[keep], b[keep], apart[keep], slack[keep]
        keep = ~(self.cross[a] & self.cross[b]) & (self.place[a] != self.place[b])  # rows from other parts meet in one of these
        a, b, apart, slack = a[keep], b[keep], apart[keep], slack[keep]
        swap = self.place[a] > self.place[b]
        return np.where(swap, b, a), np.where(swap, a, b), apart, slack

    def steps(self, limit: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
        """Rows of which the d-th next has the same key and a size that may match, for d = 1, 2 and so on."""
        rows, d = np.arange(len(self.key)), 1
        while limit is None or d <= limit:
            rows = rows[rows + d < self.stop[rows]]
            rows = rows[NUMERATOR * self.n[rows + d] <= self.most[rows]]
            if not len(rows):
                break
            yield rows, d
            d += 1

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(y, x): all pairs of rows of a key, the later one a probe, that the filters let pass, some at a time."""
        for rows, d in self.steps():
            rows = rows[self.probe[rows] | self.probe[rows + d]]
            for part in range(0, len(rows), 1 << 18):
                a = rows[part : part + (1 << 18)]
                x, y, _, _ = self.passing(a, a + d)
                keep = self.probe[y]
                yield y[keep], x[keep]

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows match by the hashes of their tokens: all that do match, and as good as no other."""
        out, total = np.zeros(len(a), bool), np.cumsum(self.size[a] + self.size[b])
        for s in np.split(np.arange(len(a)), np.searchsorted(total, np.arange(_TOKENS, int(total[-1]) if len(a) else 0, _TOKENS))):
            if not len(s):
                continue
            pair, rows = np.r_[s, s], np.r_[a[s], b[s]]
            size = self.size[rows]
            places = np.repeat(self.begin[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            both = np.sort(np.repeat((pair - s[0]).astype(np.uint64), size) << np.uint64(32) | self.tokens[places])
            common_ = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(s))
            out[s] = DENOMINATOR * common_ >= NUMERATOR * (self.size[a[s]] + self.size[b[s]] - common_)
        return out

    def matching(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(y, x): the probes with an earlier row that matches by the hashes of the tokens, the
        first found in a key; what has one is not held against others."""
        done = np.zeros(len(self.key), bool)
        for rows, d in self.steps():
            rows = rows[self.probe[rows] | self.probe[rows + d]]
            for part in range(0, len(rows), 1 << 18):
                a = rows[part : part + (1 << 18)]
                x, y, _, _ = self.passing(a, a + d)
                keep = self.probe[y] & ~done[y]
                x, y = x[keep], y[keep]
                keep = self.alike(x, y)
                done[y[keep]] = True
                yield y[keep], x[keep]

    def nearest(self) -> tuple[np.ndarray, ...]:
        """(y, x, apart, sure, more): later rows with earlier ones, the nearest by their sketches;
        SURE_PARTNERS if the first is all but certain to match, else PARTNERS; `more` if there may be others,
        as there may beyond a sure one. A row is done when it has a sure partner. Rows of
        frequent keys that meet none are given with x = -1, since other parts may have some."""
        done, known = np.zeros((2, len(self.key)), bool)
        held = [[] for _ in range(4)]

        def test(a, b):
            later = np.where(self.place[a] > self.place[b], a, b)
            open_ = ~done[later]
            x, y, apart, slack = self.passing(a[open_], b[open_])
            # equal sequences of words are known already
            same = (apart == 0) & (self.words[x] == self.words[y]) & (self.n[x] == self.n[y])
            done[y[same]] = known[y[same]] = True
            x, y, apart, slack = x[~same], y[~same], apart[~same], slack[~same]
            sure = _SURE[apart] <= slack
            done[y[sure]] = True
            for h, v in zip(held, (y, x, apart, sure), strict=True):
                h.append(v)

        last = np.zeros(0, np.int64)
        for rows, d in self.steps(_NEAR + 1):
            if d > _NEAR:
                last = rows
                break
            test(rows, rows + d)
        # greater groups: what isn't done meets all that is farther than _NEAR in the group
        for s in _starts(self.stop[last]).tolist():
            t = self.stop[last[s]]
            begin = last[s]
            group = np.arange(begin, t)
            for i in group.tolist():
                if done[i] and not (~done[i + _NEAR + 1 : t]).any():
                    continue
                b = np.arange(i + _NEAR + 1, np.searchsorted(self.n[i:t], self.most[i] // NUMERATOR, "right") + i)
                if done[i]:
                    b = b[~done[b] & (self.place[b] > self.place[i])]
                if len(b):
                    test(np.full(len(b), i), b)
        none = np.zeros(0, np.int64)
        y, x, apart, sure = (np.concatenate([none.astype(bool) if i == 3 else none, *h]) for i, h in enumerate(held))
        order = np.lexsort((x, apart, y))
        order = order[~known[y[order]]]
        y, x, apart, sure = y[order], x[order], apart[order], sure[order]
        head = _starts(y)
        n = np.diff(np.r_[head, len(y)])
        nth = np.arange(len(y)) - np.repeat(head, n)
        keep = nth < np.where(sure[np.repeat(head, n)], SURE_PARTNERS, PARTNERS)
        more = np.repeat(n > PARTNERS, n) | self.salted[y] | done[y]
        y, x, apart, sure, more = y[keep], x[keep], apart[keep], sure[keep], more[keep]
        alone = self.salted.copy()
        alone[y] = False
        alone &= ~known
        alone = np.flatnonzero(alone)
        fill = lambda v, w: np.r_[v, np.full(len(alone), w, v.dtype)]
        return np.r_[y, alone], fill(x, -1), fill(apart, 0), fill(sure, False), fill(more, True)


def _joined(rows: DataFrame, parts: int, schema: T.StructType, work, lone: bool = False) -> DataFrame:
    """`work` on the group of each part; a part comes to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, ids = None, [], []
        for batch in batches:
            data, lists = batch.column(1).to_pylist(), batch.column(2)
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != now and blobs:
                    yield from work(_Group(blobs, pa.concat_arrays(ids), lone))
                    blobs, ids = [], []
                now = part
                blobs.append(data[i])
                ids.append(lists[i].values)
        if blobs:
            yield from work(_Group(blobs, pa.concat_arrays(ids), lone))
        del blobs, ids
        common.trim()

    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _pair_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", kind), T.StructField("line", T.IntegerType()), T.StructField("x_id", kind), T.StructField("x_line", T.IntegerType()), T.StructField("yh", T.LongType()), T.StructField("xh", T.LongType()), T.StructField("apart", T.IntegerType()), T.StructField("sure", T.BooleanType()), T.StructField("more", T.BooleanType())])


def _emitter(kind: T.DataType):
    schema = _pair_schema(kind)
    arrow = to_arrow_schema(schema)

    def emit(group: _Group, y, x, apart, sure, more) -> pa.RecordBatch:
        alone = pa.array(x < 0)
        ids, x_ids, x_lines = group.take(y), group.take(x), group.line[x]
        own = lambda a, lines: _line_hash(a, np.arange(len(a)), lines).view(np.int64)
        void = lambda a: pc.if_else(alone, pa.nulls(len(a), a.type), a)
        return pa.RecordBatch.from_arrays(
            [ids.cast(arrow.field(0).type), pa.array(group.line[y]), void(x_ids.cast(arrow.field(2).type)), void(pa.array(x_lines)), pa.array(own(ids, group.line[y])), void(pa.array(own(x_ids, x_lines))), pa.array(apart.astype(np.int32)), pa.array(sure), pa.array(more)],
            schema=arrow,
        )

    return schema, emit


def candidates(rows: DataFrame, parts: int) -> DataFrame:
    """(id, line, partners, more): lines with the earlier ones likeliest to match them, by all keys."""
    schema, emit = _emitter(rows.schema["ids"].dataType.elementType)

    def work(group: _Group):
        y, *rest = group.nearest()
        if len(y):
            yield emit(group, y, *rest)

    found = _joined(rows, parts, schema, work, lone=True)
    one = F.struct((~F.col("sure")).alias("doubt"), "apart", "x_id", "x_line", "xh")
    both = found.groupBy("id", "line", "yh").agg(F.array_sort(F.collect_set(F.when(F.col("x_line").isNotNull(), one))).alias("all"), F.max("more").alias("more"))
    n = F.when(F.get("all", F.lit(0))["doubt"], PARTNERS).otherwise(SURE_PARTNERS)
    return both.select("id", "line", "yh", F.slice("all", F.lit(1), n).alias("partners"), (F.col("more") | (F.size("all") > n)).alias("more"))


def all_candidates(rows: DataFrame, parts: int, every: bool) -> DataFrame:
    """(id, line, yh, x_id, x_line, xh): the probes with every earlier line that the filters let
    pass; or with one a key, of those that match by the hashes of the tokens."""
    schema, emit = _emitter(rows.schema["ids"].dataType.elementType)

    def work(group: _Group):
        for y, x in group.pairs() if every else group.matching():
            if len(y):
                no = np.zeros(len(y), bool)
                yield emit(group, y, x, np.zeros(len(y), np.int32), no, no)

    return _joined(rows, parts, schema, work).select("id", "line", "yh", "x_id", "x_line", "xh").distinct()


def _tokens(line: str) -> frozenset[bytes]:
    return frozenset(line.encode("utf-8", "replace").translate(common._LOWER).split())


def _concerned(documents: DataFrame, hashes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, text) of the lines that have one of `hashes` (h), and of few others; written."""
    held = documents.sparkSession.sparkContext.broadcast(Map(hashes, "h", hashes.count()))  # 16 MB at most
    schema = T.StructType([common.field(documents, id_col, "id"), T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch):
                ids, texts = piece.column(0), common.encoded(piece.column(1))
                data = common.TEXT_END.join(texts) + common.TEXT_END
                whole = np.frombuffer(data, np.uint8)
                stops = np.flatnonzero((whole == 10) | (whole == 255))
                owner = np.searchsorted(np.flatnonzero(whole == 255), stops)
                first = np.searchsorted(owner, np.arange(len(texts)))
                place = np.arange(len(owner)) - first[owner]
                hit = np.flatnonzero(held.value.has(_line_hash(ids, owner, place)))
                begin = np.r_[0, stops + 1]
                lines = [data[a:b] for a, b in zip(begin[hit].tolist(), stops[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[hit])), pa.array(place[hit].astype(np.int32)), pa.array(lines, pa.binary()).cast(pa.string())], schema=arrow)
        common.trim()

    lines = documents.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).mapInArrow(run, schema)
    return common.written(lines, "lines-concerned")


def _matches(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, line) of the later lines of pairs that have a Jaccard of 3/4 or more."""
    earlier = lines.select(F.col("id").alias("x_id"), F.col("line").alias("x_line"), F.col("text").alias("x_text"))
    found = pairs.select("id", "line", "x_id", "x_line").join(earlier, ["x_id", "x_line"]).join(lines, ["id", "line"])
    schema = T.StructType([common.field(found, "id"), T.StructField("line", T.IntegerType())])

    def make():
        def work(columns):
            ids, places, texts, others = columns
            out = [], []
            for key, line, a, b in zip(ids, places, texts, others, strict=True):
                a, b = _tokens(a), _tokens(b)
                both = len(a & b)
                if both and DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both):
                    out[0].append(key)
                    out[1].append(line)
            return out

        return work

    return common.map_arrow(found, ["id", "line", "text", "x_text"], schema, make)


def matched_lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line) of every line that an earlier one matches."""
    rows = documents.select(F.col(id_col), F.col(text_col))
    surveyed = common.written(survey(rows, id_col, text_col), "line-survey")
    equal = common.written(equal_lines(surveyed), "lines-equal")
    head = token_counts(surveyed)
    parts = _parts(rows.sparkSession, head.total // 3)
    found = candidates(prefix_rows(rows, id_col, text_col, head, parts), parts)
    found = common.written(found.join(equal, ["id", "line"], "left_anti"), "line-pairs")
    pairs = found.select("id", "line", F.explode("partners").alias("x")).select("id", "line", "x.x_id", "x.x_line", "x.xh")
    texts = _concerned(rows, found.select(F.col("yh").alias("h")).unionByName(pairs.select(F.col("xh").alias("h"))), id_col, text_col)
    gone = common.written(_matches(pairs, texts).distinct(), "lines-matched")
    open_ = common.written(found.where("more").select("id", "line", "yh").join(gone, ["id", "line"], "left_anti").join(texts, ["id", "line"]), "lines-open")
    out = equal.unionByName(gone)
    n = open_.count()
    if n:
        out = out.unionByName(_second_round(rows, id_col, text_col, head, parts, open_, n))
    return out.distinct()


def _second_round(rows: DataFrame, id_col: str, text_col: str, head: Head, parts: int, open_: DataFrame, n: int, every: bool = False) -> DataFrame:
    """Of lines that no partner of the first round matched, though there may be others: those
    that one of all partners matches. All partners are compared by the hashes of their tokens,
    and one a key goes on to the texts. A line of which none of these holds on the texts, as
    hashes may be equal by chance, meets `every` partner there."""
    held = rows.sparkSession.sparkContext.broadcast(head)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("token", T.LongType())])
    arrow = to_arrow_schema(schema)
    most = GROUP_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch):
                number, h, _, _ = lines_of(common.encoded(piece.column(0)))
                for rows in _prefixes(number, h, held.value, most, lambda lines, words: np.ones(len(lines), bool)):
                    for step in (-1, 0, 1):
                        yield pa.RecordBatch.from_arrays([pa.array(_sized(rows.key, rows.n, step).view(np.int64)), pa.array(rows.token.view(np.int64))], schema=arrow)
        common.trim()

    keys = common.written(open_.select("text").mapInArrow(run, schema), "line-keys")
    m = keys.count()
    maps = Map(keys, "key", m), Map(keys, "token", m), Map(open_, "yh", n)
    rest = common.written(all_candidates(prefix_rows(rows, id_col, text_col, head, parts, *maps, with_sets=not every), parts, every), "line-pairs-rest")
    texts = _concerned(rows, rest.select(F.col("yh").alias("h")).unionByName(rest.select(F.col("xh").alias("h"))), id_col, text_col)
    found = common.written(_matches(rest, texts).distinct(), "lines-matched-rest")
    if every:
        return found
    doubt = common.written(open_.join(rest.select("id", "line").distinct(), ["id", "line"], "left_semi").join(found, ["id", "line"], "left_anti"), "lines-in-doubt")
    m = doubt.count()
    return found.unionByName(_second_round(rows, id_col, text_col, head, parts, doubt, m, True)) if m else found


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every line that matches an earlier one, earlier by id and then by place.

    Lines end at line feeds; tokens are the distinct words between ASCII white space, A-Z
    lower-cased; lines match from a Jaccard of 3/4 on. Lines without tokens stay. The partner
    may itself be removed, so the result doesn't depend on any order of work.

    Returns all columns, the text without removed lines, and __tw_n_lines and __tw_removed
    (their places). Null texts stay null and have one line, without tokens. Rows with a
    null id are given back as they are. Rows that repeat an id are one document: a line is
    known by id and place, so lines of one place aren't held against each other, and what is
    found for a place holds for each of the rows. An empty table gives an empty result.

    A line first meets, for each of its keys, the earlier lines with the nearest sketches, and
    is done when one is all but certain, so that a line with many near copies costs a few
    pairs. Lines that no such partner matches though there may be others meet, in a second
    round, all that the filters let pass."""
    gone = matched_lines(documents, id_col, text_col).groupBy(F.col("id").alias("__tw_key")).agg(F.collect_list("line").alias("__tw_gone"))
    joined = documents.join(gone, documents[id_col] == F.col("__tw_key"), "left").drop("__tw_key")
    schema = T.StructType([*documents.schema.fields, T.StructField("__tw_n_lines", T.LongType()), T.StructField("__tw_removed", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch):
                *columns, held = piece.columns
                texts, counts, removed, changed = common.encoded(columns[at]), [], [], False
                for i, (text, gone) in enumerate(zip(texts, held.to_pylist(), strict=True)):
                    counts.append((text or b"").count(b"\n") + 1)
                    out = sorted({k for k in gone or () if k < counts[-1]})
                    removed.append(out)
                    if out:
                        drop, changed = set(out), True
                        texts[i] = b"\n".join([x for k, x in enumerate(text.split(b"\n")) if k not in drop])
                if changed:
                    columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type)
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, arrow, strict=False)), pa.array(counts, pa.int64()), pa.array(removed, arrow.field(len(arrow) - 1).type)], schema=arrow)
        common.trim()

    return joined.select(*documents.columns, "__tw_gone").mapInArrow(run, schema)


def clean(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """`dedup` as a pipeline stage: the documents' own columns, `count_col` set to the new
    text's code points where lines went. A document of which every line with tokens was
    removed says nothing new and goes; one that was empty before stays."""
    out = dedup(documents, id_col, text_col)
    emptied = (F.size("__tw_removed") > 0) & (F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "") == "")
    out = out.where(~emptied)
    if count_col in out.columns:
        out = out.withColumn(count_col, F.when(F.size("__tw_removed") > 0, F.char_length(text_col)).otherwise(F.col(count_col)).cast(documents.schema[count_col].dataType))
    return out.select(*documents.columns)


def _members(documents: DataFrame, id_col: str, text_col: str, with_line: bool) -> DataFrame:
    """(id, class) of each document's different lines, a class by a 128-bit hash of its words;
    `with_line` (id, class, line) of those of three words or more: fewer match equal ones only."""
    fields = [common.field(documents, id_col, "id"), T.StructField("class", T.BinaryType())]

    def make():
        def work(columns):
            out = [], [], []
            for key, text in zip(*columns, strict=True):
                mine = {}
                for line in text.split("\n"):
                    if (tokens := _tokens(line)) and not (with_line and len(tokens) < 3):
                        mine.setdefault(xxhash.xxh3_128_digest(b" ".join(sorted(tokens))), line)
                out[0].extend([key] * len(mine))
                out[1].extend(mine)
                out[2].extend(mine.values())
            return out if with_line else out[:2]

        return work

    schema = T.StructType([*fields, T.StructField("line", T.StringType())] if with_line else fields)
    return common.map_arrow(documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), [id_col, text_col], schema, make)


def _pairs(classes: DataFrame) -> DataFrame:
    """(y, x): the pairs of classes, by number, that the filters let pass; every one."""
    head = token_counts(common.written(survey(classes, "number", "line"), "class-survey"))
    parts = _parts(classes.sparkSession, head.total // 3)
    schema = T.StructType([T.StructField("y", T.LongType()), T.StructField("x", T.LongType())])
    arrow = to_arrow_schema(schema)

    def work(group: _Group):
        ids = group.ids.to_numpy()[group.order]
        for y, x in group.pairs():
            yield pa.RecordBatch.from_arrays([pa.array(ids[y]), pa.array(ids[x])], schema=arrow)

    return _joined(prefix_rows(classes, "number", "line", head, parts, everything=True), parts, schema, work).distinct()


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(number, n, least): how many links a class has in a cell, and the least class it is
    joined to there. Pairs are dealt to a grid of cells by their two ends, and a cell asks
    for each of its lines once, so that m near copies don't mean m * m lines."""
    side = max(1, math.ceil(math.sqrt(2 * pairs.count() / PAIRS)))
    cell = (F.pmod(F.xxhash64("x"), F.lit(side)) * side + F.pmod(F.xxhash64("y"), F.lit(side))).alias("cell")
    dealt = pairs.select(cell, "y", "x")
    asked = dealt.select("cell", F.col("y").alias("number")).unionByName(dealt.select("cell", F.col("x").alias("number"))).distinct()
    lines = asked.join(classes.select("number", "line"), "number")
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("n", T.LongType()), T.StructField("least", T.LongType())])
    arrow = to_arrow_schema(schema)

    def verify(pairs: pa.Table, lines: pa.Table) -> pa.Table:
        sets = {k: _tokens(line) for k, line in zip(lines["number"].to_pylist(), lines["line"].to_pylist(), strict=True)}
        n, up = Counter(), {}

        def top(k):
            while (over := up.setdefault(k, k)) != k:
                up[k] = up[over]
                k = over
            return k

        for y, x in zip(pairs["y"].to_pylist(), pairs["x"].to_pylist(), strict=True):
            a, b = sets[y], sets[x]
            both = len(a & b)
            if DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both):
                n[y] += 1
                n[x] += 1
                low, high = sorted((top(y), top(x)))
                up[high] = low
        return pa.table([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array([top(k) for k in n], pa.int64())], schema=arrow)

    return dealt.groupBy("cell").cogroup(lines.withColumnRenamed("cell", "of").groupBy("of")).applyInArrow(verify, schema)


def links(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id and n_links of every row.

    Lines of the same words are one class. A link joins two different classes with a Jaccard
    of 3/4 or more, and every link is verified and counted, however many a line has;
    n_links sums, over the document's different lines, the other classes that each is linked
    to, so that a link within a document counts at both ends, and copies count once.
    Documents that share a class, or have linked ones, directly or through others, have the
    same class_id, the least of their ids; one without such lines has its own. Rows that
    repeat an id are one document; a row with a null id has no class and no links."""
    rows = documents.select(F.col(id_col), F.col(text_col))
    members = common.written(_members(rows, id_col, text_col, False), "line-members")
    classes = _members(rows, id_col, text_col, True).groupBy("class").agg(F.min("id").alias("owner"), F.min("line").alias("line"))
    classes = common.written(classes.withColumn("number", F.monotonically_increasing_id()), "line-classes")
    pairs = common.written(_pairs(classes), "link-pairs")
    found = common.written(_verified(pairs, classes), "links")
    owner = classes.select("number", "owner")
    linked = found.where("number != least").select("number", "least").distinct().join(owner.withColumnRenamed("owner", "a"), "number")
    linked = linked.join(owner.select(F.col("number").alias("least"), F.col("owner").alias("b")), "least").select("a", "b")
    shared = members.join(members.groupBy("class").agg(F.min("id").alias("b")), "class").where("id != b").select(F.col("id").alias("a"), "b")
    component = components(shared.unionByName(linked).distinct())
    degree = found.groupBy("number").agg(F.sum("n").alias("n")).join(classes.select("number", "class"), "number").select("class", "n")
    counted = members.join(degree, "class").groupBy("id").agg(F.sum("n").alias("__tw_n"))
    out = rows.select(id_col).join(counted.withColumnRenamed("id", "__tw_id"), F.col(id_col) == F.col("__tw_id"), "left").drop("__tw_id")
    out = out.join(component, F.col(id_col) == F.col("node"), "left")
    return out.select(id_col, F.coalesce("component", id_col).alias("class_id"), F.coalesce("__tw_n", F.lit(0)).cast("long").alias("n_links"))
