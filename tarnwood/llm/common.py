"""Plumbing that the operators share: Arrow maps, shared tables, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnwood.functions.shared import joined as joined
from tarnwood.functions.shared import shared_dir as shared_dir
from tarnwood.functions.shared import written as written

#: Words held by a worker's cache before it starts over; bounds memory, never results.
CACHE_WORDS = 250_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes that no UTF-8 text has: the end of a text, and what line feeds and other white
#: space are turned into while words are looked for.
TEXT_END, LINE_END, SPACE = b"\xff", b"\xfe", b"\xfd"
_WORDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n\t\x0b\x0c\r ", b"abcdefghijklmnopqrstuvwxyz" + LINE_END + 5 * SPACE)
#: Bytes of text worked on together.
PORTION = 4_000_000
_BLOCK = 1 << 19
_WORD_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of a word that are hashed eight at a time; what follows is hashed apart.
_WORD_BYTES = 64


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """The column's type under another name, nullable."""
    return T.StructField(name or column, df.schema[column].dataType, True)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about PORTION bytes; a single row is never split."""
    rows = max(1, batch.num_rows // max(1, -(-batch.nbytes // PORTION)))
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)


def trim() -> None:
    """Gives freed memory back to the system, so that a reused worker starts small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, columns: list[str], schema: T.StructType, make: Callable[[], Callable[[list[list]], list]]) -> DataFrame:
    """Maps batches of rows: `make()` runs once a task and returns a function from
    the columns' values, as lists, to the result's columns, as lists or arrays.
    Only `columns` are read, so the scan is pruned to them. A batch is worked on some
    PORTION bytes at a time, and a task gives its memory back when it ends."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                for part in slices(batch):
                    yield made(work([column.to_pylist() for column in part.columns]))
        finally:
            del work
            trim()

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=False) if not isinstance(c, pa.Array) else c for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.select(*[df[c] for c in columns]).mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def portions(texts: list, limit: int = PORTION) -> Iterator[tuple[int, list]]:
    """The texts, some `limit` characters at a time, and the number of the first."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def encoded(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column in UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def hashed_words(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z lower-cased, cut at ASCII white space) and
    where each begins, in the texts laid end to end, one byte apart; those bytes, white space
    as SPACE and LINE_END; and the texts' ends. Texts are strings or their bytes."""
    parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts]
    size = sum(map(len, parts)) + len(parts)
    data = TEXT_END.join([*parts, bytes(8)]).translate(_WORDS)
    whole = np.frombuffer(data, np.uint8)[:size]
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < size:
        end = min(size, at + _BLOCK)
        if end < size:  # a block ends with the last white space, or goes on to the next one
            back = max(data.rfind(c, at, end) for c in (SPACE, LINE_END, TEXT_END))
            end = back + 1 if back >= 0 else 1 + min(e for c in (SPACE, LINE_END, TEXT_END) if (e := data.find(c, end)) >= 0)
        ends = at + np.flatnonzero(whole[at:end] >= SPACE[0])
        starts = np.empty_like(ends)
        starts[0], starts[1:] = at, ends[:-1] + 1
        keep = starts < ends
        if not keep.all():
            starts, ends = starts[keep], ends[keep]
        hashes.append(_word_hashes(data, starts, ends))
        places.append(starts)
        at = end
    return np.concatenate(hashes), np.concatenate(places), whole, np.flatnonzero(whole == TEXT_END[0])


def _word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the words from `starts` to `ends`: eight bytes at a time, all words together."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * _FACTORS[0]
        at, rows = 0, np.arange(len(starts))
        while len(rows) and at < _WORD_BYTES:
            whole = len(rows) == len(h)
            left = (size if whole else size[rows]) - at
            now = eight[(starts if whole else starts[rows]) + at] & _WORD_MASK[np.minimum(left, 8)]
            now = ((h if whole else h[rows]) ^ now) * _FACTORS[1]
            h[rows] = now ^ (now >> np.uint64(29))
            at += 8
            rows = rows[left > 8]
        for row in rows.tolist():
            h[row] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[row] + at : ends[row]]))
    return mix(h)


def hash_words(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))
