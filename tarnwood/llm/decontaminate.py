"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwood.llm import common

Q = 8
#: Edits allowed for each character of an item.
EDIT_RATE = 0.1
#: Normalised characters of benchmark items that one pass over the documents looks for.
BLOCK_CHARS = 4_000_000
#: Normalised characters of documents looked at together.
WINDOW_CHARS = 500_000
#: Places of q-grams in items that are held at a time, about; bounds memory, never results.
POSTINGS = 1 << 21
_BITS = 20


def normal(text: str | None) -> str:
    """A-Z lower-cased, every run of ASCII white space one space."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(common._LOWER).split()).decode("utf-8")


def codes(text: str) -> np.ndarray:
    """The text's code points."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def folded(text: str) -> bytes:
    """A byte for each code point: itself in ASCII, else one of 127. Different characters may
    meet, so q-grams in common and edits can but be more like; alignment decides on code points."""
    if text.isascii():
        return text.encode()
    code = codes(text)
    return np.where(code < 128, code, 128 + code % 127).astype(np.uint8).tobytes()


def budget(size: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Edits allowed in an item of `size` characters: the rate's, or fewer where so many could
    leave no q-gram whole, so that the lemma misses nothing; items under q characters allow none."""
    return max(0, min(int(rate * size), (size - q) // q))


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for r in range(Q):
        k = (len(data) - r) // Q
        out[r::Q] = data[r : r + k * Q].view("<u8")[: len(out[r::Q])]
    return out


@dataclass
class Index:
    """Where each q-gram stands in a block of items."""

    items: list[str]
    rate: float

    def __post_init__(self):
        self.edits = np.array([budget(len(t), self.rate) for t in self.items] or [0])
        self.need = np.array([len(t) - Q + 1 - Q * e for t, e in zip(self.items, self.edits, strict=False)] or [1])
        found = [(grams(np.frombuffer(folded(t), np.uint8)), i) for i, t in enumerate(self.items) if len(t) >= Q]
        gram = np.concatenate([g for g, _ in found]) if found else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(g), i) for g, i in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g, _ in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.of = np.repeat(np.arange(len(self.keys)), self.count) * max(1, len(self.items)) + self.item  # ascending
        self.seen = np.zeros(1 << _BITS, np.int32)  # a key's number and one; keys that share a slot are looked up
        self.seen[self._slot(self.keys)] = np.arange(1, len(self.keys) + 1)
        self.longest = max(map(len, self.items), default=0)
        self.short = [i for i, t in enumerate(self.items) if 0 < len(t) < Q]

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)

    def search(self, docs: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, edits) of the best place of each item in each document."""
        gap = b"\xff" * (self.longest + int(self.edits.max()) * 4 + Q + 8)  # bands never reach the next document
        starts = np.cumsum([len(gap), *(len(d) + len(gap) for d in docs)])
        data = gap + gap.join(map(folded, docs)) + gap
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in self.short:
            for d, doc in enumerate(docs):
                if (at := doc.find(self.items[i])) >= 0:
                    best[d, i] = (0, at, at + len(self.items[i]))
        g = grams(np.frombuffer(data, np.uint8))
        slot = self.seen.take(self._slot(g).view(np.int64))
        at = np.flatnonzero(slot)
        if len(at) and len(self.keys):
            k, own = slot[at] - 1, g[at]
            other = np.flatnonzero(self.keys[k] != own)
            k[other] = np.minimum(np.searchsorted(self.keys, own[other]), len(self.keys) - 1)
            same = self.keys[k] == own
            at, k = at[same], k[same].astype(np.int64)
            # a q-gram that many items share has many places: so many items at a time that these stay bounded
            ranges = max(1, min(len(self.items), -(-int(self.count[k].sum()) // POSTINGS)))
            edges = np.linspace(0, len(self.items), ranges + 1).astype(np.int64)
            for first, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                self._regions(docs, starts, len(data), at, k, first, stop, best)
        return [(d, i, s, e, k) for (d, i), (k, s, e) in sorted(best.items())]

    def _regions(self, docs: list[str], starts: np.ndarray, size: int, at: np.ndarray, k: np.ndarray, begin: int, stop: int, best: dict) -> None:
        """Fills in `best` for the items from `begin` to `stop`, by the places `at` that hold the keys `k`."""
        if stop - begin == len(self.items):
            head, times = self.first[k], self.count[k]
        else:
            head = np.searchsorted(self.of, k * len(self.items) + begin)
            times = np.searchsorted(self.of, k * len(self.items) + stop) - head
            some = np.flatnonzero(times)
            head, times, at = head[some], times[some], at[some]
        total = int(times.sum())
        if not total:
            return
        post = np.repeat(head - (np.cumsum(times) - times), times) + np.arange(total)
        item = self.item[post]
        doc = np.repeat(np.searchsorted(starts, at, side="right") - 1, times)
        # documents that share too few q-grams with an item at all
        pair, inverse, shared = np.unique(doc * len(self.items) + item, return_inverse=True, return_counts=True)
        able = (shared >= self.need[pair % len(self.items)])[inverse]
        item, place = item[able], np.repeat(at, times)[able] - self.place[post[able]]
        # bands two steps wide, one step apart: the diagonals of a region with at most
        # `edits` edits span no more than a step, so one band holds them all
        step = self.edits[item] + 1
        band = place // step
        wide = np.int64(size + 1)
        key = np.concatenate([item * wide + band, item * wide + np.maximum(band - 1, 0)])
        keys, n = np.unique(key, return_counts=True)
        keys = keys[n >= self.need[keys // wide]]
        for i, b in zip((keys // wide).tolist(), (keys % wide).tolist(), strict=True):
            step = int(self.edits[i]) + 1
            low, high = b * step, (b + 2) * step - 1
            d = int(np.searchsorted(starts, high + len(self.items[i]), side="right")) - 1
            d = max(0, min(d, len(docs) - 1))
            if low > starts[d] + len(docs[d]):
                continue
            held = best.get((d, i))
            if held and held[0] == 0:
                continue
            hit = self._align(docs[d], self.items[i], low - int(starts[d]), high - int(starts[d]), step - 1)
            if hit and (held is None or hit < held):
                best[d, i] = hit

    def _align(self, doc: str, item: str, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
        """Edits, start and end of the item's best alignment that starts on a diagonal of
        the band, if within budget."""
        exact = doc.find(item, max(0, low), max(0, high) + len(item))
        if exact >= 0:
            return 0, exact, exact + len(item)
        # only the part that the band's diagonals reach
        skip = max(0, low - edits)
        doc, low, high = doc[skip : max(0, high + 2 * edits + len(item) + 1)], low - skip, high - skip
        found = banded(doc, item, low - edits, high + edits, edits)
        if found is None:
            return None
        cost, end = found
        # the start: the item backwards from that end
        text, back = doc[:end][::-1], item[::-1]
        again = banded(text, back, 0, 0, edits, fixed=True)
        return cost, skip + end - (again[1] if again else len(item)), skip + end


def banded(doc: str, item: str, low: int, high: int, edits: int, fixed: bool = False) -> tuple[int, int] | None:
    """The least edits of `item` against a part of `doc`, on diagonals low to high, and where
    it ends; None beyond `edits`. `fixed` holds the start at doc's beginning."""
    if fixed:
        low, high = -edits, edits
    m, width = len(item), high - low + 1
    big = edits + 1
    item = codes(item)
    pad = np.full(len(doc) + 2 * (m + width) + abs(low) + 8, 1 << 31, np.uint32)
    shift = m + width + abs(low)
    pad[shift : shift + len(doc)] = codes(doc)
    steps = np.arange(width, dtype=np.int32)
    diagonal = low + steps
    if fixed:
        row = np.where(diagonal >= 0, np.minimum(diagonal, big), big).astype(np.int32)
    else:
        row = np.where((diagonal >= 0) & (diagonal <= len(doc)), 0, big).astype(np.int32)
    here = np.empty(width, np.int32)
    for i in range(1, m + 1):
        text = pad[shift + low + i - 1 : shift + low + i - 1 + width]
        np.add(row, text != item[i - 1], out=here)
        np.minimum(here[:-1], row[1:] + 1, out=here[:-1])  # a character of the item left out
        here -= steps
        np.minimum.accumulate(here, out=here)  # characters of the document left out
        here += steps
        if low + i < 0 or high + i > len(doc):
            here[(diagonal < -i) | (diagonal > len(doc) - i)] = big
        np.minimum(here, big, out=here)
        if (i & 7 == 0 or i == m) and here.min() > edits:
            return None
        row, here = here, row
    at = int(row.argmin())
    return int(row[at]), low + at + m


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items, some BLOCK_CHARS at a time; the driver holds one block."""
    block, size = [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        data = normal(row[1])
        if data:
            block.append((row[0], data))
            size += len(data)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _windows(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first, docs, size = 0, [], 0
    for i, text in enumerate(texts):
        docs.append(normal(text))
        size += len(docs[-1])
        if size >= WINDOW_CHARS:
            yield first, docs
            first, docs, size = i + 1, [], 0
    if docs:
        yield first, docs


def find(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """Every document that holds a benchmark item within its edit budget: id, item, start,
    end (code points of the normalised text) and distance of the best place.

    Texts and items are compared lower-cased with white space folded; of an item of m code points
    floor(rate * m) edits are allowed, or (m - q) // q if that is less. The items are looked
    for block by block, one narrow pass over the documents each, so neither their number nor
    a document's length is limited. Null or empty texts and items match nothing; rows that
    repeat an id are searched each; other columns are not read; empty tables give an empty result."""
    schema = T.StructType([common.field(documents, id_col), common.field(benchmark, item_col), *(T.StructField(n, T.LongType()) for n in ("start", "end", "distance"))])
    out = None
    for block in _blocks(benchmark, item_col, item_text):
        held = documents.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS and an item at most

        def make(held=held):
            index = Index([t for _, t in held.value], rate)
            names = [k for k, _ in held.value]

            def work(columns):
                rows = [(columns[0][first + d], names[i], s, e, k) for first, docs in _windows(columns[1]) for d, i, s, e, k in index.search(docs)]
                return list(zip(*rows, strict=True)) if rows else [[] for _ in schema]

            return work

        part = common.map_arrow(documents, [id_col, text_col], schema, make)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], schema)


def remove(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were; `find`'s rules."""
    names, at, schema = documents.columns, documents.columns.index(text_col), T.StructType(list(documents.schema.fields))
    for block in _blocks(benchmark, item_col, item_text):
        held = documents.sparkSession.sparkContext.broadcast([t for _, t in block])

        def make(held=held):
            index = Index(held.value, rate)

            def work(columns):
                found = {first + d for first, docs in _windows(columns[at]) for d, *_ in index.search(docs)}
                keep = [i for i in range(len(columns[0])) if i not in found]
                return [[c[i] for i in keep] for c in columns]

            return work

        documents = common.map_arrow(documents, names, schema, make)
    return documents


