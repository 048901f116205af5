"""Exact token ids and counts of whole texts, and overlap resynchronisation for huge ones.

A text is cut only where the tokenizer provably cuts too: before one space or line
feed that stands between two characters that are not white space. No piece of the
pre-tokenisation patterns crosses such a place, so the ids of a text are the ids of
its units in turn; shorter texts are put together from remembered units, and the chunks
of huge ones are spliced at such places."""

from __future__ import annotations

import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnwood.llm import common

#: A stable place: one space or line feed between characters that are no white space.
STABLE = re.compile(r"(?<=\S)(?=[ \n]\S)")
IRREGULAR = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z")


@cache
def load(path: str):
    """The tokenizer of a .json file, once a process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def byte_symbols() -> dict[int, str]:
    """The printable symbol that byte-level vocabularies give to each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _plain(word: str) -> bool:
    """Letters up to U+00FF only: one pre-token that no normalisation but lower-casing changes."""
    if not word.isalpha():
        return False
    return word.isascii() or max(word) <= "\xff"


class WordIds(dict):
    """Little-endian 32-bit ids of words, for vocabularies that drop white space."""

    def __init__(self, path: str):
        self.tokenizer, self.cores = load(path), {}

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,")
        if _plain(core):
            low = core.lower()
            ids = self.cores.get(low)
            if ids is None:
                if len(self.cores) >= common.CACHE_WORDS:
                    self.cores.clear()
                symbols = low.encode().decode("latin-1").translate(byte_symbols())
                ids = self.cores[low] = np.array([t.id for t in self.tokenizer.model.tokenize(symbols)], "<u4").tobytes()
            if len(core) < len(word):
                ids += self[word[len(core) :]]
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= common.CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


class UnitCounts(dict):
    """Token counts of units, for byte-level vocabularies that keep white space."""

    def __init__(self, path: str):
        self.tokenizer = load(path)

    def __missing__(self, unit: str) -> int:
        lead = unit[:1] if unit[:1] in (" ", "\n") else ""
        core = unit[len(lead) :].rstrip(".,")
        if _plain(core):
            symbols = ((lead if lead == " " else "") + core).encode().decode("latin-1").translate(byte_symbols())
            count = len(self.tokenizer.model.tokenize(symbols)) + (lead == "\n")
            if len(lead) + len(core) < len(unit):
                count += self[unit[len(lead) + len(core) :]]
        else:
            count = len(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        if len(self) >= common.CACHE_WORDS:
            self.clear()
        self[unit] = count
        return count

    def regular(self, text: str) -> int:
        """Of a text whose white space is single spaces and line feeds between words."""
        total = -1
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            total += 1 + self[first] + sum(map(self.__getitem__, [" " + w for w in rest]))
        return total

    def chunk(self, text: str) -> int:
        if not text:
            return 0
        if not IRREGULAR.search(text):
            return self.regular(text)
        return sum(map(self.__getitem__, STABLE.split(text)))


class Resync:
    """Counts huge texts by overlapping chunks, each encoded by the library with offsets.

    Two neighbours are spliced at a stable place inside their overlap after which both
    encodings have the same next `agree` tokens, by place and id. The tokenizer cuts there
    whatever stands around, so left of it the left chunk's tokens are the whole text's and
    right of it the right chunk's. Where there is no such place, the right chunk is started
    further to the left, four times the overlap each time, at last at the last splice: then
    it replaces the left chunk, and is made twice as long, so that a text without any stable
    place costs a fixed multiple of its length. The count is exact for any text. A text of
    at most one chunk has nothing to splice and is counted by its units."""

    def __init__(self, path: str, chunk_chars: int = 32_768, overlap: int = 512, agree: int = 3):
        if not 0 < overlap < chunk_chars:
            raise ValueError("overlap must lie between 0 and chunk_chars")
        self.units, self.size, self.overlap, self.agree = UnitCounts(path), chunk_chars, overlap, agree
        self.widened = self.encoded = 0

    def encode(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of a chunk begin in the whole text, and their ids."""
        found = self.units.tokenizer.encode(text[start:end], add_special_tokens=False)
        self.encoded += end - start
        return np.array([a for a, _ in found.offsets], np.int64) + start, np.array(found.ids, np.int64)

    def count(self, text: str | None) -> int:
        text = text or ""
        if len(text) <= self.size:
            return self.units.chunk(text)
        total, begin, end = 0, 0, self.size
        left = self.encode(text, begin, end)
        while end < len(text):
            overlap, upto = self.overlap, min(len(text), end + max(self.size, end - begin))
            while True:
                start = max(begin, end - overlap)
                at, right = self._splice(text, left, start, begin, end, upto)
                if at is not None:
                    break
                overlap, self.widened = overlap * 4, self.widened + 1
            i, j, begin = at
            total += i
            left, end = (right[0][j:], right[1][j:]), upto
        return total + len(left[1])

    def _splice(self, text: str, left, start: int, begin: int, end: int, upto: int):
        """Tokens before the splice in the left and the right chunk, and its place, or None;
        and the right chunk's encoding. Without a stable place nothing is encoded."""
        if start == begin:
            return (0, 0, begin), self.encode(text, start, upto)
        places = [m.start() for m in STABLE.finditer(text, start + 1, end)]
        right = self.encode(text, start, upto) if places else None
        for p in places:
            i, j = int(np.searchsorted(left[0], p)), int(np.searchsorted(right[0], p))
            here, there = ([x[k : k + self.agree] for x in side] for side, k in ((left, i), (right, j)))
            if len(here[0]) == self.agree and all(map(np.array_equal, here, there)):
                return (i, j, p), right
        return None, right


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """Tokens of every whole text: id, n_bytes (UTF-8), n_tokens, over_limit.

    `path` is a byte-level BPE .json file present on every node. A null text counts as
    empty (0 tokens); null ids and repeated rows give a row each; other columns are not
    read; an empty table gives an empty result. One narrow pass, no shuffle: memory per
    worker is a batch of texts and a bounded cache. A text of more than `chunk_chars`
    characters is encoded in overlapping chunks by `Resync`, a shorter one by its units."""
    schema = T.StructType([common.field(df, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def make():
        counter = Resync(path, chunk_chars, overlap)

        def work(columns):
            counts = [counter.count(t) for t in columns[1]]
            return columns[0], [len((t or "").encode()) for t in columns[1]], counts, [n > limit for n in counts]

        return work

    return common.map_arrow(df, [id_col, text_col], schema, make)


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The token ids of every whole text, `end_id` after each, cut into pieces of at most
    `capacity`: id, piece, start, length, ids_crc32 and, with `with_ids`, ids.

    Only texts of more than `capacity` ids are cut. A null text is empty: one piece that
    holds `end_id` alone. Repeated rows are packed each; other columns are not read."""
    fields = [common.field(df, id_col), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def make():
        words = WordIds(path)

        def work(columns):
            out, parts = [[] for _ in range(5)], []
            for key, text in zip(*columns, strict=True):
                ids = words.text(text) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (key, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
                    if with_ids:
                        parts.append(part)
            if with_ids:
                offsets = np.cumsum([0, *out[3]]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
            return out

        return work

    return common.map_arrow(df, [id_col, text_col], schema, make)
