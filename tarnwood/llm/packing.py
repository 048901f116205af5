"""Vector best-fit packing of token pieces into training sequences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces that one task packs; bins left open at a block's end are the only loss against one large block.
BLOCK_PIECES = 16_384


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: int, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length.

    Items come longest first. A bin has three residual capacities: tokens, documents and
    attention cost (the sum of squared lengths). Of the open bins that meet every one of
    them, `norm` takes the bin whose weighted residual after placing has the least norm,
    `dot` the one with the greatest weighted dot product of demand and residual; equal
    scores go to the older bin. All open bins are compared; there is no cap on bins."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be norm or dot")
    caps = np.array([capacity, max_docs, max_attention], float)
    if len(lengths) and (lengths.max() > capacity or lengths.max() ** 2 > max_attention or max_docs < 1):
        raise ValueError("a piece is larger than an empty sequence")
    w = np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    left = np.empty((3, 1024))  # residuals of the open bins, oldest first
    names = np.empty(1024, np.int64)
    n = made = 0
    for step, k in enumerate(order):
        t = int(lengths[k])
        need = np.array([t, 1, t * t], float)
        fits = np.flatnonzero((left[0, :n] >= t) & (left[1, :n] >= 1) & (left[2, :n] >= need[2]))
        if len(fits):
            open_ = left[:, fits]
            score = (((open_ - need[:, None]) / caps[:, None]) ** 2 * w[:, None]).sum(0) if rule == "norm" else -((open_ / caps[:, None]) * (need / caps * w)[:, None]).sum(0)
            at = fits[int(np.argmin(score))]
        else:
            if n == left.shape[1]:
                left, names = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([names, np.empty_like(names)])
            at, n = n, n + 1
            left[:, at], names[at], made = caps, made, made + 1
        bins[k], offsets[k] = names[at], capacity - left[0, at]
        left[:, at] -= need
        if step % 256 == 255:  # bins that nothing can enter any more
            keep = np.flatnonzero((left[0, :n] >= least) & (left[1, :n] >= 1) & (left[2, :n] >= least * least))
            left[:, : len(keep)], names[: len(keep)], n = left[:, keep], names[keep], len(keep)
    return bins, offsets


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = 4096, max_docs: int = 4096, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", n_docs: int | None = None) -> DataFrame:
    """Places every piece: the columns of `pieces` that identify it, sequence_id and offset.

    Pieces are dealt by a hash of id, piece and start into blocks of about BLOCK_PIECES
    (`n_docs`, a count of the input, sets their number), and each block is packed alone, so
    no task holds more than a block and lengths are spread alike; a group of equal lengths
    is no hot key. Repeated rows are placed each. An empty table gives an empty result."""
    blocks = max(1, math.ceil((n_docs if n_docs is not None else pieces.count()) / BLOCK_PIECES))
    attention = max_attention or capacity * capacity
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, max_docs, attention, weights, rule)
        out = rows.drop_columns("__tw_block")
        return out.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("__tw_block", F.pmod(F.xxhash64(id_col, "piece", "start", "ids_crc32"), F.lit(blocks)))
    return dealt.groupBy("__tw_block").applyInArrow(place, schema)
