"""Hierarchical residual packing of token sequences.

Every partition packs its own pieces by best fit, largest first, and its nearly full bins are final at once. Underfull
bins become items; groups of them are packed by best fit in rounds, nearly full bins leave after each round, and the
rest is dealt afresh to fewer groups, up to one group of bounded size. A bin that has less room than the smallest other
bin holds can't take any, and is final too. Only (bin, fill) pairs travel between rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .byte_bpe import crc32, library_encoder, text_batches
from .text import in_small_batches

#: A bin with at most this share of its places free is nearly full.
NEARLY = 1 / 256
#: Pieces that a task packs at once.
LOCAL = 200_000
#: Underfull bins in one group of a round.
GROUP = 4_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: largest first (ties: as they come), each into the fullest
    bin that still takes it."""
    place = np.zeros(len(sizes), np.int64)
    offset = np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has r places free
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, own = capacity, len(fill)
            fill.append(0)
        place[k], offset[k] = own, fill[own]
        fill[own] += size
        left = room - size
        if left:
            free[left].append(own)
            some |= 1 << left
    return place, offset, np.array(fill, np.int64)


def pieces_of(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: only a document longer than ``capacity`` is cut; its first piece takes what is over."""
    if total <= capacity:
        return [(0, total)]
    over = total % capacity
    return ([(0, over)] if over else []) + [(s, capacity) for s in range(over, total, capacity)]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every row of ``docs``, tokenized and closed by ``end_id``, into sequences of at most ``capacity`` tokens.

    Ids are those of ``tokenizers`` for the file, by ``byte_bpe.LibraryEncoder``: byte-level merging depends on the merge
    ranks and the splitting pattern alone, which it hands to ``tiktoken``; it does so only where ids follow the ranks,
    and texts with special strings or long white space go to ``tokenizers`` itself.

    Returns a row for each piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    A null or empty text is one piece of one token. Repeated rows are packed each by itself; null ids stay null. An
    empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    enough = capacity - int(capacity * NEARLY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << 32
        held: list[pa.Array] = []
        rows: list[tuple[int, int, int, int, int]] = []

        def packed() -> pa.RecordBatch:
            nonlocal base
            at, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
            place, offset, fill = best_fit(length, capacity)
            ids = pa.concat_arrays(held).take(pa.array(at))
            out = [ids, *[pa.array(x) for x in (piece.astype(np.int32), start, length, crc, base + place, offset, fill[place])]]
            base += len(fill)
            return pa.RecordBatch.from_arrays(out, ["id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])

        n = 0
        for part in text_batches(batches):
            held.append(part.column(0))
            for k, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                for p, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    rows.append((n + k, p, start, length, crc32(ids[start : start + length])))
            n += part.num_rows
            if len(rows) >= LOCAL:
                yield packed()
                held, rows, n = [], [], 0
        if rows:
            yield packed()

    plain = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    local = materialise(plain.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"), "packed")
    bins = local.where(F.col("fill") < enough).groupBy("bin").agg(F.max("fill").alias("fill"))
    moved = merge_bins(bins, capacity, enough)
    out = local.join(moved, "bin", "left")
    return out.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def merge_bins(bins: DataFrame, capacity: int, enough: int) -> DataFrame:
    """Rounds of best fit over underfull bins (bin, fill): the ``sequence`` of each bin and its ``shift`` within."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], ascending=[False, True])
        place, shift, fill = best_fit(group["fill"].to_numpy(), capacity)
        lead = np.zeros(len(fill), np.int64)
        lead[place[::-1]] = group["bin"].to_numpy()[::-1]  # a merged bin goes by the first bin in it
        return pd.DataFrame({"bin": group["bin"], "sequence": lead[place], "shift": shift, "total": fill[place]})

    current, moved, level = materialise(bins, "bins"), None, 0
    while True:
        n = current.count()
        groups = math.ceil(n / GROUP)
        key = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(max(1, groups))).alias("g")
        done = materialise(current.select("bin", "fill", key).groupBy("g").applyInPandas(fit, "bin long, sequence long, shift long, total long"), "round")
        if moved is None:
            moved = done.select("bin", "sequence", "shift")
        else:
            step = done.select(F.col("bin").alias("sequence"), F.col("sequence").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(step, "sequence", "left").select("bin", F.coalesce("next", "sequence").alias("sequence"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        if groups <= 1:
            return moved
        rest = done.where((F.col("bin") == F.col("sequence")) & (F.col("total") < enough)).select("bin", F.col("total").alias("fill"))
        rest = materialise(rest, "bins")
        # of the bins that stay each can take the smallest, and where that is dealt to it does: every round merges some
        least = rest.agg(F.min("fill")).first()[0]
        if least is None or 2 * least > capacity:  # no two of them fit together
            return moved
        current, level = rest.where(capacity - F.col("fill") >= least), level + 1
