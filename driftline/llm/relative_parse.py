"""Substring dedup by relative Lempel-Ziv parsing.

The reference is all text of documents with smaller ids, held as indexed blocks: the distinct stretches around anchors,
each with the smallest document that has it. Blocks that share an anchor are in one group of bounded size, and in a
group every block is parsed greedily against all blocks of smaller documents: from its first word on, the longest match
in any of them is a factor, found by one binary search in the group's suffix order, and the parse jumps behind it (a word
that matches nowhere is passed over). Factors of the least length become duplicate spans, and places within one are never
looked at. What starts in a factor and ends behind it is looked up at the factor's end: there each place with a match of
the least length is a span too. A document's windows each lie in one of its blocks, so its spans are those of its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .repeats import NAME, compared, keyed, merged, named, spans
from .text import Words, flat

#: The least length of a factor, in words, and of the anchors by which blocks are indexed.
WIDTH, ANCHOR = 50, 25
#: Blocks under one anchor; the blocks of anchors with more are cut around longer anchors.
HOT = 1_000


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class BlockIndex:
    """Suffix order of the words of blocks, where each block has a ``source``, and searches in it.

    Behind each block stands an end mark that equals nothing else, so that no match leaves its block. Ranks by the first
    1, 2, 4, ... words are kept, each from the one before. Over the suffix order the smallest source of each 1, 2, 4, ...
    neighbours is kept, so that the nearest suffix of a smaller source is found by a binary search.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, source: np.ndarray) -> None:
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        n = int((sizes + 1).sum())
        marks = self.start + sizes
        inside = np.ones(n, bool)
        inside[marks] = False
        rank = np.zeros(n, np.int64)
        rank[inside] = _dense(words) + len(sizes)
        rank[marks] = np.arange(len(sizes))
        self.levels = [rank]
        while 1 << (len(self.levels) - 1) <= sizes.max(initial=0):
            reach = 1 << (len(self.levels) - 1)
            behind = np.zeros(n, np.int64)
            behind[: n - reach] = rank[reach:] + 1
            rank = _dense(rank * (n + 2) + behind)
            self.levels.append(rank)
        self.end = np.repeat(marks, sizes + 1)
        self.order = np.argsort(rank)
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        owner = np.repeat(source, sizes + 1).astype(np.int64)
        owner[marks] = np.iinfo(np.int64).max
        self.least = [owner[self.order]]
        while 1 << len(self.least) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` share."""
        same = a == b  # all of them
        out = np.where(same, self.end[a] - a, 0)
        open_ = np.flatnonzero(~same)
        a, b = a[open_].copy(), b[open_].copy()
        for level in range(len(self.levels) - 1, -1, -1):
            on = np.flatnonzero(self.levels[level][a] == self.levels[level][b])
            a[on], b[on], out[open_[on]] = a[on] + (1 << level), b[on] + (1 << level), out[open_[on]] + (1 << level)
        return out

    def longest(self, at: np.ndarray, source: np.ndarray) -> np.ndarray:
        """The length of the longest match of the suffix at each place in any block of a smaller source: that of the
        nearest such suffix before or behind it in suffix order."""
        out, n = np.zeros(len(at), np.int64), len(self.order)
        before, behind = self.rank[at] + 1, self.rank[at].copy()
        for level in range(len(self.least) - 1, -1, -1):
            least, reach = self.least[level], 1 << level
            on = np.flatnonzero(before >= reach)
            on = on[least[before[on] - reach] >= source[on]]
            before[on] -= reach
            on = np.flatnonzero(behind + reach <= n)
            on = on[least[behind[on]] >= source[on]]
            behind[on] += reach
        for has, near in ((before > 0, before - 1), (behind < n, behind)):
            on = np.flatnonzero(has)
            out[on] = np.maximum(out[on], self.shared(at[on], self.order[near[on]]))
        return out


def jump(at: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Where the next factor starts: behind this one, or behind a word that matches nowhere."""
    return at + np.maximum(factor, 1)


def greedy_parse(index: BlockIndex, block: np.ndarray, sizes: np.ndarray, source: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of the duplicate spans of blocks, by a greedy parse of each against those of smaller sources.

    From a block's first word on the longest match is a factor, found by one search at its start, and the parse jumps
    behind it; a word that matches nowhere is passed over. Factors of ``width`` or more are spans, and what lies within
    one needs no look. What starts in a factor and ends behind it is looked up at the factor's end: such a place with a
    match of ``width`` or more is a span too. ``block`` may name a block twice, with another source. All blocks are
    parsed side by side, a factor of each at a time.
    """
    at = np.zeros(len(block), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(row: np.ndarray, place: np.ndarray, length: np.ndarray) -> None:
        long = np.flatnonzero(length >= width)
        found.append((row[long], place[long], place[long] + length[long]))

    live = np.flatnonzero(sizes >= width)
    while len(live):
        factor = index.longest(index.start[block[live]] + at[live], source[live])
        keep(live, at[live], factor)
        behind = at[live] + np.maximum(factor, 1)
        low, high = np.maximum(at[live] + 1, behind - width + 1), np.minimum(behind, sizes[live] - width + 1)
        many = np.maximum(high - low, 0)
        row = np.repeat(live, many)
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        keep(row, place, index.longest(index.start[block[row]] + place, source[row]))
        at[live] = jump(at[live], factor)
        live = live[at[live] + width <= sizes[live]]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _factors(group: pa.Table, width: int) -> pa.Table:
    """The duplicate spans of the blocks of a group, and of the second ones of their kinds."""
    group = group.sort_by([("id", "ascending"), ("anchor", "ascending"), ("kind", "ascending")]).combine_chunks()
    raw = group["bytes"].to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    sizes, more = np.diff(words.row), group["more"].to_numpy(zero_copy_only=False)
    ids = group["id"].to_pylist()
    source = np.cumsum([k > 0 and ids[k] != ids[k - 1] for k in range(len(ids))])
    second = np.flatnonzero(more)  # these stand once more, in documents behind all others
    each = np.concatenate([np.arange(len(sizes)), second])
    last = np.full(len(second), np.iinfo(np.int64).max)
    index = BlockIndex(words.hashes, sizes, source)
    block, first, end = greedy_parse(index, each, sizes[each], np.concatenate([source, last]), width)
    gap = block * (int(sizes.max(initial=0)) + 2)
    first, end = merged(first + gap, end + gap)
    block = first // (int(sizes.max(initial=0)) + 2)
    gap = block * (int(sizes.max(initial=0)) + 2)
    later = block >= len(sizes)
    row = each[block]
    own = group.select(["anchor", "kind"]).take(pa.array(row))
    return pa.table([*own.columns, pa.array(later), pa.array((first - gap).astype(np.int32)), pa.array((end - first).astype(np.int32))], ["anchor", "kind", "later", "start", "units"])


def relative_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, twin, spans) of the documents with duplicate spans; spans are (first word, words), disjoint, in order. What
    ``key`` and ``twin`` are says ``repeats.named``.

    Every window of ``width`` words that also starts in a document with a smaller id lies in a span, and nothing else
    does. Ids must be ordered; rows with a null id take no part. Texts of fewer words have no window. Rows of one id are
    one document: what only they share stays. Other columns aren't read; an empty table gives no rows.
    """
    texts = keyed(docs, id_col, text_col).where("id is not null")
    more = F.min("id") < F.max("id")
    return spans(compared(texts, True, width, min(ANCHOR, (width + 1) // 2), HOT, more, ["id"], more, lambda t: _factors(t, width)))


def factor_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_words``, ``n_removed`` and ``kept_sha256`` (of the kept words joined
    by single spaces). A null or empty text has no words; a row with a null id keeps all its words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digest = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = text.as_buffer().to_pybytes().split()  # at the same six bytes as everywhere here
                n.append(len(words))
                for span in reversed(spans.as_py() or ()):
                    del words[span["first"] : span["first"] + span["units"]]
                removed.append(n[-1] - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    found = relative_factors(docs, id_col, text_col, width)
    out = keyed(docs, id_col, text_col).join(found.hint("merge"), NAME, "left").select("id", "text", "spans")
    return out.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def remove_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with every span's words cut from its texts, with the space behind them; all else stays as it is."""
    free = [c for c in (f"_{k}" for k in range(len(docs.columns) + 3)) if c not in docs.columns]
    names, span_col = free[:2], free[2]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column(place), batch.column(batch.num_columns - 1)
            out = text.to_pylist()
            for row in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                words = Words(*flat(text.slice(row, 1)))
                keep = np.ones(len(words.starts), bool)
                for span in spans[row].as_py():
                    keep[span["first"] : span["first"] + span["units"]] = False
                raw = words.data.tobytes()
                edges = np.concatenate([[0], words.starts[1:], [len(raw)]]) if len(keep) else np.zeros(1, np.int64)
                out[row] = b"".join(raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(keep).tolist()).decode("utf-8")
            columns = batch.columns[: len(docs_columns)]
            columns[place] = pa.array(out, text.type)
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = list(docs.columns)
    found = materialise(relative_factors(docs, id_col, text_col, width), "factors")
    found = found.select(F.col("key").alias(names[0]), F.col("twin").alias(names[1]), F.col("spans").alias(span_col))
    key, twin = named(id_col, text_col)
    both = docs.withColumns({names[0]: key, names[1]: twin}).join(found.hint("merge"), names, "left")
    return both.select(*docs_columns, span_col).mapInArrow(run, docs.schema)
