"""Substring dedup by longest-previous-factor arrays over suffix order.

A byte string of the least length counts as repeated where it also starts elsewhere, in any text. Stretches of text that
share an anchor are gathered in groups of bounded size, one stretch of each kind and a second where there are more.
There the suffixes that start a window are put in suffix order, and from the previous and next smaller positions in that
order comes the length of the longest factor that stands earlier too (and, with positions turned round, later). Copies
behind the first are so found; for results without any copy, the first is removed as well. Hashes only bring together
what is compared, and carry what is found in the stretches of a group to their equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import NAME, compared, keyed, spans
from .text import flat

#: The least length of a repeated string, in bytes, and of the anchors.
WIDTH, ANCHOR = 200, 50
#: Kinds of stretches under one anchor; the stretches of anchors with more are cut around longer anchors.
HOT = 1_000


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (ranked[1:] != ranked[:-1]).astype(np.int64)])) if len(keys) else order
    return out


def suffix_ranks(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` by their first ``width`` (8 or more) bytes, by prefix doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        keys = (keys << np.uint64(8)) | padded[k : k + n]
    rank, reach = _dense(keys), 8
    while 2 * reach <= width:
        behind = np.zeros(n, np.int64)
        behind[: n - reach] = rank[reach:] + 1
        rank, reach = _dense(rank * (n + 2) + behind), 2 * reach
    return _dense(rank[starts] * (n + 2) + rank[starts + width - reach] + 1) if reach < width else _dense(rank[starts])


def has_previous_factor(order: np.ndarray, place: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix is of full length.

    ``order`` lists suffixes in suffix order, ``place`` their positions in the text, and ``agree[k]`` tells whether the
    k-th and the one before it share a prefix of full length. From each entry, pointers lead to the previous and to the
    next smaller position; entries on the way have larger ones, so pointers may follow pointers.
    """
    n = len(order)
    found = np.zeros(n, bool)
    for way, shared in ((order, agree), (order[::-1], np.concatenate([[False], agree[1:][::-1]]))):
        position = place[way]
        ahead, full = np.arange(n) - 1, shared.copy()
        live = np.flatnonzero(full & (ahead >= 0))
        while len(live := live[position[ahead[live]] > position[live]]):
            step = ahead[live]
            joined, further = full[live] & full[step], ahead[step]
            full[live], ahead[live] = joined, further
            live = live[joined & (further >= 0)]
        hit = np.flatnonzero(full & (ahead >= 0))
        hit = hit[position[ahead[hit]] < position[hit]]
        found[way[hit]] = True
    return found


def repeated_windows(data: np.ndarray, starts: np.ndarray, width: int, keep_first: bool, again: np.ndarray | None = None) -> np.ndarray:
    """For each window start: whether its string also starts at an earlier (or, unless the first is kept, later) one.

    ``again`` lists starts whose windows stand once more behind all others; the result goes on with these.
    """
    rank = suffix_ranks(data, starts, width)
    rank = rank if again is None else np.concatenate([rank, rank[again]])
    place = np.arange(len(rank))
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    agree = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    found = has_previous_factor(order, place, agree)
    return found if keep_first else found | has_previous_factor(order, -place, agree)


def _repeats(group: pa.Table, width: int, keep_first: bool) -> pa.Table:
    """The repeated runs in the stretches of a group, and in the second ones of their kinds."""
    group = group.sort_by([(c, "ascending") for c in (*NAME, "first")]).combine_chunks()
    n = group["windows"].to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(group["bytes"].to_pylist()), np.uint8)
    base = np.concatenate([[0], np.cumsum(n + width - 1)[:-1]])
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    more = group["more"].to_numpy(zero_copy_only=False)
    again = np.flatnonzero(more[row])
    hit = np.flatnonzero(repeated_windows(data, base[row] + inner, width, keep_first, again))
    later = np.concatenate([np.zeros(len(row), bool), np.ones(len(again), bool)])
    row, inner = np.concatenate([row, row[again]]), np.concatenate([inner, inner[again]])
    fresh = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(row[hit], prepend=-1) != 0) | np.diff(later[hit], prepend=False))
    lead, length = hit[fresh], np.diff(np.concatenate([fresh, [len(hit)]]))
    own = group.select(["anchor", "kind"]).take(pa.array(row[lead]))
    return pa.table([*own.columns, pa.array(later[lead]), pa.array(inner[lead].astype(np.int32)), pa.array((length + width - 1).astype(np.int32))], ["anchor", "kind", "later", "start", "units"])


def _spans(docs: DataFrame, id_col: str, text_col: str, width: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    texts = keyed(docs, id_col, text_col)
    more = F.count("*") > 1
    runs = compared(texts.drop("id"), False, width, min(ANCHOR, (width + 1) // 2), HOT, more, [*NAME, "first"], more, lambda t: _repeats(t, width, keep_first))
    return texts, spans(runs)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_first: bool = False) -> DataFrame:
    """(key, text, spans) of the texts with repeated strings; spans are (first byte, bytes), disjoint, in order.

    Every string of ``width`` UTF-8 bytes that also starts anywhere else in the table, the same text included, lies in a
    span, and nothing else does; with ``keep_first`` the first copy, in the order of the rows' keys, is left out. Rows
    of one id and one text count as copies of each other. Null texts are empty; an empty table gives no rows.
    """
    texts, found = _spans(docs, id_col, text_col, width, keep_first)
    span = lambda p: F.struct(p["first"].alias("first"), p["units"].alias("bytes"))
    return texts.join(found, NAME).select("key", "text", F.transform("spans", span).alias("spans"))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_first: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_sha256`` (of the bytes that are left, joined). A null or empty text has no bytes; null ids stay null."""
    texts, found = _spans(docs, id_col, text_col, width, keep_first)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs, digest = [], [], [], []
            for row in range(batch.num_rows):
                raw, own = flat(batch.column(1).slice(row, 1))[0].tobytes(), batch.column(2)[row]
                first, units = ((own.values.field(c).to_numpy().astype(np.int64) for c in ("first", "units")) if own.is_valid else (np.zeros(0, np.int64),) * 2)
                edges = [0, *np.stack([first, first + units], 1).ravel().tolist(), len(raw)]
                n.append(len(raw))
                removed.append(int(units.sum()))
                runs.append(len(first))
                digest.append(hashlib.sha256(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, removed, runs)], pa.array(digest, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = texts.join(found.hint("merge"), NAME, "left").select("id", "text", "spans")
    return out.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
