"""Stretches of text that may stand elsewhere too: the common first and last part of the two substring operators.

Each text is cut into the stretches of its anchored windows. Only anchors met twice can hold repeated windows. Stretches
that are equal under one anchor are of one kind, and one of each kind goes on to be compared, with a mark that tells
whether there are more; so a large group of copies is compared once. Anchors with very many kinds are lengthened: their
stretches are cut into shorter ones around longer anchors, again and again, until few kinds share one; the longest
anchors are whole windows, which have one kind each. All steps are aggregations and equi-joins of small rows by hash;
joins stand on materialised tables, so that Spark can split hot keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, release
from .anchors import Rolling, anchored_windows
from .text import BYTE_NOISE, Words, chunks, flat, in_small_batches, mix

#: What names a text: two independent hashes of its id and of itself.
NAME = ["key", "twin"]
#: Kinds in one group that is compared in a task.
GROUP = 2_500
#: Into how many parts the places of an anchor in its windows are cut when it is lengthened.
PARTS = 4


def named(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The two hashes of a row's id and text; a null text is empty."""
    own = [F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    return F.xxhash64(*own), F.xxhash64(F.lit(1), *own)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, twin, id, text): rows of one id and text have one name; a null text is empty."""
    key, twin = named(id_col, text_col)
    return in_small_batches(docs).select(key.alias("key"), twin.alias("twin"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


class Units:
    """The bytes or words of a run of texts: hashes, the text of each, and the place where each text starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: bool) -> None:
        self.data = data
        self.words = Words(data, offsets) if words else None
        if words:
            self.hashes, self.doc, self.origin = self.words.hashes, self.words.doc, self.words.row
        else:
            self.hashes, self.doc, self.origin = BYTE_NOISE[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), offsets

    def bytes(self, first: np.ndarray, units: np.ndarray) -> list[bytes]:
        """The bytes of runs of units, from the first unit's to the last one's."""
        a, b = (self.words.starts[first], self.words.ends[first + units - 1]) if self.words else (first, first + units)
        raw = self.data.tobytes()
        return [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]


#: Cells of the table that tells which anchors may be crowded; it is of fixed size.
CELLS = 1 << 20


def stretches(texts: DataFrame, words: bool, width: int, size: int, crowded: list[np.ndarray] | None = None) -> DataFrame:
    """(key, twin, id, first, windows, anchor, kind) of each stretch of ``texts`` (key, twin, id, text; the id may lack):
    its first window, how many, and two hashes: of the anchor, and of the whole stretch with the anchor's place in it.

    ``crowded`` gives, level by level, tables of the cells of anchors whose stretches are cut around longer anchors; then
    only those of the last level are told, with the anchor ``before``, for some that weren't crowded too.
    """
    own = [c for c in texts.columns if c != "text"]
    names = [*own, "first", "windows", *(["before"] if crowded else []), "anchor", "kind"]
    form = ", ".join(f"{c} {texts.schema[c].dataType.simpleString() if c in own else 'int' if c in ('first', 'windows') else 'long'}" for c in names)
    levels = texts.sparkSession.sparkContext.broadcast(crowded or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets):
                units = Units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                rolling = Rolling(units.hashes)
                grams = rolling.fixed(size)
                place, first, last = anchored_windows(grams, units.doc, width, size)
                found = place, first, last - first + 1, np.full(len(first), size), grams[place]
                before = found[4]
                for cells in levels.value:
                    hot = np.flatnonzero(cells[(found[4] & np.uint64(CELLS - 1)).astype(np.int64)])
                    found, before = _lengthened(rolling, width, *[x[hot] for x in found])
                place, first, windows, _, anchor = found
                if len(first):
                    doc = units.doc[first]
                    kind = mix(rolling.runs(first, first + windows + width - 1) + (place - first).astype(np.uint64))
                    of = batch.slice(i, j - i).select(own).take(pa.array(doc))
                    hashes = [before, anchor, kind] if crowded else [anchor, kind]
                    yield pa.RecordBatch.from_arrays([*of.columns, *[pa.array(x.astype(np.int32)) for x in (first - units.origin[doc], windows)], *[pa.array(x.view(np.int64)) for x in hashes]], names)

    return texts.mapInArrow(run, form)


def _lengthened(rolling: Rolling, width: int, place: np.ndarray, first: np.ndarray, windows: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Stretches cut into shorter ones around longer anchors, and the anchor that each had before.

    A window holds its anchor behind x of its other units, and all windows with x in one range share the units between
    the furthest left and the nearest right ends: that run is their longer anchor. Like the anchor itself it depends on
    the window alone.
    """
    slack = width - size
    step = -(-(slack + 1) // PARTS)
    out = []
    for part in range(PARTS):
        low = np.maximum(part * step, place - first - windows + 1)
        high = np.minimum(np.minimum(part * step + step - 1, slack), place - first)
        own = np.flatnonzero(low <= high)
        left = part * step[own]
        start, long = place[own] - left, size[own] + left + np.maximum(0, slack[own] - left - step[own] + 1)
        name = mix(rolling.runs(start, start + long) + anchor[own] + np.uint64(part))
        out.append((start, place[own] - high[own], high[own] - low[own] + 1, long, name, anchor[own]))
    *found, before = (np.concatenate(x) for x in zip(*out))
    return tuple(found), before


def _cells(anchors: DataFrame) -> np.ndarray:
    """Which cells hold an anchor: at most CELLS numbers reach the driver."""
    out = np.zeros(CELLS, bool)
    out[anchors.select(F.col("anchor").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")).distinct().toArrow()["cell"].to_numpy()] = True
    return out


def _few_equal(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts`` with two of each row that stands there more often, and with one of each.

    Two say as much as many: what is found in a text counts for all rows of its name. So the work grows with the different
    rows, however often one of them stands there.
    """
    again = materialise(texts.groupBy(*NAME).agg(F.count("*").alias("n")).where("n > 1").select(*NAME), "again")
    if again.isEmpty():
        return texts, texts
    once = texts.join(again, NAME, "left_anti")
    one = materialise(texts.join(again, NAME, "left_semi").dropDuplicates(NAME), "equal_rows")
    return once.unionByName(one).unionByName(one), once.unionByName(one)


def compared(
    texts: DataFrame, words: bool, width: int, size: int, hot: int, shared: Column, order: list[str], more: Column,
    compare: Callable[[pa.Table], pa.Table],
) -> DataFrame:
    """(key, twin, first, units) of the runs of units that ``compare`` finds in each stretch.

    Of each kind the first stretch by ``order`` is compared, in a group with all kinds of its anchor. ``compare`` gets
    (anchor, kind, more, the columns of ``order``, bytes) and gives (anchor, kind, later, first, units): the runs in the
    first stretch of a kind, and in its later ones. ``shared`` (an aggregate over an anchor) tells whether an anchor
    counts, ``more`` (an aggregate over a kind) whether a kind has later stretches.
    """
    texts, each = _few_equal(texts)
    table = materialise(stretches(texts, words, width, size), "stretches")
    place = [*order, *[c for c in (*NAME, "first", "windows") if c not in order]]
    rows, firsts, levels, done = None, None, [], []
    while True:
        met = materialise(table.groupBy("anchor").agg(shared.alias("shared")).where("shared").select("anchor"), "shared")
        own = materialise(table.join(met, "anchor"), "candidates")
        release(table, met)
        kinds = own.groupBy("anchor", "kind").agg(F.min(F.struct(*place)).alias("one"), more.alias("more"))
        kinds = materialise(kinds.select("anchor", "kind", "more", "one.*"), "kinds")
        crowded = materialise(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "crowded")
        done.append(kinds)
        last = crowded.isEmpty()
        if not last:
            levels.append(_cells(crowded))
            longer = stretches(texts, words, width, size, levels).join(crowded.withColumnRenamed("anchor", "before"), "before")
            table = materialise(longer.drop("before"), "stretches")
            own, kinds = (x.join(crowded, "anchor", "left_anti") for x in (own, kinds))
        rows, firsts = (own, kinds) if rows is None else (rows.unionByName(own), firsts.unionByName(kinds))
        if last:
            break

    names = ["anchor", "kind", "more", *place]
    held = firsts.groupBy(*NAME).agg(F.collect_list(F.struct(*[c for c in names if c not in NAME])).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts = batch.column("parts")[row].values
                units = Units(*flat(batch.column("text").slice(row, 1)), words)
                first, windows = (parts.field(c).to_numpy().astype(np.int64) for c in ("first", "windows"))
                who = {c: batch.column(c).slice(row, 1).take(pa.array(np.zeros(len(first), np.int32))) for c in NAME}
                own = [who[c] if c in who else parts.field(c) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(units.bytes(first, windows + width - 1), pa.binary())], [*names, "bytes"])

    form = ", ".join(f"{c} {firsts.schema[c].dataType.simpleString()}" for c in names)
    groups = max(1, math.ceil(firsts.count() / GROUP))
    # texts are shuffled and merged at any size: what they meet grows with them
    texts_of = each.select(*NAME, "text").join(held.hint("merge"), NAME).mapInArrow(cut, f"{form}, bytes binary")
    dealt = texts_of.withColumn("bucket", F.pmod(F.xxhash64("anchor", F.lit(3)), F.lit(groups)))
    found = dealt.groupBy("bucket").applyInArrow(lambda t: compare(t.drop_columns(["bucket"])), "anchor long, kind long, later boolean, start int, units int")
    found = found.join(firsts.select("anchor", "kind", *[F.col(c).alias(f"one_{c}") for c in order]), ["anchor", "kind"])
    found = materialise(found, "found")
    release(*done)
    is_first = F.lit(True)
    for c in order:
        is_first = is_first & (F.col(c) == F.col(f"one_{c}"))
    hit = rows.join(found, ["anchor", "kind"]).where(F.col("later") != is_first)
    return hit.select(*NAME, (F.col("first") + F.col("start")).alias("first"), "units")


def spans(runs: DataFrame) -> DataFrame:
    """(key, twin, spans) of ``runs`` (key, twin, first, units): for each text the union of its runs as (first, units),
    disjoint, not touching, in order."""
    w = Window.partitionBy(*NAME).orderBy("first")
    reach = F.max(F.col("first") + F.col("units")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("fresh", F.when(reach >= F.col("first"), 0).otherwise(1))
    run = fresh.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    union = run.groupBy(*NAME, "run").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("units")).alias("end"))
    span = F.struct("first", (F.col("end") - F.col("first")).cast("int").alias("units"))
    return union.groupBy(*NAME).agg(F.sort_array(F.collect_list(span)).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint intervals that don't touch, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[fresh], reach[np.concatenate([fresh[1:], [True]])]
