"""Quality rules: fixed counts of a text, and a classifier trained on labelled rows.

The classifier is a logistic regression on hashed word 1- and 2-grams and character 3- and 4-grams (characters are the
bytes of UTF-8; shares of a text, so that length says nothing), fitted on a bounded sample of labelled texts. Its margins are calibrated to probabilities
on rows that the fit has not seen, and texts are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import Words, chunks, flat, in_small_batches, mix, noise, per_row, segment_hash

#: The bytes that count as symbols, and the base rules (fixed values of the contract).
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Cells of a hashed feature space; word features take one half of it, character features the other.
CELLS = 1 << 16
#: Labelled texts that train and calibrate the classifier at most (those with the smallest hash of id and text).
SAMPLE_TEXTS = 3_000
#: Every so many-th sampled text calibrates instead of training.
CALIBRATION = 4
#: A text is kept at this probability of good quality or more.
THRESHOLD = 0.2
STEPS, RATE, RIDGE = 120, 0.15, 1e-4


def _duplicates(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each item: 0 if its key is the first in its text, 1 if an earlier one is equal; 2 is added if a later one is."""
    tagged = mix(keys ^ noise(int(doc.max()) + 1, 21)[doc]) if len(keys) else keys
    order = np.argsort(tagged, kind="stable")
    same = tagged[order[1:]] == tagged[order[:-1]]
    out = np.zeros(len(keys), np.int8)
    out[order[1:][same]] += 1
    out[order[:-1][same]] += 2
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """The fixed counts of each text."""
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(words.row), "word_chars": per_row(lead & words.inside, offsets), "n_symbols": per_row(SYMBOL[data], offsets)}
    # lines with a word
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets]))
    starts = np.concatenate([[0], cut]) if len(cut) == 0 or cut[0] else cut
    ends = np.concatenate([starts[1:], [len(data)]])
    starts = starts + ((starts < len(data)) & (data[np.minimum(starts, max(len(data) - 1, 0))] == 10)) if len(data) else starts
    row = np.searchsorted(offsets, np.minimum(starts, max(len(data) - 1, 0)), side="right") - 1
    total = np.concatenate([[0], np.cumsum(words.inside)])
    some = (ends > starts) & (total[ends] > total[np.minimum(starts, ends)])
    starts, ends, row = starts[some], ends[some], row[some]
    again = _duplicates(row, segment_hash(data, starts, ends)) % 2 == 1
    out["n_dup_lines"] = np.bincount(row[again], minlength=n)
    # words in windows that come twice or more
    at, keys = words.window_hash(WINDOW)
    hit = at[_duplicates(words.doc[at], keys) > 0]
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(edge)[:-1] > 0], minlength=n) if len(hit) else np.zeros(n, np.int64)
    return out


def _features(data: np.ndarray, offsets: np.ndarray, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of hashed features: (text, cell) of each occurrence. Characters are bytes of the text as it stands."""
    half = np.uint64(CELLS // 2 - 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    yield words.doc, (words.hashes & half).astype(np.int64)
    at, keys = words.window_hash(2)
    yield words.doc[at], (keys & half).astype(np.int64)
    for size, seed in ((3, 31), (4, 32)):
        if len(data) < size:
            continue
        key = np.zeros(len(data) - size + 1, np.uint32)
        for k in range(size):
            key = key * np.uint32(0x01000193) + data[k : len(data) - size + 1 + k]
        key = ((key ^ np.uint32(seed)) * np.uint32(0x9E3779B1)) >> np.uint32(17)
        inside = doc[: len(key)] == doc[size - 1 :]
        yield doc[: len(key)][inside], key[inside].astype(np.int64) % (CELLS // 2) + CELLS // 2


def margins(data: np.ndarray, offsets: np.ndarray, words: Words, weights: np.ndarray) -> np.ndarray:
    """For each text the sum over feature groups of the mean weight."""
    n = len(offsets) - 1
    out = np.zeros(n)
    for doc, cell in _features(data, offsets, words):
        size = np.bincount(doc, minlength=n)
        out += np.bincount(doc, weights=weights[cell], minlength=n) / np.maximum(size, 1)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict | None:
    """Fits the classifier on a bounded sample of labelled texts; None if the labels lack one of the two classes, or if
    the texts to fit on have no features.

    An id whose labels contradict counts as good. An id on many rows counts once for each different text.
    """
    docs = in_small_batches(docs)
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(5))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), h.alias("h"))
    marked = materialise(texts.select("id", "h").join(marks, "id").distinct(), "labelled")  # small rows, without texts
    share = min(1.0, 4.0 * SAMPLE_TEXTS / max(1, marked.count()))
    few = marked.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).orderBy("h", "id").limit(SAMPLE_TEXTS)
    sample = texts.join(materialise(few, "sampled"), ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "text", "y", "h")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for k in range(batch.num_rows):
                own, at = data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]])
                total = np.zeros(CELLS, np.float32)
                for _, cell in _features(own, at, Words(own, at)):
                    total += np.bincount(cell, minlength=CELLS) / max(len(cell), 1)
                cell = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), pa.array([cell.astype("<u2").tobytes()], pa.binary()), pa.array([total[cell].astype("<f4").tobytes()], pa.binary()), batch.column(3).slice(k, 1)], ["id", "y", "cells", "shares", "h"])

    found = sample.mapInArrow(grams, f"id {docs.schema[id_col].dataType.simpleString()}, y int, cells binary, shares binary, h long").drop("id").toArrow()
    found = found.sort_by([("h", "ascending"), ("y", "ascending")])  # at most SAMPLE_TEXTS rows
    y = found["y"].to_numpy().astype(np.float64)
    cells = [np.frombuffer(c.as_buffer(), "<u2") for c in found["cells"]]
    shares = [np.frombuffer(s.as_buffer(), "<f4") for s in found["shares"]]
    held = np.arange(len(y)) % CALIBRATION == 0
    fit = [k for k in range(len(y)) if not held[k] and len(cells[k])]
    if len(np.unique(y)) < 2 or not fit:
        return None
    doc = np.repeat(np.arange(len(fit), dtype=np.int32), [len(cells[k]) for k in fit])
    cell, share, target = np.concatenate([cells[k] for k in fit]), np.concatenate([shares[k] for k in fit]), y[fit]
    # both classes weigh the same
    weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-9), 0.5 / max(1 - target.mean(), 1e-9)) / len(fit)
    blocks = [slice(*np.searchsorted(doc, [k, k + 250])) for k in range(0, len(fit), 250)]  # sums go part by part, to hold few copies
    total = lambda key, weights, size: sum(np.bincount(key[b], weights=weights(b), minlength=size) for b in blocks)
    scale = np.sqrt(total(cell, lambda b: share[b].astype(np.float64) ** 2, CELLS) / len(fit)) + 1e-3
    w, bias = np.zeros(CELLS), 0.0
    m, v, mb, vb = np.zeros(CELLS), np.zeros(CELLS), 0.0, 0.0
    value = (share / scale[cell]).astype(np.float32)
    for step in range(1, STEPS + 1):  # Adam over the whole sample
        z = total(doc, lambda b: w[cell[b]] * value[b], len(fit)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        g, gb = total(cell, lambda b: error[doc[b]] * value[b], CELLS) + RIDGE * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) / np.sqrt(step)
        w -= rate * 0.1 * m / (np.sqrt(v) + 1e-8)
        bias -= rate * 0.1 * mb / (np.sqrt(vb) + 1e-8)
    w = w / scale
    # Platt: probability = 1 / (1 + exp(-(slope * margin + shift))) on held rows, with smoothed targets
    margin = np.array([float(w[cells[k]] @ shares[k]) + bias for k in range(len(y)) if held[k]])
    t = y[held]
    good, bad = t.sum(), (1 - t).sum()
    soft = np.where(t == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    unit = max(float(margin.std()), 1e-9)
    x, a, b = margin / unit, 1.0, 0.0
    for _ in range(200):  # Newton's method, with a weak pull of the slope to 0 and steps of 1 at most
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r = p * (1 - p)
        h = np.array([[(r * x**2).sum() + 0.1, (r * x).sum()], [(r * x).sum(), r.sum() + 0.1]])
        step = np.linalg.solve(h, [((p - soft) * x).sum() + 0.1 * a, (p - soft).sum() + 0.1 * b])
        step /= max(1.0, float(np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    a /= unit
    return {"weights": w.astype(np.float32), "bias": bias, "slope": float(a), "shift": float(b)}


def assess(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, the fixed counts, ``base_failed``, ``quality`` (probability) and ``kept``.

    A null or empty text has no words and fails the base rules. Without a model the base rules decide alone. Repeated
    rows and null ids stay; an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            parts = []
            for i, j in chunks(offsets):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = Words(own, at)
                found = pd.DataFrame(base_counts(own, at, words))
                if shared.value is None:
                    found["quality"] = np.nan
                else:
                    z = shared.value["slope"] * (margins(own, at, words, shared.value["weights"]) + shared.value["bias"]) + shared.value["shift"]
                    found["quality"] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                parts.append(found)
            if parts:
                all_ = pd.concat(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(all_[c].to_numpy(np.int64)) for c in names], pa.array(all_["quality"].to_numpy(), from_pandas=True)], ["id", *names, "quality"])

    plain = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = plain.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in names)}, quality double").withColumnRenamed("id", id_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("quality") >= THRESHOLD, F.lit(True)))
