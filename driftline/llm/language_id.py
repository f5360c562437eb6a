"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes, up to three bytes of context, with the counts of its training texts frozen.
A byte costs -log2 of its probability in the longest context that has been seen; where the context has not seen the
byte, an escape is paid (method C: distinct symbols / (count + distinct symbols)) and the next shorter context is asked,
down to 1/256 for any byte. A text's code length is the sum over all of its bytes; the shortest one names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .text import chunks, flat, in_small_batches

#: Bytes of context.
ORDER = 3
#: Training texts of one language at most (those with the smallest hash of id and text): the classifier's documented bound.
TEXTS_PER_LANGUAGE = 400


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE) -> list[tuple[str, int, int]]:
    """(language, gram, count) of the training sample: byte runs of ORDER + 1, as one number, first byte highest.

    The sample holds at most ``per_language`` different whole texts of each language, those with the smallest hashes of
    id and text below a cut; texts are fetched for these hashes only, so that no task gets more.
    """
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(7))
    train = in_small_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(F.col(id_col)))
    train = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), h.alias("h"))
    sizes = materialise(train.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # a row for each language
    # a cut by hash leaves a few times as many hashes as asked for, whatever the table's size; of these the smallest stay
    cut = train.select("lang", "h").join(sizes, "lang").where(F.pmod("h", F.lit(1 << 30)) < 4.0 * per_language / F.col("n") * (1 << 30))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = materialise(cut.select("lang", "h").distinct().withColumn("r", order).where(F.col("r") <= per_language).drop("r"), "sampled")
    sample = train.join(few, ["lang", "h"]).dropDuplicates(["lang", "h"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for k in range(batch.num_rows):
                keys, n = np.unique(_keys(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return sorted((r["lang"], r["gram"], r["n"]) for r in counted.collect())


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it in its text; before the text stand zeros."""
    key = data.astype(np.int64)
    age = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER + 1):
        past = np.zeros(len(data), np.int64)
        past[k:] = data[:-k] if k else data
        past[age < k] = 0
        key += past << (8 * k)
    return key


class PpmTables:
    """Costs in bits of bytes in context, for all languages side by side.

    For each order there is a row for each gram (context and byte) that any language has seen, with the cost in each
    language, escapes to shorter contexts included, and a row for each context with the cost of its escape. What no
    language has seen goes on to the next shorter context. Size follows the grams of the bounded training sample.
    """

    def __init__(self, counts: list[tuple[str, int, int]]) -> None:
        self.languages = sorted({c[0] for c in counts})
        lang = np.searchsorted(np.array(self.languages), np.array([c[0] for c in counts]))
        gram, n = np.array([c[1] for c in counts], np.uint32), np.array([c[2] for c in counts], np.float64)
        #: For each order: grams, their costs, contexts and their escapes, grams and contexts in order.
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for order in range(ORDER + 1):
            tail = gram & np.uint32(256 ** (order + 1) - 1)
            grams, contexts = np.unique(tail), np.unique(tail >> np.uint32(8))
            costs = np.empty((len(grams), len(self.languages)), np.float32)
            escapes = np.zeros((len(contexts), len(self.languages)), np.float32)
            place = np.searchsorted(contexts, grams >> np.uint32(8))
            for k in range(len(self.languages)):
                own, inverse = np.unique(tail[lang == k], return_inverse=True)
                count = np.bincount(inverse, n[lang == k], minlength=len(own))
                seen, row = np.unique(own >> np.uint32(8), return_inverse=True)
                total, kinds = np.bincount(row, count, minlength=len(seen)), np.bincount(row, minlength=len(seen))
                escapes[np.searchsorted(contexts, seen), k] = -np.log2(kinds / (total + kinds))
                if order:
                    shorter, below = self.orders[-1][:2]
                    costs[:, k] = below[np.searchsorted(shorter, grams & np.uint32(256**order - 1)), k]
                else:
                    costs[:, k] = 8.0
                costs[:, k] += escapes[place, k]
                costs[np.searchsorted(grams, own), k] = -np.log2(count / (total + kinds)[row])
            self.orders.append((grams, costs, contexts, escapes))

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        cost = np.zeros((len(data), len(self.languages)), np.float32)
        key, lost = _keys(data, offsets).astype(np.uint32), np.arange(len(data))
        for order in range(ORDER, -1, -1):
            grams, costs, contexts, escapes = self.orders[order]
            own = key[lost] & np.uint32(256 ** (order + 1) - 1)
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            hit = grams[at] == own
            cost[lost[hit]] += costs[at[hit]]
            lost, own = lost[~hit], own[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            hit = contexts[at] == own
            cost[lost[hit]] += escapes[at[hit]]
        cost[lost] += 8.0
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            out[filled] = np.add.reduceat(cost, offsets[:-1][filled], axis=0, dtype=np.float64)
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: list[tuple[str, int, int]], id_col: str = "doc_id", text_col: str = "text", keep: bool = False, names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """One row for each row of ``docs``: its id, ``held_out``, ``lang_pred`` and ``score`` (0 to 1); with ``keep`` all
    columns of ``docs`` come first. Other ``names`` may be given; a column of ``docs`` with one of them gives way.

    ``score`` is the probability of the named language if all learned ones are equally likely before the text is read.
    A null text, one without a letter, or any text where nothing was learned: ``und`` with score 0. Equal code lengths:
    the language first in order. Repeated rows and null ids stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PpmTables(model) if model else None)  # bounded by the training sample
    own = [c for c in docs.columns if c not in names] if keep else [id_col]
    place = len(own) if text_col not in own else own.index(text_col)
    plain = in_small_batches(docs).select(*own, *([F.col(text_col)] if place == len(own) else []), is_held_out(F.col(id_col)).alias(names[0]))
    sent = [k for k in range(len(plain.columns)) if k != place or place < len(own)]
    form = T.StructType([*[plain.schema.fields[k] for k in sent], T.StructField(names[1], T.StringType()), T.StructField(names[2], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            data, offsets = flat(batch.column(place).cast(pa.string()))
            for i, j in chunks(offsets, 1 << 18):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                bits = tables.bits(own, at) if tables else np.zeros((j - i, 1))
                best = bits.argmin(1)
                score = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                latin = np.concatenate([[0], np.cumsum(letter[own])])
                names_, scores = [], []
                for k in range(j - i):
                    known = tables is not None and (latin[at[k + 1]] > latin[at[k]] or has_letter(own[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")))
                    names_.append(tables.languages[best[k]] if known else "und")
                    scores.append(float(score[k]) if known else 0.0)
                out = [*[batch.column(c).slice(i, j - i) for c in sent], pa.array(names_, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, form.names)

    return plain.mapInArrow(run, form)
