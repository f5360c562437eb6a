"""Target-distribution importance resampling over hashed n-grams, whose CRCs are combined and never recomputed.

Each word's CRC-32 is taken once. A CRC is linear over GF(2): the CRC of two strings joined is that of the first, moved on
by the second's length, xor that of the second. Moving on by a length is a 32 x 32 matrix over GF(2); its powers for 1,
2, 4, ... bytes give it for every length. So an n-gram's CRC comes from its words' CRCs and lengths, and no n-gram is
ever written out.

Two passes over the texts: one counts features in a table of fixed size, one weighs the documents. The draw sorts
(score, id) over all tasks and counts ranks from the sizes of the sorted parts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import chunks, flat, lower_ascii

#: Buckets of the hashed features, words that a document needs to be drawn, and the salt of the draw.
BUCKETS, LEAST_WORDS, SALT = 10_000, 20, "2024"
#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Words of more bytes are hashed one by one.
LONG = 64
#: Bytes of words: digits, small letters, and all of characters beyond ASCII. Capitals are lowered before.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _byte_steps() -> np.ndarray:
    """What a register becomes from each low byte when it moves on by a byte of zeros."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
    return step


STEPS = _byte_steps()


class Shift:
    """Moving CRCs on by any number of bytes: for each power of two a matrix, kept as four tables of 256 sums of its
    columns."""

    def __init__(self) -> None:
        low = np.arange(256, dtype=np.uint32)
        one = [x << np.uint32(8 * k) for k, x in enumerate([low] * 4)]
        self.powers = [[STEPS[x & 255] ^ (x >> 8) for x in one]]

    def _apply(self, power: int, crc: np.ndarray) -> np.ndarray:
        while power >= len(self.powers):
            last = len(self.powers) - 1
            self.powers.append([self._apply(last, t) for t in self.powers[last]])
        t = self.powers[power]
        return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]

    def __call__(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``crc`` moved on by ``size`` bytes."""
        out, power = crc.astype(np.uint32), 0
        while (size >> power).any():
            move = np.flatnonzero((size >> power) & 1)
            out[move] = self._apply(power, out[move])
            power += 1
        return out


SHIFT = Shift()
SPACE = np.uint32(zlib.crc32(b" "))


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC of two strings joined, from their CRCs and the second's ``size`` in bytes."""
    return SHIFT(first, size) ^ second


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start:end]``, byte place by byte place over all words at once."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG]
    at, reach = starts[order], np.bincount(size[order], minlength=LONG + 1)
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = len(order) - np.cumsum(reach)  # words longer than 0, 1, 2, ... bytes
    for place in range(LONG):
        n = live[place]
        if not n:
            break
        now = register[:n]
        register[:n] = STEPS[(now ^ data[at[:n] + place]) & 255] ^ (now >> 8)
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


class Features:
    """The n-gram CRCs of a run of texts, with the text of each; ``words`` counts the words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, longest: int) -> None:
        data = lower_ascii(data)
        inside = WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        row = np.searchsorted(starts, offsets)
        self.words = np.diff(row)
        doc = np.repeat(np.arange(len(offsets) - 1), self.words)
        word, size = word_crcs(data, starts, ends), ends - starts
        crcs, docs = [word], [doc]
        gram, room = word, len(word)
        for n in range(2, longest + 1):
            room = max(0, room - 1)
            gram = joined(joined(gram[:room], np.full(room, SPACE), np.ones(room, np.int64)), word[n - 1 :][:room], size[n - 1 :][:room])
            own = np.flatnonzero(doc[:room] == doc[n - 1 :][:room])
            crcs.append(gram[own])
            docs.append(doc[own])
        self.crc, self.doc = np.concatenate(crcs), np.concatenate(docs)

    def buckets(self, count: int) -> np.ndarray:
        return (self.crc % np.uint32(count)).astype(np.int64)


def _text(df: DataFrame, text_col: str) -> F.Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket. A task sends a row for each bucket that it has met, the driver
    gets one for each bucket: their number is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i, j in chunks(offsets):
                own = Features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], longest)
                total += np.bincount(own.buckets(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    counted = texts.select(_text(texts, text_col).alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, both smoothed by one a bucket."""
    n, (s, t) = len(source), (source.tolist(), target.tolist())
    all_s, all_t = float(sum(s) + n), float(sum(t) + n)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of each row: the sum of gains over its text's features."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                found = Features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], longest)
                n = np.bincount(found.doc, minlength=j - i)
                weight = np.zeros(j - i, np.int64)
                np.add.at(weight, found.doc, own[found.buckets(len(own))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(x.astype(np.int64)) for x in (found.words, n, weight)]], ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), _text(docs, text_col).alias("t")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[F.Column], name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 in ``order`` over all tasks: sorted parts, and how many rows stand in the parts
    before (one number a part)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    place = materialise(place, "ranked")
    part = F.shiftright("_place", 33)
    before, start = [], 0
    for p, n in sorted(tuple(r) for r in place.groupBy(part.alias("p")).count().collect()):
        before.append((p, start))
        start += n
    offsets = spark.createDataFrame(before, "_part long, _before long")
    found = place.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_place")


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    salt: str = SALT, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of ``docs``: how much its n-grams of up to ``longest`` words are
    those of ``target``'s texts, that weight with Gumbel noise from the id, and its place among the drawn (null if it is
    not drawn).

    Of the N rows with an id and at least ``least_words`` words the floor(percent * N / 100) highest scores are drawn,
    ties to the smaller id. A null or empty text has no words: no feature, weight 0. A row with a null id has a weight,
    but neither score nor rank. Equal rows are rows of their own, with equal scores. An empty table gives no rows, and an
    empty target the weights against even buckets. Other columns aren't read.
    """
    source = bucket_counts(docs, text_col, longest, buckets)
    gain = gains(source, bucket_counts(target, target_text_col, longest, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weigh(docs, gain, id_col, text_col, longest).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    may = F.col("id").isNotNull() & (F.col("n_words") >= least_words)
    drawn = math.floor(percent * scored.where(may).count() / 100)
    told = ["id", "n_features", "weight", "score"]
    best = ranked(scored.where(may).select(*told), [F.desc("score"), F.asc("id")])
    best = best.select(*told, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    rest = scored.where(~may).select(*told, F.lit(None).cast("long").alias("rank"))
    return best.unionByName(rest).withColumnRenamed("id", id_col)
