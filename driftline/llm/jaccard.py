"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct 5-word shingles. All sets are ordered alike, rare shingles first. Two sets of
similarity 0.8 or more share at least l shingles of their prefixes of n - ceil(0.8 n) + l; each document picks its own l
by the estimated cost of scanning and of verifying its candidates, and a pair must share as many prefix shingles as the
smaller of its two l before it is verified.

Equal sets are one class from the start, and only links between classes are sought. Every shared prefix shingle first
pairs its documents with its smallest document only (as many pairs as rows). What remains are shingles whose documents
are in different components. Where few documents share one, they are paired directly. Documents of shingles that many
share are never paired with each other: of these, the shingles that many of them hold make a document's common part, and
two documents either share one of their other shingles, which few hold, or all that they share is in their common parts.
Then sizes and common parts decide, so each different common part stands for all of its documents, by its smallest one,
and only different common parts are compared, by the same prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import connected_components, joined_components
from .text import Words, chunks, flat, in_small_batches, lower_ascii, mix, noise

WORDS = 5
#: The threshold as a fraction.
TOP, BOTTOM = 4, 5
#: Cells of the frequency sketch (a table of fixed size) and slices in which it is summed.
CELLS, SLICES = 1 << 20, 64
#: The largest number of shared prefix shingles that a document may ask for.
MOST = 6
#: Bits of a set's parity map, and of that of a set of more than MANY shingles.
BITS, MANY, MORE_BITS = 1 << 10, 1 << 11, 1 << 14
#: Documents of one shared shingle that are paired directly; beyond it their common parts are, in blocks of about BLOCK.
FEW, BLOCK = 24, 128


#: Seed of the second signature.
TWIN = 0x5DEECE66D


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than WORDS words are one shingle."""
    words = Words(lower_ascii(data), offsets)
    at, keys = words.window_hash(WORDS)
    edges = np.searchsorted(at, words.row)
    for k in range(len(offsets) - 1):
        first, last = words.row[k], words.row[k + 1]
        if last - first >= WORDS:
            yield np.unique(keys[edges[k] : edges[k + 1]])
        elif last > first:
            own = words.hashes[first:last]
            yield mix(np.array([(own * noise(len(own), 41)).sum() + np.uint64(len(own))], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _cell(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(44)).astype(np.int64)


def frequency_sketch(texts: DataFrame) -> np.ndarray:
    """How often the shingles of each cell occur in all texts: counted in every task, summed slice by slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i, j in chunks(offsets):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                total += np.bincount(_cell(Words(lower_ascii(own), at).window_hash(WORDS)[1]), minlength=CELLS)
        if total.any():
            parts = [p.astype("<u4").tobytes() for p in np.minimum(total, 2**32 - 1).reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // SLICES, np.int64)
        for part in group["counts"]:
            total += np.frombuffer(part, "<u4")
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    # two levels of sums, so that no task adds more than a part of all tasks' counts
    partial = texts.mapInArrow(count, "slice int, counts binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    halfway = partial.groupBy("slice", "part").applyInPandas(add, "slice int, counts binary")
    total = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for row in halfway.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        total[row["slice"]] = np.frombuffer(row["counts"], "<u4")
    return total.ravel()


def signature(shingles: np.ndarray, seed: int = 0) -> int:
    """64 bits of a set and its size; two of them, by different seeds, and the size tell classes of equal sets apart."""
    own = mix(shingles ^ np.uint64(seed)) if seed else shingles
    return int(mix(np.array([own.sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def prefix_of(shingles: np.ndarray, sketch: np.ndarray, floor: float) -> tuple[int, np.ndarray]:
    """The number of matches asked for and the prefix of that length, rarest shingles first."""
    n = len(shingles)
    needed = (TOP * n + BOTTOM - 1) // BOTTOM
    count = sketch[_cell(shingles)]
    ordered = np.lexsort((shingles, count))[: n - needed + MOST]
    scan = np.cumsum(np.maximum(count[ordered] - floor, 0.0))
    choices = np.arange(1, min(MOST, needed) + 1)
    cost = scan[n - needed + choices - 1] * (1 + n / (64 * choices))  # postings read, and sets of n merged for each candidate
    match = int(choices[np.argmin(cost)])
    return match, shingles[ordered[: n - needed + match]]


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """A bit for each cell of a small hash table: whether an odd number of shingles fall into it. Two maps differ in no
    more bits than the sets differ in shingles."""
    size = BITS if len(shingles) <= MANY else MORE_BITS
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Null and empty texts and texts without words have no shingles and are linked with nothing. Repeated rows are equal
    sets, so one component. A null id keeps its row, with a null component. An id with several texts links by each of
    them, and all its rows are in one component. An empty table gives no rows. Other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = frequency_sketch(plain.select("text"))
    floor = float(np.median(sketch))
    shared = plain.sparkSession.sparkContext.broadcast(sketch)  # of fixed size

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            n, sign, twin, match, prefix, bits = [], [], [], [], [], []
            for i, j in chunks(offsets):
                for own in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    m, p = prefix_of(own, shared.value, floor) if len(own) else (0, own)
                    n.append(len(own))
                    sign.append(signature(own))
                    twin.append(signature(own, TWIN))
                    match.append(m)
                    prefix.append(p.view(np.int64))
                    bits.append(parity_map(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sign, pa.int64()), pa.array(twin, pa.int64()), pa.array(match, pa.int32()), *[pa.array(c, pa.list_(pa.int64())) for c in (prefix, bits)]], ["id", "n", "sign", "twin", "match", "prefix", "bits"])

    table = materialise(plain.mapInArrow(prefixes, f"id {kind}, n long, sign long, twin long, match int, prefix array<long>, bits array<long>"), "prefixes")
    first = table.where("n > 0 and id is not null").groupBy("sign", "twin", "n").agg(F.min("id").alias("first_id"))
    # an id with several texts joins the classes of all of them
    several = table.where("id is not null").select("id", "sign", "n").groupBy("id").agg(F.min("sign").alias("low"), F.max("sign").alias("high")).where("low <> high").select("id")
    several = materialise(table.select("id", "sign", "twin", "n").join(several, "id", "left_semi").distinct(), "several")
    own_links = several.join(first, ["sign", "twin", "n"]).where("id <> first_id").select(F.col("id").alias("a"), F.col("first_id").alias("b"))
    component, links = _links(plain, table, kind)
    component = materialise(joined_components(component, links.unionAll(own_links)), "components")
    classes = first.join(component.select(F.col("node").alias("first_id"), "component"), "first_id", "left")
    empty = several.where("n = 0").join(component, F.col("id") == F.col("node")).select("id", "n", F.col("component").alias("of_id"))
    out = table.select("id", "n", "sign", "twin").join(classes, ["sign", "twin", "n"], "left").join(empty, ["id", "n"], "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component", "first_id", "of_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"))


def _links(plain: DataFrame, table: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Components (node, component) of verified links between documents of different sets, and more links (a, b), enough
    of them to join every component.

    A text is known by its id and the signature of its set, as an id may have several texts.
    """
    postings = table.where("n > 0 and id is not null").select(F.explode("prefix").alias("token"), "id", "sign", "n", "match")
    common = postings.groupBy("token").agg(F.min("sign").alias("low"), F.max("sign").alias("high")).where("low <> high").select("token")
    own = postings.join(common, "token").groupBy("token", "sign", "n", "match").agg(F.min("id").alias("id"))
    own = materialise(own, "postings")  # a row for each class and prefix shingle that another class shares
    tokens = own.groupBy("id", "sign").agg(F.collect_list("token").alias("tokens"), F.first("n").alias("n"), F.first("match").alias("match"))
    tokens = materialise(tokens.join(table.select("id", "sign", "bits").dropDuplicates(["id", "sign"]), ["id", "sign"]), "tokens")
    pivot = own.groupBy("token").agg(F.min(F.struct("id", "sign")).alias("p")).select("token", F.col("p.id").alias("a"), F.col("p.sign").alias("sign_a"))
    star = own.join(pivot, "token").where("id <> a").select("a", "sign_a", F.col("id").alias("b"), F.col("sign").alias("sign_b")).distinct()
    links = materialise(_verified(plain, tokens, star, kind), "links")

    component = connected_components(links)
    placed = own.join(component, own["id"] == component["node"], "left").select("token", "id", "sign", "n", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("pivot")).where("low <> high").drop("low", "high")
    rest = materialise(placed.join(mixed, "token"), "rest")
    few = rest.where(F.col("size") <= FEW)
    left, right = (few.select("token", F.col("id").alias(s), F.col("sign").alias(f"sign_{s}"), F.col("component").alias(f"c{s}")) for s in "ab")
    pair = ["a", "sign_a", "b", "sign_b"]
    pairs = left.join(right, "token").where("a < b and ca <> cb").select(*pair).distinct().join(star, pair, "left_anti")
    more = _verified(plain, tokens, pairs, kind)

    many = materialise(rest.where(F.col("size") > FEW).select("id", "sign", "n", "component").distinct(), "members")
    if many.isEmpty():
        return component, more
    shared = _shared_shingles(plain, many, kind)
    rare = shared.where(F.col("size") <= FEW)
    common = shared.where(F.col("size") > FEW).groupBy("id", "sign", "n", "component")
    common = common.agg(F.count("*").alias("h"), F.bit_xor(F.xxhash64("token")).alias("x"), F.bit_xor(F.xxhash64("token", F.lit(1))).alias("y"))
    common = materialise(many.join(common, ["id", "sign", "n", "component"], "left").na.fill(0, ["h", "x", "y"]), "common")

    left, right = (rare.select("token", F.col("id").alias(s), F.col("sign").alias(f"sign_{s}"), F.col("n").alias(f"n_{s}"), F.col("component").alias(f"c{s}")) for s in "ab")
    close = (F.least("n_a", "n_b") * BOTTOM >= F.greatest("n_a", "n_b") * TOP) & (F.col("ca") != F.col("cb"))
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & close).groupBy(*pair, "n_a", "n_b").agg(F.count("*").alias("rare"))
    for s in "ab":
        pairs = pairs.join(common.select(F.col("id").alias(s), F.col("sign").alias(f"sign_{s}"), F.col("h").alias(f"h_{s}")), [s, f"sign_{s}"])
    pairs = pairs.where(enough(F.col("rare") + F.least("h_a", "h_b"), F.col("n_a") + F.col("n_b"))).select(*pair)
    more = more.unionAll(_verified(plain, tokens, pairs, kind))
    return component, more.unionAll(_common_links(shared, common))


def enough(both: Column, sizes: Column) -> Column:
    """Whether sets that share ``both`` shingles, of ``sizes`` together, are similar enough."""
    return both * (TOP + BOTTOM) >= sizes * TOP


def _shared_shingles(plain: DataFrame, member: DataFrame, kind: str) -> DataFrame:
    """(token, id, sign, n, component, size) of all shingles of the members' whole sets that two or more hold."""
    sets = materialise(_sets(plain, member.select("id", "sign"), kind).join(member, ["id", "sign"]), "sets")
    own = sets.select("id", "sign", "n", "component", F.explode("shingles").alias("token"))
    size = own.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    return materialise(own.join(materialise(size, "sizes"), "token"), "shared")


def _common_links(shared: DataFrame, common: DataFrame) -> DataFrame:
    """Links (a, b) of documents that are similar by their common parts alone, enough of them to join every component.

    Two documents with one common part of h shingles are then similar if their sizes sum up to 9 h / 4 at most, so every
    such pair is also similar to the smallest document of the part, its pivot. Likewise, if documents of two parts are
    similar, both are similar to the pivot of the other part, or to one that the pivots join.
    """
    part = ["h", "x", "y"]
    common = common.where("h > 0")
    pivot = common.groupBy(*part).agg(F.min(F.struct("n", "id", "sign")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high"))
    pivot = materialise(pivot.select(*part, "low", "high", F.col("p.n").alias("n"), F.col("p.id").alias("id"), F.col("p.sign").alias("sign")), "pivots")
    named = pivot.select(*part, F.col("n").alias("pn"), F.col("id").alias("a"), F.col("sign").alias("sign_a"))
    inner = common.join(named, part).where(enough(F.col("h"), F.col("n") + F.col("pn")) & ~((F.col("id") == F.col("a")) & (F.col("sign") == F.col("sign_a"))))
    inner = inner.select("a", F.col("id").alias("b"))

    # different parts: prefixes of the common parts, those shingles first that few parts hold
    able = pivot.where(F.col("h") * BOTTOM >= F.col("n") * TOP)
    held = materialise(shared.where(F.col("size") > FEW).select("token", "id", "sign").join(able, ["id", "sign"]), "held")
    rate = held.groupBy("token").agg(F.count("*").alias("rate"))
    needed = F.ceil(F.col("n") * TOP / BOTTOM).cast("int")
    every = held.join(rate, "token").groupBy("id", "sign", "n", *part, "low", "high").agg(F.sort_array(F.collect_list(F.struct("rate", "token"))).alias("own"))
    every = materialise(every.select("id", "sign", "n", *part, "low", "high", F.col("own.token").alias("own")), "parts")
    prefix = every.select("id", "sign", "n", "low", "high", F.explode(F.slice("own", F.lit(1), F.col("h").cast("int") - needed + 1)).alias("token"))
    mixed = prefix.groupBy("token").agg(F.count("*").alias("rate"), F.min("low").alias("l"), F.max("high").alias("u"), F.min(F.struct("id", "sign")).alias("lead")).where("l <> u and rate > 1")
    met = materialise(prefix.join(mixed.select("token", "rate", "lead"), "token"), "met")
    sides = [met.where(F.col("rate") <= FEW).select("token", F.struct("id", "sign").alias(s), F.col("n").alias(f"n_{s}"), F.col("low").alias(f"l_{s}"), F.col("high").alias(f"u_{s}")) for s in "ab"]
    pairs = sides[0].join(sides[1], "token").where("a < b and not (l_a = u_a and l_b = u_b and l_a = l_b)").select("a", "b", "n_a", "n_b").distinct()
    for s in "ab":
        pairs = pairs.join(every.select(F.struct("id", "sign").alias(s), F.col("own").alias(f"own_{s}")), s)
    pairs = pairs.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("own_a", "own_b")).cast("long").alias("both"))

    # what still meets in many parts: blocks of parts are compared where they meet
    many = met.where(F.col("rate") > FEW)
    flat_of = lambda c: F.concat_ws(":", c["id"].cast("string"), c["sign"].cast("string"))
    group = connected_components(many.select(flat_of(F.struct("id", "sign")).alias("a"), flat_of(F.col("lead")).alias("b")).distinct())
    whole = every.withColumn("node", flat_of(F.struct("id", "sign"))).join(group, "node").withColumnRenamed("component", "group")
    sizes = whole.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    whole = whole.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = materialise(whole.select("group", "id", "sign", "n", "own", "block", "blocks"), "blocks")
    dealt = whole.select("group", "id", "sign", "n", "own", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other")
    kind = common.schema["id"].dataType.simpleString()
    form = f"a struct<id:{kind},sign:long>, b struct<id:{kind},sign:long>, n_a long, n_b long, both long"
    compared = dealt.groupBy("group", "x", "y").applyInArrow(_block_pairs, form)
    pairs = materialise(pairs.unionAll(compared).where(enough(F.col("both"), F.col("n_a") + F.col("n_b"))), "part_pairs")

    across = pairs.select("a.id", "b.id").toDF("a", "b")
    both_ways = pairs.select("a", "b", "n_b", "both").unionAll(pairs.select("b", "a", "n_a", "both").toDF("a", "b", "n_b", "both"))
    room = F.floor(F.col("both") * (TOP + BOTTOM) / TOP) - F.col("n_b")
    best = both_ways.groupBy("a").agg(F.max(F.struct(room.alias("room"), F.col("b.id").alias("id"))).alias("best"))
    best = best.select(F.col("a.id").alias("id"), F.col("a.sign").alias("sign"), F.col("best.room").alias("room"), F.col("best.id").alias("b"))
    outer = common.select("id", "n", *part).join(pivot.join(best, ["id", "sign"]).select(*part, "room", "b"), part).where("n <= room")
    return inner.unionAll(across).unionAll(outer.select(F.col("id").alias("a"), "b"))


def _block_pairs(group: pa.Table) -> pa.Table:
    """How many shingles the parts of one block share with those of another: counted against all of the second block at
    once; only pairs that are similar enough are given."""
    x, y = group["x"][0].as_py(), group["y"][0].as_py()
    block = group["block"].to_numpy()
    first, second = (np.flatnonzero(block == k) for k in (x, y))
    n, own = group["n"].to_numpy(), group["own"].combine_chunks()
    offsets, values = own.offsets.to_numpy(), own.values.to_numpy()
    sets = [values[offsets[k] : offsets[k + 1]] for k in range(group.num_rows)]
    keys = np.concatenate([sets[k] for k in second]) if len(second) else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], np.repeat(np.arange(len(second)), [len(sets[k]) for k in second])[order]
    left, right, shared = [], [], []
    for k in first.tolist():
        low, high = np.searchsorted(keys, sets[k], "left"), np.searchsorted(keys, sets[k], "right")
        length = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(owner[at], minlength=len(second))
        hit = np.flatnonzero((both * (TOP + BOTTOM) >= (n[k] + n[second]) * TOP) & ((second > k) if x == y else True))
        left += [k] * len(hit)
        right += second[hit].tolist()
        shared += both[hit].tolist()
    key = lambda rows: pa.StructArray.from_arrays([group[c].combine_chunks().take(pa.array(rows, pa.int64())) for c in ("id", "sign")], ["id", "sign"])
    return pa.table([key(left), key(right), pa.array(n[left].astype(np.int64)), pa.array(n[right].astype(np.int64)), pa.array(shared, pa.int64())], ["a", "b", "n_a", "n_b", "both"])


def _sets(plain: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """(id, sign, shingles) of the texts that ``wanted`` (id, sign) names, hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                found = list(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                edges = np.cumsum([0, *map(len, found)])
                shingles = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([signature(own) for own in found], pa.int64()), shingles], ["id", "sign", "shingles"])

    texts = plain.join(materialise(wanted.select("id").distinct(), "ids"), "id", "left_semi").mapInArrow(run, f"id {kind}, sign long, shingles array<long>")
    return texts.join(wanted, ["id", "sign"], "left_semi").dropDuplicates(["id", "sign"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sign, text) of rows (id, text)."""
    for batch in batches:
        data, offsets = flat(batch.column(1))
        sign = [signature(own) for i, j in chunks(offsets) for own in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sign, pa.int64()), batch.column(1)], ["id", "sign", "text"])


def linked(a: np.ndarray, b: np.ndarray, both: int) -> bool:
    return BOTTOM * both >= TOP * (len(a) + len(b) - both)


def _verified(plain: DataFrame, tokens: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """Of the pairs (a, sign_a, b, sign_b) of texts, those whose sets are similar enough, as links (a, b) of their ids.

    Sizes, shared prefix shingles and parity maps come first, none of which can leave out a similar pair: sets of
    similarity 0.8 differ in a ninth of their sizes' sum at most. The texts of the rest meet, and their sets are counted.
    """
    one = lambda s, *columns: tokens.select(F.col("id").alias(s), F.col("sign").alias(f"sign_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    met = pairs.join(one("a", "n", "bits", "match"), ["a", "sign_a"]).join(one("b", "n", "bits", "match"), ["b", "sign_b"])
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    alike = (F.size("bits_a") != F.size("bits_b")) | (differ * (TOP + BOTTOM) <= (F.col("n_a") + F.col("n_b")) * (BOTTOM - TOP))
    met = met.where((F.least("n_a", "n_b") * BOTTOM >= F.greatest("n_a", "n_b") * TOP) & alike)
    met = materialise(met.select("a", "sign_a", "b", "sign_b", F.least("match_a", "match_b").alias("match")), "met")
    met = met.join(one("a", "tokens"), ["a", "sign_a"]).join(one("b", "tokens"), ["b", "sign_b"]).where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("match"))
    allowed = materialise(met.select("a", "sign_a", "b", "sign_b"), "pairs")
    wanted = materialise(allowed.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")  # the planner knows its size, and broadcasts it or not
    texts = plain.where("text is not null").join(wanted, "id", "left_semi")
    texts = materialise(texts.mapInArrow(_signed, f"id {kind}, sign long, text string"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                sets = []
                for side in (2, 3):
                    text = batch.column(side)[k].as_py()
                    if text not in kept:
                        if len(kept) >= 64:
                            kept.clear()
                        kept[text] = next(shingle_sets(*flat(batch.column(side).slice(k, 1))))
                    sets.append(kept[text])
                keep.append(linked(*sets, len(np.intersect1d(*sets, assume_unique=True))))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    text = lambda s: texts.select(F.col("id").alias(s), F.col("sign").alias(f"sign_{s}"), F.col("text").alias(f"text_{s}"))
    full = allowed.join(text("b"), ["b", "sign_b"]).join(text("a"), ["a", "sign_a"])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()
