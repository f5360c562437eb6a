"""Near duplicates among vectors by iterative quantisation: balanced binary codes, multi-index Hamming tables, and the
vectors themselves for the last word.

A rotation learned on a bounded sample turns each vector into a code whose bits are balanced over the sample. Tables hold
parts of the codes; two vectors meet where a part of theirs differs in at most two bits, which is where both are when
each is put under its part and under the parts one bit away. Pairs that meet are counted out by the whole codes, once
each, and the rest is compared by the vectors.

Equal vectors are one. A large group of near copies would still be as many pairs as its square, so groups that stand out
in the sample become cores: the vectors within half of the allowed angle of a centre, which are all linked with each
other by the triangle inequality, without a look at their pairs. What lies outside a core is compared with all of it where
its distance from the centre does not decide, in blocks that give counts and no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import connected_components

#: Vectors on which the rotation is fitted and cores are sought (those with the smallest hash), bits of a code at most,
#: and rounds of the fit. Every vector is indexed.
SAMPLE, BITS, ROUNDS = 4_096, 64, 30
#: Share of the pairs at the threshold that the tables should bring together, and that whole codes should let pass; tables
#: at most; and random directions in the fit, beside the sample.
RECALL, WHOLE, MOST_TABLES, FILL = 0.97, 0.995, 24, 256
#: Vectors of the sample near a centre that make a core, cores at most, and vectors of a block.
CORE, CORES, BLOCK = 8, 512, 2_048
#: What rounding may do to an angle.
SLACK = 1e-7


def _unit_rows(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Packed vectors as rows of doubles; shorter ones end in zeros."""
    raw = column.to_pylist()
    width = max((len(r) for r in raw), default=0) // 8 if width is None else width
    out = np.zeros((len(raw), width))
    for k, r in enumerate(raw):
        out[k, : len(r) // 8] = np.frombuffer(r, "<f8")
    return out


def unit_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit) of the rows with an id and a vector that has a direction; a unit vector is packed doubles without
    zeros at its end. Equal rows are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and not v.values.null_count else np.zeros(0)
                if np.isfinite(x).all() and x.any():
                    x = x[: np.flatnonzero(x)[-1] + 1] / np.abs(x).max()
                    ids.append(i)
                    out.append((x / np.sqrt((x**2).sum())).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "unit"])

    plain = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "id long, unit binary").distinct()


class Quantiser:
    """A rotation of the sample's main directions that makes signs lose least, and the medians that balance the bits."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> None:
        bits, rng = min(bits, sample.shape[1]), np.random.default_rng(seed)
        fill = rng.normal(size=(FILL, sample.shape[1]))  # so that a few vectors alone don't make the medians
        sample = np.concatenate([sample, fill / np.sqrt((fill**2).sum(1))[:, None]])
        self.mean = sample.mean(0)
        centred = sample - self.mean
        values, vectors = np.linalg.eigh(centred.T @ centred)
        main = vectors[:, np.argsort(-values, kind="stable")[:bits]]
        seen = centred @ main
        rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(seen @ rotation >= 0, 1.0, -1.0).T @ seen)
            rotation = (left @ right).T
        self.turn = main @ rotation
        self.middle = np.median(centred @ self.turn, axis=0)
        self.bits = bits

    def codes(self, units: np.ndarray) -> np.ndarray:
        """A whole number for each vector: a bit for each direction."""
        on = (units - self.mean) @ self.turn > self.middle
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def tables(quantiser: Quantiser, sample: np.ndarray, count: int, angle: float, seed: int = 7) -> tuple[list[list[int]], int]:
    """The bits of each table, and how many bits two codes may differ in, for pairs up to ``angle``.

    Measured on the sample: each vector and itself turned by ``angle`` in a random direction should meet in the tables
    with the share RECALL, and differ in no more bits with the share WHOLE. Parts widen with the logarithm of the number
    of vectors, so that buckets don't grow; where too many tables would be needed, they are narrower.
    """
    rng = np.random.default_rng(seed)
    aside = rng.normal(size=sample.shape)
    aside -= (aside * sample).sum(1)[:, None] * sample
    aside /= np.maximum(np.sqrt((aside**2).sum(1)), 1e-300)[:, None]
    differ = quantiser.codes(sample) ^ quantiser.codes(math.cos(angle) * sample + math.sin(angle) * aside)
    width = min(quantiser.bits, max(16, math.ceil(math.log2(max(count, 2))) - 1))
    while True:
        out, left, met = [], [], np.zeros(len(sample), bool)
        while met.mean() < RECALL and len(out) < MOST_TABLES:
            if len(left) < width:
                left += [b for b in rng.permutation(quantiser.bits).tolist() if b not in left]
            out.append(sorted(left[:width]))
            left = left[width:]
            met |= np.bitwise_count(differ & np.uint64(sum(1 << b for b in out[-1]))) <= 2
        if met.mean() >= RECALL or width <= 2:
            return out, int(np.quantile(np.bitwise_count(differ), WHOLE, method="higher"))
        width = max(2, width - 2)


def _centres(sample: np.ndarray, reach: float) -> np.ndarray:
    """Directions with CORE or more vectors of the sample within the angle ``reach``, farther than that from each other."""
    least, small = math.cos(reach), sample.astype(np.float32)
    near = np.concatenate([(small[i : i + 512] @ small.T >= least).sum(1) for i in range(0, len(sample), 512)])
    out, open_ = [], near >= CORE
    while open_.any() and len(out) < CORES:
        best = int(np.where(open_, near, 0).argmax())
        mean = sample[sample @ sample[best] >= least].mean(0)
        mean /= max(float(np.sqrt((mean**2).sum())), 1e-300)
        inside = sample @ mean >= least
        if inside.sum() < CORE:
            mean, inside = sample[best], sample @ sample[best] >= least
        out.append(mean)
        open_ &= ~inside & (sample @ sample[best] < least)
    return np.array(out).reshape(len(out), sample.shape[1])


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def near_duplicates(table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of each row: with how many other vectors its cosine is found to be ``least`` or
    more, the smallest id that can be reached by such links, and whether that is its own.

    Vectors that are null, zero or hold a null or non-finite component link with nothing; so do rows with a null id,
    whose component is null and which are kept. Shorter vectors count as if they ended in zeros. Equal rows count as one
    vector (and come out as often as they stand there); different vectors of one id count each, add up in its row and
    link with each other if they are alike. Vectors on one ray are equal. No link is told below ``least``; above, those
    within a core and all of equal vectors are sure, others are found with the tables' recall (RECALL at the threshold
    itself, more above it). An empty table gives no rows.
    """
    spark = table.sparkSession
    kind = table.schema[id_col].dataType.simpleString()
    limit = math.acos(least)
    rows = materialise(unit_vectors(table, id_col, vector_col), "units")
    classes = materialise(rows.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("size")), "classes")
    every = table.select(F.col(id_col).alias("id"))
    none = every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")).withColumnRenamed("id", id_col)
    n = classes.count()
    if not n:
        return none
    width = classes.agg(F.max(F.octet_length("unit"))).first()[0] // 8
    h = F.xxhash64("unit")
    few = classes.where(F.pmod(h, F.lit(1 << 30)) < min(1.0, 4.0 * SAMPLE / n) * (1 << 30)).orderBy(h, "unit").limit(SAMPLE).select("unit").toArrow()
    sample = _unit_rows(few["unit"], width)
    quantiser, centres = Quantiser(sample), _centres(sample, limit / 2)
    shared = spark.sparkContext.broadcast((quantiser, centres))  # a few matrices of fixed size

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, middle = shared.value
        for batch in batches:
            units = _unit_rows(batch.column(0), width)
            code = own.codes(units).view(np.int64)
            core, off = np.full(len(units), -1, np.int32), np.zeros(len(units))
            if len(middle) and len(units):
                angle = _angle(units @ middle.T)
                best = angle.argmin(1)
                off = angle[np.arange(len(units)), best]
                core = np.where(off <= limit / 2 - SLACK, best, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(core), pa.array(off)], ["unit", "id", "size", "code", "core", "off"])

    nodes = classes.mapInArrow(placed, "unit binary, id long, size long, code long, core int, off double")
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links, counts = _core_links(nodes, centres, shared, limit, least, width)
    met = _table_links(nodes.where("core < 0"), *tables(quantiser, sample, n, limit), least, width)
    sizes = nodes.select("node", "size")
    own = met.join(sizes.select(F.col("node").alias("b"), F.col("size").alias("n")), "b").select(F.col("a").alias("node"), "n")
    other = met.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("n")), "a").select(F.col("b").alias("node"), "n")
    counts = own.unionByName(other).unionByName(counts).groupBy("node").agg(F.sum("n").alias("n"))
    linked = materialise(nodes.join(counts, "node", "left").select("node", "unit", "id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "linked")
    # components over ids: classes of one id are one by their id, equal vectors by the class's smallest id
    ids = nodes.select("node", "id")
    found = links.unionByName(met.select("a", "b"))
    for end in "ab":
        found = found.join(ids.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id")), end)
    component = connected_components(materialise(found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(_copies(rows, classes)).where("a <> b"), "links"))
    per_row = rows.join(linked.select("unit", "n_links"), "unit").groupBy("id").agg(F.sum("n_links").alias("n_links"))
    out = every.join(per_row, "id", "left").join(component.select(F.col("node").alias("id"), "component"), "id", "left")
    component_id = F.coalesce("component", F.col("id").cast("long")).cast(kind)
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component_id.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def _copies(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): each id with the smallest one of its equal vectors."""
    first = classes.where("size > 1").select("unit", F.col("id").alias("a"))
    return rows.join(first, "unit").select("a", F.col("id").alias("b"))


def _table_links(nodes: DataFrame, parts: list[list[int]], most: int, least: float, width: int) -> DataFrame:
    """(a, b) of the linked nodes that meet in the tables."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4_096):
                one = batch.slice(start, 4_096)
                code = one.column(1).to_numpy().view(np.uint64)
                for number, part in enumerate(parts):
                    key = np.zeros(len(code), np.int64)
                    for place, bit in enumerate(part):
                        key |= ((code >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
                    flips = np.array([0, *[1 << place for place in range(len(part))]])
                    under = (key[:, None] ^ flips[None, :]).ravel()
                    row = pa.array(np.repeat(np.arange(len(code)), len(flips)))
                    yield pa.RecordBatch.from_arrays([one.column(0).take(row), one.column(1).take(row), pa.array(np.full(len(under), number, np.int32)), pa.array(under)], ["node", "code", "part", "key"])

    rows = materialise(nodes.select("node", "code").mapInArrow(keys, "node long, code long, part int, key long"), "tables")
    a, b = (rows.select(F.col("node").alias(x), F.col("code").alias(f"{x}_code"), "part", "key") for x in "ab")
    differ = F.col("a_code").bitwiseXOR(F.col("b_code"))
    # a pair may meet more than once: in its first table, under the smallest key within one bit of both
    masks = [sum(1 << bit for bit in part) for part in parts]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    apart = [F.bit_count(differ.bitwiseAND(F.lit(m))) for m in masks]
    first = F.coalesce(*[F.when(x <= 2, number) for number, x in enumerate(apart)])
    met = a.join(b, ["part", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= most) & (F.col("part") == first))
    met = materialise(met.select("a", "b").distinct(), "met")
    vector = nodes.select("node", "unit")
    both = met.join(vector.select(F.col("node").alias("a"), F.col("unit").alias("ua")), "a").join(vector.select(F.col("node").alias("b"), F.col("unit").alias("ub")), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4_096):
                one = batch.slice(start, 4_096)
                cosine = (_unit_rows(one.column(2), width) * _unit_rows(one.column(3), width)).sum(1)
                yield one.select(["a", "b"]).filter(pa.array(cosine >= least))

    return materialise(both.select("a", "b", "ua", "ub").mapInArrow(near, "a long, b long"), "met_links")


def _core_links(nodes: DataFrame, centres: np.ndarray, shared, limit: float, least: float, width: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join what cores link, and (node, n): how many vectors a node links with by way of cores."""
    spark = nodes.sparkSession
    links, counts = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, n long")
    inside = nodes.where("core >= 0")
    told = inside.groupBy("core").agg(F.min("node").alias("head"), F.sum("size").alias("total"), F.max("off").alias("reach"), F.count("*").alias("n")).collect() if len(centres) else []
    if not told:  # a row a core, at most CORES
        return links, counts
    cores = {r["core"]: r for r in told}
    head = F.element_at(F.create_map(*[F.lit(x) for c, r in cores.items() for x in (c, r["head"])]), F.col("core"))
    total = F.element_at(F.create_map(*[F.lit(x) for c, r in cores.items() for x in (c, r["total"])]), F.col("core"))
    links = inside.select(head.alias("a"), F.col("node").alias("b"))
    counts = inside.select("node", (total - F.col("size")).alias("n"))
    numbers = sorted(cores)
    reach = np.array([cores[c]["reach"] for c in numbers])

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which nodes may link with a core that isn't theirs, and whether with all of it."""
        middle = shared.value[1][numbers]
        for batch in batches:
            for start in range(0, batch.num_rows, 4_096):
                one = batch.slice(start, 4_096)
                angle = _angle(_unit_rows(one.column("unit"), width) @ middle.T)
                row, col = np.nonzero((angle - reach <= limit + SLACK) & (one.column("core").to_numpy()[:, None] != np.array(numbers)[None, :]))
                sure = angle[row, col] + reach[col] <= limit - SLACK
                own = one.select(["node", "unit", "size", "core"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.array(numbers, np.int32)[col]), pa.array(sure)], ["node", "unit", "size", "from", "core", "sure"])

    near = materialise(nodes.select("unit", "node", "size", "core").mapInArrow(outside, "node long, unit binary, size long, from int, core int, sure boolean"), "near_cores")
    sure = near.where("sure")
    links = links.unionByName(sure.select(head.alias("a"), F.col("node").alias("b")))
    counts = counts.unionByName(sure.select("node", total.alias("n")))
    given = sure.where("from < 0").groupBy("core").agg(F.sum("size").alias("n"))  # nodes in cores count for themselves
    counts = counts.unionByName(inside.select("node", "core").join(F.broadcast(given), "core").select("node", "n"))
    open_ = near.where("not sure")
    if open_.isEmpty():
        return links, counts
    blocks = F.element_at(F.create_map(*[F.lit(x) for c, r in cores.items() for x in (c, math.ceil(r["n"] / BLOCK))]), F.col("core"))
    asked = {r["core"]: math.ceil(r["count"] / BLOCK) for r in open_.groupBy("core").count().collect()}
    parts = F.element_at(F.create_map(*[F.lit(x) for pair in asked.items() for x in pair]), F.col("core"))
    ask = open_.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    held = inside.where(F.col("core").isin(list(asked))).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("core", "block", "part", "node", "unit", "size")

    def meet(ask: pa.Table, held: pa.Table) -> pa.Table:
        on = _unit_rows(ask["unit"], width) @ _unit_rows(held["unit"], width).T >= least
        rest = ask["from"].to_numpy() < 0
        for_asked, for_held = on @ held["size"].to_numpy(), on[rest].T @ ask["size"].to_numpy()[rest]
        some, also = np.flatnonzero(for_asked), np.flatnonzero(for_held)
        node = np.concatenate([ask["node"].to_numpy()[some], held["node"].to_numpy()[also]])
        core = np.concatenate([ask["core"].to_numpy()[some], np.full(len(also), -1)]).astype(np.int32)
        return pa.table([pa.array(node), pa.array(core), pa.array(np.concatenate([for_asked[some], for_held[also]]))], ["node", "core", "n"])

    found = ask.groupBy("core", "block", "part").cogroup(held.groupBy("core", "block", "part")).applyInArrow(meet, "node long, core int, n long")
    found = materialise(found, "core_counts")
    links = links.unionByName(found.where("core >= 0").select(head.alias("a"), F.col("node").alias("b")))
    return links, counts.unionByName(found.select("node", "n"))
