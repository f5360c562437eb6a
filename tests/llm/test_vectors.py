"""Near duplicates among vectors, importance resampling and centroids, against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from driftline.llm import dual_lloyd, hamming, importance

from .conftest import pairs

VECTORS = "vec_id long, embedding array<double>, label int, id long, node string, core int, code long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "clash", 3, 4) for i, v in rows], VECTORS).repartition(3)


def brute_links(rows, least=0.9):
    """What ``near_duplicates`` promises, with every link found."""
    seen = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    units = np.zeros((len(seen), max([len(v) for _, v in seen], default=1)))
    for k, (_, v) in enumerate(seen):
        whole = np.array(v) / np.abs(v).max()
        units[k, : len(v)] = whole / np.linalg.norm(whole)
    on = units @ units.T >= least
    for k in range(len(seen)):
        on[k, k] = False
    links, root = Counter(), {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, _) in enumerate(seen):
        links[i] += int(on[k].sum())
        for j in np.flatnonzero(on[k]):
            a, b = find(i), find(seen[j][0])
            root[max(a, b)] = min(a, b)
    return sorted([(i, links[i], find(i) if i is not None else None, i is None or find(i) == i) for i, _ in rows], key=repr)


def turned(rng, v, angle):
    aside = rng.normal(size=len(v))
    aside -= (aside @ v) * v / (v @ v)
    return math.cos(angle) * v / np.linalg.norm(v) + math.sin(angle) * aside / np.linalg.norm(aside)


def test_near_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (10, [0.05, 1.0]), (11, [0.1, 1.0]), (12, [-1.0, 0.0]), (13, [1e300, 0.0]), (14, [1e-300, 1e-300])]
    assert pairs(hamming.near_duplicates(table(spark, rows)), "vec_id", "n_links", "component_id", "kept") == brute_links(rows)
    assert hamming.near_duplicates(table(spark, rows).where("false")).count() == 0
    assert pairs(hamming.near_duplicates(table(spark, [(1, None), (None, [0.0])])), "vec_id", "n_links", "component_id", "kept") == [(1, 0, 1, True), (None, 0, None, True)]


def test_near_vectors_with_large_groups(spark):
    """Exact copies, a tight group, a loose one around which others lie, and pairs."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=32).tolist()) for k in range(300)]
    tight, loose = rng.normal(size=32), rng.normal(size=32)
    rows += [(1000 + k, tight.tolist()) for k in range(150)]
    rows += [(2000 + k, turned(rng, tight, rng.uniform(0.02, 0.15)).tolist()) for k in range(150)]
    rows += [(3000 + k, turned(rng, loose, rng.uniform(0.1, 0.5)).tolist()) for k in range(150)]
    rows += [(4000 + k, turned(rng, np.array(rows[k][1]), 0.2).tolist()) for k in range(100)]
    want, got = brute_links(rows), pairs(hamming.near_duplicates(table(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want))
    assert [g for g in got if g[0] < 3000] == [w for w in want if w[0] < 3000]


@pytest.mark.parametrize("cone", [0.0, 1.5])
def test_recall_at_the_threshold(spark, cone):
    """Pairs just above the threshold, in a space without and with a common direction."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 48))
    base[:, 0] += cone * math.sqrt(48)
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(1000 + k, turned(rng, v, math.acos(0.905)).tolist()) for k, v in enumerate(base)]
    want, got = brute_links(rows), pairs(hamming.near_duplicates(table(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want) > 0


def test_codes_are_balanced(spark):
    sample = np.random.default_rng(1).normal(size=(2000, 64))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    found = hamming.Quantiser(sample)
    bits = (found.codes(sample)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert abs(bits.mean(0) - 0.5).max() < 0.06
    assert np.allclose(found.turn.T @ found.turn, np.eye(64))


def test_combined_crcs():
    texts = ["a bb", "zürich straße 東京 x" * 3, "w" * 700 + " Q7 " + "v" * 64 + " " + "u" * 65, "", "one-two_three\x00four"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = importance.Features(np.frombuffer(b"".join(raw), np.uint8), offsets, 3)
    want = Counter()
    for doc, text in enumerate(texts):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
        want.update((doc, zlib.crc32(" ".join(words[k : k + n]).encode())) for n in (1, 2, 3) for k in range(len(words) - n + 1))
        assert found.words[doc] == len(words)
    assert Counter(zip(found.doc.tolist(), found.crc.tolist())) == want


def brute_resample(docs, target, percent, longest, least, buckets=10_000):
    def hashed(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    own = [(i, *hashed(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in hashed(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in s}
    out = []
    for i, words, f in own:
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, words])
    may = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = n
    return sorted([tuple(r[:5]) for r in out], key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, odd, longest):
    target = spark.createDataFrame([("Naïve café " * 30, 1), (None, 2), ("", 3), ("same line other", 4)], "text string, weight int")
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = importance.importance_resample(odd, target, percent=30, longest=longest, least_words=10)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_resample(docs, [r["text"] for r in target.collect()], 30, longest, 10)
    assert pairs(got, *got.columns) == want
    assert sum(r[4] is not None for r in want) > 5


def test_resampling_empty(spark, odd, empty):
    assert importance.importance_resample(empty, odd.select("text")).count() == 0
    assert importance.importance_resample(odd, empty.select("text")).where("rank = 1").count() == 1


def brute_clusters(rows, k, rounds, dims, scale=1024.0):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    points = np.array([v for _, v in kept], dtype=object).reshape(-1, dims)

    def nearest():
        far = np.array([[((p - np.array(c, object)) ** 2).sum() for c in centroids] for p in points], dtype=object)
        return [min(range(len(centroids)), key=lambda c: (row[c], c)) for row in far], far

    for _ in range(rounds):
        label, _ = nearest()
        for c in range(len(centroids)):
            own = points[[j for j, x in enumerate(label) if x == c]]
            if len(own):
                centroids[c] = [int(x) // len(own) for x in own.sum(0)]
    label, far = nearest()
    inertia = Counter()
    for j, c in enumerate(label):
        inertia[c] += far[j][c]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, far[j][c], inertia[c], sum(inertia.values()), names[c]) for j, ((i, _), c) in enumerate(zip(kept, label))], key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_clusters(spark, rounds):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(5, 6)) * 3
    rows = [(k, (middle[k % 5] + rng.normal(size=6) * (0.01 if k % 5 < 3 else 1.0)).tolist()) for k in range(1300)]
    rows += [(5000 + k, [0.5, -0.25, 0.0, 1.0, 1.0, 1.0]) for k in range(40)] + [(7, rows[7][1])]
    rows += [(-1, None), (-2, []), (-3, [1.0] * 5), (-4, [1.0] * 7), (-5, [None] * 6), (-6, [float("nan")] * 6), (-7, [float("inf")] * 6), (None, [1.0] * 6)]
    got = dual_lloyd.centroid_clusters(table(spark, rows), k=8, rounds=rounds, dims=6)
    assert pairs(got, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == brute_clusters(rows, 8, rounds, 6)


def test_clusters_few_equal_and_large(spark):
    for rows in ([(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(30)], [(k, [float(k % 3), 0.0]) for k in range(40)]):
        got = dual_lloyd.centroid_clusters(table(spark, rows), dims=2)
        assert pairs(got, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == brute_clusters(rows, 8, 10, 2)
    assert dual_lloyd.centroid_clusters(table(spark, [(1, None), (2, [1.0])]), dims=2).count() == 0
    largest = dual_lloyd.centroid_clusters(table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])]), k=1, rounds=0, dims=2)
    assert {r["distance"] for r in largest.collect()} <= {0, 1 << 54, 1 << 56}


def test_whole_nodes_are_assigned_without_comparing(spark):
    """Far groups around the centroids: the trees leave few pairs of points and centroids to compare."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-5000, 5000, (8, 16))
    points = np.concatenate([m + rng.integers(-20, 20, (64, 16)) for m in middle])
    block = dual_lloyd.Block.build(np.arange(len(points)), points)
    block = dual_lloyd.Block.unpacked(block.packed(), 16)
    found = dual_lloyd.DualAssignment(block, middle, True)
    far = ((block.points[:, None] - middle[None]) ** 2).sum(2)
    assert (found.label == far.argmin(1)).all() and (found.distance == far.min(1)).all()
    assert (found.totals == [block.points[found.label == c].sum(0) for c in range(8)]).all()
    assert found.compared < len(points)
