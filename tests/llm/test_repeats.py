"""Both substring operators and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from driftline.llm import jaccard, relative_parse, repeats, suffix_dedup
from driftline.llm.anchors import Rolling, anchored_windows
from driftline.llm.components import connected_components, joined_components
from driftline.llm.jaccard import similarity_components
from driftline.llm.relative_parse import BlockIndex, factor_digests, greedy_parse, remove_factors
from driftline.llm.repeats import merged
from driftline.llm.suffix_dedup import repeat_digests, repeated_windows, suffix_ranks

from pyspark.sql import functions as F

from .conftest import pairs


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_each_window_has_an_anchor_inside():
    rng = np.random.default_rng(3)
    units = rng.integers(0, 4, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat([0, 1, 2], [30, 300, 170])
    anchor, first, last = anchored_windows(Rolling(units).fixed(10), doc, 40, 10)
    inside = [t for a, f, e in zip(anchor, first, last) for t in range(f, e + 1) if a >= t and a + 10 <= t + 40]
    assert inside == [t for t in range(461) if doc[t] == doc[t + 39]]


def test_suffix_order_and_previous_factors():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1100], data[2500:2600] = data[100:200], data[100:200]
    starts = np.arange(0, 2900)
    rank = suffix_ranks(data, starts, 20)
    strings = [data[s : s + 20].tobytes() for s in starts]
    assert [strings[k] for k in np.argsort(rank, kind="stable")] == sorted(strings)
    seen, earlier = set(), []
    for s in strings:
        earlier.append(s in seen)
        seen.add(s)
    count = Counter(strings)
    assert repeated_windows(data, starts, 20, True).tolist() == earlier
    assert repeated_windows(data, starts, 20, False).tolist() == [count[s] > 1 for s in strings]


def brute_repeats(rows, width=200):
    count = Counter(t[a : a + width] for _, t in rows for a in range(len(t) - width + 1))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - width + 1):
            if count[t[a : a + width]] > 1:
                gone[a : a + width] = b"\1" * width
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeated_bytes_go(odd, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(i, (t or "").encode()) for i, t in odd.select("doc_id", "text").collect()]
    assert pairs(repeat_digests(odd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def test_the_first_copy_can_stay(odd):
    rows = [(t or "").encode() for (t,) in odd.select("text").collect()]
    distinct = {t[a : a + 200] for t in rows for a in range(len(t) - 199)}
    spans = suffix_dedup.repeated_spans(odd, keep_first=True).collect()
    total = Counter(t[a : a + 200] for t in rows for a in range(len(t) - 199))
    assert all(r.spans for r in spans) and len(distinct) < sum(total.values())
    gone = {r.key: {a for s in r.spans for a in range(s.first, s.first + s.bytes - 199)} for r in spans}
    # windows that are marked and those that aren't: each distinct one is left exactly once among distinct rows
    from driftline.llm.repeats import keyed

    left = Counter()
    for r in keyed(odd, "doc_id", "text").select("key", "text").distinct().collect():
        raw = r.text.encode()
        left.update(raw[a : a + 200] for a in range(len(raw) - 199) if a not in gone.get(r.key, ()))
    assert set(left.values()) <= {1} or max(left.values()) == 1


def brute_factors(rows, width=50):
    least = {}
    for i, t in rows:
        if i is not None:
            w = words_of(t)
            for a in range(len(w) - width + 1):
                key = tuple(w[a : a + width])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        w = words_of(t)
        keep = [True] * len(w)
        for a in range(len(w) - width + 1 if i is not None else 0):
            if least[tuple(w[a : a + width])] < i:
                keep[a : a + width] = [False] * width
        out.append((i, w, keep))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_words_of_smaller_documents_go(odd, monkeypatch, hot):
    monkeypatch.setattr("driftline.llm.relative_parse.HOT", hot)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want = [(i, len(w), len(w) - sum(keep), hashlib.sha256(" ".join(x for x, k in zip(w, keep) if k).encode()).hexdigest()) for i, w, keep in brute_factors(rows)]
    assert pairs(factor_digests(odd), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_cut_texts_keep_what_is_left(odd):
    out = remove_factors(odd)
    assert out.columns == odd.columns and out.where("_key = 3").count() == odd.count()
    want = sorted(((i, [x for x, k in zip(w, keep) if k]) for i, w, keep in brute_factors([tuple(r) for r in odd.select("doc_id", "text").collect()])), key=repr)
    assert sorted(((i, words_of(t)) for i, t in out.select("doc_id", "text").collect()), key=repr) == want


def brute_match(blocks, source, k, p):
    best = 0
    for j, other in enumerate(blocks):
        if source[j] < source[k]:
            for q in range(len(other)):
                n = 0
                while p + n < len(blocks[k]) and q + n < len(other) and blocks[k][p + n] == other[q + n]:
                    n += 1
                best = max(best, n)
    return best


def random_blocks():
    """Blocks of few words, some made of pieces of others, in the order of their sources."""
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, 3, rng.integers(1, 40)).tolist() for _ in range(40)]
    for k in range(8, 40, 3):
        a, b = blocks[k - 5], blocks[k - 8]
        blocks[k] = [7] * (k % 3) + a[len(a) // 3 :] + b[: 2 * len(b) // 3] + [k + 10]
    return blocks, np.sort(rng.integers(0, 15, 40)), np.array([len(b) for b in blocks])


def test_searches_find_the_longest_match_in_smaller_documents():
    blocks, source, sizes = random_blocks()
    index = BlockIndex(np.concatenate(blocks).astype(np.uint64), sizes, source)
    row = np.repeat(np.arange(40), sizes)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = index.longest(index.start[row] + inner, source[row])
    assert found.tolist() == [brute_match(blocks, source, k, p) for k in range(40) for p in range(sizes[k])]
    # the second copy of a block stands behind all others and so matches the first one in full
    assert index.longest(index.start[row] + inner, np.full(len(row), 99)).tolist() == (sizes[row] - inner).tolist()


def spans_of(width, parse):
    blocks, source, sizes = random_blocks()
    index = BlockIndex(np.concatenate(blocks).astype(np.uint64), sizes, source)
    got = {(b, a) for b, first, end in zip(*parse(index, np.arange(40), sizes, source, width)) for a in range(first, end)}
    match = {(k, p): brute_match(blocks, source, k, p) for k in range(40) for p in range(sizes[k])}
    return got, {(k, a) for (k, p), n in match.items() if n >= width for a in range(p, p + n)}


@pytest.mark.parametrize("width", [3, 5, 9])
def test_greedy_parse_finds_all_duplicate_windows(width):
    got, want = spans_of(width, greedy_parse)
    assert got == want and len(want) > 20
    assert [x.tolist() for x in merged(np.array([5, 0, 20]), np.array([9, 6, 25]))] == [[0, 20], [9, 25]]


def test_the_parse_looks_only_at_factors_and_their_ends(monkeypatch):
    """In a block that is one factor the search is asked once; a jump that goes a word too far loses spans."""
    blocks = [list(range(100)), list(range(100, 200)), [*range(100), *range(100, 200)], list(range(20, 90))]
    sizes, source = np.array([len(b) for b in blocks]), np.arange(4)
    index = BlockIndex(np.concatenate(blocks).astype(np.uint64), sizes, source)
    asked, search = [], index.longest
    index.longest = lambda at, s: asked.append(len(at)) or search(at, s)
    row, first, end = greedy_parse(index, np.array([3]), sizes[[3]], source[[3]], 50)
    # no place within the factor but those whose windows would end behind it, and there is nothing behind it
    assert (row.tolist(), first.tolist(), end.tolist()) == ([0], [0], [70]) and sum(asked) == 1
    row, first, end = greedy_parse(index, np.array([2]), sizes[[2]], source[[2]], 50)
    assert sorted(zip(first.tolist(), end.tolist())) == [(0, 100), (100, 200)]

    monkeypatch.setattr(relative_parse, "jump", lambda at, factor: at + np.maximum(factor, 1) + 1)
    row, first, end = greedy_parse(index, np.array([2]), sizes[[2]], source[[2]], 50)
    assert sorted(zip(first.tolist(), end.tolist())) == [(0, 100), (101, 200)]


def test_a_broken_parse_shows_in_the_result(spark, monkeypatch):
    """A parse that never jumps on loses what begins behind words that match nowhere."""
    words = [f"w{k}" for k in range(140)]
    table = spark.createDataFrame([(1, " ".join(words)), (3, " ".join(["a", "b", "c", *words]))], "doc_id long, text string")
    removed = lambda: factor_digests(table).where("doc_id = 3").first().n_removed
    assert removed() == 140
    real = relative_parse._factors

    def broken(group, width):
        from driftline.llm import relative_parse as own

        kept, own.jump = own.jump, lambda at, factor: at + 1_000_000
        try:
            return real(group, width)
        finally:
            own.jump = kept

    monkeypatch.setattr(relative_parse, "_factors", broken)
    assert removed() < 140


def brute_components(rows):
    def shingles(t):
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def test_similar_documents_share_a_component(odd, sample):
    for docs in (odd, sample):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert pairs(similarity_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):  # each differs from the one before in one word
        words[(k * 5) % 300] = f"x{k}"
        rows.append((100 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(similarity_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_an_id_with_several_texts_links_by_each_of_them(spark):
    rng = np.random.default_rng(11)
    prose = lambda n: [f"p{rng.integers(0, 10**6)}" for _ in range(n)]
    rows = [(90, None), (91, " ")]
    for k in range(12):  # each odd id has a short and a long text, with a near copy of both under other ids
        short, long = prose(30 + k), prose(300 + 9 * k)
        rows += [(10 * k + 1001, " ".join(short)), (10 * k + 1001, " ".join(long)), (10 * k + 1001, "")]
        for own, i in ((short, 10 * k + 1000), (long, 10 * k + 1002)):
            own[0] = "changed"
            rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert pairs(similarity_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_many_near_copies_that_share_a_rare_passage(spark):
    rng = np.random.default_rng(9)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = [f"o{rng.integers(0, 100000)}" for _ in range(12 if k % 3 else 40)]
        rows.append((k + 1, " ".join(shared + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(similarity_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


@pytest.mark.parametrize("few, block", [(2, 4), (24, 128)])
def test_common_parts_of_all_kinds(spark, monkeypatch, few, block):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(13)
    passages = [[f"{name}{k}" for k in range(60)] for name in "abc"]
    pool = [[f"f{k}_{j}" for j in range(6)] for k in range(5)]
    rows = []
    for k in range(260):
        words = list(passages[k % 3 if k % 4 else 0])
        for _ in range(int(rng.integers(0, 3))):  # a few words of the passage differ, in places that several documents share
            words[int(rng.integers(0, 6)) * 10] = f"y{int(rng.integers(0, 3))}"
        words += pool[int(rng.integers(0, 5))][: int(rng.integers(0, 7))] + [f"o{k}_{j}" for j in range(int(rng.integers(0, 9)))]
        rows.append((k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(similarity_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_thousands_that_share_a_passage_are_linked_in_proportion(spark, monkeypatch):
    counted, real = [], jaccard._common_links

    def spy(shared, common):
        found = real(shared, common)
        counted.append((common.count(), found.count()))
        return found

    monkeypatch.setattr(jaccard, "_common_links", spy)
    passage = " ".join(f"p{k}" for k in range(60))  # 56 shingles, and one more for each word behind it
    own = {k + 1: 4 + k % 11 for k in range(5000)}
    docs = spark.createDataFrame([(i, " ".join([passage, *(f"o{i}_{j}" for j in range(w))])) for i, w in own.items()], "doc_id long, text string")
    # 56 / (56 + v + w) is 0.8 or more if v + w is 14 or less, and the least is 4
    want = sorted(((i, 56 + w, 1 if w <= 10 else i) for i, w in own.items()), key=repr)
    assert pairs(similarity_components(docs), "doc_id", "n_shingles", "component_id") == want
    assert counted and all(n_links <= 3 * n for n, n_links in counted)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (None, 1), (3, 3)], "a long, b long")
    assert pairs(connected_components(links), "node", "component") == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(21)
    for n, m in ((40, 25), (300, 260), (60, 200)):
        links = rng.integers(0, n, (m, 2))
        root = list(range(n))
        for _ in range(n):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        df = spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long")
        want = sorted((k, int(root[k])) for k in set(links.ravel().tolist()))
        assert sorted(map(tuple, connected_components(df).select("node", "component").collect())) == want
        one, two = df.where("a % 2 = 0"), df.where("a % 2 = 1")
        assert sorted(map(tuple, joined_components(connected_components(one), two).select("node", "component").collect())) == want


def test_empty_tables(empty):
    for out in (repeat_digests(empty), factor_digests(empty), remove_factors(empty), similarity_components(empty)):
        assert out.count() == 0


def test_rows_that_stand_thousands_of_times(spark):
    """The work grows with the different rows: of 3,000 equal ones it makes as many runs as of two."""
    rng = random.Random(8)
    base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(150))
    other = "before " * 3 + base[:600] + " behind"
    table = lambda n: spark.createDataFrame([(7, base)] * n + [(9, other), (3, "one two three")], "doc_id long, text string")
    made = []
    for n in (2, 3_000):
        runs = repeats.compared(repeats.keyed(table(n), "doc_id", "text").drop("id"), False, 200, 50, 1_000, F.count("*") > 1, [*repeats.NAME, "first"], F.count("*") > 1, lambda t: suffix_dedup._repeats(t, 200, False))
        made.append(runs.count())
    assert made[0] == made[1] > 0
    got = suffix_dedup.repeat_digests(table(3_000)).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    assert sorted((r.doc_id, r["count"], r.n_bytes - r.n_removed) for r in got) == [(3, 1, 13), (7, 3_000, 0), (9, 1, len(other) - 600)]
    words = relative_parse.factor_digests(table(3_000)).groupBy("doc_id", "n_removed").count().collect()
    assert {(r.doc_id, r["count"], r.n_removed > 0) for r in words} == {(3, 1, False), (7, 3_000, False), (9, 1, True)}
