"""Token counts of a piece vocabulary by rank-synchronous array merging.

The vocabulary's own library splits nothing: it merges the best-scored neighbouring pair of the whole normalised text,
the leftmost first. As no piece holds a space mark after another character, and characters outside every longer piece
never merge, texts may be cut there. The cut parts (pre-tokens) of a batch are held as one ragged array of symbols;
each round applies every sequence's own lowest-rank pair to all sequences at once, and the symbols that survive are
counted (one token for each UTF-8 byte where a character is in no piece).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import held
from .text import in_small_batches

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Words whose counts a worker keeps, and the characters of the longest one that it keeps; the store is emptied when full.
STORE, STORE_CHARS = 600_000, 100
#: Symbols merged at once, and the length from which a sequence is merged by itself.
BATCH, LONG = 200_000, 2_000


class RankMerger:
    """Ranked merge rules as arrays: (left, right) makes a symbol, the lowest rank first, the leftmost of equals."""

    def __init__(self, rules: list[tuple[int, int, int, int]], symbols: int) -> None:
        self.base = np.int64(symbols + 1)
        table = np.array(rules, np.int64).reshape(-1, 4)
        key = table[:, 0] * self.base + table[:, 1]
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], table[order, 2].astype(np.int32), table[order, 3].astype(np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the rules, or -1."""
        key = left * self.base + right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def merged(self, ids: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols and their sequences after all merges."""
        done_ids, done_seq = [], []
        edges = np.concatenate([np.flatnonzero(np.diff(seq, prepend=-1)), [len(seq)]])
        for a, b in zip(edges[:-1][np.diff(edges) > LONG].tolist(), edges[1:][np.diff(edges) > LONG].tolist()):
            done_ids.append(self.merged_alone(ids[a:b]))
            done_seq.append(np.full(len(done_ids[-1]), seq[a]))
        if done_ids:
            short = np.repeat(np.diff(edges) <= LONG, np.diff(edges))
            ids, seq = ids[short], seq[short]
        rule = np.full(len(ids), -1, np.int64)
        rule[:-1] = np.where(seq[:-1] == seq[1:], self.pair(ids[:-1], ids[1:]), -1)
        while True:
            rank = np.where(rule >= 0, self.rank[rule], NONE)
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if len(seq) else np.zeros(0, np.int64)
            if not len(first):
                break
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate([first, [len(seq)]]))
            live = np.repeat(lowest < NONE, size)
            if not live.all():  # finished sequences leave the arrays
                done_ids.append(ids[~live])
                done_seq.append(seq[~live])
                ids, seq, rule, rank = ids[live], seq[live], rule[live], rank[live]
                keep = lowest < NONE
                lowest, size = lowest[keep], size[keep]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            hit = self._applied(hit, ids, seq, rule)
            ids[hit] = self.made[rule[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            shift = np.cumsum(stay) - 1
            ids, seq, rule, hit = ids[stay], seq[stay], rule[stay], shift[hit]
            for at in (hit, np.unique(hit[hit > 0] - 1)):  # pairs that begin at or before a new symbol
                inner = at[at + 1 < len(ids)]
                rule[at] = -1
                rule[inner] = np.where(seq[inner] == seq[inner + 1], self.pair(ids[inner], ids[inner + 1]), -1)
        return np.concatenate([*done_ids, ids]), np.concatenate([*done_seq, seq])

    def merged_alone(self, ids: np.ndarray) -> np.ndarray:
        """Surviving symbols of one long sequence: again its lowest-rank pair everywhere at once, round by round, but
        symbols stay in place with links over those that are gone, and places wait by rank, so that a round costs what
        it changes."""
        n, ids = len(ids), ids.astype(np.int64)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rule = np.full(n, -1, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def renew(at: np.ndarray) -> None:
            inner = at[after[at] < n]
            rule[at] = -1
            rule[inner] = self.pair(ids[inner], ids[after[inner]])
            some = inner[rule[inner] >= 0]
            if not len(some):
                return
            rank = self.rank[rule[some]]
            order = np.argsort(rank, kind="stable")
            cuts = np.flatnonzero(np.diff(rank[order])) + 1
            for part in np.split(some[order], cuts):
                wait(int(self.rank[rule[part[0]]]), part)

        def wait(rank: int, part: np.ndarray) -> None:
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(ranks, rank)
            waiting[rank].append(part)

        renew(np.arange(n))
        while ranks:
            rank = heapq.heappop(ranks)
            hit = np.unique(np.concatenate(waiting.pop(rank)))
            hit = hit[alive[hit] & (rule[hit] >= 0)]
            hit = hit[self.rank[rule[hit]] == rank]
            if not len(hit):
                continue
            number = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(np.concatenate([[True], after[hit[:-1]] != hit[1:]]), number, 0))
            hit = hit[(number - start) % 2 == 0]  # overlapping hits: every other one
            made = self.made[rule[hit]].astype(np.int64)
            left = np.where(before[hit] >= 0, ids[before[hit]], -1)
            over = after[after[hit]]
            left[1:] = np.where(over[:-1] == hit[1:], made[:-1], left[1:])
            right = np.where(over < n, ids[np.minimum(over, n - 1)], -1)
            better = np.zeros(len(hit), bool)
            for found in (self.pair(left, made), self.pair(made, right)):
                better |= (found >= 0) & (self.rank[found] <= rank)
            if better.any():  # what makes a pair as good or better lets the rest wait
                last = int(better.argmax()) + 1
                if last < len(hit):
                    wait(rank, hit[last:])
                hit, made, over = hit[:last], made[:last], over[:last]
            alive[after[hit]] = False
            ids[hit] = made
            after[hit] = over
            before[over[over < n]] = hit[over < n]
            renew(np.unique(np.concatenate([hit, before[hit][before[hit] >= 0]])))
        return ids[alive]

    def _applied(self, hit: np.ndarray, ids: np.ndarray, seq: np.ndarray, rule: np.ndarray) -> np.ndarray:
        """Of the equally ranked hits, those that one-by-one merging from the left would take before it meets a better pair."""
        if len(hit) == 1 or not (seq[hit[1:]] == seq[hit[:-1]]).any():
            return hit
        fresh = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (seq[hit[1:]] != seq[hit[:-1]])])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - start) % 2 == 0]  # overlapping hits: every other one
        made, rank = self.made[rule[hit]], self.rank[rule[hit]]
        before = np.maximum(hit - 1, 0)
        left = ids[before].astype(np.int64)
        if len(hit) > 1:
            touching = np.concatenate([[False], (hit[1:] == hit[:-1] + 2) & (seq[hit[1:]] == seq[hit[:-1]])])
            left[touching] = made[np.flatnonzero(touching) - 1]
        left[(hit == 0) | (seq[before] != seq[hit])] = -1
        after = np.minimum(hit + 2, len(ids) - 1)
        right = np.where((hit + 2 < len(ids)) & (seq[after] == seq[hit]), ids[after], -1)
        made64 = made.astype(np.int64)
        better = np.zeros(len(hit), bool)
        for found in (self.pair(left, made64), self.pair(made64, right)):
            better |= (found >= 0) & (self.rank[found] <= rank)
        # after a hit that makes a pair as good or better, the rest of its sequence waits for the next round
        same = seq[hit]
        first = np.concatenate([[True], same[1:] != same[:-1]])
        seen = np.cumsum(better) - better
        return hit[seen - np.maximum.accumulate(np.where(first, seen, 0)) == 0]


class PieceMerger(RankMerger):
    """The merge rules of a sentencepiece BPE model as arrays."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        if any(MARK in piece.lstrip(MARK) for piece in score):
            raise ValueError("a piece holds a space mark after another character")
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.symbol = {c: i for i, c in enumerate(sorted(score))}
        pairs = []
        for piece, value in score.items():
            for cut in range(1, len(piece)):
                if piece[:cut] in score and piece[cut:] in score:
                    pairs.append((self.symbol[piece[:cut]], self.symbol[piece[cut:]], rank_of[value], self.symbol[piece]))
                elif len(piece) == 2:  # a character outside the pieces may still start a longer piece
                    pairs.append((self._char(piece[:1]), self._char(piece[1:]), rank_of[value], self.symbol[piece]))
        super().__init__(pairs, len(self.symbol))
        self.bytes = np.array([0 if p in score else len(p.encode()) for p in sorted(self.symbol, key=self.symbol.get)], np.int64)
        joined = {c for p in score if len(p) > 1 for c in p}
        inner = "".join(re.escape(c) for c in sorted(joined - {MARK}))
        #: A run of marks and what can merge behind it; anything else stands alone.
        self.cut = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{inner}{MARK}]+", re.S)

    def _char(self, c: str) -> int:
        return self.symbol.setdefault(c, len(self.symbol))

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = np.zeros(len(tokens), np.int64)
        if not lengths.sum():
            return out
        codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, inverse = np.unique(codes, return_inverse=True)
        ids = np.array([self.symbol.get(chr(c), -1) for c in chars], np.int64)[inverse]
        # characters outside all pieces: -1, one token for each UTF-8 byte
        wide = np.array([1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) for c in chars], np.int64)[inverse]
        seq = np.repeat(np.arange(len(tokens)), lengths)
        np.add.at(out, seq[ids < 0], wide[ids < 0])
        ids, seq = self.merged(ids, seq)
        known = ids >= 0
        np.add.at(out, seq[known], np.maximum(1, self.bytes[ids[known]]))
        return out


def _merger(path: str) -> tuple[PieceMerger, dict[str, int]]:
    return held(("pieces", path), lambda: (PieceMerger(path), {}))


def piece_counts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each whole text; null and empty texts have none."""
    merger, store = _merger(path)
    out = [0] * len(texts)
    plain: list[tuple[int, list[str]]] = []
    lack: set[str] = set()
    odd: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        words = text.replace(MARK, " ").split(" ")
        if "" in words:  # runs of spaces, or a space at an end: marks that belong together
            found = merger.cut.findall(MARK + text.replace(" ", MARK))
            odd += found
            owner += [i] * len(found)
        else:
            plain.append((i, words))
            lack.update(words)
    missing = [w for w in lack if w not in store]
    if len(store) + len(missing) > STORE:
        store.clear()
        missing = list(lack)
    for part in _batches(missing):
        found = [merger.cut.findall(MARK + w) for w in part]
        total = np.concatenate([[0], np.cumsum(merger.counts([p for f in found for p in f]))])
        store.update(zip(part, np.diff(total[np.concatenate([[0], np.cumsum([len(f) for f in found])])]).tolist()))
    for i, words in plain:
        out[i] = sum(map(store.__getitem__, words))
    for w in missing:
        if len(w) > STORE_CHARS:
            del store[w]
    at = 0
    for part in _batches(odd):
        for i, n in zip(owner[at : at + len(part)], merger.counts(part).tolist()):
            out[i] += n
        at += len(part)
    return out


def _batches(tokens: list[str]) -> Iterator[list[str]]:
    """Runs of tokens of about BATCH characters."""
    start = size = 0
    for k, token in enumerate(tokens):
        size += len(token) + 1
        if size >= BATCH:
            yield tokens[start : k + 1]
            start, size = k + 1, 0
    if start < len(tokens):
        yield tokens[start:]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids are kept as they come; other columns are
    not read. An empty table gives no rows. There is no shuffle: texts are read once, in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                n = piece_counts(part.column(1).to_pylist(), model_path)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    plain = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), size.alias("n_bytes"))
    found = plain.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
