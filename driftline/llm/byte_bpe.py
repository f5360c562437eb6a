"""Byte-level BPE: encoding by tree concatenation, and decoding.

A text is cut as the vocabulary's own pattern cuts it; what lies between two cuts is unsplit text. Short unsplit text is
merged directly. Long unsplit text is halved again and again; the halves do not depend on each other, so all leaves of
a batch are encoded first and joined level by level. A join re-encodes a window of tokens around it and widens the
window until its outermost tokens on both sides are those the halves already had: neighbouring tokens of a BPE encoding
are valid pair by pair, so from there on both sides stand as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import held
from .text import in_small_batches
from .token_count import RankMerger

#: The pattern of the vocabulary's pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest unsplit text, in bytes, that is merged without halving.
LEAF = 24
#: Pieces that a worker keeps, and the characters of the longest one that it keeps; a full store gives way
#: to a new one and is itself kept until the next is full.
STORE, STORE_CHARS = 250_000, 100


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Merge rules and bytes of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        raw = {token: bytes(alphabet[c] for c in token) for token in vocab if all(c in alphabet for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = raw.get(token, token.encode())
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rules[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.arrays = RankMerger([(*pair, *made) for pair, made in self.rules.items()], len(self.bytes))
        self.split = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]

    def merge(self, data: bytes) -> list[int]:
        """The encoding of unsplit bytes: the lowest-ranked pair first, the leftmost of equals."""
        ids, rules = [self.first[b] for b in data], self.rules
        if len(ids) > 2 * LEAF:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min(((rules[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rules), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [rules[ids[k], ids[k + 1]][1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rules = len(ids), self.rules
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rules[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in rules]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else n
            if j >= n or (ids[k], ids[j]) != pair:
                continue
            ids[k], ids[j] = rules[pair][1], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (ids[a], ids[b]) in rules:
                    heapq.heappush(heap, (rules[ids[a], ids[b]][0], a, (ids[a], ids[b])))
        return [i for i in ids if i >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring encoded texts as one."""
        if not left or not right:
            return left + right
        a, b = min(2, len(left)), min(2, len(right))
        while True:
            window = self.merge(b"".join(map(self.bytes.__getitem__, left[-a:] + right[:b])))
            left_agrees = a == len(left) or window[0] == left[-a]
            right_agrees = b == len(right) or window[-1] == right[b - 1]
            if left_agrees and right_agrees:
                return left[: len(left) - a] + window + right[b:]
            if not left_agrees:
                a = min(2 * a, len(left))
            if not right_agrees:
                b = min(2 * b, len(right))

    def unsplit(self, texts: list[bytes]) -> list[list[int]]:
        """Encodings of unsplit texts: all leaves first, then the joins, level by level."""
        data, edges, parts_of = b"".join(texts), [0], []
        for own in texts:
            parts, at = 1, edges[-1]
            while len(own) > LEAF * parts:
                parts *= 2
            if parts == 1:
                edges.append(at + len(own))
            else:
                edges += [at + len(own) * k // parts for k in range(1, parts + 1)]
            parts_of.append(parts)
        encoded = self.merge_leaves(data, np.array(edges))
        leaves, at = [], 0
        for parts in parts_of:
            leaves.append(encoded[at : at + parts])
            at += parts
        wide = [k for k, found in enumerate(leaves) if len(found) > 1]
        while wide:
            for k in wide:
                leaves[k] = [self.join(*leaves[k][j : j + 2]) for j in range(0, len(leaves[k]), 2)]
            wide = [k for k in wide if len(leaves[k]) > 1]
        return [found[0] for found in leaves]

    def merge_leaves(self, data: bytes, edges: np.ndarray) -> list[list[int]]:
        """Encodings of the stretches of ``data`` between ``edges``, all merged at once as arrays."""
        ids = np.array(self.first, np.int64)[np.frombuffer(data, np.uint8)]
        ids, seq = self.arrays.merged(ids, np.repeat(np.arange(len(edges) - 1), np.diff(edges)))
        order = np.argsort(seq, kind="stable")
        ids, at = ids[order].tolist(), np.searchsorted(seq[order], np.arange(len(edges))).tolist()
        return [ids[x:y] for x, y in zip(at, at[1:])]

    def encode_missing(self, pieces: list[str]) -> list[list[int]]:
        """Encodings of pieces, special strings as their own ids."""
        found = iter(self.unsplit([piece.encode("utf-8") for piece in pieces if piece not in self.special]))
        return [[self.special[piece]] if piece in self.special else next(found) for piece in pieces]

    def pretokens(self, text: str) -> list[str]:
        """What the pattern cuts, special strings apart."""
        parts = self.cut(text)
        if len(parts) == 1:
            return self.split(text)
        return [piece for part in parts for piece in ([part] if part in self.special else self.split(part))]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def whole_characters(raw: bytes) -> bytes:
    """Decoded bytes as the text that they stand for, in UTF-8: what isn't UTF-8 becomes U+FFFD."""
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


class Encoder:
    """Ids of whole texts. No merge crosses what the pattern cuts, so a piece is encoded once and kept, whatever comes
    before and behind it. What is kept of a piece is what ``form`` makes of its ids; texts are put together from the
    forms of their pieces.
    """

    def __init__(self, bpe: ByteBpe, missing: Callable[[list[str]], list[list[int]]], form: Callable[[list[int]], Any]) -> None:
        self.bpe, self.missing, self.form, self.store, self.old = bpe, missing, form, {}, {}

    def encode(self, texts: list[str | None]) -> Iterator[list]:
        """For each text the forms of its pieces."""
        parts = [self.bpe.pretokens(text) if text else [] for text in texts]
        asked = set().union(*parts)
        lack = asked.difference(self.store)
        if len(self.store) + len(lack) > STORE:  # what is still asked for comes back from the store before
            self.store, self.old, lack = {}, self.store, asked
        self.store.update((w, self.old[w]) for w in lack if w in self.old)
        missing = [w for w in lack if w not in self.store]
        for start in range(0, len(missing), 20_000):
            part = missing[start : start + 20_000]
            self.store.update(zip(part, map(self.form, self.missing(part))))
        for found in parts:
            yield list(map(self.store.__getitem__, found))
        for w in missing:
            if len(w) > STORE_CHARS:
                del self.store[w]


#: White space that long makes the pattern's look-ahead slow in one of the libraries.
LONG_RUN = re.compile(r"\s{200}")


def tree_encoder(path: str, digests: bool = False) -> Encoder:
    """An encoder by tree concatenation, one a worker. The form of a piece is its ids as packed 32-bit numbers, or, for
    ``digests``, their decimals joined by commas, and the bytes that they decode to."""

    def make() -> Encoder:
        bpe = ByteBpe(path)
        decimal = [str(i).encode() for i in range(len(bpe.bytes))]

        def both(ids: list[int]) -> tuple[bytes, bytes]:
            return b",".join(map(decimal.__getitem__, ids)), b"".join(map(bpe.bytes.__getitem__, ids))

        return Encoder(bpe, bpe.encode_missing, both if digests else lambda ids: np.array(ids, "<u4").tobytes())

    return held(("tree", path, digests), make)


class LibraryEncoder:
    """Ids of whole texts by the libraries: texts without special strings by ``tiktoken``, over the vocabulary of the
    file, which is the faster one; all others, and any if ids don't follow the merge order, by ``tokenizers``."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.bpe = ByteBpe(path)
        made = [new for _, new in sorted(self.bpe.rules.values())]
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        special = set(self.bpe.special.values())
        ranks = {data: i for i, data in enumerate(self.bpe.bytes) if i not in special}
        follows = made == sorted(made) and len(ranks) == len(self.bpe.bytes) - len(special)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if follows else None

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if not text:
                ids = []
            elif self.fast is None or LONG_RUN.search(text) or any(s in text for s in self.bpe.special):
                ids = self.model.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast(text)
            out.append(np.array(ids, "<u4"))
        return out


def library_encoder(path: str) -> LibraryEncoder:
    """An encoder by the libraries, one a worker."""
    return held(("library", path), lambda: LibraryEncoder(path))


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Small slices, so that a task holds few texts as Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``ids`` (array of long) and ``decoded`` (the text of those ids).

    A null or empty text has no ids and decodes to "". Repeated rows and null ids stay; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path)
        for part in text_batches(batches):
            found = [np.frombuffer(b"".join(parts), "<u4").tolist() for parts in encoder.encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64())), pa.array([encoder.bpe.decode(ids) for ids in found])], ["id", "ids", "decoded"])

    plain = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<long>, decoded string").withColumnRenamed("id", id_col)


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with digests in place of ids and text: ``n_tokens``, ``ids_sha256`` (of the decimal ids
    joined by commas) and ``decoded_sha256`` (of the decoded text in UTF-8), made where the ids are, so that neither is
    sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path, digests=True)
        for part in text_batches(batches):
            n, a, b = [], [], []
            for parts in encoder.encode(part.column(1).to_pylist()):
                decimals, raw = zip(*parts) if parts else ((), ())
                ids = b",".join(decimals)
                n.append(ids.count(b",") + 1 if parts else 0)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(whole_characters(b"".join(raw))).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
