"""Secret scans: fixed patterns, and random-looking strings found by character Markov models.

Two models of characters given the two before, one of random strings and one of ordinary identifiers, are trained on
labelled samples: what the fixed patterns match against the other words of a bounded sample of texts, and strings drawn
from the usual alphabets of keys. A string is reported when its log-likelihood ratio per character passes a threshold.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .byte_bpe import text_batches
from .text import in_small_batches

#: The fixed patterns, with the group and the least length that count (fixed values of the contract).
PATTERNS = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
HEX_RUN = re.compile(r"[0-9a-f]{16,}")  # a maximal run that is long enough: the same matches, found faster
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the models judge: unbroken strings of key characters.
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A part of such a string between separators, long enough to be judged by itself.
PART = re.compile(r"[A-Za-z0-9+]{20,}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Texts whose words train the models at most (those with the smallest hash of id and text); all words of these texts count.
SAMPLE_TEXTS = 2_000
#: Bits per character by which the random model must win.
THRESHOLD = 1.0
#: What joins words to identifiers, paths and hosts.
JOINTS = "_-/."
KINDS = ("assign", "access", "hex", "random")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns: start, end (code points) and kind, by start and then kind as listed."""
    found: list[tuple[int, int, str]] = []
    lower = text.lower()
    for kind, pattern, group, least in PATTERNS:
        if kind == "hex":
            found += [(m.start(), m.end(), kind) for m in HEX_RUN.finditer(text)]
        elif kind == "access" and "AKIA" not in text or kind == "assign" and not any(k in lower for k in KEYWORDS):
            continue
        else:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _counts(strings: list[str]) -> np.ndarray:
    """Counts of each symbol after the two before it; index len(SYMBOLS) stands before a string and for anything else."""
    n = len(SYMBOLS)
    code = np.full(256, n, np.int64)
    code[[ord(c) for c in SYMBOLS]] = np.arange(n)
    raw = np.frombuffer("\0\0".join(["", *strings, ""]).encode("ascii", "replace"), np.uint8)  # no string holds "\0"
    own, inside = code[raw], np.flatnonzero(raw)
    cell = (own[inside - 2] * (n + 1) + own[inside - 1]) * (n + 1) + own[inside]
    return np.bincount(cell, minlength=(n + 1) ** 3).reshape(n + 1, n + 1, n + 1).astype(np.float64)


def _bits(count: np.ndarray) -> np.ndarray:
    """log2 probabilities: two, one and no symbols of context, mixed by how often the context was seen."""
    width = count.shape[0]
    p = np.full(width, 1 / width)
    for own in (count.sum((0, 1)), count.sum(0), count):
        total = own.sum(-1, keepdims=True)
        p = (own + 5 * p) / (total + 5)
    return np.log2(p)


def drawn(seed: int = 17, each: int = 1_500) -> list[str]:
    """Labelled random strings from the alphabets of common keys."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[:62] + "_-")
    return ["".join(rng.choices(alphabet, k=rng.randint(20, 64))) for alphabet in alphabets for _ in range(each)]


#: Words that ordinary identifiers, paths and hosts are made of.
IDENTIFIER_WORDS = """get set user name profile file path data base from with list item index count value key map read write
load store open close start stop test main page home image photo video article news blog post view edit delete create
update config system server client request response error message result table column row field string number time date
year month day first last next previous example company project module package service account address email login
search filter report summary version release build http https www com org net html the quick brown fox over this that
very long word and for not new old red blue green large small public private static final default local global""".split()


def ordinary(seed: int = 18, each: int = 2_000) -> list[str]:
    """Labelled ordinary identifiers: such words joined in the usual ways, with a number now and then."""
    rng = random.Random(seed)
    out = []
    for join in ("", "_", "-", "/", "."):
        for _ in range(each):
            words = rng.choices(IDENTIFIER_WORDS, k=rng.randint(3, 7))
            if join == "":
                words = [w.capitalize() if k else w for k, w in enumerate(words)]
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] += str(rng.choice([1, 2, 3, 10, 64, 100, 2019, 2024]))
            out.append(join.join(words) if rng.random() < 0.8 else join.join(words).upper())
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio in bits of each symbol after the two before it; a table of fixed size."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(9))
    texts = in_small_batches(docs).where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), h.alias("h"))
    # a cut by hash leaves a few times as many hashes as asked for, whatever the table's size; of these the smallest stay
    share = min(1.0, 4.0 * SAMPLE_TEXTS / max(1, texts.count()))
    few = texts.select("h").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).distinct().orderBy("h").limit(SAMPLE_TEXTS)
    sample = texts.join(materialise(few, "sampled"), "h").dropDuplicates(["h"]).select("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches):
            strings, secret = [], []
            for text in part.column(0).to_pylist():
                spans, at = base_spans(text), 0
                hits = [m for m in (re.search(r"[A-Za-z0-9+/_.=-]+\Z", text[a:b]) for a, b, _ in spans) if m]
                rest = []
                for a, b, _ in spans:
                    rest.append(text[at:a])
                    at = max(at, b)
                words = re.findall(r"[A-Za-z][A-Za-z0-9_]{3,}", " ".join([*rest, text[at:]]))
                # words as they stand, and as identifiers and paths are made of them
                words += [JOINTS[k % len(JOINTS)].join(words[4 * k : 4 * k + 4]) for k in range(len(words) // 4)]
                strings += [m[0] for m in hits] + words
                secret += [True] * len(hits) + [False] * len(words)
            counts = [_counts([s for s, own in zip(strings, secret) if own is k]) for k in (True, False)]
            for k, c in zip((True, False), counts):
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.bool_()), pa.array(at, pa.int64()), pa.array(c.ravel()[at])], ["secret", "cell", "n"])

    total = {True: _counts(drawn()), False: _counts(ordinary())}
    counted = sample.mapInArrow(label, "secret boolean, cell long, n double").groupBy("secret", "cell").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # at most one row for each of the table's cells
        total[row["secret"]].ravel()[row["cell"]] += row["n"]
    return (_bits(total[True]) - _bits(total[False])).astype(np.float32)


def _scores(s: str, ratio: np.ndarray) -> np.ndarray:
    n = len(SYMBOLS)
    own = [n, n, *map(SYMBOLS.find, s)]
    return ratio[own[:-2], own[1:-1], own[2:]].astype(np.float64)


def random_parts(s: str, ratio: np.ndarray) -> list[tuple[int, int]]:
    """What the models call random in a string of key characters: all of it, or else its parts between separators and
    its windows of LEAST characters that pass the threshold by themselves, overlapping ones as one."""
    score = _scores(s, ratio)
    if score.mean() > THRESHOLD and _mixed(s):
        return [(0, len(s))]
    hits = [(m.start(), m.end()) for m in PART.finditer(s) if _mixed(m[0]) and _scores(m[0], ratio).mean() > THRESHOLD]
    total = np.concatenate([[0.0], np.cumsum(score)])
    hits += [(int(a), int(a) + LEAST) for a in np.flatnonzero(total[LEAST:] - total[:-LEAST] > THRESHOLD * LEAST)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if _mixed(s[a:b])]


def _mixed(s: str) -> bool:
    return bool(re.search(r"\d", s) and re.search(r"[A-Za-z]", s))


def random_spans(text: str, ratio: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Strings that the models call random, with a digit and a letter, LEAST characters or more; of a string that a base
    span covers in part, what is left outside the base spans is judged."""
    out = []
    for m in CANDIDATE.finditer(text):
        at, left = m.start(), []
        for a, b, _ in base:
            if a < m.end() and m.start() < b:
                left.append((at, a))
                at = max(at, b)
        for a, b in [*left, (at, m.end())]:
            if b - a >= LEAST:
                out += [(a + x, a + y, "random") for x, y in random_parts(text[a:b], ratio)]
    return out


def spans_of(text: str | None, ratio: np.ndarray) -> list[tuple[int, int, str]]:
    if not text:
        return []
    base = base_spans(text)
    found = base + random_spans(text, ratio, base)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and ``spans``, an array of (kind, start, end) in code points, by start.

    A null or empty text has no spans. Repeated rows and null ids stay; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in text_batches(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t, ratio)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, form)], ["id", "spans"])

    plain = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by the span's kind in brackets; all other rows and columns as they are."""
    columns = docs.columns
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches):
            texts = part.column(place).to_pylist()
            for k, text in enumerate(texts):
                out, at = [], 0
                for a, b, kind in spans_of(text, ratio):
                    if b > at:
                        out += [text[at : max(a, at)]] + ([f"[{kind}]"] if a >= at else [])
                        at = b
                if out:
                    texts[k] = "".join([*out, text[at:]])
            yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    return in_small_batches(docs).mapInArrow(run, docs.schema)


def secret_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""

    def joined(spans):
        one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        return F.array_join(F.transform(spans, one), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
