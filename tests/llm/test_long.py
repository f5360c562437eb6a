"""Texts of over a mebibyte, empty tables and rare paths: every operator has its stated result."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from driftline.llm import packing, quality, secrets
from driftline.llm.byte_bpe import encoding_digests
from driftline.llm.cover_tree import exact_top_k
from driftline.llm.jaccard import similarity_components
from driftline.llm.language_id import gram_counts, identify
from driftline.llm.packing import best_fit, merge_bins, pack_documents
from driftline.llm.queries import tokenizer_path
from driftline.llm.relative_parse import factor_digests, remove_factors
from driftline.llm.suffix_dedup import repeat_digests
from driftline.llm.text import CHUNK_BYTES
from driftline.llm.token_count import count_tokens, piece_counts
from pyspark.sql import functions as F

from .test_models import brute_counts
from .test_repeats import words_of

PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(40_000)]
    long = " ".join(rng.choice(words) for _ in range(190_000))
    assert len(long) > CHUNK_BYTES
    tail = " ".join(rng.choice(words) for _ in range(300))
    return {1: long, 2: long + " " + tail, 3: tail, 4: "q" * (CHUNK_BYTES + 5), 5: "secret = 'abcdEFGH12345678' " + tail[:100]}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en") for i, t in texts.items()] + [(6, "kurze Worte in einem Satz", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").persist()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_long_texts_are_encoded_whole(docs, texts):
    import sentencepiece
    from tokenizers import Tokenizer

    pieces, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
    counts, digests = by_id(count_tokens(docs, PIECES)), by_id(encoding_digests(docs, BYTES))
    packed = pack_documents(docs, BYTES).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    packed = {r.doc_id: r.n for r in packed}
    for i, t in texts.items():
        ids = model.encode(t, add_special_tokens=False).ids
        assert counts[i].n_tokens == len(pieces.encode(t)) and packed[i] == len(ids) + 1
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_long_unbroken_texts_are_counted_as_the_library_does():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "aé東xyz0123", "the"):
        text = "".join(rng.choice(letters) for _ in range(9_000)) + letters * 500
        assert piece_counts([text], PIECES) == [len(model.encode(text))]


def test_long_texts_are_compared_whole(docs, texts):
    bytes_ = by_id(repeat_digests(docs))
    assert (bytes_[1].n_removed, bytes_[1].n_spans) == (len(texts[1]), 1)  # it stands in 2 as well
    assert bytes_[2].n_removed == len(texts[2]) - 1 and bytes_[2].n_spans == 2  # all but the space between both
    assert bytes_[3].n_removed == len(texts[3]) and bytes_[4].n_removed == len(texts[4])
    words = by_id(factor_digests(docs))
    assert words[1].n_removed == 0 and words[2].n_removed == len(words_of(texts[1])) and words[3].n_removed == 300
    assert words_of(by_id(remove_factors(docs))[2].text) == words_of(texts[3])
    groups = by_id(similarity_components(docs))
    assert groups[1].component_id == groups[2].component_id == 1 and groups[3].component_id == 3


def test_long_texts_are_judged_whole(docs, texts):
    judged = by_id(quality.assess(docs, None))
    for i in (2, 3, 4):
        r = judged[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(texts[i])
    named = by_id(identify(docs, gram_counts(docs)))
    assert named[1].lang_pred == named[2].lang_pred and 0 <= named[2].score <= 1
    found = by_id(secrets.find_secrets(docs.unionByName(docs.where("doc_id = 5").select((F.col("doc_id") + 2).alias("doc_id"), F.concat(F.lit(texts[1] + " "), "text").alias("text"), "lang")), secrets.train(docs)))
    assert [(s.kind, s.start - len(texts[1]) - 1) for s in found[7].spans if s.kind == "assign"] == [(s.kind, s.start) for s in found[5].spans if s.kind == "assign"] != []


def test_empty_tables_and_labels(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(empty, labels) is None and quality.assess(empty, None).count() == 0
    assert secrets.find_secrets(empty, secrets.train(empty)).count() == 0 and secrets.redact(empty, secrets.train(empty)).count() == 0


def test_quality_of_odd_labels(spark):
    blank = spark.createDataFrame([(k, "") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    assert quality.train(blank, labels) is None  # nothing to fit on: the base rules decide alone
    rows = [(k % 5, f"word{k} " * 12) for k in range(60)]  # ids on many rows, labels that contradict
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int"))
    assert model is not None and np.isfinite(model["weights"]).all()


def test_ties_in_the_order_of_the_sample_give_one_model(spark):
    rows = [(k, f"good plain words number {k}" if k % 2 else f"x{k} $$ {k} %%") for k in range(60)] * 2
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels) for n in (1, 7)]
    assert np.allclose(models[0]["weights"], models[1]["weights"]) and models[0]["bias"] == pytest.approx(models[1]["bias"])


def test_rounds_of_merging_come_near_plain_best_fit(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rng = np.random.default_rng(12)
    fill = np.concatenate([rng.integers(1, 700, 600), rng.integers(1100, 2000, 500)])
    bins = spark.createDataFrame([(k, int(n)) for k, n in enumerate(fill)], "bin long, fill long")
    moved = merge_bins(bins, 2048, 2040).toPandas().merge(bins.toPandas(), on="bin")
    assert len(moved) == len(fill)
    for _, own in moved.groupby("sequence"):
        own = own.sort_values("shift")
        assert own["shift"].tolist() == [0, *np.cumsum(own["fill"])[:-1].tolist()] and own["fill"].sum() <= 2048
    assert moved["sequence"].nunique() <= 1.05 * len(best_fit(fill, 2048)[2])
    wide = spark.createDataFrame([(k, 1100) for k in range(500)], "bin long, fill long")  # no two fit together
    assert merge_bins(wide, 2048, 2040).select("sequence").distinct().count() == 500


def test_planted_secrets_are_found_and_words_are_left_alone(spark):
    rng = random.Random(15)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ratio = secrets.train(docs)
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
    planted = ["".join(rng.choices(a, k=rng.randint(24, 60))) for a in alphabets for _ in range(100)]
    hit = [any(k == "random" for _, _, k in secrets.spans_of(f"the key {s} stands here", ratio)) for s in planted if re.search(r"\d", s) and re.search("[A-Za-z]", s)]
    assert np.mean(hit) > 0.97
    plain = [w for r in docs.limit(300).select("text").collect() for w in re.findall(r"[A-Za-z]{4,}", r.text or "")]
    joined = ["_".join(rng.choices(plain, k=5)) + str(rng.randint(1, 99)) for _ in range(300)]
    wrong = [any(k == "random" for _, _, k in secrets.spans_of(f"see {s} there", ratio)) for s in joined]
    assert np.mean(wrong) < 0.03


def test_empty_and_short_vectors(spark):
    rows = [(0, []), (50, [1.0, 0.5]), (1, [1.0]), (2, [0.5, 0.5, 2.0]), (3, [-1.0])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0, k=3).collect()
    whole = {i: np.floor(256 * np.array([*v, 0.0, 0.0, 0.0])[:3]) for i, v in rows}
    want = [(q, n, i, -s) for q in (0, 50) for n, (s, i) in enumerate(sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:3], 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
