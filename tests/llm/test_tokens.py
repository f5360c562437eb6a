"""Token counts, BPE and packing against the libraries."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from driftline.llm.byte_bpe import ByteBpe, crc32, encode_documents, encoding_digests, library_encoder
from driftline.llm.packing import best_fit, pack_documents
from driftline.llm.queries import tokenizer_path
from driftline.llm.token_count import count_tokens

from .conftest import pairs

PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BYTES)
    model.no_truncation()
    model.no_padding()
    return model


def test_token_counts_are_those_of_the_library(spark, odd, sample):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (odd, sample):
        want = sorted(((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in docs.select("doc_id", "text").collect()), key=repr)
        assert pairs(count_tokens(docs, PIECES), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_equal_neighbours_merge_from_the_left(spark):
    import sentencepiece

    texts = ["a" * n for n in range(1, 40)] + ["the" * n for n in range(1, 12)] + ["  the", "the  ", "  ", "0" * 31, "▁▁x", "東京東京", "\U0001f600" * 3]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pairs(count_tokens(docs, PIECES), "doc_id", "n_tokens") == sorted(((k, len(model.encode(t))) for k, t in enumerate(texts)), key=repr)


def test_encoding_and_decoding(spark, odd, sample, library):
    for docs in (odd, sample):
        want = []
        for i, t in docs.select("doc_id", "text").collect():
            ids = library.encode(t or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert pairs(encoding_digests(docs, BYTES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_ids_and_texts_go_round(spark, odd):
    for text, back in odd.select("doc_id", "text").join(encode_documents(odd, BYTES).select("doc_id", "decoded"), "doc_id").where("doc_id <> 30").select("text", "decoded").collect():
        assert back == (text or "")


def test_halves_joined_are_the_whole(library):
    bpe = ByteBpe(BYTES)
    texts = ["x" * 5000, "ab" * 3000, "é" * 700, "".join(chr(97 + k * k % 26) for k in range(4000))]
    assert bpe.unsplit([t.encode() for t in texts]) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_piece_is_encoded_once_whatever_stands_beside_it(library):
    from driftline.llm.byte_bpe import tree_encoder

    encoder, asked = tree_encoder(BYTES), []
    plain = encoder.missing
    encoder.missing = lambda pieces: asked.extend(pieces) or plain(pieces)
    texts = ["so qyx, qyx. qyx;\n\nqyx", "so qyx! qyx<|endoftext|> qyx's\n  qyx", None, ""]
    try:
        found = [np.frombuffer(b"".join(parts), "<u4").tolist() for text in texts for parts in encoder.encode([text])]
    finally:
        encoder.missing = plain
    assert found == [library.encode(text or "", add_special_tokens=False).ids for text in texts]
    pieces = {piece for text in texts for piece in encoder.bpe.pretokens(text or "")}
    assert len(asked) == len(set(asked)) and " qyx" in asked and set(asked) <= pieces


def test_both_libraries_agree(odd, library):
    texts = [r[0] for r in odd.select("text").collect()] + [" " * 500 + "x", "a" * 20000, "don't  we'll\n\n\n 12,5"]
    assert [ids.tolist() for ids in library_encoder(BYTES).encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_best_fit_takes_the_fullest_bin():
    place, offset, fill = best_fit(np.array([5, 7, 3, 5]), 10)
    assert fill.tolist() == [10, 10] and place.tolist() == [1, 0, 0, 1] and offset.tolist() == [0, 0, 7, 5]


def test_packing(spark, odd, sample, library):
    for docs in (odd, sample):
        want = defaultdict(list)
        for i, t in docs.select("doc_id", "text").collect():
            want[i].append(library.encode(t or "", add_special_tokens=False).ids + [0])
        rows = pack_documents(docs, BYTES).collect()
        bins, seen = defaultdict(list), defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
            assert any(crc32(np.array(ids[r.start : r.start + r.length])) == r.ids_crc32 for ids in want[r.doc_id])
            seen[r.doc_id].append((r.start, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at and length > 0
                at += length
            assert at <= 2048
        assert {i: sum(map(len, ids)) for i, ids in want.items()} == {i: sum(n for _, n in parts) for i, parts in seen.items()}
        short = {i for i, ids in want.items() if all(len(x) <= 2048 for x in ids)}
        assert all(r.piece == 0 for r in rows if r.doc_id in short)
        assert len(bins) <= np.ceil(sum(len(x) for ids in want.values() for x in ids) / 2048 * 1.02) + 1


def test_crc_is_that_of_little_endian_ids():
    assert crc32(np.array([1, 70000])) == zlib.crc32(bytes([1, 0, 0, 0, 0x70, 0x11, 1, 0]))


def test_empty_tables(empty):
    for out in (count_tokens(empty, PIECES), encoding_digests(empty, BYTES), encode_documents(empty, BYTES), pack_documents(empty, BYTES)):
        assert out.count() == 0
