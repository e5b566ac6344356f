"""Token lengths, byte-level BPE and token files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
from scoremart.llm import bpe, queries, token_file, token_lengths
from scoremart.session import scratch_path
from tokenizers import Tokenizer

from .conftest import odd_texts

END = 1


@pytest.fixture(scope="module")
def encoding():
    return token_lengths.rank_encoding(queries.RANKS, vocabularies.PATTERN)


def test_length_histogram_answers_every_limit(spark, odd_docs, no_docs, encoding):
    lengths = np.array([len(encoding.encode_ordinary(x or "")) for _, x in odd_texts()])
    sums = token_lengths.suffix_sums(
        token_lengths.length_histogram(token_lengths.encoded_lengths(odd_docs, queries.RANKS, vocabularies.PATTERN))
    ).cache()
    rows = sums.collect()
    assert len(rows) == len(set(lengths))
    for r in rows:
        n = r["n_tokens"]
        assert r["n_docs"] == (lengths == n).sum() and r["docs_at_least"] == (lengths >= n).sum()
        assert r["tokens_at_least"] == lengths[lengths >= n].sum() and r["docs_at_most"] == (lengths <= n).sum()
        assert r["truncated_tokens"] == np.minimum(lengths, n).sum()
    for limit in (0, 1, 77, 1023, 1024, 10**6):
        assert token_lengths.truncated_total(sums, limit) == np.minimum(lengths, limit).sum()
    assert token_lengths.total_tokens(sums) == lengths.sum()
    for q in (0.1, 0.5, 1.0):
        assert token_lengths.quantile(sums, q) == np.sort(lengths)[int(np.ceil(q * len(lengths))) - 1]
    empty = token_lengths.suffix_sums(token_lengths.length_histogram(token_lengths.encoded_lengths(no_docs, queries.RANKS, vocabularies.PATTERN)))
    assert empty.count() == 0 and token_lengths.total_tokens(empty) == 0
    assert token_lengths.quantile(empty, 0.5) is None and token_lengths.truncated_total(empty, 5) == 0


def test_bpe_round_trip(spark, odd_docs, no_docs, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 3000)
    for blocks in (3000, 1 << 24):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", blocks)
        found = bpe.with_decoded(bpe.encode(odd_docs, queries.RANKS, vocabularies.PATTERN), queries.RANKS).collect()
        got = sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"]), r["n_tokens"]) for r in found), key=repr)
        want = []
        for i, x in odd_texts():
            ids = encoding.encode_ordinary(x or "")
            want.append((i, np.array(ids, "<u4").tobytes(), (x or "").encode(), len(ids)))
        assert got == sorted(want, key=repr)
    digests = bpe.with_decoded(bpe.encode(odd_docs, queries.RANKS, vocabularies.PATTERN), queries.RANKS, digests=True)
    assert {r["decoded_sha256"] for r in digests.collect()} == {hashlib.sha256((x or "").encode()).hexdigest() for _, x in odd_texts()}
    assert bpe.encode(no_docs, queries.RANKS, vocabularies.PATTERN).count() == 0


def test_word_encoder_equals_the_library(monkeypatch):
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    rng = random.Random(2)
    letters = "áâçµªº²¼\x1c\x1dabcABCéÉß' .,!12½\xa0\x85İΣσ́中٠​\t\n<|endoftext|>'s'LL&\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts[7::50] = [x[:9] + rng.choice(["<|endoftext|>", " <|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|> é's"]) + x[9:] for x in texts[7::50]]
    monkeypatch.setattr(token_file, "MEMORY", 200)
    encoder = token_file.WordEncoder(queries.WORD_TOKENIZER)
    for low in range(0, 3000, 500):
        for text, ids in zip(texts[low : low + 500], encoder.encode(texts[low : low + 500], END), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [END], repr(text)


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(4)
    for limit, counts in ((16, rng.integers(0, 50, 40)), (5, 2 ** np.arange(20)), (16, np.array([0, 7, 0])), (16, np.zeros(3, int))):
        size = token_file.code_lengths(np.asarray(counts), limit)
        used = counts > 0
        assert (size[used] > 0).all() and (size[~used] == 0).all() and size.max() <= limit
        assert (2.0 ** -size[used]).sum() <= 1
    # Fibonacci weights: without a limit the optimal code is known.
    assert sorted(token_file.code_lengths(np.array([1, 1, 2, 3, 5, 8]))) == [1, 2, 3, 4, 5, 5]


def test_token_file_round_trip(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 700)
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    path = scratch_path(spark, "test-tokens")
    token_file.write_token_file(token_file.staged_ids(odd_docs, queries.WORD_TOKENIZER, END), path)
    found = token_file.read_token_file(spark, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    want = sorted((str(i), *library.encode(x or "", add_special_tokens=False).ids, END) for i, x in odd_texts())
    assert sorted((str(r["doc_id"]), *np.frombuffer(r["ids"], "<u4").tolist()) for r in found) == want
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    sums = {r["start"]: r["ids_crc32"] for r in token_file.read_token_file(spark, path, digest=True).collect()}
    assert sums == {r["start"]: zlib.crc32(bytes(r["ids"])) for r in found}
    path = scratch_path(spark, "test-tokens")
    token_file.write_token_file(token_file.staged_ids(no_docs, queries.WORD_TOKENIZER, END), path)
    assert token_file.read_token_file(spark, path).count() == 0
