import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.tokenizer import DEFAULT_VOCABULARY, TOKENIZER_DIR, Encoder, count_tokens, decode_corpus, encode_corpus, load_vocabulary

tiktoken = pytest.importorskip("tiktoken")


def reference(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=load_vocabulary(path).pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=[DEFAULT_VOCABULARY, f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken"])
def both(request):
    return Encoder(load_vocabulary(request.param)), reference(request.param)


EDGES = ["", " ", "\n\n\n", "a" * 20_000, "ab" * 2000, " " * 5000, "=-" * 500, "é" * 300, "👩‍🔬 ok", "<|endoftext|>x", "1" * 999, "don't they'll", "\x00\x01", "漢字かな交じり文", "﻿x"]


@pytest.mark.parametrize("text", EDGES, ids=range(len(EDGES)))
def test_edges_match_and_round_trip(both, text):
    encoder, ref = both
    ids = encoder.encode(text)
    assert list(ids) == ref.encode_ordinary(text)
    assert encoder.vocabulary.decode(ids).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_matches(text):
    path = DEFAULT_VOCABULARY
    encoder = _ENCODERS.setdefault(path, None) or _ENCODERS.__setitem__(path, (Encoder(load_vocabulary(path)), reference(path))) or _ENCODERS[path]
    assert list(encoder[0].encode(text)) == encoder[1].encode_ordinary(text)


_ENCODERS: dict = {}


def test_random_letter_runs_match(both):
    random.seed(5)
    encoder, ref = both
    for letters in ("abcdefghij ,.éßя漢1\n", "the ingestrouabcd", "aab"):
        for _ in range(400):
            text = "".join(random.choice(letters) for _ in range(random.randint(1, 120)))
            assert list(encoder.encode(text)) == ref.encode_ordinary(text)


def test_decoding_refuses_unknown_ids(both):
    with pytest.raises(ValueError):
        both[0].vocabulary.decode([len(both[0].vocabulary)])


def test_corpus_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "y"), (None, "é" * 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ref = reference(DEFAULT_VOCABULARY)
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(docs).collect()), key=str)
    assert got == sorted(((d, ref.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    assert encode_corpus(docs).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id or 0, r.text) for r in decode_corpus(encode_corpus(docs)).collect()) == sorted((d or 0, t or "") for d, t, _ in rows)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(docs).collect()) == sorted((d or 0, len(ref.encode_ordinary(t or ""))) for d, t, _ in rows)
    assert encode_corpus(docs.where("false")).count() == 0
