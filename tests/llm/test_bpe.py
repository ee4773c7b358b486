import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " ", "\n\n\n", "x" * 5000, " " * 300, "ab" * 9000, "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", "don't WE'LL  it's", "Überaß 中文字 emoji 😀👨‍👩‍👧 ​　x", "\U0001f600" * 40, "՘a࢏1 ֋!", "1234567890 1a2b", "\r\n\t mixed \x00\x01", "é" * 50, "�"]


LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture
def library():
    return LIBRARY


def same(library, texts):
    trie = bpe.WordTrie(bpe.vocabulary(PATH))
    for text, raw in zip(texts, bpe.encode_texts(trie, texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.vocabulary(PATH).decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False) == text


def test_odd_texts_equal_the_library(library):
    same(library, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text_equals_the_library(texts):
    same(LIBRARY, texts)


def test_random_words_equal_the_library(library):
    rng = random.Random(3)
    common = [t.decode("utf-8", "ignore") for t in rng.sample(sorted(bpe.vocabulary(PATH).ids), 400)]
    same(library, ["".join(rng.choices(common + list("etaoin  "), k=rng.randint(1, 60))) for _ in range(600)])


def test_every_token_that_is_whole_is_its_own_encoding(library):
    vocab = bpe.vocabulary(PATH)
    for raw, i in random.Random(1).sample(sorted(vocab.ids.items()), 3000):
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if len(vocab.words(text)) == 1:
            assert (library.encode(text).ids == [i]) == vocab.is_whole(i)


def test_bytes_that_are_no_text_decode_as_in_the_library(library):
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 8))]
        assert bpe.vocabulary(PATH).decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_a_full_trie_begins_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_NODES", 20)
    trie = bpe.WordTrie(bpe.vocabulary(PATH))
    for text in ["one two three four five six", "one seven", "eight nine ten eleven twelve", "one"]:
        assert np.frombuffer(bpe.encode_texts(trie, [text])[0], "<u4").tolist() == library.encode(text).ids


def test_rows_of_any_kind(spark, library):
    rows = [(1, t, 7) for t in ODD] + [(None, None, 1), (2, None, 2), (3, "a", 0), (3, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = bpe.encode_decode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded, bytes(r.ids)) for r in got) == sorted((i or 0, t or "", np.array(library.encode(t or "").ids, "<u4").tobytes()) for i, t, _ in rows)
    assert bpe.encode_decode(docs.limit(0), PATH).collect() == []


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12_bpe(spark, sf).collect()}
    assert got == want
