"""Byte-pair transducer against the tokenizers library, the lookahead by force, and the decoder's state."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import BLOCK, Decoder, Encoder, Merges, Word, decode, encode, lookahead
from tidemark.llm.queries import op13_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return json.load(f)


@pytest.fixture(scope="module")
def encoder(spec):
    return Encoder(spec)


def test_every_code_point(encoder, library):
    for low in range(0, 0x30000, 0x400):
        text = "".join(f"a{chr(c)}b " for c in range(low, low + 0x400) if not 0xD800 <= c < 0xE000)
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size, long", [(BLOCK, 4096), (1, 3), (7, 5), (33, 20)])
def test_hard_texts_in_blocks_of_any_size(encoder, library, spec, size, long):
    rng = random.Random(size)
    tokens = [t.removesuffix("</w>") for t in spec["model"]["vocab"] if t.isascii()]
    makers = [
        lambda: "".join(rng.choice(tokens) for _ in range(150)),
        lambda: "".join(rng.choice("aeinrst'! \n") for _ in range(1500)),
        lambda: "".join(chr(rng.choice([rng.randint(32, 0x250), rng.randint(0x300, 0x36F), rng.randint(0x1100, 0x11FF), 0x130, 0x3A3, 0x27, 32])) for _ in range(200)),
        lambda: "".join(rng.choice(["'", "r", "e", "'re", "'s", "ll", "1", "!!", " ", "É"]) for _ in range(200)),
        lambda: "".join(rng.choice(["ha", "lol", "o", "!", "'"]) * rng.randint(1, 60) for _ in range(30)),
    ]
    for k in range(60):
        text = makers[k % len(makers)]()
        assert [i for ids in encoder.plain(text, size, long) for i in ids] == library.encode(text, add_special_tokens=False).ids


def test_special_tokens_are_found_first(encoder, library):
    text = "<|endoftext|>a<|STARTOFTEXT|><|startoftext|><|endoftext|> <|endoftext"
    assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_word_of_millions_of_bytes_is_never_held(encoder, library):
    word = Word(encoder.merges)
    piece = ("motivationmondayhahahahaha" * 400).encode()
    ids, most = [], 0
    for _ in range(100):
        ids += word.feed(piece)
        most = max(most, len(word.held))
    ids += word.end()
    assert most <= word.block
    assert ids == library.encode((piece * 100).decode(), add_special_tokens=False).ids


def test_lookahead_of_small_lists_holds_for_all_words():
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("b", "ba"), ("aba", "b")]
    letters = {c: i for i, c in enumerate("ab")}
    vocab = dict(letters)
    for u, v in merges:
        vocab.setdefault(u + v, len(vocab))
    made = Merges.__new__(Merges)
    made.rank = {(vocab[u], vocab[v]): k for k, (u, v) in enumerate(merges)}
    made.made = [vocab[u + v] for u, v in merges]
    size = {i: len(t) for t, i in vocab.items()}

    def bounds(word):
        at = [0]
        for i in made.apply([letters[c] for c in word]):
            at.append(at[-1] + size[i])
        return set(at)

    words = [""]
    for _ in range(11):
        words += [w + c for w in words if len(w) == max(map(len, words)) for c in "ab"]
    reach = lookahead(merges)
    for word in words:
        whole = bounds(word)
        for end in range(reach, len(word)):
            start = bounds(word[:end])
            assert {b for b in start if b <= end - reach} == {b for b in whole if b <= end - reach}


def test_list_that_is_not_proper_is_refused(spec):
    model = spec["model"] | {"merges": [["ab", "c"], ["a", "b"]], "vocab": spec["model"]["vocab"] | {"ab": 1, "abc": 2}}
    with pytest.raises(ValueError):
        Merges(spec | {"model": model})


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_decoder_at_any_cut(name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        decoder = Decoder(json.load(f))
    ids = np.array(tokenizer.encode("Größe 日本語 😀!  <|endoftext|> x", add_special_tokens=False).ids[:-1], "<u4")
    want = tokenizer.decode(ids.tolist(), skip_special_tokens=False)
    assert all(decoder.text(ids, step) == want for step in (1, 2, 3, 1000))
    assert decoder.text(ids[:0]) == ""


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: r for r in op13_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want


def test_odd_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "y"), (None, "Hello", "z"), (2, "it's " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode(encode(docs, PATH), PATH).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in out] == [0, 0, 1, 60_000] and out[0].text == "" and out[2].doc_id is None
    assert out[3].text == library.decode(library.encode(rows[3][1], add_special_tokens=False).ids, skip_special_tokens=False)
    assert decode(encode(docs.where(F.lit(False)), PATH), PATH).count() == 0
