"""Encoding, decoding and counting against the libraries themselves."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import documents
from tokenizers import Tokenizer

from ledgerlens.llm import queries, tokencount
from ledgerlens.llm.bpe import Codec

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def noise(alphabet, n, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_codec_equals_library():
    own, library = Codec(WORD), Tokenizer.from_file(WORD)
    alphabet = ["a", "B", "Σ", "ς", "İ", "É", "é", " ", "  ", " ", "\x1c", "\x85", "½", "²", "٣", "_", "-", "'s", "'re", "!", ",", ".", "..", "<|endoftext|>", "漢字", "😀", "ﬁ", "\n", "\x00"]
    for text in noise(alphabet, 3000, 25, 1):
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("chunk", [1, 7, 8192])
def test_counts_equal_library(monkeypatch, chunk):
    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    machine, library = tokencount.Machine(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = noise("abeinrst  ▁\n\t<s>0x0A漢字😀ﬁÉé.,!hello  ", 1500, 60, 2) + ["a" * 3000, " " * 70, "aa, bb.cc\n,,dd ., x"]
    assert [machine.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_counts_do_not_depend_on_memory(monkeypatch):
    monkeypatch.setattr(tokencount, "MAX_STATES", 50)
    monkeypatch.setattr(tokencount, "MAX_WORDS", 3)
    machine, library = tokencount.Machine(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = noise("abeinrst ,", 200, 60, 3)
    assert [machine.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_queries_on_awkward_rows(spark, sf_of, awkward):
    sf = sf_of(documents=documents(awkward))
    library, pieces = Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for doc_id, text in awkward:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = queries.op1_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    want = [(d, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 4096) for d, t in awkward]
    assert sorted(map(tuple, queries.op5_token_counts(spark, sf).collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, sf_of):
    sf = sf_of()
    assert queries.op1_bpe(spark, sf).count() == 0
    assert queries.op5_token_counts(spark, sf).count() == 0
