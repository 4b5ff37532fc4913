import functools
import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from promptmill.llm import bpetree


@pytest.fixture(scope="module")
def byte_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


def expected(path, text):
    t = library(path)
    ids = t.encode(text or "", add_special_tokens=False).ids
    decoded = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def awkward_texts():
    words = "alpha beta  gamma\tdelta\n\nepsilon ünïcödé 日本語 \U0001f600 <|endoftext|> 12345 don't".split(" ")
    long_mixed = " ".join(words[n % len(words)] + str(n % 7) for n in range(3000))
    return [
        (1, long_mixed),
        (2, "a" * 5000),
        (3, "é" * 3001 + "  " + "\U0001f600" * 999),
        (4, None),
        (5, ""),
        (6, "short text"),
        (6, "short text"),
        (None, "   " * 400 + "x" + "\n" * 300),
        (7, "<|endoftext|>" * 300),
        (8, "".join(chr(0x4E00 + (n * 37) % 2000) for n in range(4000))),
    ]


def test_equal_to_library_with_many_leaves(spark, byte_path, documents):
    rows = [(d, t, None, None, None) for d, t in awkward_texts()]
    frame = documents(rows)
    got = sorted(
        (r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
        for r in bpetree.encode(frame, byte_path, piece_chars=97).collect()
    )
    want = sorted((d is None, d, *expected(byte_path, t)) for d, t in awkward_texts())
    assert got == want


def test_repair_agrees_with_whole_encoding(byte_path):
    tokens = bpetree.ByteTokens(byte_path)
    # The file's merges rise with their ids, so the rank encoder is used; its ids are the library's.
    assert tokens.ranked is not None
    texts = [t for _, t in awkward_texts() if t] + ["a<|endoftext|>b", " \n\n  x", "it's 12,345.6 ¿qué?"]
    assert tokens.encode(texts) == [library(byte_path).encode(t, add_special_tokens=False).ids for t in texts]
    text = "the quick  brown fox " * 50 + "ééé" * 40
    whole = tokens.encode([text])[0]
    for cut in (1, 13, 200, 523, len(text) - 3):
        left, right = text[:cut], text[cut:]
        li, ri = tokens.encode([left, right])
        found = bpetree.repair(tokens, left.encode(), li, right.encode(), ri)
        if found is None:
            continue
        a, b, window = found
        assert li[:a] + window + ri[b:] == whole


def test_empty_table(spark, byte_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpetree.encode(empty, byte_path).count() == 0


def test_registered_query_equals_library(spark, byte_path):
    import duckdb

    from promptmill.llm.queries import op12_bpe_tree

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_bpe_tree(spark, sf).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        assert got[doc_id] == expected(byte_path, text), doc_id
