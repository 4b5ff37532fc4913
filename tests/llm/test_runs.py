import hashlib
import random
import zlib

import numpy as np
import pytest

from promptmill.llm import runs


def brute_runs(words):
    """Every maximal stretch of smallest period q and length >= max(6, 4q), by checking all q."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            block = words[s : s + q]
            smallest = next(p for p in range(1, q + 1) if all(block[k] == block[k - p] for k in range(p, q)) and q % p == 0)
            if length >= max(6, 4 * q) and smallest == q:
                found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_digests(words):
    found = brute_runs(words)
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = set()
    for s, length, q in found:
        gone.update(range(s + q, s + length))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None, None, None, None)
    return (len(found), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def random_words(rng, n):
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3:
            block = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            out += block * rng.randint(1, 8) + block[: rng.randint(0, len(block))]
        else:
            out.append(rng.choice("abcdefgh"))
    return out[:n]


def test_solver_equals_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        words = random_words(rng, rng.randint(0, 120))
        spec = (len(words), 0, max(runs.octaves(len(words)), default=-1), 0, len(words), 0, len(words))
        got = runs.runs_of(runs.solve([words], [spec])[0])
        assert got == brute_runs(words), words


def test_digests_equal_brute_force():
    rng = random.Random(11)
    for _ in range(100):
        words = random_words(rng, rng.randint(0, 80))
        spec = (len(words), 0, max(runs.octaves(len(words)), default=-1), 0, len(words), 0, len(words))
        assert runs.digests(words, runs.runs_of(runs.solve([words], [spec])[0])) == brute_digests(words)


def planted_words(doc_id, text):
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def test_long_documents_are_tiled_and_stitched(spark, documents, monkeypatch):
    # Small tiles: many tiles per octave, runs across tile edges, several octave groups.
    monkeypatch.setattr(runs, "TILE_WORDS", 64)
    monkeypatch.setattr(runs, "SHARED_OCTAVES", 3)
    rng = random.Random(3)
    texts = [" ".join(random_words(rng, rng.randint(0, 700))) for _ in range(25)]
    texts += [" ".join(["x", "y"] * 300), " ".join(["w"] * 500), " ".join([f"u{n % 37}" for n in range(900)])]
    rows = [(n, t, None, None, None) for n, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), (0, texts[0], None, None, None), (99, None, None, None, None), (98, "", None, None, None)]
    got = sorted(
        ((r.doc_id is None, r.doc_id, *r[1:]) for r in runs.periodic_runs(documents(rows)).collect()), key=lambda r: (r[0], r[1] or 0, r[-1])
    )
    want = sorted(((d is None, d, *brute_digests(planted_words(d, t))) for d, t, *_ in rows), key=lambda r: (r[0], r[1] or 0, r[-1]))
    assert got == want


def test_planted_period_matches_the_contract(spark):
    from pyspark.sql import functions as F

    ids = [n for n in range(3000) if zlib.crc32(str(n).encode()) % 10 == 0][:20]
    text = " ".join(f"w{k}" for k in range(57))
    frame = spark.createDataFrame([(i, text) for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.w for r in frame.select("doc_id", runs.planted(runs.words_of(F.col("text")), F.col("doc_id")).alias("w")).collect()}
    assert got == {i: planted_words(i, text) for i in ids}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert runs.periodic_runs(empty).count() == 0


def test_registered_query_against_brute_force(spark):
    import duckdb

    from promptmill.llm.queries import op13_periodic_runs

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r[1:]) for r in op13_periodic_runs(spark, sf).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(texts)
    checked = 0
    for doc_id, text in texts:
        words = planted_words(doc_id, text)
        if len(words) <= 1500:
            assert got[doc_id] == brute_digests(words), doc_id
            checked += 1
    assert checked > len(texts) // 2
