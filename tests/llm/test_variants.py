import random
import re
import zlib

import pytest

from promptmill.llm import variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 97 == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    vocab = {w: n for w, n in counts.items() if n >= 3}
    out = {}
    for w, n in vocab.items():
        others = [v for v in vocab if near(w, v)]
        best = min(others, key=lambda v: (-vocab[v], v)) if others else None
        form = best if best is not None and vocab[best] >= 2 * n else None
        out[w] = [form, None, n, len(others), vocab[form] if form else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def random_corpus(rng, docs=120):
    stems = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    rows = []
    for d in range(docs):
        words = []
        for _ in range(rng.randint(0, 80)):
            w = rng.choice(stems)
            r = rng.random()
            if r < 0.2 and w:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice("abcdeÉé") + w[i + 1 :]
            elif r < 0.3:
                w = w + rng.choice("xyz")
            elif r < 0.35:
                w = w.upper()
            words.append(w)
        rows.append((d, " ".join(words) + rng.choice(["", "!", " 12 ", "\t"])))
    return rows


def test_affected_bound_holds_for_every_near_pair():
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 12))) for _ in range(3000)}
    frequencies = {}
    for w in words:
        for q in range(variants.Q_MIN, variants.Q_MAX + 1):
            for g in {w[i : i + q] for i in range(len(w) - q + 1)}:
                frequencies[g] = frequencies.get(g, 0) + 1
    grams = variants.Grams(frequencies, len(words))
    assert grams.frequent, "the dictionary must extend some grams"
    words = sorted(words)
    decomposed = {w: grams.decompose(w) for w in words}
    for a in words:
        for b in words:
            if a < b and near(a, b):
                (ta, na), (tb, nb) = decomposed[a], decomposed[b]
                assert len(set(ta) & set(tb)) >= max(len(ta) - na, len(tb) - nb), (a, b)


def test_variants_equal_brute_force(spark, documents):
    rng = random.Random(9)
    rows = random_corpus(rng)
    rows += [(None, rows[0][1]), (5, rows[5][1]), (7, None), (8, "")]
    frame = documents([(d, t, None, None, None) for d, t in rows])
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(frame).collect()}
    assert got == brute(rows)


def test_deletion_rule_matches_the_contract(spark):
    from pyspark.sql import functions as F

    ids = [d for d in range(5000) if zlib.crc32(f"{d}:abcdefgh".encode()) % 97 == 0][:5]
    assert ids
    frame = spark.createDataFrame([(d, "ABCDefgh") for d in ids], "doc_id bigint, text string")
    got = sorted(r.word for r in variants.letter_runs(frame, "doc_id", "text").collect())
    want = []
    for d in ids:
        h = zlib.crc32(f"{d}:abcdefgh".encode())
        k = h % 8
        want.append("abcdefgh"[:k] + "abcdefgh"[k + 1 :])
    assert got == sorted(want)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert variants.variants(empty).count() == 0


def test_registered_query_against_deletion_neighbourhoods(spark):
    """The whole sf0.01 vocabulary against an independent exact method (shared single deletions)."""
    import duckdb

    from promptmill.llm.queries import op11_spelling_variants

    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    vocab = {w: n for w, n in counts.items() if n >= 3}
    keyed = {}
    for w in vocab:
        for k in variants.deletion_keys(w):
            keyed.setdefault(k, []).append(w)
    others = {w: set() for w in vocab}
    for group in keyed.values():
        for a in group:
            for b in group:
                if a != b and near(a, b):
                    others[a].add(b)
    got = {r.word: (r.form, r.n, r.n_near, r.form_n) for r in op11_spelling_variants(spark, sf).collect()}
    assert set(got) == set(vocab)
    for w, n in vocab.items():
        best = min(others[w], key=lambda v: (-vocab[v], v)) if others[w] else None
        form = best if best is not None and vocab[best] >= 2 * n else None
        assert got[w] == (form, n, len(others[w]), vocab[form] if form else None), w
