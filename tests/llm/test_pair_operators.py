"""Fingerprints, search, lines, mixing, SimHash groups and the pipeline against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from promptmill.llm import edits, fingerprints, lines, mixing, neardocs, simhash, topk
from promptmill.llm.components import components
from promptmill.llm.succession import with_successor


class Forest:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    chance = random.Random(4)
    links = {
        "random": [(chance.randrange(300), chance.randrange(300)) for _ in range(200)] + [(5, 5), (9, 8), (8, 9)],
        "chain": [(n, n + 1) for n in range(200)],
        "star": [(0, n) for n in range(1, 300)],
        "none": [],
    }[shape]
    forest = Forest(range(400))
    for a, b in links:
        forest.link(a, b)
    want = {n: forest.root(n) for a, b in links if a != b for n in (a, b)}
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want


# --- fingerprints ---------------------------------------------------------------


def test_components_leave_no_finished_rounds(spark, monkeypatch):
    """Each round begins after the driver has dropped what the rounds before it left."""
    from promptmill.sinks import scratch

    calls, stored = [], scratch.stored_table
    monkeypatch.setattr(scratch, "forget_finished", lambda session: calls.append("gc"))
    monkeypatch.setattr(scratch, "stored_table", lambda rows: calls.append("round") or stored(rows))
    components(spark.createDataFrame([(n, n + 1) for n in range(20)], "a bigint, b bigint")).count()
    assert calls[0] == "round" and calls[1:] == ["gc", "round"] * (len(calls) // 2) and len(calls) > 4


def shingles(text, words=5):
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(parts[n : n + words]) for n in range(max(1, len(parts) - words + 1))} if parts else set()


def test_likeness_estimates_jaccard(spark):
    chance = random.Random(6)
    vocabulary = [f"w{n}" for n in range(5000)]
    pairs = []
    for n in range(60):
        a = [chance.choice(vocabulary) for _ in range(400)]
        cut = 400 * n // 60
        pairs.append((" ".join(a), " ".join(a[:cut] + [chance.choice(vocabulary) for _ in range(400 - cut)])))
    frame = spark.createDataFrame(pairs, "a string, b string")
    found = frame.select("a", "b", fingerprints.likeness(*[fingerprints.fingerprint(F.col(c)) for c in "ab"]).alias("s"))
    errors = [r.s - len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a) | shingles(r.b)) for r in found.collect()]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_fingerprints_awkward(spark, documents, awkward):
    rows = fingerprints.fingerprints(documents(awkward)).collect()
    assert len(rows) == len(awkward)
    by_text = defaultdict(set)
    for r, row in zip(rows, awkward):
        by_text[" ".join((row[1] or "").split())].add(r.fingerprint)
        assert len(r.fingerprint) == (256 if (row[1] or "").split() else 0)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprints(documents([])).collect() == []
    same, mixed = fingerprints.likeness(F.lit(""), F.lit("")), fingerprints.likeness(F.lit(""), F.lit("0" * 256))
    assert tuple(spark.range(1).select(same, mixed).first()) == (1.0, 0.0)


def test_densified_bins_follow_the_rule(spark):
    minima = [fingerprints._EMPTY] * fingerprints.BINS
    full = {3: 11, 77: 12, 200: 13}
    for b, v in full.items():
        minima[b] = v
    frame = spark.createDataFrame([(minima,)], "m array<bigint>")
    got = frame.select(fingerprints.densify(F.col("m"))).first()[0]
    assert all(got[b] == v for b, v in full.items()) and set(got) == set(full.values())
    assert min(got.count(v) for v in full.values()) > 40


@pytest.mark.parametrize("ids", [[5], [0, 1023, 1024, 5000, 10**7, 10**7 + 1, -3000], [None, None, 4, 4, 9]])
def test_successor(spark, ids):
    rows = [(i, f"text {n}") for n, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = with_successor(frame, {"text": lambda t: t}).collect()
    marks = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1]]))
    want = {(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


# --- search -----------------------------------------------------------------------


def plain_top_k(rows, k):
    usable = {
        (i, tuple(int(np.floor(256 * float(x))) for x in v))
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    }
    want = []
    for i, v in usable:
        if i % 50 == 0:
            best = sorted(
                (-sum(x * y for x, y in zip(v, w)), j) for j, w in usable if (j, w) != (i, v) and len(w) == len(v)
            )[:k]
            want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    return sorted(want)


def test_top_k(spark):
    chance = np.random.default_rng(7)
    # Coarse values make many ties.
    rows = [(n, (chance.integers(-3, 4, 8) / 4).tolist()) for n in range(700)]
    rows += [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (1050, None), (1100, []), (1150, [float("nan")] * 8)]
    rows += [(1200, [float("inf")] + [0.0] * 7), (1250, [None] + [0.0] * 7), (None, [0.5] * 8), rows[50], rows[50]]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS dim", "3 AS key")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == plain_top_k(rows, 5)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_skip_exact_reads():
    chance = np.random.default_rng(1)
    exact = chance.normal(0, 60, (2000, 16)).astype(np.int64)
    cells, grid = topk._quantised(exact)

    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, rows):
            Counting.read += len(rows)
            return np.asarray(self).__getitem__(rows)

    block = {
        "ids": np.arange(2000), "keys": np.arange(2000), "exact": exact.view(Counting),
        "cells": np.frombuffer(cells, np.uint8).reshape(-1, 16), "grid": np.frombuffer(grid).reshape(2, 16),
    }
    _, found, score = topk.best_in_block(exact[:1], np.array([0]), np.array([0]), block, 5)
    want = sorted((-(exact[1:] @ exact[0])).tolist())[:5]
    assert (-score).tolist() == want and 0 not in found and Counting.read < 500


def test_large_slots_across_turns(spark, monkeypatch):
    """Slots that are cut by turns, and slots beyond the limit, lose no near pair."""
    monkeypatch.setattr(simhash, "TURN_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    chance = random.Random(8)
    points = {chance.getrandbits(63) for _ in range(6)}
    for point in list(points):
        points |= {point ^ 1 << chance.randrange(63) ^ 1 << chance.randrange(63) for _ in range(12)}
    points = sorted(points)
    slots = {p: [n for n in range(5) if n == 0 or chance.random() < 0.3] for p in points}
    rows = spark.createDataFrame([(p, slots[p]) for p in points], "point bigint, slots array<int>")
    want = Forest(points)
    for a in points:
        for b in points:
            if bin(a ^ b).count("1") <= 3:
                want.link(a, b)
    try:
        for limit in (9, 40, 1000):
            got = Forest(points)
            for a, b in simhash.near_links(rows, 3, limit, F.col("slots")).collect():
                assert bin(a ^ b).count("1") <= 3 or want.root(a) == want.root(b)
                got.link(a, b)
            assert [got.root(p) for p in points] == [want.root(p) for p in points]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- lines ----------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(row[j] + 1, following[-1] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


def test_edit_distance():
    chance = random.Random(9)
    for _ in range(500):
        a, b = ("".join(chance.choice("abé") for _ in range(chance.randrange(12))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain_distance(a, b)


def test_edits_side_by_side(monkeypatch):
    """Blocks of pairs, of any size, against the distance of each pair."""
    chance = random.Random(3)
    texts = [""]
    for _ in range(60):
        letters = [chance.choice("abc é\U0001f600") for _ in range(chance.choice((1, 5, 30, 120)))]
        texts.append("".join(letters))
        for _ in range(chance.choice((0, 1, 4, 12))):
            letters[chance.randrange(len(letters))] = chance.choice(("", "q", "xy"))
        texts.append("".join(letters))
    letters, starts = edits.letters_of(texts)
    pairs = [(n, n + 1) for n in range(len(texts) - 1)]
    pairs += [(chance.randrange(len(texts)), chance.randrange(len(texts))) for _ in range(300)]
    first, second = np.array(pairs).T
    allowed = np.array([chance.choice((0, 1, 3, 9, 30, 240)) for _ in pairs])
    distances = np.array([lines.edit_distance(texts[a], texts[b]) for a, b in pairs])
    for chars, cells in ((1 << 19, 1 << 15), (900, 100)):
        monkeypatch.setattr(edits, "BLOCK_CHARS", chars)
        monkeypatch.setattr(edits, "BLOCK_CELLS", cells)
        assert (edits.within_edits(letters, starts, first, second, allowed) == (distances <= allowed)).all()


def test_verified_in_slices(monkeypatch):
    """Many groups go through a task in small slices of text, one group at a time at least."""
    taken = []

    def alike(texts):
        taken.append(sum(map(len, texts)))
        return lines.edits_alike(0.9)(texts)

    monkeypatch.setattr(lines, "VERIFIED_BYTES", 2000)
    chance = random.Random(5)
    groups = [["".join(chance.choice("abcdefgh ") for _ in range(100))] for _ in range(80)]
    for group in groups:
        group += [group[0][:50] + "#" * edits_ + group[0][50 + edits_ :] for edits_ in (4, 10, 40)]
    group = pa.array(
        [[{"key": t.encode(), "simhash": 0, "text": t, "share": 0} for t in g] for g in groups],
        pa.list_(pa.struct([("key", pa.binary()), ("simhash", pa.int64()), ("text", pa.string()), ("share", pa.int32())])),
    )
    batch = pa.RecordBatch.from_arrays([pa.array([True] * 80), group], ["inside", "lines"])
    found = []
    for part in lines._group_slices(batch):
        items, sizes = part.column("lines").flatten(), np.full(part.num_rows, 4)
        blocks = lines._near_in_groups(items.field("simhash").to_numpy().view(np.uint64), sizes, 3)
        texts = items.field("text").to_pylist()
        found += [(texts[a], texts[b]) for a, b in lines._connecting(blocks, len(texts), alike(texts)).tolist()]
    assert len(taken) > 10 and max(taken) <= 2400
    want, got = Forest(t for g in groups for t in g), Forest(t for g in groups for t in g)
    for a, b in found:
        got.link(a, b)
    for g in groups:
        for a in g:
            for b in g:
                if lines.similar(a, b, 0.9):
                    want.link(a, b)
    nodes = list(want.up)
    assert [got.root(n) for n in nodes] == [want.root(n) for n in nodes] and len(found) == 160


def test_near_pairs_of_a_large_group_come_in_blocks(monkeypatch):
    """A group of near copies never has all its pairs in memory, and none is left out."""
    monkeypatch.setattr(lines, "PAIRS_AT_ONCE", 1000)
    marks = np.random.default_rng(4).integers(0, 8, 330).astype(np.uint64)
    sizes = np.array([2, 300, 1, 2, 25])
    blocks = list(lines._near_in_groups(marks, sizes, 3))
    assert max(a.size for a, _, _ in blocks) <= 1000
    want, begin = [], 0
    for size in sizes.tolist():
        want += [(a, b) for a in range(begin, begin + size) for b in range(a + 1, begin + size)]
        begin += size
    assert sorted((a, b) for first, second, _ in blocks for a, b in zip(first.tolist(), second.tolist())) == want
    links = lines._connecting(iter(blocks), 330, lambda a, b: (a - b) % 7 == 0)
    assert len(links) == 293 + 18


def plain_lines(rows):
    """Texts without repeated lines, from all pairs of lines; rows are (doc_id, text)."""
    places, texts = defaultdict(list), {}
    for doc_id, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if len(line.lower().split()) >= 5:
                places[lines.normalised(line)].append((doc_id, n))
    keys = sorted(places)
    marks = {k: int(lines.line_hashes([k], 5)[3][0]) for k in keys}
    forest = Forest(keys)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            near = bin((marks[a] ^ marks[b]) & (1 << 64) - 1).count("1") <= 3
            if near and plain_distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9):
                forest.link(a, b)
    firsts = defaultdict(lambda: (10**9,))
    for k in keys:
        firsts[forest.root(k)] = min(firsts[forest.root(k)], *places[k])
    gone = {p for k in keys for p in places[k] if p != firsts[forest.root(k)]}
    for doc_id, text in rows:
        parts = (text or "").split("\n")
        texts[doc_id] = "\n".join(p for n, p in enumerate(parts) if (doc_id, n) not in gone)
    return texts


def test_fuzzy_lines(spark, documents, monkeypatch):
    monkeypatch.setattr(lines, "VERIFIED_ROWS", 4)
    chance = random.Random(11)
    vocabulary = [f"wort{n}" for n in range(400)]
    base = [[chance.choice(vocabulary) for _ in range(40)] for _ in range(12)]

    def line():
        words = list(chance.choice(base))
        if chance.random() < 0.6:
            words[chance.randrange(40)] = chance.choice(vocabulary)
        if chance.random() < 0.1:
            chance.shuffle(words)
        return (" " * chance.randrange(3)).join(["", " ".join(words), ""]).replace("w", chance.choice("wW"), 1)

    rows = [(n, "\n".join(line() for _ in range(chance.randrange(1, 6))) + "\nshort line") for n in range(60)]
    docs = documents([(*r, "en", "s", 1) for r in rows])
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    want = plain_lines(rows)
    assert got == want and any(want[n] != t for n, t in rows)


def test_large_cluster_meets_slot_by_slot(spark):
    """Lines chained into one large cluster were all dealt to all shares, rows in the square of the lines (F1, F2)."""
    chain = [(f"c{n:02d}", 1, [n, n + 1]) for n in range(64)]
    copies = [(f"h{n:02d}", 2, [900, 901]) for n in range(40)]
    small = [(f"s{n}", 3, [7 + n]) for n in range(3)]
    every = {key: (cluster, set(slots)) for key, cluster, slots in [*chain, *copies, *small]}
    frame = spark.createDataFrame([(k.encode(), c, s) for k, c, s in [*chain, *copies, *small]], "key binary, cluster bigint, slots array<bigint>")
    got = lines.units(frame.select("key", "cluster"), frame.select("key", "slots"), 4).collect()
    met = defaultdict(set)
    for r in got:
        met[r.cluster, r.slot, r.shares].add(bytes(r.key).decode())
    assert sum(len(keys) * unit[2] for unit, keys in met.items() if unit[0] == 1) == 2 * 63
    assert all(-(-len(keys) // 4) == unit[2] for unit, keys in met.items())
    assert met[2, None, 10] == {k for k, _, _ in copies} and met[3, None, 1] == {k for k, _, _ in small}
    for a, (cluster, slots) in every.items():
        for b, (other, others) in every.items():
            if a < b and cluster == other and slots & others:
                assert any({a, b} <= keys for keys in met.values())


def test_repeated_lines_leave_little_scratch(spark, documents, monkeypatch):
    """Tables of finished steps go at once; they stayed until the session ended (F1, F2)."""
    released = []
    monkeypatch.setattr(lines, "release", lambda path: released.append(path))
    docs = documents([(n, f"one line of several words {n % 3}\nand another line of words", "en", "s", 1) for n in range(9)])
    assert lines.drop_repeated_lines(docs).filter("_dropped > 0").count() == 8
    assert len(set(released)) >= 4


def test_lines_awkward(spark, documents, awkward):
    docs = documents(awkward)
    got = lines.drop_repeated_lines(docs).collect()
    assert len(got) == len(awkward)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.text, r._lines, r._dropped))
    assert by_id[1][0][2] == 0 and all(t == "" and d == 1 for t, _, d in by_id[2])
    assert by_id[3] == [(None, 0, 0)] and by_id[5][0][0] == awkward[7][1]
    assert docs.columns == [c for c in got[0].__fields__ if c not in ("_lines", "_dropped")]
    assert lines.drop_repeated_lines(documents([])).collect() == []


def edited(words, chance, share):
    """A line whose edit similarity to the one of ``words`` is 1 - share or a little more."""
    line = " ".join(words)
    letters = list(line)
    for at in chance.sample(range(len(letters)), max(1, int(share * len(letters)))):
        letters[at] = chance.choice("abcdefgh")
    return "".join(letters)


def test_fuzzy_lines_recall(spark, tmp_path, documents):
    """The query and the stage against edit similarity alone: no bit filter in the brute force."""
    from promptmill.llm.queries import JOBS

    chance = random.Random(23)
    rows = []
    for n in range(150):
        words = ["".join(chance.choice("abcdefghijklmnoprstu") for _ in range(chance.randrange(3, 9))) for _ in range(chance.choice((6, 12, 50)))]
        rows += [(n, " ".join(words)), (1000 + n, edited(words, chance, 0.03))]
    keys = [lines.normalised(t) for _, t in rows]
    forest = Forest(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if lines.similar(keys[a], keys[b], 0.9):
                forest.link(a, b)
    gone = {rows[n][0] for n in range(len(rows)) if forest.root(n) != n}
    assert len(gone) == 150
    docs = documents([(*r, "en", "s", 1) for r in rows], extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in JOBS["op4_fuzzy_lines"](spark, str(tmp_path)).collect() if r.n_dropped}
    assert got <= gone and len(got) >= 0.93 * len(gone)
    assert {r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {r[0] for r in rows} - got


def test_short_lines_and_lines_without_blanks(spark, tmp_path, documents):
    from promptmill.llm.queries import JOBS

    chinese = "敏捷的棕色狐狸跳过了那只懒惰的狗然后沿着河流一直跑到森林的尽头"
    rows = [
        (1, f"All rights reserved.\n\n}}\n{chinese}\nabcdefgh"),
        (2, f"all rights  reserved.\n\n}}\n{chinese}\nabcdefgx"),
        (3, f"own\n{chinese.replace('森林', '村庄')}\n \n"),
    ]
    docs = documents([(*r, "en", "s", 1) for r in rows], extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in JOBS["op4_fuzzy_lines"](spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "\nabcdefgx", 3: "own\n \n"}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == got


# --- mixing ---------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    left, rest, target = set(order), share * sum(sizes.values()), {}
    while left:
        unit = rest / sum(weight[s] for s in left)
        full = [s for s in left if unit * weight[s] > most * sizes[s]]
        if not full:
            return target | {s: unit * weight[s] for s in left}
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
            left.remove(s)
    return target


def test_mix(spark, documents):
    chance = random.Random(13)
    rows = []
    for n in range(400):
        source = chance.choice(["a", "a", "a", "b", "c", "dé", None])
        rows.append((n, " ".join("w" for _ in range(chance.randrange(0, 300))), None, source, 0))
    pieces, taken = mixing.mix(documents(rows), (5, 2, 1), block_words=32)
    got = taken.collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    sizes, words = defaultdict(int), {r[0]: len(r[1].split()) for r in rows}
    for r in rows:
        sizes[r[3]] += words[r[0]]
    targets, sums = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r["size"] == words[r.doc_id] and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(targets[r.source])
        sums[r.source] += r.taken
    for source, target in targets.items():
        assert abs(sums[source] - target) <= 32 * 6
    # Early slots already hold every source in its share.
    everything = sum(targets.values())
    early = pieces.filter("slot < 64").groupBy("place").agg(F.sum("words").alias("words")).collect()
    order = sorted(targets, key=lambda s: (s is None, s or ""))
    for r in early:
        assert abs(r.words / (64 * 32) - targets[order[r.place]] / everything) < 0.1
    assert sorted(map(tuple, mixing.mix(documents(rows), (5, 2, 1), block_words=32)[1].collect())) == sorted(map(tuple, got))


def test_mix_awkward(spark, documents, awkward):
    _, taken = mixing.mix(documents(awkward), (5, 2, 1))
    rows = taken.collect()
    assert len(rows) == len(awkward) and all(r.taken <= 2 * r["size"] for r in rows)
    copies = mixing.mixed_documents(documents(awkward), (5, 2, 1)).collect()
    assert {r.text for r in copies} <= {r[1] for r in awkward if (r[1] or "").split()}
    for part in mixing.mix(documents([]), (5, 2, 1)):
        assert part.collect() == []


# --- SimHash --------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_within_matches_bit_counts():
    chance = np.random.default_rng(3)
    points = chance.integers(0, 1 << 63, 150, np.uint64)
    points[75:] = points[:75] ^ np.uint64(0b1011)
    for radius in (0, 1, 2, 3, 4, 6):
        near = simhash.within(points[:70], simhash.planes_of(points), 150, radius)
        assert (near == (np.bitwise_count(points[:70, None] ^ points[None]) <= radius)).all()


@pytest.mark.parametrize("slot_rows", [4096, 8])
def test_near_links_connect_what_is_near(spark, slot_rows):
    chance = random.Random(17)
    points = {chance.getrandbits(63) for _ in range(150)}
    for p in list(points)[:60]:
        for _ in range(chance.randrange(1, 4)):
            q = p
            for _ in range(chance.randrange(1, 5)):
                q ^= 1 << chance.randrange(63)
            points.add(q)
    points = sorted(points)
    forest = Forest(points)
    for n, a in enumerate(points):
        for b in points[n + 1 :]:
            if (a ^ b).bit_count() <= 3:
                forest.link(a, b)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in points], "p bigint"), 3, slot_rows).collect()
    found = Forest(points)
    for a, b in links:
        found.link(a, b)
    assert {p: found.root(p) for p in points} == {p: forest.root(p) for p in points}


def test_near_groups(spark, documents, awkward):
    got = simhash.near_groups(documents(awkward)).collect()
    assert len(got) == len(awkward)
    prints = [(r[0], plain_fingerprint(r[1])) for r in awkward]
    points = sorted({p for _, p in prints})
    forest = Forest(points)
    for a in points:
        for b in points:
            if (a ^ b).bit_count() <= 3:
                forest.link(a, b)
    least = {root: min((i for i, p in prints if i is not None and forest.root(p) == root), default=None) for root in map(forest.root, points)}
    want = sorted((str(i), p, str(least[forest.root(p)])) for i, p in prints)
    assert sorted((str(r.doc_id), r.fingerprint & (1 << 64) - 1, str(r.component_id)) for r in got) == want
    assert simhash.near_groups(documents([])).collect() == []
    kept = simhash.keep_one(documents(awkward))
    assert kept.count() == len({forest.root(p) for p in points}) and kept.columns == documents(awkward).columns


# --- pipeline -------------------------------------------------------------------


def test_stages_against_plain_python(spark, documents):
    chance = random.Random(19)
    vocabulary = {lang: [f"{lang}{n}" for n in range(300)] for lang in ("xen", "yfr")}
    rows = []
    for n in range(120):
        lang = chance.choice(list(vocabulary))
        text = "\n".join(" ".join(chance.choice(vocabulary[lang]) for _ in range(25)) for _ in range(3))
        rows.append((n, text, lang, chance.choice("abc"), len(text)))
    rows += [(200 + n, rows[n][1], *rows[n][2:]) for n in range(20)]
    rows += [(300, "1234 5678 !!", "xen", "a", 12), (301, None, None, "a", None)]
    docs = documents(rows, extra=False)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {300, 301}
    unique = corpus_pipeline.line_dedup(spark, kept, "")
    assert {r.doc_id: r.text for r in unique.collect()} == {r[0]: r[1] for r in rows[:120]}
    doubled = documents(rows[:140], extra=False)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, doubled, "").collect()) == list(range(120))
    mixed = corpus_pipeline.mix_sources(spark, unique, "")
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2 and mixed.columns == docs.columns
    sizes = defaultdict(int)
    for r in rows[:120]:
        sizes[r[3]] += 75
    targets, sums = plain_targets(sizes), defaultdict(int)
    for doc_id, count in copies.items():
        sums[rows[doc_id][3]] += 75 * count
    assert all(abs(sums[s] - t) <= 75 + 128 * 8 for s, t in targets.items())
    packed = corpus_pipeline.pack_sequences(spark, mixed, "")
    assert packed.count() >= mixed.count()


def test_near_dedup_recall(spark, documents):
    """The stage against the Jaccard similarity of five-word shingles over all pairs."""
    chance = random.Random(29)
    vocabulary = [f"w{n}" for n in range(3000)]
    rows = []
    for n in range(120):
        words = [chance.choice(vocabulary) for _ in range(chance.choice((12, 40, 70, 250)))]
        other = list(words)
        if n % 3 == 0:
            other.append("more")
        elif n % 3 == 1:
            for at in chance.sample(range(len(other)), max(1, len(other) // 60)):
                other[at] = chance.choice(vocabulary)
        else:
            other = other[: len(other) // 2] + [chance.choice(vocabulary) for _ in range(len(other) // 2)]
        rows += [(n, " ".join(words)), (1000 + n, " ".join(other))]
    sets = [shingles(t) for _, t in rows]
    forest = Forest(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                forest.link(a, b)
    want = {rows[n][0] for n in range(len(rows)) if forest.root(n) == n}
    docs = documents([(*r, "en", "s", 1) for r in rows], extra=False)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert want <= got and len(got - want) <= 0.03 * (len(rows) - len(want)) and len(want) < 200


def test_near_dedup_leaves_no_similar_pair(spark, documents, monkeypatch):
    """Pairs of similarity 0.8 whose SimHashes differ in over 18 bits were left out (F4)."""
    chance = random.Random(9)
    rows = []
    for n in range(0, 1600, 2):
        words = [f"w{chance.randrange(10**6)}" for _ in range(9 if n < 1200 else chance.randrange(10, 120))]
        fewer = words[:-1] if n < 1200 else words[: -max(1, (len(words) - 4) // 5)]
        rows += [(n, " ".join(words), "en", "s", 1), (n + 1, " ".join(fewer), "en", "s", 1)]
    shingles = [set(simhash.shingle_hashes(r[1], 5).tolist()) for r in rows]
    alike = [len(a & b) / len(a | b) >= 0.8 for a, b in zip(shingles[::2], shingles[1::2])]
    marks = [simhash.majority(np.array(sorted(s), np.uint64)) for s in shingles]
    assert any(bin((a ^ b) & (1 << 64) - 1).count("1") > 18 for a, b, same in zip(marks[::2], marks[1::2], alike) if same)
    groups = {r.doc_id: bytes(r.group) for r in neardocs.similar_groups(documents(rows)).collect()}
    assert [groups[n] == groups[n + 1] for n in range(0, 1600, 2)] == alike
    assert 0 < sum(alike) and len(set(groups.values())) == 1600 - sum(alike)


def test_missed_pairs_are_all_similar_ones(spark):
    """The prefix join against all pairs: nothing similar between two groups is missing."""
    chance = np.random.default_rng(2)
    sets = []
    for size in [*range(1, 40), 100, 333]:
        base = chance.integers(0, 1 << 64, 2 * size, np.uint64)
        sets += [np.unique(base[low : low + size]) for low in (0, size // 12, size // 9, size // 8, size // 4)]
    frame = spark.createDataFrame(
        [(n, s.size, neardocs.prefix_of(s).tolist(), n if n % 5 else n + 1) for n, s in enumerate(sets)],
        "id bigint, shingles int, prefix array<bigint>, group bigint",
    )
    group = lambda n: n if n % 5 else n + 1
    got = {(r.a, r.b) for r in neardocs.missed_pairs(frame).collect()}
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if group(a) != group(b)]
    want = {(a, b) for a, b in pairs if neardocs.jaccard(sets[a], sets[b]) >= 0.8}
    assert len(want) > 20 and want <= got and len(got) < 3 * len(want)


def test_near_dedup_blocks(spark, documents, monkeypatch):
    """Near fingerprints are candidates by their blocks of bits, whatever shingles the slots sample."""
    monkeypatch.setattr(neardocs, "slots_of", lambda hashes: hashes[:1].view(np.int64) + np.int64(hashes.size))
    chance = random.Random(31)
    rows, at = [], 0
    while len(rows) < 20:
        words = [f"w{chance.randrange(5000)}" for _ in range(300)]
        near = [*words, f"more{at}"]
        at += 1
        a, b = (neardocs.majority(np.unique(neardocs.shingle_hashes(" ".join(w), 5))) for w in (words, near))
        if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
            rows += [(at, " ".join(words)), (1000 + at, " ".join(near))]
    docs = documents([(*r, "en", "s", 1) for r in rows], extra=False)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {n for n, _ in rows if n < 1000}


def test_near_dedup_awkward(spark, documents, awkward):
    kept = corpus_pipeline.near_dedup(spark, documents(awkward), "")
    assert kept.columns == documents(awkward).columns
    words = {" ".join((r[1] or "").lower().split()) for r in awkward}
    # The line and the line with one word more: 8 of 9 shingles.
    assert kept.count() == len(words) - 1
    assert corpus_pipeline.near_dedup(spark, documents([]), "").collect() == []


def test_run_on_an_empty_table(spark, tmp_path, documents):
    documents([], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_digest_of_edited_text(spark, tmp_path, documents):
    from promptmill.llm.queries import JOBS

    rows = [(3, "äbcde fg", None, None, None), (1, "one two three", None, None, None), (9, None, None, None, None)]
    documents(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in JOBS["op2_fingerprints"](spark, str(tmp_path)).collect()}
    edited = {1: "one two" + "äbcde ", 3: "äbcd", 9: ""}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edited.items()}
    assert {i: d for i, (_, d) in got.items()} == want and got[3][0] == 8
