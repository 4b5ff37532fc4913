"""Near-duplicate documents: one of each group that shares most of its five-word shingles.

Documents whose SimHashes differ in 3 bits or less (all of them, found by blocks of bits), and
those that have a slot (a sample of their shingles) in common and differ in few bits, are
candidates; they are linked if the Jaccard similarity of their shingles is high. Between the
groups so found, an exact prefix join finds every similar pair that the candidates miss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.batches import list_array, text_slices, texts_of
from promptmill.llm.components import components
from promptmill.llm.lines import units, verified
from promptmill.llm.simhash import keep_first, majority, near_links, shingle_hashes, text_mark
from promptmill.llm.simhash import slots_of as block_slots
from promptmill.sinks.scratch import forget_finished, scratch_table

WORDS = 5
SIMILARITY = 0.8
# Documents of that similarity differ in about 10 bits of 64. Blocks find all within the first
# number of bits; beyond it they are too narrow, and a slot must be shared.
BLOCK_RADIUS, RADIUS = 3, 18
BINS = 16
# Different texts of one cluster that are verified in one task with as many others.
VERIFIED_ROWS = 256
# Text whose shingles are held at once.
SLICE_BYTES = 1 << 20
# Hashes of texts that a task comparing pairs keeps for further pairs.
READY_HASHES = 1 << 20
# Below the second number of shingles a slot is made of one, from the first on of three. Documents
# of 0.8 of each other's number have one kind in common.
FEW = (48, 64)

_NONE = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def slots_of(hashes: np.ndarray) -> np.ndarray:
    """The least hashes in 16 ranges: each by itself for few hashes, three neighbours for many."""
    least = np.full(BINS, _NONE)
    np.minimum.at(least, (hashes >> np.uint64(60)).astype(np.int64), hashes)
    found = []
    if hashes.size < FEW[1]:
        found.append(least[least != _NONE])
    if hashes.size >= FEW[0]:
        second, third = np.roll(least, -1), np.roll(least, -2)
        full = (least != _NONE) & (second != _NONE) & (third != _NONE)
        found.append(((least * _FACTOR + second) * _FACTOR + third)[full])
    return np.concatenate(found).view(np.int64)


def prefix_of(hashes: np.ndarray) -> np.ndarray:
    """So many of the least hashes that two sets of a similarity of 4/5 or more have one of them in common."""
    return hashes[: hashes.size - (4 * hashes.size + 4) // 5 + 1].view(np.int64) if hashes.size else hashes.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / max(1, a.size + b.size - both)


def _alike(texts: list[str]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of the texts have a high similarity, for ``verified``."""
    ready: dict[int, np.ndarray] = {}

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        for n in np.unique(np.append(a, b)).tolist():
            if n not in ready:
                ready[n] = np.unique(shingle_hashes(texts[n], WORDS))
        pairs = zip(a.tolist(), b.tolist())
        return np.fromiter((jaccard(ready[n], ready[m]) >= SIMILARITY for n, m in pairs), bool, a.size)

    return compare


def find_marks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id_column, mark, key, simhash, slots, shingles, prefix`` of every row; a map.

    ``key`` is a digest of the words, ``shingles`` the number of different ones.
    """
    rows = docs.select(id_column, text_column, text_mark(text_column).alias("_mark"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_column, SLICE_BYTES):
                texts = texts_of(part, text_column)
                keys = [hashlib.blake2b(b" ".join(t.encode().lower().split()), digest_size=16).digest() for t in texts]
                hashes = [np.unique(shingle_hashes(t, WORDS)) for t in texts]
                slots, prefixes = [slots_of(h) for h in hashes], [prefix_of(h) for h in hashes]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_column),
                        part.column("_mark"),
                        pa.array(keys, pa.binary()),
                        pa.array([majority(h) for h in hashes], pa.int64()),
                        list_array(pa.array(np.concatenate(slots), pa.int64()), np.array([s.size for s in slots])),
                        pa.array([h.size for h in hashes], pa.int32()),
                        list_array(pa.array(np.concatenate(prefixes), pa.int64()), np.array([p.size for p in prefixes])),
                    ],
                    [id_column, "mark", "key", "simhash", "slots", "shingles", "prefix"],
                )

    kind = dict(rows.dtypes)[id_column]
    columns = "mark bigint, key binary, simhash bigint, slots array<bigint>, shingles int, prefix array<bigint>"
    return rows.mapInArrow(scan, f"`{id_column}` {kind}, {columns}")


def missed_pairs(sets: DataFrame) -> DataFrame:
    """``a, b``: pairs of different groups that may be similar; ``sets`` has ``id, shingles, prefix, group``.

    Exact: a similar pair has a hash of both prefixes in common (prefix filter), and the hashes
    in common there and those behind the longer rest of the two are enough for 4/5.
    """
    rows = sets.select("id", "shingles", "group", F.explode("prefix").alias("hash"))
    one, other = (rows.withColumnsRenamed({"id": n, "shingles": f"n{n}", "group": f"g{n}"}) for n in "ab")
    met = one.join(other, "hash").filter("a < b AND ga <> gb AND 5 * least(na, nb) >= 4 * greatest(na, nb)")
    shared = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    rest = F.floor((F.lit(4) * F.greatest("na", "nb") + F.lit(4)) / F.lit(5)) - F.lit(1)
    return shared.filter(F.lit(9) * (F.col("shared") + rest) >= F.lit(4) * (F.col("na") + F.col("nb"))).select("a", "b")


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose texts (``id, key, text``) are similar, as their keys."""
    sides = [texts.select(F.col("id").alias(n), F.col("key").alias(f"key_{n}"), F.col("text").alias(f"text_{n}")) for n in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("key_a", "key_b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            near = []
            for row in range(batch.num_rows):
                pair = []
                for side in "ab":
                    key = batch.column(f"key_{side}")[row].as_py()
                    if key not in ready:
                        if held > READY_HASHES:
                            ready.clear()
                            held = 0
                        ready[key] = np.unique(shingle_hashes(batch.column(f"text_{side}")[row].as_py(), WORDS))
                        held += ready[key].size
                    pair.append(ready[key])
                near.append(jaccard(*pair) >= SIMILARITY)
            keys = batch.select(["key_a", "key_b"]).filter(pa.array(near, pa.bool_()))
            yield keys.rename_columns(["a", "b"])

    return both.mapInArrow(compare, "a binary, b binary")


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, mark, group``, one row per input row.

    Texts of equal words (as ASCII lower case) are one text, texts without words too; others are
    linked if the Jaccard similarity of their shingles is 0.8 or more. Only candidates' texts
    are shuffled, and a fifth of the hashes of all shingles.
    """
    marked = scratch_table(find_marks(docs, id_column, text_column))
    place = F.struct(F.col(f"`{id_column}`").alias("id"), "mark")
    texts = scratch_table(marked.groupBy("key").agg(F.min("simhash").alias("simhash"), F.min(place).alias("place")))
    points = marked.filter("size(slots) > 0").select("simhash", "slots").distinct()
    by_blocks = near_links(points.select("simhash").distinct(), BLOCK_RADIUS)
    roots = components(by_blocks.unionByName(near_links(points, RADIUS, slots=F.col("slots"))))
    clustered = texts.join(roots.withColumnsRenamed({"node": "simhash", "root": "cluster"}), "simhash", "left").withColumn(
        "cluster", F.coalesce("cluster", "simhash")
    )
    # Texts meet in their slots, in the blocks of their SimHash, or by an equal SimHash.
    blocks = F.transform(block_slots(F.col("simhash"), BLOCK_RADIUS), lambda block: block.bitwiseOR(F.lit(1 << 60)))
    own = F.concat("slots", blocks, F.array("simhash"))
    slots = marked.select("key", own.alias("slots")).dropDuplicates(["key"])
    meeting = units(clustered, slots, VERIFIED_ROWS)
    wanted = texts.join(meeting, "key").select("place", "key", "simhash", "cluster", "slot", "shares")
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("text"), text_mark(text_column).alias("_mark"))
    same = F.col("_id").eqNullSafe(F.col("place.id")) & (F.col("_mark") == F.col("place.mark"))
    candidates = rows.join(wanted, same).select("key", "simhash", "cluster", "slot", "shares", F.coalesce("text", F.lit("")).alias("text"))
    links = verified(candidates, RADIUS, _alike)
    groups = components(links).withColumnsRenamed({"node": "key", "root": "group"})
    forget_finished(docs.sparkSession)
    # Groups hold what candidates connect, copies in great number too; only pairs between groups are left.
    distinct = marked.filter("shingles > 0").dropDuplicates(["key"]).join(groups, "key", "left")
    number = F.xxhash64("key").alias("id")
    sets = distinct.select(number, "shingles", "prefix", F.xxhash64(F.coalesce("group", "key")).alias("group"))
    pairs = scratch_table(missed_pairs(sets))
    forget_finished(docs.sparkSession)
    if not pairs.isEmpty():
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        places = texts.select(number, "key", "place").join(ids, "id")
        read = rows.join(places, same).select("id", "key", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id"])
        more = similar_pairs(pairs, read)
        groups = components(groups.select("key", "group").union(more)).withColumnsRenamed({"node": "key", "root": "group"})
    forget_finished(docs.sparkSession)
    return marked.join(groups, "key", "left").select(id_column, "mark", F.coalesce("group", "key").alias("group"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each of ``similar_groups``'s groups."""
    return keep_first(docs, similar_groups(docs, id_column, text_column), id_column, text_column)
