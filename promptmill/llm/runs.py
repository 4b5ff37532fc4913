"""Periodic runs of words by scale-tiled distribution.

A run is a stretch of consecutive words with smallest period q, at least ``max(6, 4q)``
words long, that no neighbouring word extends keeping period q. Runs of periods in one octave
``[2**j, 2**(j+1))`` are at least ``4 * 2**j`` words long, so each holds a sample point (a
multiple of ``D = 2**(j+1)``) ``c`` with ``c + q`` inside it. Each document is cut, per octave,
into overlapping tiles; a tile's sample points get Z-values (the longest common extensions of
``c`` and ``c + q``, forward and backward, for every q of the octave) and report the stretch
between them as a fragment, cut at the tile's edges. Fragments of a (document, period) are
shuffled together and stitched where they touch: the stitched stretch is the whole run.
A document of at most ``TILE_WORDS`` words is one tile for every octave, and is finished in
the task that reads it.

Z-values are found by direct extension, vectorised over all sample points and periods of an
Arrow batch at once, ``STEP`` words a step; only sample points whose words already agree at
``c, c + q`` (or just before) are extended, and each leaves at its first difference. Words are
compared exactly: Arrow's dictionary encoding gives equal words equal integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of a tile's core; a longer document has several tiles per octave.
TILE_WORDS = 8192
# Core of a tile in sample spacings, for octaves whose spacing is too wide for TILE_WORDS.
TILE_SPACINGS = 8
# Octaves whose sample spacing fits TILE_SPACINGS times into TILE_WORDS share tiles of that width.
SHARED_OCTAVES = (TILE_WORDS // TILE_SPACINGS).bit_length() - 1
# Words of tiles handled in one numpy pass.
BATCH_WORDS = 1 << 19

WORD = r"[^\x20\x09-\x0D]+"

_FRAGMENTS = "q bigint, s bigint, e bigint, primitive boolean"
_DIGESTS = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


def words_of(text: Column) -> Column:
    """The words of a text, none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), 0), F.array().cast("array<string>"))


def planted(words: Column, doc_id: Column) -> Column:
    """Words with the contract's planted period: if ``h % 10 == 0`` (h = crc32 of the decimal id), word
    ``i >= a`` becomes word ``a + (i - a) % p``. Null ids and empty word lists are left as they are.

    The words from a on are the block ``a .. a+p-1`` repeated, so the result is built from slices
    (linear in the words); ``words`` should be a column already computed, not an expression.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    moved = F.slice(F.concat(F.slice(words, 1, a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))), 1, n)
    return F.when((h % 10 == 0) & (n > 0), moved).otherwise(words)


def octaves(n: int) -> range:
    """Octaves j whose periods ``[2**j, 2**(j+1))`` can hold a run in n words."""
    top = 0
    while max(6, 4 << top) <= n:
        top += 1
    return range(top)


# Words compared at once per step of an extension.
STEP = 8


def extension(flat: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common extension of positions x and y of ``flat``, at most ``most``: Z-values.

    Vectorised over all queries, ``STEP`` words a step; a query leaves as soon as it differs.
    Separators after each tile are unique, so no extension crosses a tile's end.
    """
    got = np.zeros(x.size, np.int64)
    active = np.flatnonzero(most > 0)
    offsets = np.arange(STEP)
    size = flat.size
    while active.size:
        at_x = np.minimum(x[active, None] + got[active, None] + offsets, size - 1)
        at_y = np.minimum(y[active, None] + got[active, None] + offsets, size - 1)
        same = flat[at_x] == flat[at_y]
        same &= (got[active, None] + offsets) < most[active, None]
        same &= (x[active, None] + got[active, None] + offsets < size) & (y[active, None] + got[active, None] + offsets < size)
        run = np.where(same.all(1), STEP, np.argmin(same, 1))
        got[active] += run
        active = active[run == STEP]
    return got


def _prime_factors(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return out + ([q] if q > 1 else [])


def solve(tile_ids: list[np.ndarray], specs: list[tuple[int, int, int, int, int, int, int]]) -> list[np.ndarray]:
    """Fragments ``(q, s, e, primitive)`` of each tile, positions of the document; e is past the last word.

    ``specs[t] = (n, j_lo, j_hi, core_lo, core_hi, lo, hi)``; ``tile_ids[t]`` are the words lo..hi as
    integers (equal words, equal integers; negative ones are not allowed). A fragment is a stretch
    with period q found from a sample point; it is kept if it is long enough to be a run or reaches
    a cut edge of the tile (it may then be part of a longer run).
    """
    if any(len(ids) and not isinstance(ids, np.ndarray) for ids in tile_ids):
        vocab: dict = {}
        tile_ids = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in ids), np.int64, len(ids)) for ids in tile_ids]
    parts, starts = [], []
    at = 0
    for t, ids in enumerate(tile_ids):
        # A separator of its own after each tile: no extension crosses it.
        parts.append(np.concatenate([np.asarray(ids, np.int64), [-1 - t]]))
        starts.append(at)
        at += len(ids) + 1
    out = [np.zeros((0, 4), np.int64) for _ in specs]
    if not at:
        return out
    flat = np.concatenate(parts)
    reverse = flat[::-1].copy()
    queries = []  # tile, c (document), q, base (flat index of the tile's first word)
    spec = np.array(specs, np.int64).reshape(-1, 7)
    n_all, j_lo, j_hi, core_lo, core_hi, lo_all, hi_all = spec.T
    base_all = np.asarray(starts, np.int64) - lo_all
    for j in range(int(j_lo.min(initial=0)), int(j_hi.max(initial=-1)) + 1):
        # All tiles of this octave at once: sample points c of the core times periods q.
        tiles = np.flatnonzero((j_lo <= j) & (j <= j_hi))
        d = 2 << j
        first = -(-core_lo[tiles] // d) * d
        count_c = np.maximum(0, -(-(core_hi[tiles] - first) // d))
        count_q = np.maximum(0, np.minimum(d, n_all[tiles] // 4 + 1) - (1 << j))
        pairs = count_c * count_q
        total = int(pairs.sum())
        if not total:
            continue
        tile = np.repeat(tiles, pairs)
        k = np.arange(total) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        per = np.repeat(count_q, pairs)
        c = np.repeat(first, pairs) + (k // per) * d
        q = (1 << j) + k % per
        keep = c + q < hi_all[tile]
        queries.append(np.stack([tile[keep], c[keep], q[keep], base_all[tile][keep]], 1))
    if not queries:
        return out
    t, c, q, shift = np.concatenate(queries).T
    lo = np.array([s[5] for s in specs], np.int64)[t]
    hi = np.array([s[6] for s in specs], np.int64)[t]
    n = np.array([s[0] for s in specs], np.int64)[t]
    x = c + shift
    # Only sample points where the words at c, c + q or c - 1, c + q - 1 agree can start a stretch.
    ahead = flat[x] == flat[x + q]
    behind = (c > lo) & (flat[x - 1] == flat[x + q - 1])
    live = np.flatnonzero(ahead | behind)
    t, c, q, shift, lo, hi, n, x = (v[live] for v in (t, c, q, shift, lo, hi, n, x))
    f = extension(flat, x, x + q, hi - c - q)
    size = flat.size
    b = np.where(c > lo, extension(reverse, np.minimum(size - x, size - 1), size - (x + q), np.where(c > lo, c - lo, 0)), 0)
    s, e = c - b, c + f
    long_enough = e - s + q >= np.maximum(6, 4 * q)
    cut = ((s == lo) & (lo > 0)) | ((e + q == hi) & (hi < n))
    keep = (e > s) & (long_enough | cut)
    t, q, s, e, shift = t[keep], q[keep], s[keep], e[keep], shift[keep]
    # Smallest period q: the first q words are no power of a shorter block.
    primitive = np.ones(q.size, bool)
    for m in np.unique(q):
        rows = np.flatnonzero(q == m)
        for p in _prime_factors(int(m)):
            part = int(m) // p
            at_s = s[rows] + shift[rows]
            ext = extension(flat, at_s, at_s + part, np.full(rows.size, int(m) - part))
            primitive[rows[ext >= int(m) - part]] = False
    found = np.unique(np.stack([t, q, s, e, primitive.astype(np.int64)], 1), axis=0) if t.size else np.zeros((0, 5), np.int64)
    for tile in np.unique(found[:, 0]):
        out[int(tile)] = found[found[:, 0] == tile][:, 1:]
    return out


def runs_of(fragments: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs among stitched fragments, by start, then period."""
    runs = []
    for q, s, e, primitive in fragments.tolist():
        length = e - s + q
        if primitive and length >= max(6, 4 * q):
            runs.append((s, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def digests(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """``n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``."""
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = None
    for s, length, q in runs:
        # Greatest length/period, exactly; ties: smallest start, then period (runs are in that order).
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    dropped = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        dropped[s + q] += 1
        dropped[s + length] -= 1
    gone = np.cumsum(dropped)[: len(words)] > 0
    kept = " ".join(w for w, g in zip(words, gone.tolist()) if not g)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None, None, None, None)
    return (len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def _words_batches(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BATCH_WORDS`` words each."""
    sizes = np.asarray(batch.column(column).value_lengths().fill_null(0))
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_WORDS)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _encoded(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Integer ids of all words of a list column (equal words, equal ids; found by Arrow), and row offsets."""
    ids = pc.dictionary_encode(words.flatten()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = words.offsets.to_numpy().astype(np.int64)
    return ids, offsets - offsets[0]


_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one tile: found, stitched (nothing to stitch) and digested in their task.

    Words stay in Arrow; only documents with runs are turned into Python strings. For the others
    the digest of all words (``_all_sha``, computed by Spark) is the collapsed digest.
    """
    names = [c.split()[0] for c in _DIGESTS.split(", ")]
    schema = pa.schema([(k, pa.int64()) for k in names[:5]] + [(k, pa.string()) for k in names[5:]])
    for batch in batches:
        for part in _words_batches(batch, "_words"):
            column = part.column("_words")
            ids, offsets = _encoded(column)
            sizes = np.diff(offsets)
            docs = [ids[offsets[i] : offsets[i + 1]] for i in range(part.num_rows)]
            specs = [(int(n), 0, max(octaves(int(n)), default=-1), 0, int(n), 0, int(n)) for n in sizes]
            found = solve(docs, specs)
            all_sha = part.column("_all_sha").to_pylist()
            rows = []
            for i, fragments in enumerate(found):
                runs = runs_of(fragments)
                if runs:
                    rows.append(digests(column[i].as_py(), runs))
                else:
                    rows.append((0, None, None, None, None, _EMPTY_SHA, all_sha[i]))
            columns = dict(zip(names, zip(*rows))) if rows else {k: [] for k in names}
            body = pa.RecordBatch.from_pydict({k: list(v) for k, v in columns.items()}, schema)
            yield pa.RecordBatch.from_arrays([part.column("_id"), *body.columns], [ "_id", *names])


def _tile_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_key", pa.int64()), ("q", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("primitive", pa.bool_())])
    for batch in batches:
        for part in _words_batches(batch, "words"):
            ids, offsets = _encoded(part.column("words"))
            tiles = [ids[offsets[i] : offsets[i + 1]] for i in range(part.num_rows)]
            cols = {k: part.column(k).to_pylist() for k in ("n", "j_lo", "j_hi", "core_lo", "core_hi", "lo", "hi")}
            found = solve(tiles, list(zip(*cols.values())))
            keys = part.column("_key").to_numpy()
            sizes = [len(f) for f in found]
            stacked = np.concatenate(found) if any(sizes) else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(keys, sizes)), pa.array(stacked[:, 0]), pa.array(stacked[:, 1]), pa.array(stacked[:, 2]),
                 pa.array(stacked[:, 3].astype(bool))],
                schema=schema,
            )


def _spacing(j: Column) -> Column:
    """``2**(j+1)``, the sample spacing of octave j."""
    return F.pow(F.lit(2), j + 1).cast("bigint")


def _tile_specs(n: Column) -> Column:
    """The tiles of a long document, as an array of structs ``j_lo, j_hi, core_lo, core_hi, lo, hi``.

    Octaves whose tiles are ``TILE_WORDS`` wide share them; each wider octave has its own, of
    ``TILE_SPACINGS`` sample spacings. A tile's extent reaches one spacing D before and after its
    core: its first sample point looks back up to D words, its last one forward to the next
    tile's first sample point.
    """
    top = F.floor(F.log2(F.greatest(n, F.lit(4)) / 4)).cast("int")
    shared = F.least(top, F.lit(SHARED_OCTAVES - 1))
    groups = F.concat(
        F.array(F.struct(F.lit(0).alias("j_lo"), shared.alias("j_hi"), F.lit(TILE_WORDS).alias("w"), _spacing(shared).alias("d"))),
        F.transform(
            F.sequence(F.lit(SHARED_OCTAVES), F.greatest(top, F.lit(SHARED_OCTAVES - 1)), F.lit(1)),
            lambda j: F.struct(j.alias("j_lo"), j.alias("j_hi"), (F.lit(TILE_SPACINGS) * _spacing(j)).alias("w"), _spacing(j).alias("d")),
        ),
    )
    groups = F.filter(groups, lambda g: g["j_lo"] <= top)
    return F.flatten(
        F.transform(
            groups,
            lambda g: F.transform(
                F.sequence(F.lit(0), F.ceil(n / g["w"]).cast("int") - 1),
                lambda t: F.struct(
                    g["j_lo"].alias("j_lo"),
                    g["j_hi"].alias("j_hi"),
                    (t * g["w"]).cast("bigint").alias("core_lo"),
                    F.least((t + 1) * g["w"], n).cast("bigint").alias("core_hi"),
                    F.greatest(t * g["w"] - g["d"], F.lit(0)).cast("bigint").alias("lo"),
                    F.least((t + 1) * g["w"] + g["d"], n).cast("bigint").alias("hi"),
                ),
            ),
        )
    )


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plant: bool = True) -> DataFrame:
    """``<id_column>, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``.

    One row per input row: repeated rows and null ids give rows of their own (a null id plants
    nothing). A null or empty text has no words: no runs, four nulls, and the digests of empty
    texts. Other columns of ``docs`` are not carried. An empty table gives an empty result.
    With ``plant`` the contract's planted period is applied first (see ``planted``).
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def with_words(texts: DataFrame) -> DataFrame:
        found = texts.select(
            F.col(id_column).alias("_id"),
            words_of(F.col(text_column)).alias("_found"),
            # A key that is the same whenever the scan is read again.
            F.xxhash64(F.input_file_name(), F.monotonically_increasing_id()).alias("_key"),
        )
        # Words are found once; the planted period refers to them several times.
        words = planted(F.col("_found"), F.col("_id")) if plant else F.col("_found")
        return found.select("_id", words.alias("_words"), "_key")

    rows = with_words(docs)
    # n words take 2n - 1 code points at least: shorter texts are never long, and the scans
    # for long documents find no words in them.
    maybe_long = with_words(docs.where(F.length(F.col(text_column)) >= 2 * TILE_WORDS + 1))
    short = rows.where(F.size("_words") <= TILE_WORDS).select(
        "_id", "_words", F.sha2(F.array_join("_words", " "), 256).alias("_all_sha")
    )
    done = short.mapInArrow(_whole_documents, f"_id {kind}, {_DIGESTS}")
    long = maybe_long.where(F.size("_words") > TILE_WORDS)
    tiled = long.select("_key", F.size("_words").cast("bigint").alias("n"), F.inline(_tile_specs(F.size("_words"))), "_words").select(
        "_key", "n", "j_lo", "j_hi", "core_lo", "core_hi", "lo", "hi",
        F.slice("_words", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("words"),
    )
    # Tiles of one long document go to many tasks.
    spread = tiled.repartition("_key", "j_lo", "core_lo")
    fragments = spread.mapInArrow(_tile_fragments, "_key bigint, " + _FRAGMENTS)
    runs = stitched(fragments)
    per_doc = runs.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("s", "q", "e", "primitive"))).alias("runs"))
    joined = long.join(per_doc, "_key", "left").select("_id", "_words", "runs")
    finished = joined.mapInArrow(_long_documents, f"_id {kind}, {_DIGESTS}")
    return done.unionByName(finished).withColumnRenamed("_id", id_column)


def stitched(fragments: DataFrame) -> DataFrame:
    """Fragments of a (document, period) united where they overlap or touch: whole stretches."""
    order = Window.partitionBy("_key", "q").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_key", "q", "_island").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("primitive", "s").alias("primitive")
    )


def _long_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _DIGESTS.split(", ")]
    for batch in batches:
        for part in _words_batches(batch, "_words"):
            rows = []
            for words, found in zip(part.column("_words").to_pylist(), part.column("runs").to_pylist()):
                frags = np.array([(f["q"], f["s"], f["e"], int(f["primitive"])) for f in (found or [])], np.int64).reshape(-1, 4)
                rows.append(digests(words, runs_of(frags)))
            columns = dict(zip(names, zip(*rows))) if rows else {k: [] for k in names}
            yield pa.RecordBatch.from_pydict(
                {"_id": part.column("_id"), **{k: list(v) for k, v in columns.items()}},
                pa.schema([("_id", part.schema.field("_id").type)] + [(k, pa.int64()) for k in names[:5]] + [(k, pa.string()) for k in names[5:]]),
            )
