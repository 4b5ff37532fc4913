"""Exact top-k search by inner product over vector-approximation files.

Vectors are kept in blocks: exact components, and one quantised cell per component. A block of
queries scans a block's cells for bounds on every score, then reads exact vectors from the
highest bound down until no unread one can enter the best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.sinks.scratch import scratch_table

# Vectors of a block, queries of a block, blocks that one task scans for a block of queries.
BLOCK_ROWS, QUERY_ROWS, BLOCKS_PER_TASK = 2048, 1024, 8
CELLS = 16
# Exact vectors read at a time.
READ = 16
# What rounding may take from a bound, relative to the sizes that went into it.
ROUNDING = 1e-9

_BLOCK = "dim int, ids binary, keys binary, exact binary"
_CELLS = f"{_BLOCK}, cells binary, grid binary"


def _plain(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _whole_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, keys and integer components of the usable vectors of a batch, for each dimension."""
    lists = batch.column("vector")
    ids = batch.column("id")
    usable = (~_plain(lists.is_null())) & ~_plain(ids.is_null())
    ids = ids.fill_null(0).to_numpy()
    keys = _plain(batch.column("key"))
    sizes = np.where(usable, _plain(lists.value_lengths().fill_null(0)), 0)
    offsets = _plain(lists.offsets)
    values = _plain(lists.values).astype(np.float64)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        found = np.floor(256.0 * values[offsets[rows][:, None] + np.arange(dim)])
        rows, found = rows[np.isfinite(found).all(axis=1)], found[np.isfinite(found).all(axis=1)]
        if rows.size:
            yield ids[rows], keys[rows], found.astype(np.int64)


def _blocks(vectors: DataFrame, size: int, with_cells: bool) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, keys, exact in _whole_vectors(batch):
                for at in range(0, ids.size, size):
                    part = exact[at : at + size]
                    row = [part.shape[1], ids[at : at + size].tobytes(), keys[at : at + size].tobytes(), part.tobytes()]
                    rows.append(row + (_quantised(part) if with_cells else []))
            names = [c.split()[0] for c in (_CELLS if with_cells else _BLOCK).split(", ")]
            types = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return vectors.mapInArrow(pack, _CELLS if with_cells else _BLOCK)


def _quantised(exact: np.ndarray) -> list[bytes]:
    """The cell of every component, and each dimension's first border and cell width."""
    low = exact.min(axis=0).astype(np.float64)
    width = np.maximum((exact.max(axis=0) - low) / CELLS, 1e-12)
    cells = np.clip((exact - low) / width, 0, CELLS - 1).astype(np.uint8)
    return [cells.tobytes(), np.stack([low, width]).tobytes()]


def best_in_block(
    queries: np.ndarray, query_ids: np.ndarray, query_keys: np.ndarray, block: dict[str, np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, block rows and scores of each query's best ``k`` in a block."""
    low, width = block["grid"]
    centre = low + (block["cells"] + 0.5) * width
    size = np.abs(queries).astype(np.float64)
    middle = queries @ centre.T
    # Half a cell on either side, and what rounding may have moved.
    slack = size @ (width / 2) + ROUNDING * (size @ (np.abs(low) + CELLS * width)) + 0.5
    found: list[tuple[int, int, int]] = []
    for n in range(len(queries)):
        own = (block["ids"] == query_ids[n]) & (block["keys"] == query_keys[n])
        upper = np.where(own, -np.inf, middle[n] + slack[n])
        limit = np.partition(upper, -k)[-k] - 2 * slack[n] if upper.size > k else -np.inf
        near = np.flatnonzero((upper >= limit) & ~own)
        near = near[np.argsort(-upper[near], kind="stable")]
        best: list[tuple[int, int, int]] = []
        for at in range(0, near.size, READ):
            if len(best) == k and -best[-1][0] > upper[near[at]]:
                break
            rows = near[at : at + READ]
            scores = block["exact"][rows] @ queries[n]
            best += zip((-scores).tolist(), block["ids"][rows].tolist(), rows.tolist())
            best = sorted(best)[:k]
        found += [(n, row, -score) for score, _, row in best]
    columns = np.array(found, np.int64).reshape(-1, 3)
    return columns[:, 0], columns[:, 1], columns[:, 2]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of every row with ``is_query``.

    Components x become floor(256 * x); the score is the integer inner product (BIGINT), ties
    go to the smaller id, fewer than ``k`` other rows give all. Rows with a null id, a null or
    empty vector, or a null or non-finite component take no part; repeated equal rows count
    once; rows with one id and different vectors are rows of their own; vectors meet vectors
    of their own dimension; other columns are ignored; an empty table gives an empty table.

    Each block of queries meets each block of vectors exactly once, in tasks of bounded size.
    """
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector_column}`").alias("vector"), is_query.alias("asks")
    )
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    rows = rows.withColumn("key", F.xxhash64("vector")).dropDuplicates(["id", "vector"])
    shares = max(1, -(-n_rows // (BLOCK_ROWS * BLOCKS_PER_TASK)))
    apart = rows.filter("asks").repartition(max(1, -(-n_queries // QUERY_ROWS)), "id", "key")
    # Written, as its blocks are named by their content and read twice.
    asked = scratch_table(_blocks(apart, QUERY_ROWS, False)).select(
        F.xxhash64("ids", "keys").alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
        "dim",
        *[F.col(c).alias(f"q_{c}") for c in ("ids", "keys", "exact")],
    )
    held = _blocks(rows, BLOCK_ROWS, True).withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
    # Names of the query blocks spread the vectors' blocks; then each pair meets on its own.
    pairs = held.join(asked.select("dim", "share", "query_block"), ["dim", "share"]).join(
        asked.drop("dim"), ["query_block", "share"]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                block = {
                    "ids": np.frombuffer(row["ids"], np.int64),
                    "keys": np.frombuffer(row["keys"], np.int64),
                    "exact": np.frombuffer(row["exact"], np.int64).reshape(-1, dim),
                    "cells": np.frombuffer(row["cells"], np.uint8).reshape(-1, dim),
                    "grid": np.frombuffer(row["grid"], np.float64).reshape(2, dim),
                }
                ids, keys = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_keys"], np.int64)
                queries = np.frombuffer(row["q_exact"], np.int64).reshape(-1, dim)
                asking, found, score = best_in_block(queries, ids, keys, block, k)
                columns = [ids[asking], keys[asking], block["ids"][found], score]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["query_id", "query_key", "vec_id", "score"]
                )

    found = pairs.mapInArrow(search, "query_id bigint, query_key bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
