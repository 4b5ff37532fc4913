"""Packing token sequences by minimum bin slack.

Documents are cut into full windows and one remainder. Which remainders share a window is
decided on their lengths alone: a bitset of reachable sums finds the lengths that come closest
to the capacity, and the choice is repeated as often as the counts allow. Which document takes
which place follows from its rank among those of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptmill.llm.batches import text_slices, texts_of
from promptmill.llm.wordpieces import WordPieces
from promptmill.sinks.scratch import stored_table

CAPACITY = 2048
END_ID = 1
# Pieces of one length are ranked in so many runs, apart from each other.
RUNS = 1024


@dataclass(frozen=True)
class Pattern:
    """A way to fill a window: pieces as (length, count), used for ``times`` windows."""

    pieces: tuple[tuple[int, int], ...]
    times: int


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of at most ``counts`` lengths whose sum comes closest to ``room``, not above.

    Bit s of ``sums`` says that s is reachable with the lengths seen so far, longest first.
    Counts enter as powers of two. Walking back, a length is used only where the longer ones
    before it do not reach the sum alone.
    """
    sums, within = 1, (1 << room + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, sums))
            sums |= sums << length * take & within
            left, take = left - take, take * 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Windows for all pieces: each holds the longest piece left and what fits it best."""
    left, patterns = dict(counts), []
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if c > (n == longest)}
        used = fullest(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        patterns.append(Pattern(tuple(sorted(used.items(), reverse=True)), times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return patterns


class Places:
    """Window and offset of the r-th piece of each length."""

    def __init__(self, patterns: list[Pattern]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        window = 0
        for pattern in patterns:
            offset = 0
            for length, count in pattern.pieces:
                rank = ranks.get(length, 0)
                rows.setdefault(length, []).append((rank, window, count, offset))
                ranks[length] = rank + count * pattern.times
                offset += length * count
            window += pattern.times
        self.rows = {length: np.array(r, np.int64) for length, r in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        windows, offsets = np.zeros(ranks.size, np.int64), np.zeros(ranks.size, np.int64)
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            first, window, count, offset = self.rows[length].T
            at = np.searchsorted(first, ranks[mine], side="right") - 1
            nth = ranks[mine] - first[at]
            windows[mine] = window[at] + nth // count[at]
            offsets[mine] = offset[at] + nth % count[at] * length
        return windows, offsets


def _packed_width(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def cut(docs: DataFrame, tokenizer: str, id_column: str, text_column: str, capacity: int, end_id: int) -> DataFrame:
    """``piece, id_column, start, length, doc_tokens, width, ids``: a row per piece, ids packed."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordPieces(tokenizer)
        kind = _packed_width(max(words.size, end_id + 1))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch, text_column):
                rows, starts, totals, ids = [], [], [], []
                for row, own in enumerate(words.encode(texts_of(part, text_column))):
                    own = np.append(own, end_id).astype(kind)
                    for start in range(0, own.size, capacity):
                        rows.append(row)
                        starts.append(start)
                        totals.append(own.size)
                        ids.append(own[start : start + capacity].tobytes())
                width = np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + len(rows))),
                        part.column(id_column).take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array([len(i) // width for i in ids], pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array([width] * len(rows), pa.int32()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["piece", id_column, "start", "length", "doc_tokens", "width", "ids"],
                )
                number += len(rows)

    rows = docs.select(id_column, text_column)
    schema = f"piece bigint, `{id_column}` {dict(rows.dtypes)[id_column]}, start bigint, length bigint, doc_tokens bigint"
    return rows.mapInArrow(pieces, f"{schema}, width int, ids binary")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``piece, sequence_id, offset``: a place for every piece, from lengths alone.

    ``pieces`` has ``piece`` (BIGINT, unique) and ``length``. The driver gets a count per
    length, ``capacity`` numbers at most, and its plan goes back to the tasks. Ranks are
    counted in runs, so a length that many documents share is not one task's work.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = Places(plan(counts, capacity))
    run = pieces.select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(RUNS)).alias("run"))
    runs = run.groupBy("length", "run").agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("length", "run", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_earlier"))
    inside = F.row_number().over(Window.partitionBy("length", "run").orderBy("piece")) - 1
    ranked = (
        run.withColumn("_inside", inside)
        .join(offsets, ["length", "run"])
        .select("piece", "length", (F.col("_earlier") + F.col("_inside")).alias("rank"))
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, offsets = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), pa.array(windows), pa.array(offsets)], ["piece", "sequence_id", "offset"]
            )

    return ranked.mapInArrow(find, "piece bigint, sequence_id bigint, offset bigint")


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id_column, start, length, doc_tokens, sequence_id, offset, ids``: all pieces, placed.

    A document's ids are the tokenizer's for its text, then ``end_id``; ``ids`` are a piece's,
    as little-endian unsigned 32-bit numbers. Each id lies in one piece; the pieces of a
    sequence fill it from offset 0 without gaps, ``capacity`` ids at most. A null text is an
    empty one and makes one piece, the end id; null and repeated ids get their pieces; other
    columns are ignored; an empty table gives an empty table.

    Texts are tokenized once, and the pieces written; only their numbers and lengths are ranked.
    """
    stored, _ = stored_table(cut(docs, tokenizer, id_column, text_column, capacity, end_id))
    placed = stored.join(place(stored.select("piece", "length"), capacity), "piece").drop("piece")

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = {2: np.uint16, 4: np.uint32}
            wide = [
                np.frombuffer(ids, kinds[width]).astype("<u4").tobytes()
                for ids, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())
            ]
            kept = [n for n in batch.schema.names if n not in ("ids", "width")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(wide, pa.binary())], [*kept, "ids"]
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in placed.dtypes if n != "ids" and n != "width")
    return placed.mapInArrow(widen, f"{schema}, ids binary")
