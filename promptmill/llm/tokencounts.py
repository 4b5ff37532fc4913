"""Token counts of whole texts, tokenizing each distinct pre-token once.

Blocks of documents are turned into frequencies per pre-token and document, packed by a hash
of the pre-token. All rows of a hash meet in one partition, where a pre-token is tokenized the
first time it comes and looked up from then on; frequencies times pieces are summed up there,
and the sums of a document's parts once more. Ids are never kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from promptmill.llm.batches import list_array, text_slices, texts_of
from promptmill.llm.wordpieces import WordPieces

# A block is a slice of a task's rows; its number and a row's place in it make one BIGINT.
BLOCK_BITS, PLACE_BITS = 24, 16
BLOCK_BYTES = 12 << 20
# Hashes of pre-tokens, and so the most partitions that can share them.
BUCKETS = 2048
# A pre-token in more than one of so many documents of a block is dealt out by block as well.
FREQUENT = 8
# Partial sums, and tokenized pre-tokens, that a task holds.
HELD, KNOWN = 2_000_000, 1_000_000

# A byte that no UTF-8 text holds.
SEPARATOR = b"\xff"
# Packed places that are unpacked at once.
UNPACKED_BYTES = 1 << 20

_PACKED = "words binary, sizes binary, places binary, times binary"


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column with the bytes of ``sizes[i]`` consecutive values in row i."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all rows of a packed column."""
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v), kind)


def frequencies(docs: DataFrame, tokenizer: str, id_column: str, text_column: str) -> DataFrame:
    """``bucket, block, words, sizes, places, times, ids, n_bytes``: packed frequencies.

    A row has the pre-tokens of one block and bucket, how many documents hold each, which (by
    their places in the block), and how often. A block has one more row, with the ids and
    sizes of its documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = WordPieces(tokenizer)
        block = TaskContext.get().partitionId() << BLOCK_BITS
        for batch in batches:
            for part in text_slices(batch, text_column, BLOCK_BYTES):
                texts = texts_of(part, text_column)
                codes, units = pieces.units(texts)
                words = [u.encode() for u in units]
                pairs = np.concatenate(codes) << PLACE_BITS | np.repeat(np.arange(len(texts)), [c.size for c in codes])
                pairs, times = np.unique(pairs, return_counts=True)
                sizes = np.bincount(pairs >> PLACE_BITS, minlength=len(words))
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS
                often = sizes > max(1, len(texts) // FREQUENT)
                bucket[often] = (bucket[often] + block) % BUCKETS
                # Pre-tokens, and their documents with them, in order of buckets.
                order = np.argsort(bucket, kind="stable")
                starts = (np.cumsum(sizes) - sizes)[order]
                moved = np.repeat(starts - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(pairs.size)
                present, begins, counts = np.unique(bucket[order], return_index=True, return_counts=True)
                held = np.add.reduceat(sizes[order], begins) if begins.size else begins
                ordered = [words[n] for n in order.tolist()]
                joined = [SEPARATOR.join(ordered[s : s + n]) for s, n in zip(begins.tolist(), counts.tolist())]
                rows = present.size + 1
                ids = np.append(np.zeros(present.size, int), len(texts))
                n_bytes = pc.fill_null(pc.binary_length(part.column(text_column)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(present, block % BUCKETS).astype(np.int32)),
                        pa.array(np.full(rows, block)),
                        pa.array([*joined, None], pa.binary()),
                        _packed(sizes[order].astype(np.uint16), np.append(counts, 0)),
                        _packed((pairs[moved] & (1 << PLACE_BITS) - 1).astype(np.uint16), np.append(held, 0)),
                        _packed(times[moved].astype(np.uint32), np.append(held, 0)),
                        list_array(part.column(id_column), ids),
                        list_array(n_bytes, ids),
                    ],
                    ["bucket", "block", "words", "sizes", "places", "times", "ids", "n_bytes"],
                )
                block += 1

    rows = docs.select(id_column, text_column)
    kind = dict(rows.dtypes)[id_column]
    return rows.mapInArrow(count, f"bucket int, block bigint, {_PACKED}, ids array<{kind}>, n_bytes array<bigint>")


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_bytes, n_tokens``, one row per input row.

    ``tokenizer`` is the path of a ``tokenizers`` file that all executors have. Counts are the
    library's for whole texts, without tokens added around them; added tokens inside a text
    are recognised, as is its default. Null texts count as empty ones, with 0; null and
    repeated ids get their rows; other columns are ignored; an empty table gives an empty
    table. Rows should come from stored files, so that a repeated task sees them in the same
    order.

    A pre-token is tokenized once in the partition of its hash. One that many documents hold
    (FREQUENT) is dealt out over partitions by block, and tokenized once in each. Nothing is
    broadcast. A partition holds bounded sums and sends one packed row on for each block; the
    sums of a block meet in one partition, which holds a number per document of its own.
    """
    kind = docs.select(id_column).dtypes[0][1]
    id_type = to_arrow_type(docs.schema[id_column].dataType)
    names = ["block", "places", "tokens", "ids", "n_bytes"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = WordPieces(tokenizer), {}

        def count(word: bytes) -> int:
            if len(known) >= KNOWN:
                known.clear()
            known[word] = found = len(pieces.ids(word.decode()))
            return found

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in (part for whole in batches for part in text_slices(whole, "places", UNPACKED_BYTES)):
            packed = batch.filter(pc.is_valid(batch.column("words")))
            words = SEPARATOR.join(packed.column("words").to_pylist()).split(SEPARATOR) if packed.num_rows else []
            counts = np.fromiter((known[w] if w in known else count(w) for w in words), np.int64, len(words))
            sizes = _values(packed.column("sizes"), np.uint16)
            rows_of = pc.binary_length(packed.column("places")).to_numpy() // 2
            keys = np.repeat(packed.column("block").to_numpy() << PLACE_BITS, rows_of) | _values(packed.column("places"), np.uint16)
            held.append((keys, np.repeat(counts, sizes) * _values(packed.column("times"), np.uint32)))
            heads = batch.filter(pc.is_null(batch.column("words")))
            if heads.num_rows:
                none = pa.nulls(heads.num_rows, pa.binary())
                columns = [heads.column("block"), none, none, heads.column("ids"), heads.column("n_bytes")]
                yield pa.RecordBatch.from_arrays(columns, names)
            if sum(k.size for k, _ in held) > HELD:
                held = [summed(held)]
                if held[0][0].size > HELD // 2:
                    yield partial(held.pop())
        if held:
            yield partial(summed(held))

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, group = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        values = np.concatenate([v for _, v in held])
        # Halves, as sums of floats are exact below 2 ** 53 only.
        low = np.bincount(group, values & 0xFFFFFF, keys.size).astype(np.int64)
        return keys, low + (np.bincount(group, values >> 24, keys.size).astype(np.int64) << 24)

    def partial(sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        keys, tokens = sums
        blocks, counts = np.unique(keys >> PLACE_BITS, return_counts=True)
        places = _packed((keys & (1 << PLACE_BITS) - 1).astype(np.uint16), counts)
        none = [pa.nulls(blocks.size, pa.list_(kind)) for kind in (id_type, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(blocks), places, _packed(tokens, counts), *none], names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads = [], []
        for batch in batches:
            parts = batch.filter(pc.is_valid(batch.column("places")))
            sizes = pc.binary_length(parts.column("places")).to_numpy() // 2
            keys = np.repeat(parts.column("block").to_numpy() << PLACE_BITS, sizes) | _values(parts.column("places"), np.uint16)
            held.append((keys, _values(parts.column("tokens"), np.int64)))
            heads.append(batch.filter(pc.is_null(batch.column("places"))))
            if sum(k.size for k, _ in held) > HELD:
                held = [summed(held)]
        keys, tokens = summed(held) if held else (np.zeros(0, np.int64),) * 2
        for head in heads:
            for row in range(head.num_rows):
                ids, n_bytes = head.column("ids")[row].values, head.column("n_bytes")[row].values
                own = (head.column("block")[row].as_py() << PLACE_BITS) + np.arange(len(ids))
                at = np.minimum(np.searchsorted(keys, own), max(keys.size - 1, 0))
                found = np.where(keys[at] == own, tokens[at], 0) if keys.size else np.zeros(own.size, np.int64)
                yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(found)], [id_column, "n_bytes", "n_tokens"])

    packed = frequencies(docs, tokenizer, id_column, text_column).repartition("bucket")
    parts = packed.mapInArrow(
        add, f"block bigint, places binary, tokens binary, ids array<{kind}>, n_bytes array<bigint>"
    )
    return parts.repartition("block").mapInArrow(total, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint")
