"""Byte-level BPE ids of whole texts by tree concatenation, and the text they decode to.

A text of at most ``PIECE_CHARS`` code points is encoded whole. A longer one is the root of a
tree of halves: it is cut into ``2**k`` equal leaves of at most ``PIECE_CHARS`` code points,
the leaves are encoded apart (in parallel tasks), and every join of two neighbouring leaves is
repaired: the last ``w`` tokens of the left side and the first ``w`` of the right side are
encoded again as one window, for ``w`` = 2, 4, 8, ..., until the window's first and last
``MARGIN`` tokens agree exactly (ids and byte spans) with both sides. The window's tokens then
replace the ones they cover. A join that finds no agreement within half of each leaf sends its
text to be encoded whole in one task (exact).

Results equal ``Tokenizer.encode(text, add_special_tokens=False)`` and ``decode(ids,
skip_special_tokens=False)`` of the library; the tests compare both on every test text.
Null texts are empty texts; null and repeated ``doc_id`` values are kept as rows of their own.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promptmill.llm.batches import text_slices, texts_of
from promptmill.llm.wordpieces import _byte_letters
from promptmill.sinks.scratch import stored_table

# Code points of a leaf of the tree at most.
PIECE_CHARS = 1 << 15
# Tokens at each end of a repaired window that must agree with the sides.
MARGIN = 2
# Text encoded at once in a task; the library's encodings of a slice are held until its ids are read.
SLICE_BYTES = 1 << 20
# Leaves whose ids are turned into digests at once.
PARTS_ROWS = 32

_DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_JOINS = pa.schema([("_row", pa.int64()), ("k", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("window", pa.list_(pa.int32()))])


class ByteTokens:
    """The library's tokenizer and the bytes each id decodes to."""

    def __init__(self, path: str) -> None:
        # One thread per task: Spark runs the tasks in parallel already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        letters = {chr(c): b for b, c in _byte_letters().items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * size
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, n in self.tokenizer.get_vocab(with_added_tokens=True).items():
            # Added tokens decode to their own text; vocabulary tokens through the byte map.
            self.bytes[n] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, size)

        self.ranked = _rank_engine(path, letters)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode(text, allowed_special="all") for text in texts]
        return [self.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]

    def decoded(self, ids: list[int]) -> bytes:
        """What ``decode(ids, skip_special_tokens=False)`` gives, as UTF-8."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace").encode()


def _rank_engine(path: str, letters: dict[str, int]) -> tiktoken.Encoding | None:
    """The same encoder as merge ranks, where the file allows it exactly; else None (the library encodes).

    That is: plain byte-level BPE (no normalizer, the standard split pattern, no prefix space, no
    dropout, suffixes or byte fallback), every byte a token, merges whose results' ids rise in
    merge order (so a merge's rank is its result's id), and added tokens matched as they are.
    The tests compare its ids with the library's on every test text.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )
    added = spec.get("added_tokens") or []
    if not plain or any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        return None
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if min(made, default=0) < 0 or any(x >= y for x, y in zip(made, made[1:])) or any(c not in vocab for c in letters):
        return None
    ranks = {bytes(letters[c] for c in token): n for token, n in vocab.items()}
    return tiktoken.Encoding(
        "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added}
    )


def digests(tokens: ByteTokens, ids: list[int]) -> tuple[int, str, str]:
    listed = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(tokens.decoded(ids)).hexdigest()


def repair(tokens: ByteTokens, left: bytes, left_ids: list[int], right: bytes, right_ids: list[int]):
    """``(a, b, window_ids)``: left keeps ``left_ids[:a]``, right ``right_ids[b:]``; None if no window agrees."""
    lens = tokens.lengths
    left_ends = np.cumsum(lens[np.asarray(left_ids, np.int64)]) if left_ids else np.zeros(0, np.int64)
    right_ends = np.cumsum(lens[np.asarray(right_ids, np.int64)]) if right_ids else np.zeros(0, np.int64)
    # Windows stay within half of each leaf, so the repairs of a leaf's two joins never overlap.
    most = min(len(left_ids), len(right_ids)) // 2
    w = MARGIN
    while True:
        a, b = max(0, len(left_ids) - w), min(len(right_ids), w)
        start = int(left_ends[a - 1]) if a else 0
        end = int(right_ends[b - 1]) if b else 0
        try:
            window = (left[start:] + right[:end]).decode("utf-8")
        except UnicodeDecodeError:
            window = None
        if window is not None:
            ids = tokens.encode([window])[0]
            head, tail = left_ids[a : a + MARGIN], right_ids[max(0, b - MARGIN) : b]
            spans = np.cumsum(lens[np.asarray(ids, np.int64)]) if ids else np.zeros(0, np.int64)
            # The window's first tokens start where the left ones do, its last ones end where the right ones end.
            agree = ids[: len(head)] == head and ids[len(ids) - len(tail) :] == tail
            if agree and _same_cuts(spans, lens, head, tail, len(ids)):
                return a, b, ids
        w *= 2
        if w > most:
            return None


def _same_cuts(spans: np.ndarray, lens: np.ndarray, head: list[int], tail: list[int], n: int) -> bool:
    """The agreeing tokens also have the same byte spans at both ends of the window."""
    if n < len(head) + len(tail):
        return False
    head_ends = np.cumsum(lens[np.asarray(head, np.int64)]) if head else np.zeros(0, np.int64)
    if head and not np.array_equal(spans[: len(head)], head_ends):
        return False
    if tail:
        total = spans[-1]
        tail_starts = total - np.cumsum(lens[np.asarray(tail[::-1], np.int64)])[::-1]
        window_starts = np.concatenate([[0], spans[:-1]])[n - len(tail) :]
        if not np.array_equal(window_starts, tail_starts):
            return False
    return True


def _tree_pieces(text: F.Column, piece_chars: int) -> F.Column:
    """The leaves of a long text: ``2**k`` equal runs of code points, k as small as possible."""
    n = F.length(text)
    leaves = F.pow(F.lit(2), F.ceil(F.log2(F.ceil(n / F.lit(piece_chars))))).cast("int")
    size = F.ceil(n / leaves).cast("int")
    return F.filter(
        F.transform(
            F.sequence(F.lit(0), leaves - 1), lambda k: F.struct(k.alias("k"), F.substring(text, k * size + 1, size).alias("piece"))
        ),
        lambda p: F.length(p["piece"]) > 0,
    )


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
           piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``<id_column>, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``.

    One row per input row (repeated and null ids included); a null text counts as empty. Other
    columns of ``docs`` are not carried, so their names never clash. An empty table gives an
    empty result.
    """
    rows = docs.select(
        F.col(id_column).alias("_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    short = rows.where(F.length("_text") <= piece_chars)
    kind = docs.schema[id_column].dataType.simpleString()
    whole = short.mapInArrow(_whole(tokenizer), f"_id {kind}, {_DIGESTS}")
    long = rows.where(F.length("_text") > piece_chars).select(
        "_id", "_row", F.inline(_tree_pieces(F.col("_text"), piece_chars))
    )
    leaves, _ = stored_table(long.mapInArrow(_leaves(tokenizer), f"_id {kind}, _row bigint, k int, piece string, ids array<int>"))
    joined = _joined(leaves, tokenizer, kind)
    return whole.unionByName(joined).withColumnRenamed("_id", id_column)


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(path)
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE_BYTES):
                results = [digests(tokens, ids) for ids in tokens.encode(texts_of(part, "_text"))]
                yield pa.RecordBatch.from_pydict(
                    {
                        "_id": part.column("_id"),
                        "n_tokens": pa.array([r[0] for r in results], pa.int64()),
                        "ids_sha256": pa.array([r[1] for r in results], pa.string()),
                        "decoded_sha256": pa.array([r[2] for r in results], pa.string()),
                    }
                )

    return run


def _leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(path)
        for batch in batches:
            for part in text_slices(batch, "piece", SLICE_BYTES):
                ids = tokens.encode(texts_of(part, "piece"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_row"), part.column("k"), part.column("piece"),
                     pa.array(ids, pa.list_(pa.int32()))],
                    names=["_id", "_row", "k", "piece", "ids"],
                )

    return run


def _joined(leaves: DataFrame, path: str, kind: str) -> DataFrame:
    """Digests of long texts: joins of neighbouring leaves repaired, leaves trimmed and put together."""
    right = leaves.select("_row", (F.col("k") - 1).alias("k"), F.col("piece").alias("r_piece"), F.col("ids").alias("r_ids"))
    pairs = leaves.select("_row", "k", "piece", "ids").join(right, ["_row", "k"])

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(path)
        for whole in batches:
            for batch in text_slices(whole, "piece", SLICE_BYTES):
                out = {"_row": [], "k": [], "a": [], "b": [], "window": []}
                for row in batch.to_pylist():
                    found = repair(tokens, row["piece"].encode(), row["ids"], row["r_piece"].encode(), row["r_ids"])
                    a, b, window = found if found else (-1, -1, None)
                    for key, value in zip(out, (row["_row"], row["k"], a, b, window)):
                        out[key].append(value)
                yield pa.RecordBatch.from_pydict(out, _JOINS)

    joins = pairs.mapInArrow(fix, "_row bigint, k int, a int, b int, window array<int>")
    joins, _ = stored_table(joins)
    # A row whose joins all agree is trimmed and put together; any other is encoded whole.
    failed = joins.where("a < 0").select("_row").distinct()
    ends = joins.select("_row", "k", F.col("a").alias("to"), "window")
    starts = joins.select("_row", (F.col("k") + 1).alias("k"), F.col("b").alias("from"))
    trimmed = (
        leaves.join(failed, "_row", "left_anti")
        .join(ends, ["_row", "k"], "left")
        .join(starts, ["_row", "k"], "left")
        .select(
            "_id",
            "_row",
            "k",
            F.concat(
                F.slice("ids", F.coalesce(F.col("from"), F.lit(0)) + 1, F.coalesce(F.col("to"), F.size("ids")) - F.coalesce(F.col("from"), F.lit(0))),
                F.coalesce(F.col("window"), F.array().cast("array<int>")),
            ).alias("ids"),
        )
    )
    parts = trimmed.mapInArrow(_parts(path), f"_id {kind}, _row bigint, k int, n bigint, listed string, decoded binary")
    put = parts.groupBy("_row").agg(
        F.first("_id").alias("_id"),
        F.sort_array(F.collect_list(F.struct("k", "n", "listed", "decoded"))).alias("p"),
    )
    resolved = put.select(
        "_id",
        F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("n_tokens"),
        F.sha2(F.array_join(F.filter(F.transform("p", lambda x: x["listed"]), lambda s: s != ""), ","), 256).alias("ids_sha256"),
        # All bytes of a whole text's tokens are its valid UTF-8, which decoding leaves as they are.
        F.sha2(F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["decoded"])), 256).alias("decoded_sha256"),
    )
    redo = (
        leaves.join(failed, "_row")
        .groupBy("_row")
        .agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("p"))
        .select("_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("_text"))
        .mapInArrow(_whole(path), f"_id {kind}, {_DIGESTS}")
    )
    return resolved.unionByName(redo)


def _parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(path)
        for whole in batches:
            for start in range(0, whole.num_rows, PARTS_ROWS):
                batch = whole.slice(start, PARTS_ROWS)
                ids = batch.column("ids").to_pylist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "_id": batch.column("_id"),
                        "_row": batch.column("_row"),
                        "k": batch.column("k"),
                        "n": pa.array([len(i) for i in ids], pa.int64()),
                        "listed": pa.array([",".join(map(str, i)) for i in ids], pa.string()),
                        "decoded": pa.array([b"".join(tokens.bytes[t] for t in i) for i in ids], pa.binary()),
                    }
                )

    return run
