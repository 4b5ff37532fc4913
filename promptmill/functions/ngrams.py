"""Arrow UDF that counts the n-grams two texts have in common, all orders of a text in one pass.

It maps two texts to a few sums. Merging texts of one pair and summing pairs is left to Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship these functions with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Text whose words are held at once inside a task; a single longer text is still handled whole.
SLICE_BYTES = 1 << 20

SUMS = ("m", "c", "r", "wm", "wr")
MATCHES = "array<struct<m: bigint, c: bigint, r: bigint, wm: double, wr: double>>"


def _slices(candidates: pa.Array, references: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges with about ``SLICE_BYTES`` of text."""
    sizes = [pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False) for a in (candidates, references)]
    part = np.cumsum(sizes[0].astype(np.int64) + sizes[1]) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(candidates)]
    yield from zip(edges, edges[1:])


def matches(candidates: Sequence[str | None], references: Sequence[str | None], orders: int, keywords: Sequence[str],
            plain: float) -> list[tuple[np.ndarray, ...]]:
    """``SUMS`` per text pair, for each order: clipped matches, the n-grams of both texts, and the weighted two.

    Words are numbered exactly, an n-gram by the number of its first n - 1 words in its pair and
    its last word, so no two n-grams fall together. A null text has none. ``str.split`` knows the
    blanks of ``split_words``.
    """
    words = [(text or "").split() for both in zip(candidates, references) for text in both]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array([word for text in words for word in text], pa.string()).dictionary_encode()
    codes, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    heavy = pc.is_in(known, value_set=pa.array(keywords, pa.string())).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(sizes.size), sizes)
    ends = np.cumsum(sizes)[text]
    starts, before, owners = np.arange(codes.size), text // 2, np.arange(len(candidates))
    found = []
    for order in range(1, orders + 1):
        inside = starts + order <= ends[starts]
        starts = starts[inside]
        last = codes[starts + order - 1]
        items, number = np.unique(before[inside] * max(1, len(known)) + last, return_inverse=True)
        owners = owners[items // max(1, len(known))]
        of_reference = text[starts] % 2 == 1
        c = np.bincount(number[~of_reference], minlength=items.size)
        r = np.bincount(number[of_reference], minlength=items.size)
        m = np.minimum(c, r)
        whole = [np.bincount(owners, n, len(candidates)) for n in (m, c, r)]
        if order == 1:
            factor = np.where(heavy[items % max(1, len(known))], 1.0, plain)
            weighted = [np.bincount(owners, n * factor, len(candidates)) for n in (m, r)]
        else:
            weighted = [whole[0], whole[2]]
        found.append((*(n.astype(np.int64) for n in whole), *weighted))
        before = number
    return found


def ngram_matches(orders: int, keywords: Sequence[str], plain: float) -> Callable[[str, str], Column]:
    """A function of two text columns: an array with the ``SUMS`` of each order, never null."""

    def count(candidates: pa.Array, references: pa.Array) -> pa.Array:
        sums = [[] for _ in range(orders * len(SUMS))]
        for low, high in _slices(candidates, references):
            some = (a.slice(low, high - low).to_pylist() for a in (candidates, references))
            for kept, found in zip(sums, (s for of in matches(*some, orders, keywords, plain) for s in of)):
                kept.append(found)
        # Row by row: the sums of order 1, those of order 2 and so on.
        columns = [np.stack([np.concatenate(sums[o * len(SUMS) + k]) for o in range(orders)], axis=1) for k in range(len(SUMS))]
        values = pa.StructArray.from_arrays([pa.array(c.ravel()) for c in columns], SUMS)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(candidates) + 1, dtype=np.int32) * orders), values)

    return F.arrow_udf(count, MATCHES)
