"""Document fingerprints by one-permutation MinHash, in column functions only.

Every shingle is hashed once. The leading bits of a hash name a bin, a bin keeps its smallest
hash, an empty bin borrows from a full one, and the low bits of the kept hashes are the
fingerprint.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2 ** BIN_BITS bins, of which VALUE_BITS low bits are stored (one hex digit).
BIN_BITS = 8
BINS = 1 << BIN_BITS
VALUE_BITS = 4
# Bins an empty bin looks at one by one.
PROBES = 8
SHINGLE_WORDS = 5
BLANKS = r"[\x20\x09-\x0D]+"
DIGITS = "0123456789abcdef"

_SHIFT = 64 - BIN_BITS
_EMPTY = (1 << _SHIFT) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """One BIGINT per run of ``words`` words; a shorter text is one shingle, no words are none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))

    def runs(w: Column) -> Column:
        long_enough = F.transform(
            F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[w[i + k] for k in range(words)])
        )
        return F.when(F.size(w) >= words, long_enough).otherwise(F.array(F.xxhash64(w)))

    none = F.array().cast("array<bigint>")
    return F.when(trimmed == "", none).otherwise(_let(F.split(trimmed, BLANKS), runs))


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of each bin without the bin's bits; ``_EMPTY`` in a bin without hashes.

    A sentinel above all others is added to every bin, so after sorting, the first value of
    each bin is its minimum and no bin is missing.
    """
    signed = range(-BINS // 2, BINS // 2)
    sentinels = F.transform(
        F.sequence(F.lit(signed[0]), F.lit(signed[-1])),
        lambda b: F.shiftleft(b.cast("bigint"), _SHIFT).bitwiseOR(F.lit(_EMPTY)),
    )

    def firsts(ordered: Column) -> Column:
        opens = F.filter(
            ordered, lambda x, i: ~F.shiftright(x, _SHIFT).eqNullSafe(F.shiftright(F.get(ordered, i - 1), _SHIFT))
        )
        return F.transform(opens, lambda x: x.bitwiseAND(F.lit(_EMPTY)))

    return _let(F.sort_array(F.concat(hashes, sentinels)), firsts)


def _probe_orders() -> tuple[list[int], list[int], list[int]]:
    """Each bin's first probes, its offset, and the inverse of its odd step modulo the bins.

    A bin's n-th probe is offset + n * step, so it comes to every bin once.
    """
    chance = random.Random(20170614)
    offsets = [chance.randrange(BINS) for _ in range(BINS)]
    steps = [2 * chance.randrange(BINS // 2) + 1 for _ in range(BINS)]
    first = [(offset + n * step) % BINS for offset, step in zip(offsets, steps) for n in range(PROBES)]
    return first, offsets, [pow(step, -1, BINS) for step in steps]


def densify(minima: Column) -> Column:
    """Fill each empty bin from a full one.

    An empty bin probes the bins in an order of its own, an offset and an odd step drawn for
    it once, and borrows from the first full one. The order depends on nothing else, so equal
    sets of full bins borrow alike and every full bin is as likely a lender. Where the first
    probes find none, the full bin that comes first in the order is looked up.
    """
    first, offsets, inverses = map(F.lit, _probe_orders())

    def fill(m: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: m[b].isNotNull())

        def borrow(lenders: Column) -> Column:
            def value(x: Column, b: Column) -> Column:
                turns = F.transform(
                    lenders, lambda c: F.pmod((c - offsets[b]) * inverses[b], F.lit(BINS)) * BINS + c
                )
                return F.coalesce(x, *[m[first[b * PROBES + n]] for n in range(PROBES)], m[F.array_min(turns) % BINS])

            return F.when(F.size(lenders) == BINS, m).otherwise(F.transform(m, value))

        return _let(full, borrow)

    return _let(F.transform(minima, lambda x: F.nullif(x, F.lit(_EMPTY))), fill)


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The packed low bits of the bins as hex digits; '' for a text without words or null."""

    def packed(hashes: Column) -> Column:
        shown = F.lit(list(DIGITS))
        digits = F.transform(
            densify(bin_minima(hashes)), lambda v: shown[v.bitwiseAND(F.lit((1 << VALUE_BITS) - 1)).cast("int")]
        )
        return F.when(F.size(hashes) == 0, F.lit("")).otherwise(F.array_join(digits, ""))

    return _let(shingle_hashes(F.coalesce(text, F.lit("")), words), packed)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1) of the shingles behind two fingerprints.

    Different hashes agree in their low bits by chance in one of 2 ** VALUE_BITS bins; the
    estimate takes that share out. Two texts without words are alike, one such text is
    unlike any other.
    """
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    chance = 1.0 / (1 << VALUE_BITS)
    unbiased = (same / F.lit(float(BINS)) - chance) / (1.0 - chance)
    return (
        F.when((a == "") & (b == ""), 1.0)
        .when((a == "") | (b == ""), 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), unbiased)))
    )


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS
) -> DataFrame:
    """``id_column, fingerprint``, one row per input row, without any shuffle.

    A null text is an empty one, whose fingerprint is ''; equal texts have equal fingerprints;
    null and repeated ids get their rows; other columns are ignored; an empty table gives an
    empty table.
    """
    return docs.select(f"`{id_column}`", fingerprint(F.col(f"`{text_column}`"), words).alias("fingerprint"))
