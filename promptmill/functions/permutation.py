"""A keyed bijection of ``[0, n)``: the shuffled place of a row from its number, in a map.

A balanced Feistel network of ``ROUNDS`` rounds permutes ``[0, 4**h)``, h the fewest bits per
half that hold ``n - 1``; values that land at ``n`` or beyond are sent through it again (cycle
walking) until they fall below ``n``. Since ``4**h < 4n``, a walk takes fewer than four steps on
average. Any round function makes a Feistel network a bijection; here
``F_r(x) = (((x xor B_r) * A_r) mod 4**h) >> h``, plain integer arithmetic that SQL engines
compute alike. ``A_r`` (odd) and ``B_r`` come from the seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
# Walk steps inside one expression; values still at n or beyond get more in another pass.
WALK = 32
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def seeded_constants(seed: int) -> list[tuple[int, int]]:
    """32-bit constants of each round, from the seed alone; keys are their low h bits."""
    return [
        (((seed + 1) * _MIX[0] + (r + 1) * _MIX[1]) % (1 << 32), ((seed + 7) * _MIX[2] + (r + 1) * _MIX[3]) % (1 << 32))
        for r in range(ROUNDS)
    ]


def round_keys(seed: int, h: int) -> list[tuple[int, int]]:
    """``(A_r, B_r)`` of each round, below ``2**h``; A_r odd."""
    mask = (1 << h) - 1
    return [((c & mask) | 1, d & mask) for c, d in seeded_constants(seed)]


def feistel(x: Column, h: int, keys: list[tuple[int, int]]) -> Column:
    """One pass of the network over ``[0, 4**h)``."""
    mask = (1 << h) - 1
    left, right = F.shiftright(x, h), x.bitwiseAND(F.lit(mask))
    for a, b in keys:
        mixed = F.shiftright(F.pmod(right.bitwiseXOR(F.lit(b)) * F.lit(a), F.lit(1 << (2 * h))), h)
        left, right = right, left.bitwiseXOR(mixed)
    return F.shiftleft(left, h).bitwiseOR(right)


def walk(x: Column, n: int, seed: int, steps: int = WALK, first: bool = True) -> Column:
    """The network once (``first``), then ``steps`` of the cycle walk: values below n stay, others
    go through the network again. A value may still be n or more after it (rarely): walk on."""
    h = half_bits(n)
    keys = round_keys(seed, h)
    start = feistel(x.cast("bigint"), h, keys) if first else x.cast("bigint")
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda v, _: F.when(v < n, v).otherwise(feistel(v, h, keys)))


def positions(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The same bijection in numpy (for tests and small tables)."""
    h = half_bits(n)
    keys = round_keys(seed, h)
    mask = (1 << h) - 1

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & mask
        for a, b in keys:
            left, right = right, left ^ ((((right ^ b) * a) % (1 << (2 * h))) >> h)
        return (left << h) | right

    out = once(numbers.astype(np.int64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out


def sql_network(column: str, h: str, seed: int) -> str:
    """A DuckDB expression of one pass of the network over ``column``, with ``h`` an expression."""
    mask = f"((1 << {h}) - 1)"
    left, right = f"({column} >> {h})", f"({column} & {mask})"
    for c, d in seeded_constants(seed):
        a, b = f"(({c} & {mask}) | 1)", f"({d} & {mask})"
        mixed = f"((((xor({right}, {b}) * {a}) % (1 << (2 * {h})))) >> {h})"
        left, right = right, f"xor({left}, {mixed})"
    return f"(({left} << {h}) | {right})"


# h in SQL for a table of n rows, as ``half_bits``.
SQL_HALF_BITS = "greatest(1, ceil((floor(log2(greatest({n} - 1, 1))) + 1) / 2))::BIGINT"
