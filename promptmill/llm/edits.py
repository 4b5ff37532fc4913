"""Which pairs of texts lie within an edit distance, many pairs side by side.

The table of a pair is filled antidiagonal by antidiagonal, only as far from its main diagonal
as the allowed distance; one array operation does a step of all pairs of a block.
"""

from __future__ import annotations

import numpy as np

# Distances are counted in bytes up to ``CAP``; pairs that allow more edits need another way.
CAP = np.uint8(250)
MOST_EDITS = 240
# Characters of a block of pairs, on either side, and cells of one antidiagonal of it.
BLOCK_CHARS, BLOCK_CELLS = 1 << 19, 1 << 15
# Steps between two looks at which pairs are beyond their distance already.
LOOK = 32


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters as small numbers, none of them 0 or 1, and where each text begins (one more entry)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    number = np.zeros(int(points.max(initial=0)) + 1, np.uint32)
    number[points] = 1
    found = np.flatnonzero(number)
    number[found] = np.arange(2, found.size + 2)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if found.size + 2 <= np.iinfo(k).max)
    return number.astype(kind)[points], starts


def within_edits(
    letters: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray, allowed: np.ndarray
) -> np.ndarray:
    """Whether the texts ``left[n]`` and ``right[n]`` are ``allowed[n]`` edits apart, or less.

    ``allowed`` is ``MOST_EDITS`` at most.
    """
    sizes = np.diff(starts)
    a, b, m, n = starts[left], starts[right], sizes[left], sizes[right]
    found = np.zeros(left.size, bool)
    todo = np.flatnonzero(np.abs(m - n) <= allowed)
    todo = todo[np.argsort(np.maximum(m, n)[todo], kind="stable")]
    for some in _blocks(todo, np.maximum(m, n)[todo], allowed[todo]):
        for way in (1, -1):
            # What both texts begin with, or end with, costs nothing.
            length = int(np.minimum(m[some], n[some]).max())
            if not length:
                continue
            same = _columns(letters, a[some], m[some], length, 0, way) == _columns(letters, b[some], n[some], length, 1, way)
            common = np.where(same.all(axis=1), length, same.argmin(axis=1))
            m[some] -= common
            n[some] -= common
            if way == 1:
                a[some] += common
                b[some] += common
    empty = (m == 0) | (n == 0)
    found[todo] = (empty & (m + n <= allowed))[todo]
    todo = todo[~empty[todo]]
    todo = todo[np.lexsort(((m + n)[todo], allowed[todo]))]
    for some in _blocks(todo, np.maximum(m, n)[todo], allowed[todo]):
        found[some] = _near(letters, a[some], m[some], b[some], n[some], allowed[some])
    return found


def _blocks(pairs: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> list[np.ndarray]:
    """Runs of the pairs that are bounded in characters and cells; a single pair may be beyond."""
    found, begin, most, band = [], 0, 0, 0
    for n, (size, edits) in enumerate(zip(sizes.tolist(), allowed.tolist())):
        most, band = max(most, size), max(band, edits)
        count = n + 1 - begin
        if count > 1 and (count * (most + 2 * band + 4) > BLOCK_CHARS or count * (band + 2) > BLOCK_CELLS):
            found.append(pairs[begin:n])
            begin, most, band = n, size, edits
    return [*found, pairs[begin:]] if begin < pairs.size else found


def _columns(letters: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int, filler: int, way: int) -> np.ndarray:
    """A row for each text: its first (``way`` 1) or last ``length`` characters, then the filler."""
    at = np.arange(length)
    place = (begin if way == 1 else begin + size - 1)[:, None] + way * at
    return np.where(at < size[:, None], letters[np.clip(place, 0, letters.size - 1)], letters.dtype.type(filler))


def _near(
    letters: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, allowed: np.ndarray
) -> np.ndarray:
    """``within_edits`` of the pairs of a block, all of their texts not empty.

    Antidiagonal s holds the cells i + j = s; its t-th cell lies on diagonal j - i = 2t - band,
    or one more on odd ones.
    """
    band = int(allowed.max()) + int(allowed.max()) % 2
    front = band // 2 + 2
    sides = []
    for filler, begin, size in ((0, a, m), (1, b, n)):
        length = int(size.max())
        side = np.full((length + 3 * front + band, begin.size), filler, letters.dtype)
        side[front : front + length] = _columns(letters, begin, size, length, filler, 1).T
        sides.append(side)
    # Characters of the first text backwards: its index falls along an antidiagonal.
    first, second = np.ascontiguousarray(sides[0][::-1]), sides[1]
    last = first.shape[0] - 1
    ends, distance = m + n, np.full(a.size, CAP)
    limit, pair = allowed, np.arange(a.size)
    even, odd = np.full((band + 1, a.size), CAP), np.full((band + 2, a.size), CAP)
    even[band // 2] = 0
    for s in range(1, int(ends.max()) + 1):
        cells = even if s % 2 == 0 else odd[1:-1]
        other = odd if s % 2 == 0 else even
        lowest = -band + s % 2
        i, j = (s - lowest) // 2, (s + lowest) // 2
        at, bt = last - (front + i - 1), front + j - 1
        # Beyond both texts no cell counts, and slices may be short of the ends of the fillers.
        low = max(0, -at, -bt)
        high = min(cells.shape[0], first.shape[0] - at, second.shape[0] - bt)
        if low or high < cells.shape[0]:
            unequal = np.ones(cells.shape, bool)
            unequal[low:high] = first[at + low : at + high] != second[bt + low : bt + high]
        else:
            unequal = first[at : at + high] != second[bt : bt + high]
        aside = np.minimum(other[:-1], other[1:])
        aside += np.uint8(1)
        cells += unequal.view(np.uint8)
        np.minimum(cells, aside, out=cells)
        np.minimum(cells, CAP, out=cells)
        done = np.flatnonzero(ends == s)
        if done.size:
            distance[pair[done]] = cells[((n - m)[done] - lowest) // 2, done]
        if s % LOOK == 0:
            open_ = (ends > s) & (np.minimum(even.min(axis=0), odd.min(axis=0)) <= allowed)
            if not open_.any():
                break
            if open_.sum() * 4 < open_.size * 3:
                first, second, even, odd = (np.ascontiguousarray(x[:, open_]) for x in (first, second, even, odd))
                pair, ends, m, n, allowed = (x[open_] for x in (pair, ends, m, n, allowed))
    return distance <= limit
