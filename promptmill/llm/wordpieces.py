"""Exact token ids of a public tokenizer, with work per distinct unit instead of per word.

A unit is a run of characters without blanks, in lower case, across which no token reaches.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import regex
from tokenizers import AddedToken, Tokenizer, normalizers

# The steps that make blanks borders of tokens. Fixed values of such tokenizer files.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_BLANK = r"\s+"
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Characters for which Python and every library agree on case, letters and blanks.
_ODD = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa1-\\xac\\xae-\\u024f]")
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True
# Bytes of a unit that are compared as two machine words.
_SHORT = 16
_MASKS = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_SHORT + 1)], np.uint64)
_HIGH_MASKS = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(_SHORT + 1)], np.uint64)


def _byte_letters() -> dict[int, int]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


class WordPieces:
    """Units of texts, and the ids of units, equal to what the library gives for whole texts."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            [s["type"] for s in steps] == _NORMALIZER
            and steps[1]["pattern"] == {"Regex": _BLANK}
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": _PIECES}
            and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
            and not splits[1]["add_prefix_space"]
        )
        added: list[AddedToken] = list(self.whole.get_added_tokens_decoder().values())
        self.by_word &= all(not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in added)
        self.added = [t.content for t in added]
        self.lowered = [t.lower() for t in self.added]
        self.at_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if added else None
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        if self.by_word:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.model, self.split = self.bare.model, self.whole.pre_tokenizer[0]
            self.letters, self.pieces = _byte_letters(), regex.compile(_PIECES)
            self.known: dict[str, tuple[int, ...]] = {}

    def units(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """For each text the numbers of its units in order, and the numbered units.

        A unit may have two numbers. A tokenizer whose tokens may cross blanks has each whole
        text as its unit.
        """
        if not self.by_word:
            return [np.array([n]) for n in range(len(texts))], texts
        lowered = [t.lower() for t in texts]
        plain = [
            n for n, t in enumerate(texts) if not _ODD.search(t) and not any(a in lowered[n] for a in self.lowered)
        ]
        found, units = self._plain_units([lowered[n] for n in plain])
        codes: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for n, own in zip(plain, found):
            codes[n] = own
        numbers: dict[str, int] = {}
        for n in sorted(set(range(len(texts))) - set(plain)):
            own = [numbers.setdefault(u, len(units) + len(numbers)) for u in self._odd_units(texts[n])]
            codes[n] = np.array(own, np.int64)
        return codes, units + list(numbers)

    def _plain_units(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        parts = [t.encode() for t in texts]
        buffer = b" " + b" ".join(parts) + b" " * (_SHORT + 1)
        blank = _BLANKS[np.frombuffer(buffer, np.uint8)]
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        sizes = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - starts
        codes = np.zeros(starts.size, np.int64)
        short = np.flatnonzero(sizes <= _SHORT)
        # Machine words that begin at any byte.
        words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
        low = words[starts[short]] & _MASKS[sizes[short]]
        high = words[starts[short] + 8] & _HIGH_MASKS[sizes[short]]
        # Equal units sort together; units that only their mix equals are told apart by themselves.
        order = np.argsort((low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F)))
        low, high = low[order], high[order]
        opens = np.ones(order.size, bool)
        opens[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        codes[short[order]] = np.cumsum(opens) - 1
        first = short[order[opens]]
        units = [buffer[s : s + n] for s, n in zip(starts[first].tolist(), sizes[first].tolist())]
        numbers: dict[bytes, int] = {}
        for at in np.flatnonzero(sizes > _SHORT).tolist():
            unit = buffer[starts[at] : starts[at] + sizes[at]]
            codes[at] = numbers.setdefault(unit, len(units) + len(numbers))
        edges = np.cumsum([1, *(len(p) + 1 for p in parts)])
        return np.split(codes, np.searchsorted(starts, edges[1:-1])) if parts else [], [
            u.decode() for u in chain(units, numbers)
        ]

    def _odd_units(self, text: str) -> list[str]:
        """The library's own splitting: added tokens first, then its normal form and pieces."""
        parts = self.at_added.split(text) if self.at_added else [text]
        found: list[str] = []
        for n, part in enumerate(parts):
            if n % 2:
                found.append(part)
            elif part:
                found += [p for p, _ in self.split.pre_tokenize_str(self.whole.normalizer.normalize_str(part))]
        return found

    def ids(self, unit: str) -> tuple[int, ...]:
        """The ids of one unit."""
        if not self.by_word:
            return tuple(self.whole.encode(unit, add_special_tokens=False).ids)
        if unit.isascii() and unit.isalpha():
            return self._piece(unit)
        if _ODD.search(unit) or unit in self.added:
            return tuple(self.bare.encode(unit, add_special_tokens=False).ids)
        return tuple(chain.from_iterable(map(self._piece, self.pieces.findall(unit))))

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = tuple(t.id for t in self.model.tokenize(shown))
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        codes, units = self.units(texts)
        per_unit = [self.ids(u) for u in units]
        sizes = np.fromiter(map(len, per_unit), np.int64, len(per_unit))
        flat = np.fromiter(chain.from_iterable(per_unit), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        return [_gather(flat, starts, sizes, own) for own in codes]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if ends.size else 0)]
