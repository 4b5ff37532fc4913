"""Secret scans: all rules compiled into one automaton that reads each byte once."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptmill.llm.automaton import Backwards, compile_rules
from promptmill.llm.batches import joined_bytes, text_slices, texts_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has fewer than ``least`` bytes are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token"))
BASE_RULES = (
    Rule(
        "assign",
        rf"""({_NAMES}|{_either("api")}_?{_either("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    # A failing run holds no other match, so its least length may be part of the rule: short runs,
    # of which every text is full, then end without a report.
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)

SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])


def find_secrets(
    docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id_column, spans``: the secrets of every text, one row per input row.

    A span has its kind, start and end (code points, end exclusive) and the matched text;
    spans are ordered by start, then as the rules are. Matches of one rule are leftmost,
    longest and do not overlap. A null text is an empty one and has no spans; rows with a
    null or repeated id are scanned like any other; other columns are ignored; an empty
    table gives an empty table. A map over the rows, without any shuffle.
    """
    rules = list(rules)
    table = compile_rules([rule.pattern for rule in rules])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backwards = [Backwards(rule.pattern) for rule in rules]
        exact = [re.compile(rule.pattern.encode()) for rule in rules]
        for batch in batches:
            for part in text_slices(batch, text_column):
                texts = [t.encode() for t in texts_of(part, text_column)]
                buffer, starts = joined_bytes(texts)
                where, what = table.scan(np.frombuffer(buffer, np.uint8))
                spans: list[list[dict]] = [[] for _ in texts]
                doc_of = np.searchsorted(starts, where, side="right") - 1
                for doc in np.unique(doc_of).tolist():
                    mine = doc_of == doc
                    found = _spans(texts[doc], (where[mine] - starts[doc]).tolist(), what[mine].tolist(), backwards)
                    spans[doc] = _kept(texts[doc], found, rules, exact)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), pa.array(spans, pa.list_(_SPAN))], [id_column, "spans"]
                )

    rows = docs.select(id_column, text_column)
    return rows.mapInArrow(scan, f"`{id_column}` {dict(rows.dtypes)[id_column]}, spans {SPANS}")


def _spans(text: bytes, ends: list[int], bits: list[int], backwards: list[Backwards]) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes; a match begins behind the one before it of its rule."""
    found, before = [], [0] * len(backwards)
    for end, mask in zip(ends, bits):
        for rule, reader in enumerate(backwards):
            if mask >> rule & 1:
                found.append((reader.start(text, end, before[rule]), rule, end))
                before[rule] = end
    return sorted(found)


def _kept(text: bytes, found: list[tuple[int, int, int]], rules: list[Rule], exact: list[re.Pattern]) -> list[dict]:
    # Code points before each byte.
    points = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=points[1:])
    kept = []
    for start, rule, end in found:
        value = exact[rule].fullmatch(text, start, end)
        if value is not None and len(value.group(rules[rule].group)) >= rules[rule].least:
            kept.append(
                {
                    "kind": rules[rule].kind,
                    "start": int(points[start]),
                    "end": int(points[end]),
                    "value": value.group().decode(),
                }
            )
    return kept
