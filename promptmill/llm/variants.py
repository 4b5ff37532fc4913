"""Spelling variants of words by a variable-length gram index (VGRAM).

Words are the letter runs of documents (after the contract's planted deletions) with at least
``LEAST_CHARS`` code points and ``LEAST_COUNT`` occurrences. Two words are near if one insertion,
deletion or replacement of a code point turns one into the other.

1. **Gram dictionary.** Every ``Q_MIN``-gram is a gram. A gram shorter than ``Q_MAX`` that more
   than ``EXTEND_SHARE`` of all words hold is *frequent*: its one-longer extensions are grams too
   (a frequency-pruned trie). Only the ``DICTIONARY_MOST`` most frequent grams are candidates for
   extending, so the table each task gets is bounded.
2. **Decomposition.** At each position the longest gram starting there is taken; a gram that ends
   no later than an earlier one is dropped. Equal grams of a word are told apart by their
   occurrence number, so gram sets are multisets.
3. **Affected-gram bounds.** For a word s, ``nag(s)`` is the most grams one edit can destroy: for
   each edit place i, the grams whose own text reaches i, and the grams after them that a changed
   gram could swallow. Near words share at least ``max(|VG(s)| - nag(s), |VG(t)| - nag(t))`` grams.
4. **List merging with prefixes.** Grams are ordered rarest first (by the bounded frequency table,
   unknown grams counting as rarest). A word indexes its first ``nag + 1`` grams; two near words
   with a positive bound share a gram there (prefix filter). Candidates meet by gram and length
   (lengths differ by one at most), and keep the pairs sharing enough grams (count filter).
5. **Exact rest.** A word whose bound is not positive (short words, where one edit may touch every
   gram) is also keyed by itself and its single deletions; two such words that are near share a
   key. So no near pair is lost.
6. **Verify.** Every candidate pair is checked by the edit distance (exactly 1).

Forms and roots: a word's form is its near word of largest n (ties: smallest), if that n is at
least twice its own; forms are followed to the root by pointer jumping (n at least doubles at each
step, so chains are short).

Null texts hold no runs; a null doc_id makes no deletion (its hash is null). Repeated rows count
as often as they come. Other columns of ``docs`` are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.sinks.scratch import stored_table

# Fixed values of the contract.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIVISOR = 97
LEAST_CHARS, LEAST_COUNT = 5, 3

# Gram lengths.
Q_MIN, Q_MAX = 2, 6
# A gram held by more than this share of all words is extended.
EXTEND_SHARE = 1 / 512
# Grams whose frequencies are known to every task (most frequent first), bounding what is shipped.
DICTIONARY_MOST = 1 << 14

_DECOMPOSED = "word string, n bigint, len int, tags array<string>, bound int, prefix array<string>, keys array<string>"


def letter_runs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``word``: each lower-cased letter run of every text, after the contract's deletion, one row a run."""
    runs = docs.select(
        F.col(id_column).alias("_id"),
        F.explode(F.regexp_extract_all(F.col(text_column), F.lit(LETTERS), 0)).alias("_run"),
    ).select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    h = F.crc32(F.concat(F.col("_id").cast("string"), F.lit(":"), F.col("_run")).cast("binary"))
    at = (h % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    return runs.select(F.when(h % DIVISOR == 0, cut).otherwise(F.col("_run")).alias("word"))


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word, n``: words of at least LEAST_CHARS code points and LEAST_COUNT occurrences."""
    words = letter_runs(docs, id_column, text_column).where(F.length("word") >= LEAST_CHARS)
    # Counted where the runs are first (partial aggregation), then by word.
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_frequencies(vocab: DataFrame) -> dict[str, int]:
    """The ``DICTIONARY_MOST`` grams held by most words, and by how many."""
    length = F.length("word")
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(Q_MIN), F.lit(Q_MAX)),
                lambda q: F.transform(F.sequence(F.lit(0), length - q), lambda i: F.substring("word", i + 1, q)),
            )
        )
    )
    counted = vocab.select(F.explode(F.filter(grams, lambda g: F.length(g) > 0)).alias("gram")).groupBy("gram").count()
    top = counted.orderBy(F.desc("count"), "gram").limit(DICTIONARY_MOST).collect()
    return {r.gram: r["count"] for r in top}


class Grams:
    """Decomposition of words into variable-length grams, and their affected-gram bounds."""

    def __init__(self, frequencies: dict[str, int], words: int) -> None:
        least = words * EXTEND_SHARE
        frequent = {g for g, c in frequencies.items() if c > least and len(g) < Q_MAX}
        # Prefix-closed: a gram extends only if all its shorter prefixes do.
        self.frequent = {g for g in frequent if all(g[:k] in frequent for k in range(Q_MIN, len(g)))}
        self.order = frequencies

    def spans(self, word: str) -> tuple[list[int], list[int], list[int], list[bool]]:
        """Start, end (inclusive), reach and kept mark of the longest gram at every position."""
        size = len(word)
        starts, ends, reach, kept = [], [], [], []
        furthest = -1
        for p in range(size - Q_MIN + 1):
            q = Q_MIN
            while q < Q_MAX and word[p : p + q] in self.frequent and p + q < size:
                q += 1
            end = p + q - 1
            # Places whose edit changes this gram: its own text, and the next place if it could
            # still grow there (it stopped at the end of the word while frequent and short).
            grows = q < Q_MAX and end == size - 1 and word[p : p + q] in self.frequent
            starts.append(p)
            ends.append(end)
            reach.append(end + 1 if grows else end)
            kept.append(end > furthest)
            furthest = max(furthest, end)
        return starts, ends, reach, kept

    def decompose(self, word: str) -> tuple[list[str], int]:
        """Tagged grams (``gram#k``, k-th occurrence) and the most of them one edit can destroy."""
        starts, ends, reach, kept = self.spans(word)
        grams = [word[p : e + 1] for p, e, k in zip(starts, ends, kept) if k]
        seen: dict[str, int] = {}
        tags = []
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
            tags.append(f"{g}#{seen[g]}")
        worst = 0
        size = len(word)
        for i in range(size + 1):
            window = range(max(0, i - Q_MAX + 1), min(len(starts), i + Q_MAX - 1))
            changed = [p for p in window if p <= i <= reach[p]]
            first = min([*changed, i])
            hit = 0
            for p in window:
                if not kept[p]:
                    continue
                if p in changed or (p > first and ends[p] <= min(p - 1, i) + Q_MAX - 1):
                    hit += 1
            worst = max(worst, hit)
        return tags, worst

    def rank(self, tag: str) -> tuple[int, str]:
        """Rarest first; grams beyond the known table count as the rarest."""
        gram = tag.split("#", 1)[0]
        return self.order.get(gram, 0), tag


def deletion_keys(word: str) -> list[str]:
    """The word and every word one deletion makes of it: near words share one of these."""
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}]


def _decompose(frequencies: dict[str, int], words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(frequencies, words)
        for batch in batches:
            out = {k: [] for k in ("word", "n", "len", "tags", "bound", "prefix", "keys")}
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                tags, nag = grams.decompose(word)
                bound = len(tags) - nag
                ordered = sorted(tags, key=grams.rank)
                prefix = ordered if bound <= 0 else ordered[: nag + 1]
                for key, value in zip(out, (word, n, len(word), tags, bound, prefix, deletion_keys(word) if bound <= 0 else [])):
                    out[key].append(value)
            yield pa.RecordBatch.from_pydict(
                out,
                pa.schema([("word", pa.string()), ("n", pa.int64()), ("len", pa.int32()), ("tags", pa.list_(pa.string())),
                           ("bound", pa.int32()), ("prefix", pa.list_(pa.string())), ("keys", pa.list_(pa.string()))]),
            )

    return run


def near_pairs(decomposed: DataFrame) -> DataFrame:
    """``a, b``: every near pair of words once, a < b.

    Pairs of two weak words (bound not positive) are found by their deletion keys alone. Every
    other pair has a strong word, whose prefix must meet the other word's prefix (a weak word's
    prefix is all its grams): so only strong words are indexed, and every word probes the index.
    A strong word probes its own length and the next (the shorter of two strong words finds the
    pair); a weak word probes the lengths next to its own on both sides.
    """
    index = decomposed.where(F.col("bound") > 0).select(
        F.col("word").alias("b"), F.col("len"), F.explode("prefix").alias("gram")
    )
    strong = F.col("bound") > 0
    probe = decomposed.select(
        F.col("word").alias("a"),
        F.col("len").alias("a_len"),
        strong.alias("a_strong"),
        F.explode("prefix").alias("gram"),
    ).select(
        "a", "a_len", "a_strong", "gram",
        F.explode(
            F.when(F.col("a_strong"), F.array(F.col("a_len"), F.col("a_len") + 1)).otherwise(
                F.array(F.col("a_len") - 1, F.col("a_len"), F.col("a_len") + 1)
            )
        ).alias("len"),
    )
    by_gram = probe.join(index, ["gram", "len"]).where(
        ~F.col("a_strong") | (F.col("a_len") < F.col("len")) | (F.col("a") < F.col("b"))
    )
    keyed = decomposed.where(F.size("keys") > 0).select("word", F.explode("keys").alias("key"))
    by_key = (
        keyed.withColumnRenamed("word", "a")
        .join(keyed.withColumnRenamed("word", "b"), "key")
        .where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    candidates = by_gram.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(by_key).distinct()
    info = decomposed.select("word", "tags", "bound")
    left = info.select(F.col("word").alias("a"), F.col("tags").alias("a_tags"), F.col("bound").alias("a_bound"))
    right = info.select(F.col("word").alias("b"), F.col("tags").alias("b_tags"), F.col("bound").alias("b_bound"))
    met = candidates.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("a_tags", "b_tags"))
    # Count filter (a bound that is not positive says nothing), then the exact check.
    counted = met.where(shared >= F.greatest("a_bound", "b_bound"))
    return counted.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary."""
    spark = docs.sparkSession
    vocab, _ = stored_table(vocabulary(docs, id_column, text_column))
    words = vocab.count()
    frequencies = gram_frequencies(vocab)
    decomposed, _ = stored_table(
        vocab.mapInArrow(_decompose(frequencies, words), _DECOMPOSED)
    )
    pairs, _ = stored_table(near_pairs(decomposed))
    counts = decomposed.select("word", "n")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
    ).join(counts.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = links.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        # Largest n, then smallest word.
        F.min(F.struct((-F.col("other_n")).alias("neg_n"), F.col("other").alias("other"))).alias("best"),
    )
    table = counts.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.neg_n") >= 2 * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.neg_n") >= 2 * F.col("n"), -F.col("best.neg_n")).cast("bigint").alias("form_n"),
    )
    table, _ = stored_table(table)
    return table.join(roots(table), "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots(table: DataFrame) -> DataFrame:
    """``word, root``: forms followed to the end by pointer jumping (each step doubles the reach)."""
    pointer, _ = stored_table(table.select("word", F.coalesce("form", "word").alias("to")))
    while True:
        step = pointer.alias("p").join(pointer.alias("q"), F.col("p.to") == F.col("q.word")).select(
            F.col("p.word").alias("word"), F.col("q.to").alias("to"), (F.col("p.to") != F.col("q.to")).alias("moved")
        )
        step, _ = stored_table(step)
        if step.where("moved").limit(1).count() == 0:
            return step.select("word", F.col("to").alias("root"))
        pointer = step.select("word", "to")
