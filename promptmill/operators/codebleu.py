"""CodeBLEU: n-gram, keyword-weighted n-gram, syntax and data-flow match of a corpus of pairs.

Every part is a clipped multiset match between a candidate and its reference. Each text
is turned into items, items are counted per pair, and the counts are summed per corpus.
N-grams of a pair in one row are counted inside the row, without a row for each of them.
"""

from __future__ import annotations

import keyword
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.functions.ngrams import SUMS, ngram_matches
from promptmill.functions.pyparse import code_structure
from promptmill.functions.text import split_words

# Fixed values of the published score.
ORDERS = 4
PART_WEIGHTS = (0.25, 0.25, 0.25, 0.25)
PLAIN_TOKEN_WEIGHT = 0.2
ZERO_MATCH_EPSILON = 0.1
KEYWORDS = tuple(keyword.kwlist)

NGRAM_KINDS = tuple(range(1, ORDERS + 1))
SUBTREE = 1
EDGE = 2
PARSES = 3
# Whether a pair is in one row, and then its texts.
ALONE = ("_single", "_candidate", "_reference")


def _placed_texts(pairs: DataFrame, pair: Sequence[str], partitions: int | None) -> DataFrame:
    """The texts of each pair, placed by ``pair``.

    All counting below groups by ``pair`` and more, so Spark keeps this placement and
    never shuffles the item rows. The number of partitions is fixed (the
    session's shuffle partitions by default), because merging partitions by the size of
    the texts would ignore how much they grow.
    """
    return _place(pairs.select(*pair, "candidate", "reference"), pair, partitions)


def _both_texts() -> Column:
    return F.array(
        F.struct(F.lit(False).alias("is_reference"), F.col("candidate").alias("text")),
        F.struct(F.lit(True).alias("is_reference"), F.col("reference").alias("text")),
    )


def _place(rows: DataFrame, pair: Sequence[str], partitions: int | None) -> DataFrame:
    if partitions is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *pair)


def _item(kind: int, *values: Column) -> Column:
    """An item as two hashes of its values: 128 bits, however long the values are.

    The first hash of a single token is ``token_key``. A null value makes a null item.
    """
    present = reduce(and_, (v.isNotNull() for v in values))
    keys = F.xxhash64(*values), F.xxhash64(F.lit(kind), *values)
    return F.struct(F.lit(kind).alias("kind"), *[F.when(present, k).alias(f"item{n}") for n, k in enumerate(keys)])


def token_key(token: str) -> Column:
    return F.xxhash64(F.lit(token))


def _ngram_rows(placed: DataFrame, pair: Sequence[str]) -> DataFrame:
    """``ALONE, kind, item0, item1`` rows, where kind n is an n-gram, as hashes of fixed width.

    A pair in one row stays one row without an item, its texts beside it as plain columns: with a
    struct of them, rows took up many times their size on disk. The texts of a pair in several
    rows, whose items must meet, are taken apart. There, where a text ends too early for an
    n-gram the item is null, and a blank text keeps one row of nulls.
    """
    alone = F.count(F.lit(1)).over(Window.partitionBy(*pair)) == 1
    marked = placed.withColumn("_single", alone)
    marked = marked.withColumns({f"_{side}": F.when(F.col("_single"), F.col(side)) for side in ("candidate", "reference")})
    single = F.col("_single")
    nothing = F.array(F.struct(F.lit(False).alias("is_reference"), F.lit(None).cast("string").alias("text")))
    spread = marked.select(*pair, *ALONE, F.inline(F.when(single, nothing).otherwise(_both_texts())))
    words = spread.select(*pair, *ALONE, "is_reference", split_words("text").alias("words"))
    shifted = [F.slice("words", n, F.size("words")).alias(f"w{n}") for n in NGRAM_KINDS]
    rows = words.select(*pair, *ALONE, "is_reference", F.inline_outer(F.arrays_zip(*shifted)))
    items = [_item(n, *[F.col(f"w{k}") for k in NGRAM_KINDS[:n]]) for n in NGRAM_KINDS]
    return rows.select(
        *pair, *ALONE, "is_reference", F.inline(F.when(single, F.array(items[0])).otherwise(F.array(*items)))
    )


def _structure_rows(placed: DataFrame, pair: Sequence[str], partitions: int | None) -> DataFrame:
    """``kind, item0, item1`` rows of subtrees and data-flow edges, and one if the text parses.

    Spark forgets a placement across a Python step, so it is renewed after the parser,
    while each text still is one row.
    """
    spread = placed.select(*pair, F.inline(_both_texts()))
    parsed = spread.select(*pair, "is_reference", code_structure("text").alias("tree"))
    subtrees = F.transform("tree.subtrees", lambda item: _item(SUBTREE, item))
    edges = F.transform("tree.edges", lambda item: _item(EDGE, item))
    whole = F.array(_item(PARSES, F.when(F.col("tree.parses"), F.lit(""))))
    trees = _place(parsed, pair, partitions)
    return trees.select(*pair, "is_reference", F.inline_outer(F.concat(subtrees, edges, whole)))


def _clipped(items: DataFrame, pair: Sequence[str], kinds: Sequence[int], weighted: bool) -> DataFrame:
    """One row per pair: for each kind the clipped matches and the items of both texts.

    Columns are m, c, r and the kind; with ``weighted`` also wm and wr, in which plain
    tokens count less than keywords.
    """
    in_reference = F.col("is_reference")
    counts = items.groupBy(*pair, "kind", "item0", "item1").agg(
        F.count_if(~in_reference).alias("c"), F.count_if(in_reference).alias("r")
    )
    both = F.least("c", "r")
    is_keyword = F.col("item0").isin([token_key(word) for word in KEYWORDS])
    weight = F.when(is_keyword, F.lit(1.0)).otherwise(F.lit(PLAIN_TOKEN_WEIGHT))

    def total(kind: int, value: Column) -> Column:
        chosen = (F.col("kind") == kind) & F.col("item0").isNotNull()
        return F.sum(F.when(chosen, value).otherwise(F.lit(0)))

    sums = []
    for kind in kinds:
        sums += [
            total(kind, both).alias(f"m{kind}"),
            total(kind, F.col("c")).alias(f"c{kind}"),
            total(kind, F.col("r")).alias(f"r{kind}"),
        ]
        if weighted:
            factor = weight if kind == 1 else F.lit(1.0)
            sums += [
                total(kind, both * factor).alias(f"wm{kind}"),
                total(kind, F.col("r") * factor).alias(f"wr{kind}"),
            ]
    return counts.groupBy(*pair).agg(*sums)


def pair_ngrams(pairs: DataFrame, pair: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Clipped n-gram matches of each pair, plain and keyword-weighted.

    Pairs in several rows get their sums from item rows, the others from their texts.
    """
    rows = _ngram_rows(_placed_texts(pairs, pair, partitions), pair)
    summed = _clipped(rows, [*pair, *ALONE], NGRAM_KINDS, True)
    count = ngram_matches(ORDERS, KEYWORDS, PLAIN_TOKEN_WEIGHT)
    counted = summed.withColumn("_own", count("_candidate", "_reference"))
    single = F.col("_single")
    sums = [
        F.when(single, F.col("_own")[n - 1][name]).otherwise(F.col(f"{name}{n}")).alias(f"{name}{n}")
        for n in NGRAM_KINDS
        for name in SUMS
    ]
    return counted.select(*pair, *sums)


def pair_structure(pairs: DataFrame, pair: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Clipped subtree and data-flow matches of each pair; c3 is 1 if the candidate parses."""
    rows = _structure_rows(_placed_texts(pairs, pair, partitions), pair, partitions)
    return _clipped(rows, pair, (SUBTREE, EDGE, PARSES), False)


def _geometric_mean(numerators: Sequence[Column], denominators: Sequence[Column]) -> Column:
    """Mean of the n-gram shares, where a share of zero is lifted by the epsilon."""
    logs = [
        F.log(F.when(n == 0, F.lit(ZERO_MATCH_EPSILON)).otherwise(n) / d)
        for n, d in zip(numerators, denominators, strict=True)
    ]
    mean = reduce(lambda a, b: a + b, logs) / F.lit(float(len(logs)))
    return F.when(numerators[0] == 0, F.lit(0.0)).otherwise(F.exp(mean))


def ngram_bleu(
    pairs: DataFrame, pair: Sequence[str], by: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """The plain (precision) and the keyword-weighted (recall) n-gram match per group of ``by``.

    A pair adds at least one n-gram of every order to a denominator, even if its texts
    are too short to have any.
    """
    return ngram_bleu_of(pair_ngrams(pairs, pair, partitions), by)


def ngram_bleu_of(per_pair: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``ngram_bleu`` from the clipped counts of each pair (``pair_ngrams``), as stored or merged."""

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("double")

    def floored(name: str) -> Column:
        return F.greatest(F.col(name).cast("double"), F.lit(1.0))

    sums = [total(F.col("c1")).alias("candidate_len"), total(F.col("r1")).alias("reference_len")]
    for n in NGRAM_KINDS:
        sums += [
            total(F.col(f"m{n}")).alias(f"m{n}"),
            total(floored(f"c{n}")).alias(f"c{n}"),
            total(F.col(f"wm{n}")).alias(f"wm{n}"),
            total(floored(f"wr{n}")).alias(f"wr{n}"),
        ]
    corpus = per_pair.groupBy(*by).agg(*sums)
    candidate_len, reference_len = F.col("candidate_len"), F.col("reference_len")
    brevity = (
        F.when(candidate_len > reference_len, F.lit(1.0))
        .when(candidate_len == 0, F.lit(0.0))
        .otherwise(F.exp(F.lit(1.0) - reference_len / candidate_len))
    )

    def bleu(top: str, bottom: str) -> Column:
        numerators = [F.col(f"{top}{n}") for n in NGRAM_KINDS]
        denominators = [F.col(f"{bottom}{n}") for n in NGRAM_KINDS]
        return brevity * _geometric_mean(numerators, denominators)

    return corpus.select(
        *by, bleu("m", "c").alias("ngram_match"), bleu("wm", "wr").alias("weighted_ngram_match")
    )


def structure_match(
    pairs: DataFrame, pair: Sequence[str], by: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Share of reference subtrees and of reference data-flow edges found, per group of ``by``.

    ``syntax_rate`` is the share of candidates that parse, from the same parse.
    """
    return structure_match_of(pair_structure(pairs, pair, partitions), by)


def structure_match_of(per_pair: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``structure_match`` from the clipped matches of each pair (``pair_structure``), as stored or merged."""

    def share(kind: int) -> Column:
        found, wanted = F.sum(f"m{kind}"), F.sum(f"r{kind}")
        return F.when(wanted > 0, found / wanted).otherwise(F.lit(0.0))

    return per_pair.groupBy(*by).agg(
        share(SUBTREE).alias("syntax_match"),
        share(EDGE).alias("dataflow_match"),
        F.avg(F.col(f"c{PARSES}").cast("double")).alias("syntax_rate"),
    )


def code_bleu(
    pairs: DataFrame, pair: Sequence[str], by: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """CodeBLEU, its four parts and the syntax rate per group of ``by``; ``pair`` identifies a pair and
    includes ``by``.

    Both halves read the same placed texts, which Spark shuffles once. The join sees one
    row per group.
    """
    return code_bleu_of(pair_ngrams(pairs, pair, partitions), pair_structure(pairs, pair, partitions), by)


def code_bleu_of(per_pair_ngrams: DataFrame, per_pair_structure: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``code_bleu`` from per-pair partial counts, as stored or merged."""
    grams, shapes = ngram_bleu_of(per_pair_ngrams, by), structure_match_of(per_pair_structure, by)
    joined = grams.join(shapes, list(by)) if by else grams.crossJoin(shapes)
    # The public scorer lets a data-flow match of zero count as one.
    flow = F.col("dataflow_match")
    parts = [
        F.col("ngram_match"),
        F.col("weighted_ngram_match"),
        F.col("syntax_match"),
        F.when(flow == 0, F.lit(1.0)).otherwise(flow),
    ]
    score = reduce(lambda a, b: a + b, (F.lit(w) * p for w, p in zip(PART_WEIGHTS, parts, strict=True)))
    return joined.withColumn("codebleu", score)
