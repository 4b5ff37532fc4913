"""Row-local steps: registry filter, column mapping, blank filter, tokenising, masking."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from promptmill.functions import prompts as P
from promptmill.functions import tokens as K
from promptmill.functions.text import strip
from promptmill.sources.registry import DatasetSpec

# Functions that run in tasks ship with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Encoder = Callable[[list[str]], list[list[int]]]


# Digits of the exact comparison with whole numbers in JSON.
EXACT = "decimal(38,9)"


def _equals_any(column: Column, kind: T.DataType, expected: list[bool | int | float]) -> Column:
    """Python equality with numbers or booleans: 1, 1.0 and True are equal, "1" is not.

    Whole numbers are compared exactly, as decimals where the field is JSON.
    """
    whole = [int(e) for e in expected if isinstance(e, int)]
    broken = [e for e in expected if isinstance(e, float)]
    flags = [bool(e) for e in expected if e in (0, 1)]
    if isinstance(kind, T.VariantType):
        held = F.schema_of_variant(column)
        is_number = held.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        exact = F.try_variant_get(column, "$", EXACT).isin([F.lit(str(e)).cast(EXACT) for e in whole])
        near = F.try_variant_get(column, "$", "double").isin(broken)
        return F.when(is_number, F.coalesce(exact, F.lit(False)) | F.coalesce(near, F.lit(False))).when(
            held == "BOOLEAN", F.try_variant_get(column, "$", "boolean").isin(flags)
        ).otherwise(F.lit(False))
    if isinstance(kind, T.BooleanType):
        return column.isin(flags)
    if isinstance(kind, T.NumericType):
        return column.isin(whole + broken)
    return F.lit(False)


def _as_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        fraction = F.schema_of_variant(column).rlike("^(DECIMAL|DOUBLE|FLOAT)")
        number = F.try_variant_get(column, "$", "double").cast("string")
        return F.when(fraction, number).otherwise(F.try_variant_get(column, "$", "string"))
    return column.cast("string")


def _flat(expected: Any) -> list[Any]:
    return [e for item in expected for e in _flat(item)] if isinstance(expected, list) else [expected]


def matches(rows: DataFrame, name: str, expected: Any) -> Column:
    """One registry condition as a predicate that is never null; a list is met by any item.

    Items of one kind make one membership test, however many there are.
    """
    wanted = _flat(expected)
    if any(isinstance(e, dict) for e in wanted):
        raise ValueError(f"The filter on `{name}` holds an object; only values and lists of values can be compared.")
    if name not in rows.columns:
        return F.lit(None in wanted)
    column, kind = F.col(f"`{name}`"), rows.schema[name].dataType
    texts = sorted({e.strip().lower() for e in wanted if isinstance(e, str)})
    plain = [e for e in wanted if isinstance(e, (bool, int, float))]
    tests = []
    if None in wanted:
        tests.append(column.isNull())
        if isinstance(kind, T.VariantType):
            tests.append(F.is_variant_null(column))
    if texts:
        tests.append(F.lower(strip(_as_text(column, kind))).isin(texts))
    if plain:
        tests.append(_equals_any(column, kind, plain))
    return reduce(or_, (F.coalesce(test, F.lit(False)) for test in tests), F.lit(False))


def row_filter(rows: DataFrame, conditions: dict[str, Any] | None, also: Column | None = None) -> DataFrame:
    """Keep the rows that meet every condition; a list is met by any of its items.

    Rows for which ``also`` holds are kept whatever the conditions say (rows on their way to a
    quarantine table, for instance).
    """
    if not conditions:
        return rows
    if not isinstance(conditions, dict):
        raise ValueError(f"Expected a filter of field names and values, found {type(conditions).__name__}.")
    condition = reduce(and_, (matches(rows, name, want) for name, want in conditions.items()))
    return rows.filter(condition if also is None else also | condition)


def map_columns(
    rows: DataFrame, spec: DatasetSpec, keep: Sequence[str] = (), reuse_source: bool = True
) -> DataFrame:
    """Only ``keep``, ``user_prompt`` and ``assistant_response``, whatever the source names.

    A source whose instruction is mapped to ``query`` repeats it as the input, because
    the input fallbacks read ``query`` too; ``reuse_source=False`` leaves the repeat out.
    """
    rows = rows.withColumns(
        {f.name: _as_text(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema if isinstance(f.dataType, T.VariantType)}
    )
    inputs = spec.input_names
    if not reuse_source:
        inputs = [name for name in inputs if name != spec.instruction_names[0]]
    pick = lambda names: P.first_present(rows.columns, names)
    return rows.select(
        *keep,
        P.normalize_prompt(pick(spec.instruction_names), pick(inputs)).alias("user_prompt"),
        strip(pick(spec.output_names)).alias("assistant_response"),
    )


def drop_blank(rows: DataFrame) -> DataFrame:
    return rows.filter((strip("user_prompt") != "") & (strip("assistant_response") != ""))


def emit_if(rows: DataFrame, keep: Sequence[str], condition: Column, *columns: Column) -> DataFrame:
    """Map each row to one row of ``keep`` and ``columns``, or to none.

    A plain filter on a computed column is pushed below the projection, which then
    computes the column twice. Going through a generator computes it once.
    """
    return rows.select(*keep, F.inline(F.when(condition, F.array(F.struct(*columns)))))


def encode(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Prompt ids and full ids from the built-in tokenizer, without leaving the JVM.

    The rendered prompt is a prefix of the rendered conversation and ends in a line
    break, where no token can straddle, so the response is tokenised on its own and the
    prompt only once.
    """
    prompt_text = P.render_chat(P.prompt_messages("user_prompt"), add_generation_prompt=True)
    rest = F.concat(F.col("assistant_response"), F.lit(P.TURN_CLOSE + "\n"))
    return rows.select(
        *keep, K.token_ids(prompt_text).alias("prompt_ids"), K.token_ids(rest).alias("_rest_ids")
    ).select(*keep, "prompt_ids", F.concat("prompt_ids", "_rest_ids").alias("full_ids"))


def one_sequence(ids: Any) -> list[int]:
    """A hook's result for one text as a list of ints."""
    ids = ids.tolist() if hasattr(ids, "tolist") else ids
    if not isinstance(ids, (list, tuple)):
        raise TypeError(f"A tokenizer hook gave {type(ids).__name__} where ids were expected.")
    ids = [i.tolist() if hasattr(i, "tolist") else i for i in ids]
    if ids and isinstance(ids[0], (list, tuple)):
        if len(ids) != 1:
            raise ValueError(f"A tokenizer hook gave {len(ids)} sequences for one text.")
        ids = ids[0]
    return [int(i) for i in ids]


def encode_with(rows: DataFrame, load: Callable[[], Encoder], keep: Sequence[str] = ()) -> DataFrame:
    """The same columns from a user's tokenizer.

    ``load`` runs on the executors, once per task, and returns a function from texts to
    id lists. Arrays and batches of one are taken as lists; anything else fails.
    """

    @F.pandas_udf("struct<prompt_ids: array<int>, full_ids: array<int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for prompts, conversations in batches:
            yield pd.DataFrame(
                {
                    "prompt_ids": [one_sequence(ids) for ids in encoder(list(prompts))],
                    "full_ids": [one_sequence(ids) for ids in encoder(list(conversations))],
                }
            )

    prompt_text = P.render_chat(P.prompt_messages("user_prompt"), add_generation_prompt=True)
    full_text = P.render_chat(P.chat_messages("user_prompt", "assistant_response"))
    return rows.select(*keep, run(prompt_text, full_text).alias("ids")).select(
        *keep, "ids.prompt_ids", "ids.full_ids"
    )


def supervise(encoded: DataFrame, cutoff_len: int, keep: Sequence[str] = ()) -> DataFrame:
    """Model inputs: ids, masked labels, attention mask.

    Rows longer than the cutoff and rows without a supervised label are left out.
    """
    cutoff_len = K.check_cutoff(cutoff_len)
    bounded = encoded.select(
        *keep, "full_ids", K.response_boundary("prompt_ids", "full_ids").alias("boundary")
    )
    wanted = (F.size("full_ids") <= cutoff_len) & K.has_supervision(K.response_ids("full_ids", "boundary"))
    kept = emit_if(bounded, keep, wanted, F.col("full_ids"), F.col("boundary"))
    return kept.select(
        *keep,
        F.col("full_ids").alias("input_ids"),
        K.mask_labels("full_ids", "boundary").alias("labels"),
        K.attention_mask("full_ids").alias("attention_mask"),
    )


class StageCounts:
    """Row counts of named stages, gathered by ``DataFrame.observe`` while the rows are written.

    A marked stage is counted by the first action that runs it, in the same pass that does the
    work: there is no second pass. Spark merges the observed metrics of successful task attempts
    of that action once, so retried and speculative tasks do not count twice. ``result`` waits
    for that action; call it after the write.
    """

    def __init__(self) -> None:
        self.marks: list[tuple[str, str, Observation]] = []

    def mark(self, frame: DataFrame, dataset: str, stage: str, where: Column | None = None) -> DataFrame:
        """``frame``, counted as it passes (only rows where ``where`` holds, if given)."""
        observation = Observation()
        self.marks.append((dataset, stage, observation))
        counted = F.count(F.lit(1)) if where is None else F.count_if(where)
        return frame.observe(observation, counted.cast("bigint").alias("n_rows"))

    def result(self) -> list[tuple[str, str, int]]:
        """``(dataset, stage, n_rows)`` in the order stages were marked (a dataset named twice comes twice)."""
        return [(dataset, stage, int(o.get["n_rows"])) for dataset, stage, o in self.marks]


FilterHook = Callable[[list[str], list[str]], Sequence[bool]]
SplitHook = Callable[[str, str], Sequence[tuple[str, str]]]


def apply_hooks(
    rows: DataFrame,
    keep: Sequence[str],
    load_filter: Callable[[], FilterHook] | None = None,
    load_splitter: Callable[[], SplitHook] | None = None,
) -> DataFrame:
    """``keep, piece, user_prompt, assistant_response``: rows through a user's filter and splitter.

    Both hooks are loaded once per task, on the executors, and run over Arrow batches in the
    task (``mapInArrow`` with a declared schema, so nothing is inferred). The filter gets the
    prompts and responses of a batch and returns one boolean per row. The splitter turns one
    (prompt, response) into any number of pairs, 0 dropping the row; ``piece`` numbers them from
    0 (0 without a splitter). A hook that returns anything else fails the task with a TypeError.
    """
    keep = list(keep)
    schema = T.StructType(
        [rows.schema[k] for k in keep]
        + [T.StructField("piece", T.IntegerType()), T.StructField("user_prompt", T.StringType()),
           T.StructField("assistant_response", T.StringType())]
    )
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = load_filter() if load_filter else None
        split = load_splitter() if load_splitter else None
        for batch in batches:
            prompts = batch.column("user_prompt").to_pylist()
            responses = batch.column("assistant_response").to_pylist()
            passed = list(wanted(prompts, responses)) if wanted else [True] * batch.num_rows
            if len(passed) != batch.num_rows or not all(isinstance(p, (bool, np.bool_)) for p in passed):
                raise TypeError("A filter hook must return one boolean per row.")
            out: dict[str, list] = {name: [] for name in schema.fieldNames()}
            kept_columns = {k: batch.column(k).to_pylist() for k in keep}
            for i in range(batch.num_rows):
                if not passed[i]:
                    continue
                pieces = split(prompts[i], responses[i]) if split else [(prompts[i], responses[i])]
                for n, piece in enumerate(pieces):
                    if not (isinstance(piece, (tuple, list)) and len(piece) == 2 and all(isinstance(t, str) for t in piece)):
                        raise TypeError("A splitter hook must return (prompt, response) pairs of strings.")
                    for k in keep:
                        out[k].append(kept_columns[k][i])
                    out["piece"].append(n)
                    out["user_prompt"].append(piece[0])
                    out["assistant_response"].append(piece[1])
            yield pa.RecordBatch.from_pydict(out, arrow)

    return rows.select(*keep, "user_prompt", "assistant_response").mapInArrow(run, schema)


def supervise_or_reject(encoded: DataFrame, cutoff_len: int, keep: Sequence[str] = (), reason: str = "reason") -> DataFrame:
    """``supervise`` for lenient runs: rows without a response boundary are kept with a reason.

    ``reason`` names a column of ``encoded`` that may already hold one (a malformed source row);
    a row with a reason has null ids and passes the length and supervision tests untouched. All
    in one projection and one generator, so the rows are encoded once.
    """
    cutoff_len = K.check_cutoff(cutoff_len)
    why = F.coalesce(F.col(reason), K.reject_reason("prompt_ids", "full_ids"))
    marked = encoded.select(*keep, "prompt_ids", "full_ids", why.alias(reason))
    bounded = marked.select(
        *keep, reason, "full_ids", F.when(F.col(reason).isNull(), K.shared_prefix("prompt_ids", "full_ids")).alias("boundary")
    )
    fits = (F.size("full_ids") <= cutoff_len) & K.has_supervision(K.response_ids("full_ids", "boundary"))
    wanted = F.col(reason).isNotNull() | fits
    kept = emit_if(bounded, [*keep, reason], wanted, F.col("full_ids"), F.col("boundary"))
    ok = F.col(reason).isNull()
    return kept.select(
        *keep,
        F.when(ok, F.col("full_ids")).alias("input_ids"),
        F.when(ok, K.mask_labels("full_ids", "boundary")).alias("labels"),
        F.when(ok, K.attention_mask("full_ids")).alias("attention_mask"),
        reason,
    )


def count_stages(mapped: DataFrame, cutoff_len: int) -> DataFrame:
    """``stage, n_rows``: mapped rows, those not blank, those left after tokenising.

    One pass over the rows, whatever the number of stages.
    """
    present = (strip("user_prompt") != "") & (strip("assistant_response") != "")
    encoded = encode(mapped.select("*", present.alias("present")), ["present"])
    boundary = K.response_boundary("prompt_ids", "full_ids")
    fits = (F.size("full_ids") <= K.check_cutoff(cutoff_len)) & K.has_supervision(
        K.response_ids("full_ids", boundary)
    )
    counted = encoded.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if("present").alias("not_blank"),
        F.count_if(F.col("present") & fits).alias("supervised"),
    )
    stages = [F.struct(F.lit(s).alias("stage"), F.col(s).alias("n_rows")) for s in counted.columns]
    return counted.select(F.inline(F.array(*stages)))
