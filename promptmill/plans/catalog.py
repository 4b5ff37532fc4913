"""Registered queries: a name, a Spark job over a folder of tables, and DuckDB SQL to check it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from promptmill.functions.prompts import TURN_CLOSE, TURN_OPEN
from promptmill.functions.text import BLANKS
from promptmill.functions.tokens import TOKEN_PATTERN
from promptmill.sources.turns import dialogue_pairs

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    job: Job
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under its function name."""

    def add(job: Job) -> Job:
        CATALOG[job.__name__] = Query(job, sql)
        return job

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn that follows them."""
    return dialogue_pairs(table(spark, folder, "conversations"))


# --- SQL fragments -------------------------------------------------------------

PAIRS = """
followed AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS output
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
pairs AS (
  SELECT conv_id, turn, text AS instruction, '' AS input, output
  FROM followed WHERE role = 'user' AND next_role = 'assistant'
)"""


def sql_strip(value: str) -> str:
    return f"trim({value}, '{BLANKS}')"


def sql_ids(text: str) -> str:
    """Token ids of the built-in tokenizer."""
    return (
        f"list_transform(regexp_extract_all({text}, '{TOKEN_PATTERN}'), "
        "lambda t: ('0x' || substr(md5(t), 1, 7))::BIGINT)"
    )


def sql_order(key: str, seed: int = 42) -> str:
    """Order value of the seeded shuffle."""
    return f"substr(md5('{seed}:' || {key}), 1, 15)"


PROMPT_TEXT = f"'{TURN_OPEN}user' || chr(10) || {{prompt}} || '{TURN_CLOSE}' || chr(10) || '{TURN_OPEN}assistant' || chr(10)"
RESPONSE_TEXT = f"{{response}} || '{TURN_CLOSE}' || chr(10)"


def encoded_sql(source: str = "pairs") -> str:
    """CTEs up to ``encoded(conv_id, turn, prompt_ids, full_ids)`` over mapped pairs."""
    prompt = PROMPT_TEXT.format(prompt=sql_strip("instruction"))
    response = RESPONSE_TEXT.format(response=sql_strip("output"))
    return f"""WITH {PAIRS},
rendered AS (
  SELECT conv_id, turn, {prompt} AS prompt_text, {prompt} || {response} AS full_text FROM {source}
  WHERE {sql_strip("instruction")} <> '' AND {sql_strip("output")} <> ''
),
encoded AS (
  SELECT conv_id, turn, {sql_ids("prompt_text")} AS prompt_ids, {sql_ids("full_text")} AS full_ids
  FROM rendered
)"""


def list_sum(values: str) -> str:
    return f"coalesce(list_sum({values}), 0)::BIGINT"
