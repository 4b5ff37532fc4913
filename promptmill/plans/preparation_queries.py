"""Queries over the preparation operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions import prompts as P
from promptmill.functions import scores as S
from promptmill.functions import tokens as K
from promptmill.functions.text import strip
from promptmill.operators import batching, ordering, rows
from promptmill.plans.catalog import (
    PAIRS,
    PROMPT_TEXT,
    RESPONSE_TEXT,
    encoded_sql,
    list_sum,
    pairs,
    query,
    sql_order,
    sql_strip,
    table,
)
from promptmill.sinks.scratch import scratch_table
from promptmill.sources.registry import DatasetSpec

PLAIN = DatasetSpec("pairs", "")
KEY = ["conv_id", "turn"]

# Derived columns, written in SQL that Spark and DuckDB read alike.
NOISY_INPUT = (
    "CASE conv_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'N/A' WHEN 2 THEN ' <noinput> ' WHEN 3 THEN '' "
    "ELSE concat('  Context ', CAST(turn AS STRING), ' ') END"
)
NOISY_INSTRUCTION = "CASE WHEN turn % 3 = 1 THEN '   ' ELSE instruction END"
BLANKED = "CASE WHEN (conv_id + turn) % 5 = 0 THEN concat(' ', chr(10)) ELSE instruction END"
CUTOFF = 256


def total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b)


def length(values: Column | str) -> Column:
    return F.size(values).cast("bigint")


def mapped_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rows.drop_blank(rows.map_columns(pairs(spark, folder), PLAIN, KEY))


def encoded_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rows.encode(mapped_pairs(spark, folder), KEY)


@query(f"""WITH {PAIRS},
named AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE instruction END AS task,
         instruction AS question, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat(' ', output, ' ') END AS reply,
         concat(output, '  !') AS answer
  FROM pairs
)
SELECT conv_id, turn, {sql_strip("coalesce(task, question, '')")} AS user_prompt,
       {sql_strip("coalesce(reply, answer, '')")} AS assistant_response FROM named""")
def map_columns(spark: SparkSession, folder: str) -> DataFrame:
    named = pairs(spark, folder).selectExpr(
        "conv_id",
        "turn",
        "CASE WHEN conv_id % 4 = 0 THEN NULL ELSE instruction END AS task",
        "instruction AS question",
        "CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat(' ', output, ' ') END AS reply",
        "concat(output, '  !') AS answer",
    )
    return rows.map_columns(named, DatasetSpec("d", "", {"instruction": "task", "output": "reply"}), KEY)


@query(f"""WITH {PAIRS},
noisy AS (
  SELECT conv_id, turn, {sql_strip(NOISY_INSTRUCTION)} AS head, {sql_strip(NOISY_INPUT)} AS extra FROM pairs
)
SELECT conv_id, turn,
  CASE WHEN extra = '' OR lower(extra) IN ('<noinput>', '< noinput >', 'none', 'null', 'n/a') THEN head
       WHEN head = '' THEN extra ELSE head || chr(10) || extra END AS user_prompt
FROM noisy""")
def normalize_prompt(spark: SparkSession, folder: str) -> DataFrame:
    prompt = P.normalize_prompt(F.expr(NOISY_INSTRUCTION), F.expr(NOISY_INPUT))
    return pairs(spark, folder).select(*KEY, prompt.alias("user_prompt"))


@query(f"""SELECT doc_id, lang, source, text FROM documents
WHERE lower({sql_strip("lang")}) IN ('en', 'fr') AND lower({sql_strip("source")}) = 'src1'""")
def row_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = rows.row_filter(table(spark, folder, "documents"), {"lang": [" EN ", "fr"], "source": "SRC1"})
    return kept.select("doc_id", "lang", "source", "text")


@query("""SELECT event_id, user_id FROM events
WHERE user_id IN (SELECT unnest(range(0, 10000, 2))) AND event_type IS DISTINCT FROM 'error' AND event_id % 3 = 0""")
def row_filter_values(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers from a long list, a boolean, and a null."""
    events = table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "event_id % 3 = 0 AS third", "CASE WHEN event_type = 'error' THEN 1 END AS failed"
    )
    conditions = {"user_id": list(range(0, 10000, 2)), "third": True, "failed": None}
    return rows.row_filter(events, conditions).select("event_id", "user_id")


@query(f"""WITH {PAIRS},
mapped AS (
  SELECT conv_id, turn, {sql_strip(BLANKED)} AS user_prompt, {sql_strip("output")} AS assistant_response FROM pairs
)
SELECT * FROM mapped WHERE user_prompt <> '' AND assistant_response <> ''""")
def drop_blank(spark: SparkSession, folder: str) -> DataFrame:
    blanked = pairs(spark, folder).withColumn("instruction", F.expr(BLANKED))
    return rows.drop_blank(rows.map_columns(blanked, PLAIN, KEY))


@query(f"""WITH {PAIRS}
SELECT conv_id, turn, 0::BIGINT AS pos, 'user' AS role, {sql_strip("instruction")} AS content FROM pairs
UNION ALL SELECT conv_id, turn, 1, 'assistant', {sql_strip("output")} FROM pairs""")
def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    mapped = rows.map_columns(pairs(spark, folder), PLAIN, KEY)
    messages = mapped.select(*KEY, F.posexplode(P.chat_messages("user_prompt", "assistant_response")))
    return messages.select(*KEY, F.col("pos").cast("bigint").alias("pos"), "col.role", "col.content")


@query(f"""WITH {PAIRS}
SELECT conv_id, turn, {PROMPT_TEXT.format(prompt=sql_strip("instruction"))} AS prompt_text,
  '<|im_start|>user' || chr(10) || {sql_strip("instruction")} || '<|im_end|>' || chr(10) ||
  '<|im_start|>assistant' || chr(10) || {RESPONSE_TEXT.format(response=sql_strip("output"))} AS full_text
FROM pairs""")
def render_chat(spark: SparkSession, folder: str) -> DataFrame:
    mapped = rows.map_columns(pairs(spark, folder), PLAIN, KEY)
    return mapped.select(
        *KEY,
        P.render_chat(P.prompt_messages("user_prompt"), True).alias("prompt_text"),
        P.render_chat(P.chat_messages("user_prompt", "assistant_response")).alias("full_text"),
    )


def sql_line_lengths(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10)), lambda x: length(x))"


@query(f"""{encoded_sql()},
hooked AS (
  SELECT conv_id, turn, {sql_line_lengths("prompt_text")} AS prompt_ids, {sql_line_lengths("full_text")} AS full_ids FROM rendered
)
SELECT conv_id, turn, len(prompt_ids)::BIGINT AS n_prompt, len(full_ids)::BIGINT AS n_full,
       {list_sum("prompt_ids")} AS prompt_sum, {list_sum("full_ids")} AS full_sum FROM hooked""")
def tokenize_hook(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts from a tokenizer that the caller brings: line lengths, as batches of one."""

    def load():
        return lambda texts: [[[len(line) for line in text.split("\n")]] for text in texts]

    return rows.encode_with(mapped_pairs(spark, folder), load, KEY).select(
        *KEY,
        length("prompt_ids").alias("n_prompt"),
        length("full_ids").alias("n_full"),
        total("prompt_ids").alias("prompt_sum"),
        total("full_ids").alias("full_sum"),
    )


@query(f"""{encoded_sql()}
SELECT conv_id, turn, len(prompt_ids)::BIGINT AS n_prompt, len(full_ids)::BIGINT AS n_full,
       {list_sum("prompt_ids")} AS prompt_sum, {list_sum("full_ids")} AS full_sum FROM encoded""")
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_pairs(spark, folder).select(
        *KEY,
        length("prompt_ids").alias("n_prompt"),
        length("full_ids").alias("n_full"),
        total("prompt_ids").alias("prompt_sum"),
        total("full_ids").alias("full_sum"),
    )


@query(f"""{encoded_sql()}
SELECT conv_id, turn, len(full_ids)::BIGINT AS n_tokens, {list_sum("full_ids")} AS id_sum
FROM encoded WHERE len(full_ids) <= {CUTOFF}""")
def cutoff_filter(spark: SparkSession, folder: str) -> DataFrame:
    supervised = rows.supervise(encoded_pairs(spark, folder), CUTOFF, KEY)
    return supervised.select(*KEY, length("input_ids").alias("n_tokens"), total("input_ids").alias("id_sum"))


@query(f"""{encoded_sql()},
altered AS (
  SELECT conv_id, turn, len(prompt_ids) AS n,
    CASE WHEN conv_id % 4 = 0 THEN list_concat(prompt_ids[1:len(prompt_ids) - 1], [-1]) ELSE prompt_ids END AS p, full_ids AS f
  FROM encoded
)
SELECT conv_id, turn,
  coalesce(list_min(list_filter(range(1, n + 1), lambda i: p[i] IS DISTINCT FROM f[i])) - 1, n)::BIGINT AS boundary
FROM altered""")
def response_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth conversation's prompt ends in another id, which forces the common prefix."""
    last_changed = F.concat(
        F.slice("prompt_ids", F.lit(1), F.size("prompt_ids") - F.lit(1)), F.array(F.lit(-1))
    )
    altered = F.when(F.col("conv_id") % 4 == 0, last_changed).otherwise(F.col("prompt_ids"))
    return encoded_pairs(spark, folder).select(*KEY, altered.alias("p"), F.col("full_ids").alias("f")).select(
        *KEY, K.response_boundary("p", "f").cast("bigint").alias("boundary")
    )


@query(f"""{encoded_sql()}
SELECT conv_id, turn, len(prompt_ids)::BIGINT AS n_masked, (len(full_ids) - len(prompt_ids))::BIGINT AS n_kept,
  ({list_sum("full_ids")} - {list_sum("prompt_ids")} - 100 * len(prompt_ids))::BIGINT AS label_sum,
  len(full_ids)::BIGINT AS mask_sum
FROM encoded""")
def mask_labels(spark: SparkSession, folder: str) -> DataFrame:
    labelled = rows.supervise(encoded_pairs(spark, folder), 1 << 30, KEY)
    masked = F.filter("labels", lambda x: x == K.IGNORE_INDEX)
    return labelled.select(
        *KEY,
        length(masked).alias("n_masked"),
        (length("labels") - length(masked)).alias("n_kept"),
        total("labels").alias("label_sum"),
        total("attention_mask").alias("mask_sum"),
    )


@query(f"""{encoded_sql()}
SELECT conv_id, turn, (len(full_ids) - len(prompt_ids))::BIGINT AS n_supervised FROM encoded
WHERE (conv_id + turn) % 7 <> 0 AND len(full_ids) > len(prompt_ids)""")
def supervision_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh row has nothing but its prompt."""
    bare = (F.col("conv_id") + F.col("turn")) % 7 == 0
    encoded = encoded_pairs(spark, folder).withColumn(
        "full_ids", F.when(bare, F.col("prompt_ids")).otherwise(F.col("full_ids"))
    )
    kept = F.filter("labels", lambda x: x != K.IGNORE_INDEX)
    return rows.supervise(encoded, 1 << 30, KEY).select(*KEY, length(kept).alias("n_supervised"))


@query("""WITH lengths AS (SELECT doc_id, n_chars AS s, (n_chars * 7 + doc_id) % 1500 + 1 AS t FROM documents),
ceilings AS (
  SELECT doc_id, s, t, CASE WHEN t * 2 < 1000 THEN 1000 WHEN s * 2 < 1000 THEN 1000 - s
    ELSE trunc(1000::DOUBLE * (t::DOUBLE / (s + t)::DOUBLE))::BIGINT END AS ceiling FROM lengths
)
SELECT doc_id, least(greatest(1000 - least(ceiling, t), 0), s)::BIGINT AS source_len, least(ceiling, t)::BIGINT AS target_len
FROM ceilings""")
def truncation_budget(spark: SparkSession, folder: str) -> DataFrame:
    lengths = table(spark, folder, "documents").selectExpr(
        "doc_id", "n_chars AS s", "(n_chars * 7 + doc_id) % 1500 + 1 AS t"
    )
    return lengths.select("doc_id", K.truncation_budget("s", "t", 1000).alias("kept")).select(
        "doc_id", "kept.source_len", "kept.target_len"
    )


@query(f"""{encoded_sql()},
placed AS (
  SELECT conv_id || ':' || turn AS row_key, len(full_ids) AS n, {list_sum("full_ids")} AS id_sum,
    {list_sum("full_ids")} - {list_sum("prompt_ids")} - 100 * len(prompt_ids) AS label_sum FROM encoded
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY {sql_order("row_key")}, row_key) - 1 AS position FROM placed
),
sized AS (
  SELECT *, position // 8 AS batch_id, (max(n) OVER (PARTITION BY position // 8) + 7) // 8 * 8 AS padded_len FROM ranked
)
SELECT row_key, position::BIGINT AS position, batch_id::BIGINT AS batch_id, padded_len::BIGINT AS padded_len,
  padded_len::BIGINT AS n_ids, id_sum::BIGINT AS id_sum, (label_sum - 100 * (padded_len - n))::BIGINT AS label_sum,
  n::BIGINT AS mask_sum FROM sized""")
def batch_pad(spark: SparkSession, folder: str) -> DataFrame:
    """Tokenised once into a scratch table; ranking and padding then read that."""
    supervised = rows.supervise(encoded_pairs(spark, folder), 1 << 30, KEY)
    row_key = F.concat_ws(":", *[F.col(c).cast("string") for c in KEY])
    stored = scratch_table(supervised.select(row_key.alias("row_key"), "input_ids", "labels", "attention_mask"))
    padded = batching.batch_pad(stored, "row_key", batch_size=8, pad_id=0, multiple_of=8)
    return padded.select(
        "row_key",
        F.col("position").cast("bigint").alias("position"),
        "batch_id",
        F.col("padded_len").cast("bigint").alias("padded_len"),
        length("input_ids").alias("n_ids"),
        total("input_ids").alias("id_sum"),
        total("labels").alias("label_sum"),
        total("attention_mask").alias("mask_sum"),
    )


@query("SELECT doc_id, source, text FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def head_n(spark: SparkSession, folder: str) -> DataFrame:
    english = rows.row_filter(table(spark, folder, "documents"), {"lang": "en"})
    return ordering.head_n(english, ["doc_id"], 100).select("doc_id", "source", "text")


@query("""SELECT event_id, user_id, value FROM (
  SELECT event_id, user_id, value, nullif(event_type, 'error') AS kind FROM events
) ORDER BY kind NULLS FIRST, value DESC NULLS LAST, event_id LIMIT 3000""")
def head_by_several(spark: SparkSession, folder: str) -> DataFrame:
    """A larger N over a key with nulls and ties, one column descending."""
    events = table(spark, folder, "events").selectExpr("event_id", "user_id", "value", "nullif(event_type, 'error') AS kind")
    return ordering.head_n(events, ["kind", "-value", "event_id"], 3000).drop("kind")


@query(f"""SELECT doc_id, text, (row_number() OVER (ORDER BY {sql_order("doc_id")}, doc_id) - 1)::BIGINT AS position
FROM documents""")
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    ranked = ordering.with_shuffle_rank(documents, "doc_id", seed=42)
    return ranked.withColumn("position", F.col("position").cast("bigint"))


def _split_sql(wanted: str) -> str:
    return f"""WITH ranked AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY {sql_order("doc_id")}, doc_id) AS r, count(*) OVER () AS n FROM documents
)
SELECT doc_id, text, CASE WHEN r <= {wanted} THEN 'test' ELSE 'train' END AS split FROM ranked"""


@query(_split_sql("ceil(0.1::DOUBLE * n)"))
def split_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.label_split(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", 0.1)


@query(_split_sql("100"))
def split_count(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.label_split(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", 100)


@query(f"""WITH {PAIRS}
SELECT 'pairs' AS dataset, 0 AS dataset_order, {sql_strip("instruction")} AS user_prompt,
  {sql_strip("output")} AS assistant_response FROM pairs
UNION ALL SELECT 'documents', 1, {sql_strip("concat('Label ', source)")}, {sql_strip("text")} FROM documents""")
def concat_datasets(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").selectExpr(
        "concat('Label ', source) AS instruction", "text AS completion"
    )
    return ordering.concat_datasets(
        [
            ("pairs", rows.map_columns(pairs(spark, folder), PLAIN)),
            ("documents", rows.map_columns(documents, PLAIN)),
        ]
    )


STAGE_COUNTS = f"""{encoded_sql("(SELECT * REPLACE (" + BLANKED + " AS instruction) FROM pairs)")}
SELECT 'raw' AS stage, count(*)::BIGINT AS n_rows FROM pairs
UNION ALL SELECT 'not_blank', count(*) FROM rendered
UNION ALL SELECT 'supervised', count(*) FROM encoded WHERE len(full_ids) <= {CUTOFF} AND len(full_ids) > len(prompt_ids)"""


def _keyed_sql() -> str:
    from promptmill.functions import permutation as PERM

    h = PERM.SQL_HALF_BITS.format(n="count(*)")
    return f"""WITH RECURSIVE sized AS (SELECT count(*) AS n, {h} AS h FROM documents),
walked(doc_id, v) AS (
  SELECT doc_id, {PERM.sql_network("doc_id", "h", 42)} FROM documents, sized
  UNION ALL
  SELECT w.doc_id, {PERM.sql_network("w.v", "h", 42)} FROM walked w, sized WHERE w.v >= sized.n
)
SELECT w.doc_id, w.v AS position, (w.v // 8)::BIGINT AS batch,
  CASE WHEN w.v < ceil(0.1 * sized.n) THEN 'test' ELSE 'train' END AS split
FROM walked w, sized WHERE w.v < sized.n"""


@query(_keyed_sql())
def keyed_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """Place, batch of 8 and a 10 % split of every document from a keyed bijection of its dense id."""
    documents = table(spark, folder, "documents").select("doc_id")
    found = documents.agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.count_distinct("doc_id").alias("distinct"),
    ).first()
    if (found["low"], found["high"], found["distinct"]) != (0, found["n"] - 1, found["n"]) and found["n"]:
        raise ValueError("keyed_shuffle needs ids 0 .. n-1 without gaps or repeats; number the rows first.")
    n = found["n"]
    placed = ordering.keyed_positions(documents, "doc_id", n, seed=42)
    test = -(-n // 10)
    return placed.select(
        "doc_id",
        "position",
        F.floor(F.col("position") / 8).cast("bigint").alias("batch"),
        F.when(F.col("position") < test, "test").otherwise("train").alias("split"),
    )


def _even_prompts():
    """A filter hook: rows whose prompt has an even number of characters."""
    return lambda prompts, responses: [len(p) % 2 == 0 for p in prompts]


def _sentences():
    """A splitter hook: one row per part of the response between '. '."""
    return lambda prompt, response: [(prompt, part) for part in response.split(". ")]


@query(f"""WITH {PAIRS},
mapped AS (
  SELECT conv_id, turn, {sql_strip("instruction")} AS user_prompt, {sql_strip("output")} AS assistant_response FROM pairs
),
parted AS (SELECT *, string_split(assistant_response, '. ') AS parts FROM mapped WHERE length(user_prompt) % 2 = 0)
SELECT conv_id, turn, (generate_subscripts(parts, 1) - 1)::INT AS piece, user_prompt, unnest(parts) AS assistant_response
FROM parted""")
def hooked_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Mapped pairs through a user's filter hook and 1-to-N splitter hook, run in tasks."""
    mapped = rows.map_columns(pairs(spark, folder), PLAIN, KEY)
    return rows.apply_hooks(mapped, KEY, _even_prompts, _sentences)


@query(STAGE_COUNTS)
def stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts after each stage, from one pass over the rows."""
    blanked = pairs(spark, folder).withColumn("instruction", F.expr(BLANKED))
    return rows.count_stages(rows.map_columns(blanked, PLAIN), CUTOFF)


@query(STAGE_COUNTS)
def observed_stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts, observed while the supervised rows are written: the write is the only pass."""
    counts = rows.StageCounts()
    blanked = pairs(spark, folder).withColumn("instruction", F.expr(BLANKED))
    mapped = counts.mark(rows.map_columns(blanked, PLAIN), "pairs", "raw")
    kept = counts.mark(rows.drop_blank(mapped), "pairs", "not_blank")
    supervised = counts.mark(rows.supervise(rows.encode(kept), CUTOFF), "pairs", "supervised")
    scratch_table(supervised.select("input_ids", "labels"))
    found = [(stage, n) for _, stage, n in counts.result()]
    return spark.createDataFrame(found, "stage string, n_rows bigint")


@query("""WITH sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
epochs AS (SELECT lang, n, greatest(ceil(n / 8.0), 1)::BIGINT AS steps_per_epoch FROM sizes),
totals AS (SELECT *, greatest(ceil(steps_per_epoch * 2.5), 1)::BIGINT AS total_steps FROM epochs)
SELECT lang, n::BIGINT AS n_rows, steps_per_epoch, total_steps,
  greatest(ceil(total_steps * 0.05::DOUBLE), 1)::BIGINT AS warmup_steps FROM totals""")
def step_plan(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    plan = S.step_plan("n_rows", batch_size=2, accumulation=4, epochs=2.5, warmup_ratio=0.05)
    return sizes.select("lang", "n_rows", plan.alias("plan")).select("lang", "n_rows", "plan.*")


@query("""SELECT event_id, coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(
  [trunc(value)::INT, (event_id % 7 - 3)::INT, trunc(value)::INT, (user_id % 5)::INT], lambda k: k > 0))), ','), ''), '1') AS ks
FROM events""")
def parse_k(spark: SparkSession, folder: str) -> DataFrame:
    given = F.expr(
        "array(CAST(value AS INT), CAST(event_id % 7 - 3 AS INT), CAST(value AS INT), CAST(user_id % 5 AS INT))"
    )
    ks = F.transform(S.parse_k_column(given), lambda k: k.cast("string"))
    return table(spark, folder, "events").select("event_id", F.array_join(ks, ",").alias("ks"))


def prepared_split(spark: SparkSession, folder: str) -> DataFrame:
    """The whole preparation of the dialogue pairs, down to one summary row per kept pair."""
    supervised = rows.supervise(encoded_pairs(spark, folder), 2048, KEY)
    row_key = F.concat_ws(":", *[F.col(c).cast("string") for c in KEY])
    stored = scratch_table(supervised.select(*KEY, row_key.alias("row_key"), "input_ids", "labels"))
    masked = F.filter("labels", lambda x: x == K.IGNORE_INDEX)
    return ordering.label_split(stored, "row_key", 0.1).select(
        *KEY, length("input_ids").alias("n_tokens"), length(masked).alias("n_masked"), "split"
    )


query(f"""{encoded_sql()},
kept AS (
  SELECT *, conv_id || ':' || turn AS row_key FROM encoded
  WHERE len(full_ids) <= 2048 AND len(full_ids) > len(prompt_ids)
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY {sql_order("row_key")}, row_key) AS r, count(*) OVER () AS n FROM kept
)
SELECT conv_id, turn, len(full_ids)::BIGINT AS n_tokens, len(prompt_ids)::BIGINT AS n_masked,
  CASE WHEN r <= ceil(0.1::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM ranked""")(prepared_split)
