"""The registered queries of the operators: their whole tables, production settings."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.llm import bpetree, fingerprints, langid, lines, mixing, packing, runs, secrets, sharding, simhash, tokencounts, topk, variants
from promptmill.llm.succession import with_successor

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Tokens beyond which a document is reported as too long.
TOKEN_LIMIT = 2048


def _job(job: Job) -> Job:
    JOBS[job.__name__] = job
    return job


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_job
def op1_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_job
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and two likenesses."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_chars, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n_chars - half), F.substr("next_text", F.lit(1), half))
    measures = {"text": lambda text: text, "fingerprint": fingerprints.fingerprint}
    marked = (
        with_successor(docs, measures)
        .withColumns({"n_chars": n_chars.cast("bigint"), "edited": edited})
        .select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            "fingerprint",
            fingerprints.fingerprint(F.col("edited")).alias("edited_fingerprint"),
            "next_fingerprint",
        )
    )
    own = F.col("fingerprint")
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        fingerprints.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


@_job
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every 50th vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@_job
def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines, and how many it had and lost."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_repeated_lines(docs, least_words=1, radius=lines.WIDE_RADIUS)
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")


@_job
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the three folds that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.remainder(F.col("doc_id")) == 2
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("_language").alias("lang_pred"), F.col("_score").alias("score")
    )


@_job
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words a mix takes from every document, with sources weighing 5, 2, 1 in turn."""
    taken = mixing.mix(_table(spark, sf_dir, "documents"), (5, 2, 1))[1]
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@_job
def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document it is linked to."""
    return simhash.near_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@_job
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and text form of the secrets found in every document."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = [rule.kind for rule in secrets.BASE_RULES]

    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(of([kind])).cast("bigint").alias(f"n_{kind}") for kind in base],
        F.sha2(listed(of(base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@_job
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and which exceed the limit."""
    counts = tokencounts.token_counts(_table(spark, sf_dir, "documents"), TOKENIZER)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


SHARDS = tuple(f"shard-{n:03d}" for n in range(64))


@_job
def op10_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document."""
    return sharding.place(_table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard", "shard_name")


_SLOT = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {sharding.KEY_DIGITS}))::BIGINT % {sharding.SLOTS}"
SQL["op10_shard_placement"] = f"""
WITH shards AS (SELECT string_split('{",".join(map(str, sharding.fill_table(SHARDS)))}', ',') AS filled),
placed AS (SELECT doc_id, {_SLOT} AS slot FROM documents)
SELECT doc_id, slot, filled[slot + 1]::INTEGER AS shard,
       'shard-' || lpad(filled[slot + 1], 3, '0') AS shard_name
FROM placed, shards
"""

@_job
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of five or more letters seen three times or more, its form and its root."""
    return variants.variants(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@_job
def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, long ones encoded by halves and joined, and their decoding."""
    return bpetree.encode(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


@_job
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated word blocks in every whole text, with the contract's planted periods."""
    return runs.periodic_runs(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )


JOBS["pipeline"] = corpus_pipeline.run
