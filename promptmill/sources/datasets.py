"""JSON and JSON Lines scans with an explicit, pruned schema."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill.sources.arrays import array_elements
from promptmill.sources.registry import DatasetSpec

# Where a scanned row stands: file, split inside the file, running id inside the task.
# Sorting by these restores file order whatever way Spark packed the splits.
POSITION = ("source_file", "source_block", "source_row")

# Array files larger than this are split over many tasks (when the schema is known); smaller ones
# are parsed whole, one task a file.
ARRAY_SPLIT_BYTES = 64 << 20

# Records of the head scan end at each opening brace: they stay about as small as a file's objects,
# also in a file that is one long line.
HEAD_SEPARATOR = "{"
# Blank characters before a file's first visible one (white space and the byte order mark).
_BLANK = "\\t\\n\\r \\uFEFF"


def _has_plain_value(expected: Any) -> bool:
    if isinstance(expected, list):
        return any(_has_plain_value(item) for item in expected)
    return not isinstance(expected, str)


def read_schema(spec: DatasetSpec) -> T.StructType:
    """Only the fields the mapping and the filter can touch.

    Text fields are read as strings. A field compared with a number, a boolean or null,
    mapped or not, is read as VARIANT, which keeps each row's own JSON type. No inference
    pass is needed, and unused fields are never materialised.
    """
    fields = {
        name: T.StringType()
        for name in [*spec.instruction_names, *spec.input_names, *spec.output_names]
    }
    for name, expected in spec.row_filter.items():
        if _has_plain_value(expected):
            fields[name] = T.VariantType()
        else:
            fields.setdefault(name, T.StringType())
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# The column of rows that could not be parsed, in lenient reads.
CORRUPT = "_corrupt_record"


def read_dataset(
    spark: SparkSession, path: str, schema: T.StructType | None = None, with_position: bool = False, lenient: bool = False
) -> DataFrame:
    """Scan JSON array and JSON Lines files, each told apart by its first visible byte.

    JSON Lines stay splittable. An array file larger than ``ARRAY_SPLIT_BYTES`` is split over
    many tasks when ``schema`` is given (``arrays.array_elements``); smaller ones, and all of them
    without a schema, are parsed one task a file. Malformed input fails, unless ``lenient``:
    then a malformed line (or array file, or array element) is a row whose ``_corrupt_record``
    holds its text and whose fields are null.
    """
    heads = {r.file: (r.head, r.size) for r in file_heads(spark, path).collect()}
    arrays = sorted(file for file, (byte, _) in heads.items() if byte == "[")
    split = [file for file in arrays if schema is not None and heads[file][1] > ARRAY_SPLIT_BYTES]
    arrays = [file for file in arrays if file not in split]
    others = sorted(set(heads) - set(arrays) - set(split))

    if lenient and schema is not None and CORRUPT not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    mode = "PERMISSIVE" if lenient else "FAILFAST"

    def scan(files: list[str], is_array: bool) -> DataFrame:
        reader = spark.read.option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", is_array)
        return _placed((reader if schema is None else reader.schema(schema)).json(files), with_position)

    parts = [scan(files, kind) for files, kind in ((others, False), (arrays, True)) if files]
    if split:
        parts.append(_placed_elements(array_elements(spark, split, schema, mode), with_position))
    if not parts:
        parts = [scan([path], False)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _placed_elements(elements: DataFrame, with_position: bool) -> DataFrame:
    """Elements of split arrays: ranged by file and element, so that each task holds a run of one
    file in order, as a scan split does; the task's number stands for the split."""
    if not with_position:
        return elements.drop("file", "element")
    ranged = elements.repartitionByRange("file", "element").sortWithinPartitions("file", "element")
    return ranged.select(
        "*",
        F.col("file").alias(POSITION[0]),
        F.spark_partition_id().cast("bigint").alias(POSITION[1]),
        F.monotonically_increasing_id().alias(POSITION[2]),
    ).drop("file", "element")


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """``file, head, size``: each file at ``path`` (a file, folder or glob), its first visible character and bytes.

    One Spark job reads the files in tasks through Spark's text reader, so any store Spark reads
    works and the driver opens no file. Blank and empty files have no row. Compressed files are
    read through their codec, as every Spark scan does. Every byte is read once (the text reader
    has no way to stop after the head); records are cut at ``{``, so none grows beyond an object.
    """
    records = spark.read.option("lineSep", HEAD_SEPARATOR).text(path)
    first = F.regexp_extract("value", f"^[{_BLANK}]*([^{_BLANK}])", 1)
    per_file = records.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        first.alias("first"),
        F.col("_metadata.file_size").alias("size"),
    ).groupBy("file").agg(
        F.min_by("first", "at").alias("first"), F.count(F.lit(1)).alias("records"), F.max("size").alias("size")
    )
    # A blank first record followed by another one: the separator itself came first.
    head = F.when(F.col("first") != "", F.col("first")).when(F.col("records") > 1, F.lit(HEAD_SEPARATOR))
    return per_file.select("file", head.alias("head"), "size").where(F.col("head").isNotNull())


def _placed(rows: DataFrame, with_position: bool) -> DataFrame:
    if not with_position:
        return rows
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias(POSITION[0]),
        F.col("_metadata.file_block_start").alias(POSITION[1]),
        F.monotonically_increasing_id().alias(POSITION[2]),
    )

