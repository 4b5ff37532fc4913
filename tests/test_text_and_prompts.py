import pytest
from pyspark.sql import functions as F

from promptmill.functions import prompts as P
from promptmill.functions import text as X
from promptmill.operators import rows
from promptmill.sources.registry import DatasetSpec

SAMPLES = ["", "  ", "\x1f a 　", "a ", "\x85x y ", "plain", "\n\t \xa0q "]


@pytest.mark.parametrize("text", SAMPLES)
def test_strip_like_python(one, text):
    assert one(X.strip(F.lit(text)), X.rstrip(F.lit(text))) == (text.strip(), text.rstrip())


@pytest.mark.parametrize("text", [*SAMPLES, "a b c\x1dd", "one  two\n"])
def test_split_words_like_python(one, text):
    assert one(X.split_words(F.lit(text))) == text.split()


def test_split_lines_like_python(one):
    text = "a\r\nb\rc\x0bd\x1ee f\x85g\n\nh"
    assert one(X.split_lines(F.lit(text))) == text.splitlines()


@pytest.mark.parametrize(
    ("instruction", "extra", "expected"),
    [
        ("explain", "none", "explain"),
        ("  do ", " x=1 ", "do\nx=1"),
        ("", "x", "x"),
        ("a", " < NoInput > ", "a"),
        ("a", "N/A", "a"),
        ("a", "null　", "a"),
        ("a", "nothing", "a\nnothing"),
        ("", "", ""),
    ],
)
def test_normalize_prompt(one, instruction, extra, expected):
    assert one(P.normalize_prompt(F.lit(instruction), F.lit(extra))) == expected


def mapped(spark, columns, schema, *values, **options):
    frame = spark.createDataFrame(list(values), schema)
    return [tuple(r) for r in rows.map_columns(frame, DatasetSpec("d", "", columns), **options).collect()]


def test_custom_columns(spark):
    columns = {"instruction": "goal", "query": "hint", "output": "reply_text"}
    schema = "goal string, hint string, reply_text string"
    assert mapped(spark, columns, schema, ("sort the list", "n=3", " ok  ")) == [("sort the list\nn=3", "ok")]


def test_only_null_falls_through(spark):
    schema = "instruction string, prompt string, output string, answer string"
    got = mapped(spark, {}, schema, (None, "p", None, "a"), ("", "p", "", "a"))
    assert got == [("p", "a"), ("", "")]


def test_input_repeats_a_query_instruction_unless_told_otherwise(spark):
    columns, schema = {"instruction": "query", "output": "response"}, "query string, response string"
    assert mapped(spark, columns, schema, ("q", "r")) == [("q\nq", "r")]
    assert mapped(spark, columns, schema, ("q", "r"), reuse_source=False) == [("q", "r")]


def test_non_string_fields_become_text(spark):
    assert mapped(spark, {}, "instruction int, output double", (3, 1.5)) == [("3", "1.5")]


def test_only_new_columns_remain(spark):
    frame = spark.createDataFrame([(1, "a", "b", "z")], "id int, instruction string, output string, other string")
    assert rows.map_columns(frame, DatasetSpec("d", ""), ["id"]).columns == [
        "id",
        "user_prompt",
        "assistant_response",
    ]


def test_drop_blank(spark):
    frame = spark.createDataFrame(
        [("a", "b"), (" 　", "b"), ("a", "\n")], "user_prompt string, assistant_response string"
    )
    assert [tuple(r) for r in rows.drop_blank(frame).collect()] == [("a", "b")]


def test_messages_and_rendering(one):
    messages, text, opened = one(
        P.chat_messages(F.lit("hi"), F.lit("yo")),
        P.render_chat(P.chat_messages(F.lit("hi"), F.lit("yo"))),
        P.render_chat(P.prompt_messages(F.lit("hi")), add_generation_prompt=True),
    )
    assert [m.asDict() for m in messages] == [
        {"role": "user", "content": "hi"},
        {"role": "assistant", "content": "yo"},
    ]
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert text.startswith(opened)
