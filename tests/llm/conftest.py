import public_tokenizers
import pytest

from promptmill.sinks import scratch


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def documents(spark):
    """Documents with every awkward value: nulls, empty and long texts, ties, repeated rows, extra columns."""

    def build(rows, extra=True):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if extra:
            # Names that operators use inside.
            names = ("slot", "key", "mark", "size", "piece", "fingerprint", "dropped", "place", "shard", "rank", "_first")
            frame = frame.selectExpr("*", *[f"'x' AS `{n}`" for n in names])
        return frame

    return build


@pytest.fixture
def awkward():
    long = " ".join(f"word{n % 977}x" for n in range(30_000))
    line = "the quick brown fox jumps over the lazy dog by the river"
    return [
        (1, line, "en", "a", 3),
        (2, line, "en", "a", 3),
        (2, line, "en", "a", 3),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (None, "no id here but five words", None, "b", None),
        (None, None, None, None, None),
        (5, long, "fr", "b", 1),
        (6, "   \t ", "en", "b", 1),
        (7, "ünïcödé 日本語 \U0001f600 text\nsecond line é", "de", "c", 1),
        (8, line + " today", "en", "c", 1),
        (8, "another text of the same id", "en", "c", 1),
        (-9, "12 34 !!", "en", "a", 1),
    ]


@pytest.fixture(scope="session", autouse=True)
def clean_scratch():
    yield
    scratch.release_all()
