import pytest
from pyspark.sql import functions as F

from promptmill.functions import tokens as K
from promptmill.operators import rows


def ints(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def test_unwrap_ids(one):
    batch = lambda *lists: F.array(*[ints(*x) for x in lists])
    assert one(K.unwrap_ids(batch([1, 2, 3]))) == [1, 2, 3]
    with pytest.raises(Exception, match="found sequences: 2"):
        one(K.unwrap_ids(batch([1], [2])))


@pytest.mark.parametrize(
    ("prompt", "full", "boundary"),
    [([7, 8, 9], [7, 8, 9, 40, 41], 3), ([1, 2, 9], [1, 2, 3, 4], 2), ([9, 1], [9, 2], 1), ([1], [1], 1)],
)
def test_boundary(one, prompt, full, boundary):
    assert one(K.response_boundary(ints(*prompt), ints(*full))) == boundary


def test_boundary_errors(one):
    with pytest.raises(Exception, match="differ from the first id"):
        one(K.response_boundary(ints(9), ints(1, 2)))
    with pytest.raises(Exception, match="more ids than"):
        one(K.response_boundary(ints(1, 2, 3), ints(1, 2)))
    assert one(K.reject_reason(ints(9), ints(1, 2))) is not None
    assert one(K.reject_reason(ints(1), ints(1, 2))) is None


def test_labels_and_mask(one):
    full = ints(7, 8, 9, 40, 41)
    labels, mask = one(K.mask_labels(full, F.lit(3)), K.attention_mask(full))
    assert labels == [-100, -100, -100, 40, 41] and mask == [1] * 5


@pytest.mark.parametrize(
    ("source", "target", "cutoff", "kept"),
    # By hand: proportional share; a short side keeps all and the other gets the rest.
    [(1500, 500, 800, (600, 200)), (50, 700, 400, (50, 350)), (700, 60, 500, (440, 60)), (3, 4, 64, (3, 4))],
)
def test_truncation_budget(one, source, target, cutoff, kept):
    assert tuple(one(K.truncation_budget(F.lit(source), F.lit(target), cutoff))) == kept


def test_cutoff_must_be_positive(spark):
    with pytest.raises(ValueError):
        rows.supervise(spark.range(1), 0)


def encoded(spark, *values):
    return spark.createDataFrame(list(values), "id int, prompt_ids array<int>, full_ids array<int>")


def test_supervise_drops_long_and_unsupervised_rows(spark):
    frame = encoded(
        spark,
        (0, [1, 2], [1, 2, 3]),
        (1, [1, 2], list(range(1, 14))),
        (2, [1, 2], [1, 2]),
        (3, [1, 2], [1, 2, -100]),
        (4, [1, 9], [1, 2, 3]),
    )
    got = {r["id"]: r for r in rows.supervise(frame, 8, ["id"]).collect()}
    assert sorted(got) == [0, 4]
    assert got[0]["input_ids"] == [1, 2, 3] and got[0]["labels"] == [-100, -100, 3]
    assert got[4]["labels"] == [-100, 2, 3] and got[4]["attention_mask"] == [1, 1, 1]


def test_supervise_fails_without_a_boundary(spark):
    with pytest.raises(Exception, match="differ from the first id"):
        rows.supervise(encoded(spark, (0, [9], [1, 2])), 8, ["id"]).collect()


def texts(spark):
    return spark.createDataFrame(
        [(0, "Write f(x)", "def f(x):\n    return x"), (1, "a\tb é", "z" * 40)],
        "id int, user_prompt string, assistant_response string",
    )


def test_split_tokenising_equals_tokenising_the_whole(spark):
    from promptmill.functions.prompts import chat_messages, render_chat

    whole = texts(spark).select(
        K.token_ids(render_chat(chat_messages("user_prompt", "assistant_response"))).alias("ids")
    )
    parts = rows.encode(texts(spark), ["id"])
    assert [r["full_ids"] for r in parts.collect()] == [r["ids"] for r in whole.collect()]


def test_ids_are_computed_once(spark):
    plan = rows.supervise(rows.encode(texts(spark), ["id"]), 8, ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("md5") == 2  # once for the prompt, once for the response


def tiny_bpe():
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE(unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    alphabet = pre_tokenizers.ByteLevel.alphabet()
    trainer = trainers.BpeTrainer(vocab_size=300, initial_alphabet=alphabet, special_tokens=["?"])
    tokenizer.train_from_iterator(["def f(x): return x", "write a function"], trainer)
    return tokenizer


def test_user_tokenizer(spark):
    model = tiny_bpe().to_str()

    def load():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        return lambda batch: [e.ids for e in tokenizer.encode_batch(batch)]

    got = rows.supervise(rows.encode_with(texts(spark), load, ["id"]), 4096, ["id"]).collect()
    assert len(got) == 2
    for row in got:
        assert len(row["input_ids"]) == len(row["labels"])
        kept = [i for i in row["labels"] if i != -100]
        assert 0 < len(kept) < len(row["labels"]) and row["input_ids"][-len(kept):] == kept
