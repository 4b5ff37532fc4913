import json

import pytest

from promptmill.operators.rows import map_columns, row_filter
from promptmill.sources.datasets import read_dataset, read_schema
from promptmill.sources.registry import DatasetSpec

ROWS = [
    {"id": 0, "lang": " Python ", "flag": True, "n": 1},
    {"id": 1, "lang": "sql", "flag": False, "n": 1.0},
    {"id": 2, "lang": None, "flag": "true", "n": "1"},
    {"id": 3, "flag": 1, "n": 2},
]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    file = tmp_path_factory.mktemp("rows") / "rows.jsonl"
    file.write_text("".join(json.dumps(r) + "\n" for r in ROWS))
    return str(file)


@pytest.mark.parametrize(
    ("conditions", "kept_ids"),
    [
        ({"lang": "python"}, [0]),
        ({"lang": ["PYTHON", "sql"]}, [0, 1]),
        ({"lang": []}, []),
        ({"lang": None}, [2, 3]),
        ({"missing": None}, [0, 1, 2, 3]),
        ({"missing": "x"}, []),
        ({"flag": True}, [0, 3]),
        ({"flag": 1}, [0, 3]),
        ({"flag": "true"}, [0, 2]),
        ({"n": 1}, [0, 1]),
        ({"n": [2, "1"]}, [0, 2, 3]),
        ({"n": 1.0, "lang": ["python", None]}, [0]),
        ({}, [0, 1, 2, 3]),
    ],
)
def test_conditions_on_mixed_json(spark, path, conditions, kept_ids):
    spec = DatasetSpec("d", path, {"output": "id"}, conditions)
    kept = row_filter(read_dataset(spark, path, read_schema(spec)), conditions)
    assert sorted(int(r["id"]) for r in kept.select("id").collect()) == kept_ids


def read_back(spark, tmp_path, rows, columns, conditions):
    file = tmp_path / "rows.jsonl"
    file.write_text("".join(json.dumps(r) + "\n" for r in rows))
    spec = DatasetSpec("d", str(file), columns, conditions)
    return spec, row_filter(read_dataset(spark, str(file), read_schema(spec)), conditions)


def test_whole_numbers_are_exact(spark, tmp_path):
    rows = [{"id": 9007199254740992 + n, "output": str(n)} for n in range(3)]
    _, kept = read_back(spark, tmp_path, rows, {}, {"id": 9007199254740993})
    assert [r["output"] for r in kept.collect()] == ["1"]


def test_a_mapped_field_keeps_its_type(spark, tmp_path):
    rows = [{"instruction": "a", "output": 5}, {"instruction": "b", "output": "5"}, {"instruction": "c", "output": 6}]
    spec, kept = read_back(spark, tmp_path, rows, {}, {"output": 5})
    assert [tuple(r) for r in map_columns(kept, spec).collect()] == [("a", "5")]


def test_long_lists(spark, tmp_path):
    rows = [{"id": n, "output": f"t{n}"} for n in range(5)]
    _, kept = read_back(spark, tmp_path, rows, {}, {"id": list(range(3, 5003)), "output": [f"T{n}" for n in range(5000)]})
    assert sorted(r["output"] for r in kept.collect()) == ["t3", "t4"]


def test_typed_columns(spark):
    frame = spark.createDataFrame([(1, True, "1"), (2, False, "x")], "n int, flag boolean, s string")
    count = lambda conditions: row_filter(frame, conditions).count()
    assert count({"n": 1}) == 1 and count({"n": True}) == 1 and count({"s": 1}) == 0
    assert count({"flag": True}) == 1 and count({"flag": 2}) == 0 and count({"flag": "TRUE"}) == 1


def test_bad_filters(spark):
    frame = spark.range(1)
    with pytest.raises(ValueError):
        row_filter(frame, ["id"])
    with pytest.raises(ValueError):
        row_filter(frame, {"id": {"a": 1}})


def test_scan_needs_no_inference_and_reads_only_named_fields(spark, path):
    schema = read_schema(DatasetSpec("d", path, {"output": "answer_col"}, {"lang": "python", "n": 1}))
    assert "answer_col" in schema.names and "flag" not in schema.names
    assert schema["n"].dataType.typeName() == "variant"
