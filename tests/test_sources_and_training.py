import json

import pytest
from pyspark.sql import functions as F

from promptmill.operators import ordering
from promptmill.plans.training import (
    PreparationOptions,
    format_dataset,
    load_and_prepare,
    prepare_training_data,
)
from promptmill.sources.benchmarks import humaneval_tasks, mbpp_tasks, read_completions, read_table, read_verdicts
from promptmill.sources.datasets import read_dataset, read_schema
from promptmill.sources.registry import DatasetSpec, dataset_names, load_registry, resolve_dataset
from promptmill.sources.turns import dialogue_pairs


def write_registry(folder, content):
    (folder / "dataset_info.json").write_text(json.dumps(content))
    return str(folder)


def test_registry_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_registry(spark, str(tmp_path))
    with pytest.raises(ValueError):
        load_registry(spark, write_registry(tmp_path, []))
    folder = write_registry(
        tmp_path, {"b": {}, "a": {"file_name": "no.json"}, "c": {"file_name": "c.json", "filter": ["x"]}}
    )
    (tmp_path / "c.json").write_text("[]")
    registry = load_registry(spark, folder)
    with pytest.raises(KeyError, match="a, b, c"):
        resolve_dataset(spark, registry, folder, "zzz")
    with pytest.raises(ValueError, match="file_name"):
        resolve_dataset(spark, registry, folder, "b")
    with pytest.raises(FileNotFoundError):
        resolve_dataset(spark, registry, folder, "a")
    with pytest.raises(ValueError, match="filter"):
        resolve_dataset(spark, registry, folder, "c")


def test_dataset_names():
    assert dataset_names(" a, ,b,,a ") == ["a", "b", "a"] and dataset_names(None) == []
    assert dataset_names([" a", "", "b,c"]) == ["a", "b,c"]


def test_input_field_choice():
    assert DatasetSpec("d", "", {"input": "i", "query": "q"}).input_names[0] == "i"
    assert DatasetSpec("d", "", {"query": "q"}).input_names[0] == "q"
    assert DatasetSpec("d", "").input_names[0] == "input"


ROWS = [{"instruction": f"do {i}", "output": str(i)} for i in range(5)]


@pytest.mark.parametrize("name", ["rows.json", "rows.jsonl", "odd.json"])
def test_arrays_and_lines_are_told_apart_by_content(spark, tmp_path, name):
    path = tmp_path / name
    text = json.dumps(ROWS, indent=1) if name == "rows.json" else "\n".join(map(json.dumps, ROWS))
    path.write_text(" \n" + text)
    got = read_dataset(spark, str(path), read_schema(DatasetSpec("d", str(path)))).collect()
    assert [(r["instruction"], r["output"], r["prompt"]) for r in got] == [
        (r["instruction"], r["output"], None) for r in ROWS
    ]
    assert read_dataset(spark, str(path)).columns == ["instruction", "output"]


def test_malformed_lines_fail(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"instruction": "a"}\n{"instruction": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_dataset(spark, str(path), read_schema(DatasetSpec("d", str(path)))).collect()


@pytest.fixture
def many_splits(spark):
    """Small splits, so one file is read by many tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("sort_below", [100_000, 5])
@pytest.mark.parametrize("n", [37, 180, 500, None])
def test_first_n_in_file_order_after_the_filter(spark, tmp_path, monkeypatch, many_splits, sort_below, n):
    monkeypatch.setattr(ordering, "SORT_BELOW", sort_below)
    monkeypatch.setattr(ordering, "ROWS_PER_FILE", 7)
    path = tmp_path / "rows.jsonl"
    lines = [{"instruction": str(i) if i % 7 else " ", "output": "x", "lang": "py" if i % 3 else "c"} for i in range(400)]
    path.write_text("".join(json.dumps(line) + "\n" for line in lines))
    spec = DatasetSpec("d", str(path), {}, {"lang": "py"})
    assert read_dataset(spark, str(path), read_schema(spec)).rdd.getNumPartitions() > 5
    got = format_dataset(spark, spec, PreparationOptions("d", max_samples=n))
    kept = [i for i in range(400) if i % 3][:n]
    want = {str(v): i for i, v in enumerate(kept) if v % 7}
    assert {r["user_prompt"]: r["row_number"] for r in got.collect()} == want


def training_folder(tmp_path):
    rows = [
        {"instruction": "a", "input": "", "output": "x"},
        {"instruction": "b", "input": "none", "output": "y"},
        {"instruction": " ", "input": "", "output": "blank"},
        {"instruction": "c", "input": "", "output": "long " * 300},
        {"instruction": "d", "input": "", "output": "sql row", "lang": "sql"},
    ]
    for row in rows[:4]:
        row["lang"] = "Python"
    (tmp_path / "one.json").write_text(json.dumps(rows))
    (tmp_path / "two.jsonl").write_text("".join(json.dumps({"query": f"q{i}", "response": f"r{i}"}) + "\n" for i in range(6)))
    return write_registry(
        tmp_path,
        {
            "one": {"file_name": "one.json", "filter": {"lang": "python"}, "columns": {"output": "output"}},
            "two": {"file_name": "two.jsonl", "columns": {"instruction": "query", "output": "response"}},
        },
    )


def test_four_rows_become_one_training_and_one_validation_row(spark, tmp_path):
    options = PreparationOptions("one", training_folder(tmp_path), cutoff_len=64, val_size=0.5)
    train, test = load_and_prepare(spark, options)
    assert train.count() == 1 and test.count() == 1
    assert train.columns == ["row_id", "dataset", "input_ids", "labels", "attention_mask"]


def test_whole_preparation(spark, tmp_path):
    folder = training_folder(tmp_path)
    options = PreparationOptions("one,two,two", folder, cutoff_len=64, max_samples=4, val_size=3)
    got = prepare_training_data(spark, options).orderBy("row_id").collect()
    assert [int(r["row_id"].partition(":")[0]) for r in got] == [0] * 2 + [1] * 4 + [2] * 4
    assert [int(r["row_id"].partition(":")[2]) for r in got] == [0, 1] + [0, 1, 2, 3] * 2
    assert [r["dataset"] for r in got] == ["one"] * 2 + ["two"] * 8
    assert sum(r["split"] == "test" for r in got) == 3
    train, none = load_and_prepare(spark, PreparationOptions("two", folder))
    assert none is None and train.count() == 6
    with pytest.raises(ValueError, match="no dataset"):
        load_and_prepare(spark, PreparationOptions(" , ", folder))


def test_cached_preparation_follows_what_it_depends_on(spark, tmp_path):
    folder = training_folder(tmp_path)
    cache = str(tmp_path / "cache")

    def count(**options):
        return prepare_training_data(spark, PreparationOptions("two", folder, cache_path=cache, **options)).count()

    def written():
        return min(f.stat().st_mtime_ns for f in (tmp_path / "cache").iterdir())

    assert count(cutoff_len=1) == 0
    assert count() == 6
    before = written()
    assert count(seed=7, val_size=0.5) == 6 and written() == before
    assert count(max_samples=2) == 2
    assert count(load_tokenizer=lambda: lambda texts: [[ord(c) for c in t] for t in texts]) == 6
    assert count() == 6
    (tmp_path / "two.jsonl").write_text(json.dumps({"query": "q", "response": "r"}) + "\n")
    assert count() == 1


def test_mixed_folder_and_broken_lines(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"id": n} for n in range(3)], indent=1))
    (folder / "b.jsonl").write_text("".join(json.dumps({"id": n}) + "\n" for n in range(3, 8)))
    assert sorted(r["id"] for r in read_dataset(spark, str(folder)).collect()) == list(range(8))
    array = tmp_path / "completions.json"
    record = {"benchmark": "mbpp", "task_id": "1", "sample_idx": 0, "text": "x"}
    array.write_text(json.dumps([record, record | {"sample_idx": 1}], indent=2))
    assert sorted(r["sample_idx"] for r in read_completions(spark, str(array)).collect()) == [0, 1]
    broken = tmp_path / "completions.jsonl"
    broken.write_text(json.dumps(record) + "\n{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_completions(spark, str(broken)).collect()


def test_bad_options():
    with pytest.raises(ValueError):
        PreparationOptions("a", cutoff_len=0)
    with pytest.raises(ValueError):
        PreparationOptions("a", val_size=-0.1)


@pytest.mark.parametrize("span", [1, 3, 4, 1024])
def test_pairs_of_long_gappy_conversations(spark, span):
    turns, want = [], []
    for conv in range(4):
        numbers = [n for n in range(60 if conv == 0 else 9) if (n * 7 + conv) % 5 and not 12 < n < 31]
        rows = [(conv, n, ("user", "assistant", "system")[(n * n + conv) % 3 % (2 + n % 2)], f"{conv}-{n}") for n in numbers]
        turns += rows
        want += [
            (a[0], a[1], a[3], b[3]) for a, b in zip(rows, rows[1:]) if (a[2], b[2]) == ("user", "assistant")
        ]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = dialogue_pairs(frame, span).select("conv_id", "turn", "instruction", "output").collect()
    assert want and sorted(tuple(r) for r in got) == sorted(want)


def test_benchmark_tasks(spark, tmp_path):
    human = spark.createDataFrame(
        [("HumanEval/0", "\ndef f():\n", "    return 1\n", "def check(c): pass\n", "f")],
        "task_id string, prompt string, canonical_solution string, test string, entry_point string",
    )
    human.write.parquet(str(tmp_path / "human"))
    task = humaneval_tasks(read_table(spark, str(tmp_path / "human"))).first()
    assert task["prompt"] == "def f():" and task["reference"] == "def f():    return 1\n"
    assert task["test"] == "def check(c): pass\n\ncheck(f)"
    mbpp = spark.createDataFrame(
        [(7, "P", "def f(a):\n  return a", ["import re"], ["assert 1"])],
        "task_id int, text string, code string, test_imports array<string>, test_list array<string>",
    )
    task = mbpp_tasks(mbpp).first()
    assert tuple(task) == ("mbpp", "7", "P\nPython function: f(a)", "def f(a):\n  return a", "import re\nassert 1")


def test_recorded_tables(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"benchmark": "mbpp", "task_id": "1", "sample_idx": 0, "text": "x", "passed": true}\n')
    assert tuple(read_completions(spark, str(path)).first()) == ("mbpp", "1", 0, "x")
    assert tuple(read_verdicts(spark, str(path)).first()) == ("mbpp", "1", 0, True)


def test_row_local_steps_accept_a_stream(spark, tmp_path):
    from promptmill.operators import rows

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"instruction": "a", "output": "b"}\n{"instruction": "", "output": "b"}\n')
    spec = DatasetSpec("d", "")
    stream = spark.readStream.schema(read_schema(spec)).json(str(tmp_path / "in"))
    ready = rows.supervise(rows.encode(rows.drop_blank(rows.map_columns(stream, spec))), 64)
    run = (
        ready.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count("*")).first()[0] == 1


def test_file_heads_of_many_small_files_in_one_job(spark, tmp_path):
    """10,000 files of both kinds are told apart in tasks, and read by their kind."""
    from promptmill.sources.datasets import file_heads

    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(10_000):
        if n % 3 == 0:
            text = f'﻿\n  [{{"id": {n}, "s": "{{[\\""}}]'
        elif n % 3 == 1:
            text = f'\n{{"id": {n}, "s": "]"}}\n'
        else:
            text = f'{{"id": {n}}}'
        (folder / f"f{n:05d}.json").write_text(text, encoding="utf-8")
    (folder / "blank.json").write_text("  \n\t")
    (folder / "empty.json").write_text("")
    heads = {r.file.rsplit("/", 1)[1]: r.head for r in file_heads(spark, str(folder)).collect()}
    assert len(heads) == 10_000
    assert all(heads[f"f{n:05d}.json"] == ("[" if n % 3 == 0 else "{") for n in range(10_000))
    assert sorted(r["id"] for r in read_dataset(spark, str(folder)).select("id").collect()) == list(range(10_000))


def test_stage_counts_come_with_the_write(spark, tmp_path):
    from promptmill.plans.training import prepare_with_counts

    folder = training_folder(tmp_path)
    options = PreparationOptions("one,two,two", folder, cutoff_len=64, max_samples=4)
    prepared, counts = prepare_with_counts(spark, options)
    one = [("one", "raw", 4), ("one", "not_blank", 3), ("one", "supervised", 2)]
    two = [("two", "raw", 4), ("two", "not_blank", 4), ("two", "supervised", 4)]
    assert counts == one + two + two
    assert prepared.count() == 10
    cache = str(tmp_path / "cache")
    built = prepare_with_counts(spark, PreparationOptions("one", folder, cutoff_len=64, cache_path=cache))[1]
    reused = prepare_with_counts(spark, PreparationOptions("one", folder, cutoff_len=64, cache_path=cache, seed=3))[1]
    assert built == reused == one


def test_observed_counts_equal_the_counting_pass(spark):
    from promptmill.plans import preparation_queries as Q

    folder = "/root/testdata/sf0.001"
    assert sorted(Q.observed_stage_counts(spark, folder).collect()) == sorted(Q.stage_counts(spark, folder).collect())


def broken_folder(tmp_path):
    good = [json.dumps({"query": f"q{i}", "response": f"r{i}"}) for i in range(5)]
    lines = good[:2] + ['{"query": "broken", "response": '] + good[2:]
    (tmp_path / "two.jsonl").write_text("\n".join(lines) + "\n")
    return write_registry(tmp_path, {"two": {"file_name": "two.jsonl", "columns": {"instruction": "query", "output": "response"}}})


def test_strict_runs_still_fail_on_a_malformed_line(spark, tmp_path):
    folder = broken_folder(tmp_path)
    with pytest.raises(Exception):
        prepare_training_data(spark, PreparationOptions("two", folder)).count()


def test_lenient_runs_quarantine_malformed_rows_and_rows_without_a_boundary(spark, tmp_path):
    from promptmill.plans.training import prepare_with_counts

    folder = broken_folder(tmp_path)
    dead = str(tmp_path / "dead")

    def load():
        # Prompts of q3 are encoded apart from their conversations: no boundary.
        def encode(texts):
            return [[7] if "q3" in t and "r3" not in t else [ord(c) % 97 for c in t] for t in texts]

        return encode

    options = PreparationOptions("two", folder, cutoff_len=4096, quarantine_path=dead, load_tokenizer=load)
    prepared, counts = prepare_with_counts(spark, options)
    assert prepared.count() == 4 and "reason" not in prepared.columns
    rejected = sorted(spark.read.parquet(dead).collect())
    assert [(r.dataset, r.row_number) for r in rejected] == [("two", 2), ("two", 4)]
    assert rejected[0].reason.startswith("Malformed JSON") and "differ" in rejected[1].reason
    assert counts == [("two", "raw", 6), ("two", "not_blank", 5), ("two", "supervised", 4)]


def test_filter_and_splitter_hooks_run_inside_the_preparation(spark, tmp_path):
    # Hooks defined inside the test travel by value, as a user's own functions do.
    def _short_prompts():
        return lambda prompts, responses: [len(p) < 2 for p in prompts]

    def _twice():
        return lambda prompt, response: [(prompt, response), (prompt, response + " again")]

    folder = training_folder(tmp_path)
    options = PreparationOptions("two", folder, cutoff_len=4096, load_filter=_short_prompts, load_splitter=_twice)
    got = prepare_training_data(spark, options).orderBy("row_id").collect()
    # Prompts q0..q5 are two characters long: the filter keeps none of them.
    assert got == []
    keep_all = PreparationOptions("two", folder, cutoff_len=4096, load_splitter=_twice)
    got = prepare_training_data(spark, keep_all).orderBy("row_id").collect()
    assert len(got) == 12
    assert [r.row_id.split(":")[1:] for r in got[:2]] == [["0" * 19, "0" * 10], ["0" * 19, "0" * 9 + "1"]]


def test_hook_returning_the_wrong_type_fails(spark, tmp_path):
    folder = training_folder(tmp_path)

    def bad():
        return lambda prompt, response: "not pairs"

    with pytest.raises(Exception, match="pairs of strings"):
        prepare_training_data(spark, PreparationOptions("two", folder, load_splitter=bad)).count()


def test_hooked_pairs_query_equals_its_sql(spark):
    import duckdb

    from promptmill.plans import preparation_queries as Q
    from promptmill.plans.catalog import CATALOG

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("conversations",):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(con.execute(CATALOG["hooked_pairs"].sql).fetchall())
    got = sorted(tuple(r) for r in Q.hooked_pairs(spark, folder).collect())
    assert got == want and len(got) > 0


def test_incremental_cache_tokenises_new_files_only(spark, tmp_path):
    from promptmill.plans.incremental import prepare_incremental
    from promptmill.plans.training import build_rows

    data = tmp_path / "data"
    data.mkdir()
    folder = data / "parts"
    folder.mkdir()
    for n in range(3):
        (folder / f"f{n}.jsonl").write_text("".join(json.dumps({"query": f"q{n}-{i}", "response": f"r{i}"}) + "\n" for i in range(4)))
    registry = write_registry(data, {"many": {"file_name": "parts", "columns": {"instruction": "query", "output": "response"}}})
    cache = str(tmp_path / "cache")
    options = PreparationOptions("many,many", registry, cutoff_len=4096, max_samples=10, cache_path=cache)

    def full():
        plain = PreparationOptions("many,many", registry, cutoff_len=4096, max_samples=10)
        return sorted((r.row_id, r.dataset, list(r.input_ids)) for r in build_rows(spark, plain).collect())

    got, built = prepare_incremental(spark, options)
    assert len(built) == 3
    assert sorted((r.row_id, r.dataset, list(r.input_ids)) for r in got.collect()) == full()
    got, built = prepare_incremental(spark, options)
    assert built == []
    (folder / "f1b.jsonl").write_text(json.dumps({"query": "new", "response": "one"}) + "\n")
    got, built = prepare_incremental(spark, options)
    assert [b.rsplit("/", 1)[1] for b in built] == ["f1b.jsonl"]
    assert sorted((r.row_id, r.dataset, list(r.input_ids)) for r in got.collect()) == full()


def test_file_heads_of_compressed_files(spark, tmp_path):
    import gzip

    from promptmill.sources.datasets import file_heads

    folder = tmp_path / "packed"
    folder.mkdir()
    with gzip.open(folder / "a.json.gz", "wt") as out:
        out.write('  [{"id": 1}, {"id": 2}]')
    with gzip.open(folder / "b.jsonl.gz", "wt") as out:
        out.write('{"id": 3}\n{"id": 4}\n')
    heads = {r.file.rsplit("/", 1)[1]: r.head for r in file_heads(spark, str(folder)).collect()}
    assert heads == {"a.json.gz": "[", "b.jsonl.gz": "{"}
    assert sorted(r["id"] for r in read_dataset(spark, str(folder)).collect()) == [1, 2, 3, 4]
