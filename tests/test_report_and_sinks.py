import os

import pytest
from pyspark.sql import functions as F

from promptmill.operators.completions import choose_benchmark, clean_completions, pair_candidates
from promptmill.operators.report import metrics_report, summaries
from promptmill.plans.evaluation import evaluate, evaluate_and_save
from promptmill.sinks import scratch
from promptmill.sinks.tables import prepare_output, save_split

TASKS = [
    ("humaneval", "0", "def f(a):", "def f(a):    return a", "check(f)"),
    ("mbpp", "0", "Write g", "def g(b):\n    return b", "assert g(1)"),
]
COMPLETIONS = [
    ("humaneval", "0", 0, "assistant\n```python\n    return a\n```"),
    ("humaneval", "0", 1, "def f(a):\n    return a"),
    ("mbpp", "0", 0, "```python\ndef g(b):\n    return b\n```"),
    ("mbpp", "0", 1, "no code ("),
    ("mbpp", "9", 0, "task unknown"),
]
VERDICTS = [("humaneval", "0", 0, False), ("humaneval", "0", 1, True), ("mbpp", "0", 0, True), ("mbpp", "0", 1, True)]


@pytest.fixture
def tables(spark):
    return (
        spark.createDataFrame(COMPLETIONS, "benchmark string, task_id string, sample_idx int, text string"),
        spark.createDataFrame(TASKS, "benchmark string, task_id string, prompt string, reference string, test string"),
        spark.createDataFrame(VERDICTS, "benchmark string, task_id string, sample_idx int, passed boolean"),
    )


def test_pairing(tables):
    completions, tasks, _ = tables
    rows = pair_candidates(clean_completions(completions), tasks).collect()
    got = {(r["benchmark"], r["sample_idx"]): (r["candidate"], r["test"]) for r in rows}
    assert got == {
        ("humaneval", 0): ("def f(a):\nreturn a", "check(f)"),
        ("humaneval", 1): ("def f(a):\n    return a", "check(f)"),
        ("mbpp", 0): ("def g(b):\n    return b", "assert g(1)"),
        ("mbpp", 1): ("no code (", "assert g(1)"),
    }


def test_report(tables):
    completions, tasks, verdicts = tables
    report = {r["benchmark"]: r for r in evaluate(completions, tasks, verdicts, "1,2,3").collect()}
    assert report["humaneval"]["syntax_rate"] == 0.0 and report["mbpp"]["syntax_rate"] == 1.0
    assert report["humaneval"]["pass_at_k"] == {"pass@1": 0.5, "pass@2": 1.0, "pass@3": 0.0}
    assert sorted(report["mbpp"]["pass_at_k"]) == ["pass@1", "pass@2", "pass@3"]
    assert report["mbpp"]["codebleu"] == pytest.approx(1.0)
    only = evaluate(completions, tasks, verdicts, benchmark="mbpp").collect()
    assert [r["benchmark"] for r in only] == ["mbpp"] and only[0]["pass_at_k"] == {"pass@1": 1.0}


def test_unknown_benchmark(tables):
    with pytest.raises(ValueError):
        choose_benchmark(tables[0], "other")


def test_summaries(tables):
    completions, tasks, verdicts = tables
    report = metrics_report(pair_candidates(clean_completions(completions), tasks), verdicts, "1")
    lines = {r["benchmark"]: r["line"] for r in summaries(report).collect()}
    assert lines["humaneval"].startswith("HumanEval -> SyntaxRate: 0.0000, pass@1: 0.5000, CodeBLEU: 0.")
    unscored = report.withColumn("codebleu", F.lit(None).cast("double"))
    assert summaries(unscored).filter("benchmark = 'humaneval'").first()["line"].endswith("CodeBLEU: n/a")


def test_results_grow_by_run(spark, tables, tmp_path):
    path = str(tmp_path / "results")
    completions, tasks, verdicts = tables
    evaluate_and_save(completions, tasks, verdicts, path, "org/my model", "2,1")
    evaluate_and_save(completions, tasks, verdicts, path, "other", temperature=0.7)
    saved = {r["model"]: r for r in spark.read.json(path).collect()}
    assert sorted(saved) == ["org/my model", "other"]
    row = saved["org/my model"]
    assert row["pass_k"] == [1, 2] and row["model_safe"] == "org__my_model" and row["benchmark"] == "all"
    assert row["metrics"]["mbpp"]["pass_at_k"]["pass@1"] == 1.0 and row["max_new_tokens"] == 2048
    assert saved["other"]["temperature"] == 0.7


def test_output_folder_rule(spark, tmp_path):
    new = tmp_path / "out"
    assert prepare_output(spark, str(new)) == "append" and new.is_dir()
    (new / "old").write_text("x")
    (new / "deep").mkdir()
    with pytest.raises(ValueError):
        prepare_output(spark, str(new))
    assert prepare_output(spark, str(new), resume=True) == "append" and (new / "old").exists()
    assert prepare_output(spark, str(new), overwrite=True) == "overwrite" and not os.listdir(new)
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError):
        prepare_output(spark, str(tmp_path / "file"))


def test_save_split(spark, tmp_path):
    rows = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train"))
    save_split(rows, str(tmp_path / "data"))
    back = spark.read.parquet(str(tmp_path / "data"))
    assert back.filter("split = 'test'").count() == 3 and back.count() == 10


class FakeSession:
    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_scratch_folder_follows_the_session(spark):
    root = spark.conf.get(scratch.SCRATCH_CONF, None)
    if root:
        assert scratch.scratch_root(spark) == root.rstrip("/")
    shared = FakeSession(spark_master="spark://host", spark_checkpoint_dir="hdfs://shared/")
    assert scratch.scratch_root(shared) == "hdfs://shared"
    local = FakeSession(spark_master="local[2]")
    assert os.path.isdir(scratch.scratch_root(local)) and scratch.scratch_root(local) == scratch.scratch_root(local)
    with pytest.raises(ValueError, match="shared"):
        scratch.scratch_root(FakeSession(spark_master="yarn"))


def test_scratch_table_keeps_rows_and_types(spark):
    rows = spark.range(3).withColumn("ids", F.array(F.col("id").cast("int")))
    stored = scratch.scratch_table(rows)
    assert stored.dtypes == rows.dtypes and stored.count() == 3
    assert "Range" not in stored._jdf.queryExecution().executedPlan().toString()


def test_publication_is_atomic(spark, tmp_path):
    from promptmill.sinks import tables

    path = str(tmp_path / "published")

    def build(n):
        return lambda: spark.range(n).withColumnRenamed("id", "x")

    assert tables.prepared_table(spark, path, build(3), "one").count() == 3
    assert tables.prepared_table(spark, path, build(99), "one").count() == 3  # reused

    # A run that dies while writing its build leaves the published table as it was.
    def broken():
        return spark.range(5).selectExpr("raise_error('stopped') AS x")

    with pytest.raises(Exception):
        tables.prepared_table(spark, path, broken, "two")
    assert tables.current_version(spark, path)[1] == "one"
    assert tables.prepared_table(spark, path, build(99), "one").count() == 3

    # A new identity publishes a new build; old builds beyond the kept one are removed.
    for n, name in ((4, "two"), (5, "three"), (6, "four")):
        assert tables.prepared_table(spark, path, build(n), name).count() == n
    assert len(list((tmp_path / "published" / tables.VERSIONS).iterdir())) <= tables.KEPT_VERSIONS + 2


def test_report_state_merged_over_three_batches_equals_a_full_report(spark, tables, tmp_path):
    from promptmill.operators.report_state import merge_batch, report_from_state

    completions, tasks, verdicts = tables
    more = [("humaneval", "0", 2, "def f(a):\n    return a + 0"), ("mbpp", "0", 0, "def g(b):\n    return b * 1")]
    batches = [
        (COMPLETIONS[:2], VERDICTS[:2]),
        (COMPLETIONS[2:], VERDICTS[2:]),
        # A new sample, and mbpp sample 0 replaced: new text, now failing.
        (more, [("humaneval", "0", 2, True), ("mbpp", "0", 0, False)]),
    ]
    root = str(tmp_path / "state")
    everything, verdict_rows = {}, {}
    for rows, outcomes in batches:
        frame = spark.createDataFrame(rows, "benchmark string, task_id string, sample_idx int, text string")
        paired = pair_candidates(clean_completions(frame), tasks)
        merge_batch(spark, root, paired, spark.createDataFrame(outcomes, "benchmark string, task_id string, sample_idx int, passed boolean"))
        everything.update({r[:3]: r for r in rows})
        verdict_rows.update({r[:3]: r for r in outcomes})
        all_rows = spark.createDataFrame(list(everything.values()), "benchmark string, task_id string, sample_idx int, text string")
        all_verdicts = spark.createDataFrame(list(verdict_rows.values()), "benchmark string, task_id string, sample_idx int, passed boolean")
        full = metrics_report(pair_candidates(clean_completions(all_rows), tasks), all_verdicts, "1,2")
        merged = report_from_state(spark, root, "1,2")
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, full.collect()))
