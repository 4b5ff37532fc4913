import pytest
from pyspark.sql import functions as F

from promptmill.functions.scores import split_size
from promptmill.operators import batching, ordering
from promptmill.sinks.scratch import scratch_table

PARTITIONS = [1, 4, 17]


def keyed(spark, n, partitions):
    return spark.range(n).select("id", (F.col("id") * 7 % 10).alias("v")).repartition(partitions)


def collected(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_head_n(spark):
    frame = spark.range(20).repartition(5)
    assert sorted(r["id"] for r in ordering.head_n(frame, ["id"], 3).collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in ordering.head_n(frame, ["-id"], 3).collect()) == [17, 18, 19]
    assert ordering.head_n(frame, ["id"], 0).count() == 0
    assert ordering.head_n(frame, ["id"], 100).count() == 20
    assert ordering.head_n(frame, ["id"], None).count() == 20


@pytest.mark.parametrize(
    ("order", "n", "sort_below"), [(["id"], 123, 3), (["v", "id"], 31, 3), (["-v", "id"], 499, 3), (["v", "-id"], 1, 100_000)]
)
def test_head_of_keys_with_nulls_and_ties(spark, monkeypatch, order, sort_below, n):
    monkeypatch.setattr(ordering, "SORT_BELOW", sort_below)
    monkeypatch.setattr(ordering, "RANGES", 4)
    frame = keyed(spark, 500, 7).withColumn("v", F.when(F.col("id") % 17 > 0, F.col("v")))
    directions = [F.col(c.removeprefix("-")).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    assert collected(ordering.head_n(frame, order, n)) == collected(frame.orderBy(*directions).limit(n))
    assert ordering.head_n(frame, order, 1000).count() == 500


def test_ties_at_the_end_are_an_error(spark):
    with pytest.raises(ValueError, match="tied"):
        ordering.head_n(keyed(spark, 500, 7), ["v"], 123)


def test_head_does_not_sort_rows_in_one_task(spark):
    plan = ordering.head_n(keyed(spark, 500, 7), ["id"], 10)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


@pytest.mark.parametrize(("bins", "sort_below"), [(256, 1), (4096, 10), (4096, 10_000)])
def test_nth_smallest_with_a_value_holding_a_third_of_the_rows(spark, monkeypatch, bins, sort_below):
    monkeypatch.setattr(ordering, "BINS", bins)
    monkeypatch.setattr(ordering, "SORT_BELOW", sort_below)
    numbers = [5] * 40 + list(range(80)) + [10**17]
    frame = spark.createDataFrame([(x,) for x in numbers], "value bigint").repartition(4)
    ranked = sorted(numbers)
    for n in (1, 30, 47, 121):
        found = ordering.nth_smallest(frame, n, 0, 1 << 60)
        below = sum(x < ranked[n - 1] for x in numbers)
        assert found == (ranked[n - 1], n - below, numbers.count(ranked[n - 1]))


def test_nth_smallest_over_a_full_bigint_range(spark):
    frame = spark.createDataFrame([(-(2**62),), (0,), (2**62,)], "value bigint")
    assert [ordering.nth_smallest(frame, n, -(2**62), 2**62 + 1).value for n in (1, 2, 3)] == [-(2**62), 0, 2**62]


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_shuffle_rank_is_a_stable_permutation(spark, partitions):
    ranked = ordering.with_shuffle_rank(keyed(spark, 300, partitions), "id", 42)
    positions = {r["id"]: r["position"] for r in ranked.collect()}
    assert sorted(positions.values()) == list(range(300))
    first = ordering.with_shuffle_rank(keyed(spark, 300, 1), "id", 42)
    assert positions == {r["id"]: r["position"] for r in first.collect()}
    order = [r["id"] for r in ordering.seeded_shuffle(keyed(spark, 300, partitions), "id", 42).collect()]
    assert [positions[i] for i in order] == list(range(300))
    assert order != sorted(order)


def test_other_seed_other_order(spark):
    orders = [[r["id"] for r in ordering.seeded_shuffle(spark.range(50), "id", s).collect()] for s in (1, 2)]
    assert orders[0] != orders[1]


@pytest.mark.parametrize("partitions", PARTITIONS)
@pytest.mark.parametrize(("size", "tests"), [(0.1, 30), (0.333, 100), (1.5, 1), (299, 299), (0, 0)])
def test_split_sizes_and_stability(spark, partitions, size, tests):
    labelled = ordering.label_split(keyed(spark, 300, partitions), "id", size)
    chosen = {r["id"] for r in labelled.filter("split = 'test'").collect()}
    assert len(chosen) == tests and labelled.count() == 300
    positions = ordering.with_shuffle_rank(keyed(spark, 300, 1), "id", 42)
    assert chosen == {r["id"] for r in positions.filter(F.col("position") < tests).collect()}


def test_split_parts_are_disjoint(spark):
    train, test = ordering.split(spark.range(10), "id", 0.5)
    assert sorted([r["id"] for r in train.collect()] + [r["id"] for r in test.collect()]) == list(range(10))
    assert ordering.split(spark.range(10), "id", 0)[1] is None


@pytest.mark.parametrize("size", [10, 11, 0.95, -1])
def test_bad_split_sizes(spark, size):
    with pytest.raises(ValueError):
        ordering.label_split(spark.range(10), "id", size)


def test_split_size_matches_float_rounding():
    assert split_size(3, 0.1) == 1 and split_size(1000, 0.1) == 100 and split_size(7, 0.5) == 4


def test_repeated_keys_fail_instead_of_splitting_wrongly(spark):
    frame = spark.range(9).select((F.col("id") % 2).alias("key"))
    with pytest.raises(ValueError, match="same `key`"):
        ordering.label_split(frame, "key", 2)


def test_a_null_key_counts_as_a_row(spark):
    frame = spark.createDataFrame([(None,), (1,), (2,), (3,)], "key bigint")
    assert ordering.label_split(frame, "key", 0.5).filter("split = 'test'").count() == 2


def test_colliding_order_values_break_on_the_key(spark, monkeypatch):
    monkeypatch.setattr(ordering, "shuffle_value", lambda key, seed: F.lit(7).cast("bigint"))
    chosen = ordering.label_split(spark.range(20).repartition(3), "id", 5).filter("split = 'test'")
    assert sorted(r["id"] for r in chosen.collect()) == [0, 1, 2, 3, 4]


def test_concat_keeps_duplicates_and_order(spark):
    a, b = spark.createDataFrame([("x",), ("x",)], "t string"), spark.createDataFrame([("y",)], "t string")
    merged = ordering.concat_datasets([("a", a), ("b", b)])
    assert collected(merged) == [("a", 0, "x"), ("a", 0, "x"), ("b", 1, "y")]
    with pytest.raises(ValueError):
        ordering.concat_datasets([])


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_batches_match_a_plain_computation(spark, partitions):
    frame = spark.range(53).select(
        "id", F.sequence(F.lit(0).cast("bigint"), F.col("id") % 11).cast("array<int>").alias("input_ids")
    )
    frame = frame.select("*", F.col("input_ids").alias("labels"), F.col("input_ids").alias("attention_mask"))
    stored = scratch_table(frame.repartition(partitions))
    batches = {}
    for row in batching.batch_pad(stored, "id", 4, pad_id=9, multiple_of=8).collect():
        batches.setdefault(row["batch_id"], []).append(row)
    assert sorted(len(b) for b in batches.values()) == [1] + [4] * 13
    for rows in batches.values():
        width = -(-max(r["id"] % 11 + 1 for r in rows) // 8) * 8
        for r in rows:
            n = r["id"] % 11 + 1
            assert r["input_ids"] == list(range(n)) + [9] * (width - n)
            assert r["labels"] == list(range(n)) + [-100] * (width - n)
            assert r["attention_mask"] == list(range(n)) + [0] * (width - n)


def test_keyed_bijection_for_every_size_up_to_10000():
    import numpy as np

    from promptmill.functions import permutation as PERM

    for n in range(1, 10_001):
        placed = PERM.positions(np.arange(n), n, 42)
        assert np.array_equal(np.sort(placed), np.arange(n)), n


def test_keyed_positions_equal_numpy_and_duckdb(spark):
    import duckdb
    import numpy as np

    from promptmill.functions import permutation as PERM
    from promptmill.operators import ordering as O
    from promptmill.plans import preparation_queries as Q

    for n in (1, 2, 3, 17, 1000, 4097):
        rows = spark.range(n).withColumnRenamed("id", "k")
        got = sorted((r.k, r.position) for r in O.keyed_positions(rows, "k", n, seed=42).collect())
        assert [p for _, p in got] == PERM.positions(np.arange(n), n, 42).tolist()
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(Q.CATALOG["keyed_shuffle"].sql if hasattr(Q, "CATALOG") else Q._keyed_sql()).fetchall())
    got = sorted(tuple(r) for r in Q.keyed_shuffle(spark, folder).collect())
    assert got == want
    assert sum(1 for r in got if r[3] == "test") == 100 and len({r[1] for r in got}) == 1000


@pytest.mark.parametrize("first_on_driver", [0, 10_000])
@pytest.mark.parametrize(("order", "n"), [(["id"], 123), (["v", "id"], 31), (["-v", "id"], 499), (["v", "-id"], 1)])
def test_both_ways_to_the_last_key_agree(spark, monkeypatch, first_on_driver, order, n):
    monkeypatch.setattr(ordering, "FIRST_ON_DRIVER", first_on_driver)
    monkeypatch.setattr(ordering, "SORT_BELOW", 3)
    monkeypatch.setattr(ordering, "RANGES", 4)
    frame = keyed(spark, 500, 7).withColumn("v", F.when(F.col("id") % 17 > 0, F.col("v")))
    directions = [F.col(c.removeprefix("-")).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    assert collected(ordering.head_n(frame, order, n)) == collected(frame.orderBy(*directions).limit(n))
    with pytest.raises(ValueError, match="tied"):
        ordering.head_n(keyed(spark, 500, 7), ["v"], 123)
