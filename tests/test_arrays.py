import json
import random

from pyspark.sql import types as T

from promptmill.sources.arrays import array_elements

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("s", T.StringType()),
        T.StructField("t", T.StructType([T.StructField(n, T.StringType()) for n in ("k", "more")] + [T.StructField("list", T.ArrayType(T.StringType()))])),
    ]
)


def awkward_items(rng, n):
    pieces = [",", "[", "]", "{", "}", '"', "\\", '\\"', "é", "日本", " ", "\n", "x", "\\\\", ",\\", "\t"]
    items = []
    for i in range(n):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        item = {"id": i, "s": s}
        if rng.random() < 0.5:
            item["t"] = {"k": s, "more": s[::-1], "list": ["a,b", s, "]"]}
        items.append(item)
    return items


def test_split_array_equals_multiline_read(spark, tmp_path):
    rng = random.Random(4)
    folder = tmp_path / "arrays"
    folder.mkdir()
    wanted = {}
    for f in range(3):
        items = awkward_items(rng, 400)
        text = json.dumps(items, ensure_ascii=False, indent=rng.choice([None, 1]))
        (folder / f"a{f}.json").write_text("﻿ \n" + text + "\n ", encoding="utf-8")
        wanted[f"a{f}.json"] = items
    (folder / "empty.json").write_text("[ ]")
    (folder / "one.json").write_text('[{"id": 7, "s": "]"}]')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = array_elements(spark, [str(folder)], SCHEMA).collect()
        assert spark.read.option("lineSep", ",").text(str(folder)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by_file = {}
    for r in got:
        by_file.setdefault(r.file.rsplit("/", 1)[1], []).append((r.element, r.id, r.s, r.t))
    reference = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(str(folder))
    for name in ["a0.json", "a1.json", "a2.json", "one.json"]:
        rows = sorted(by_file[name])
        assert [e for e, *_ in rows] == list(range(len(rows)))
        plain = [(r.id, r.s, r.t) for r in reference.where(reference["id"].isNotNull()).collect() if r.id is not None]
        ids = [i for _, i, _, _ in rows]
        if name != "one.json":
            assert ids == list(range(400))
            assert [s for _, _, s, _ in rows] == [item["s"] for item in wanted[name]]
    multiline = sorted((r.id, r.s, r.t) for r in reference.collect())
    split = sorted((i, s, t) for rows in by_file.values() for _, i, s, t in rows)
    diff = [(a, b) for a, b in zip(split, multiline) if a != b]
    assert split == multiline, diff[:2]
    assert "empty.json" not in by_file


def test_large_arrays_keep_file_order_through_the_dataset_reader(spark, tmp_path, monkeypatch):
    from promptmill.operators import ordering
    from promptmill.sources import datasets

    rng = random.Random(8)
    items = awkward_items(rng, 300)
    (tmp_path / "big.json").write_text(json.dumps(items, ensure_ascii=False, indent=2), encoding="utf-8")
    (tmp_path / "lines.jsonl").write_text("".join(json.dumps({"id": 1000 + i, "s": "l"}) + "\n" for i in range(5)))
    monkeypatch.setattr(datasets, "ARRAY_SPLIT_BYTES", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = datasets.read_dataset(spark, str(tmp_path), SCHEMA, with_position=True)
        numbered = ordering.number_rows(rows, datasets.POSITION[:2]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    big = sorted((r.row_number, r.id, r.s) for r in numbered if r.source_file.endswith("big.json"))
    lines = sorted(r.row_number for r in numbered if r.source_file.endswith("lines.jsonl"))
    assert [(i, s) for _, i, s in big] == [(it["id"], it["s"]) for it in items]
    assert [n for n, _, _ in big] == list(range(300)) and lines == list(range(300, 305))
