import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from promptmill.functions import pyparse as Y
from promptmill.functions import scores as S
from promptmill.operators import codebleu as B
from promptmill.operators import joins
from promptmill.operators.metrics import mean_pass_at_k, task_pass_counts


def test_parse_k(one):
    assert S.parse_k("10,1,5,1,0") == [1, 5, 10] and S.parse_k("") == [1] and S.parse_k(None) == [1]
    assert S.parse_k([3, 3, -1]) == [3]
    assert S.samples_needed("10,1,5") == 10 and S.samples_needed(None) == 1
    array = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<int>")
    assert one(S.parse_k_column(array(10, 1, 5, 1, 0)), S.parse_k_column(array(-1))) == ([1, 5, 10], [1])


def published(n, c, k):
    return 1.0 if n - c < k else 1.0 - math.prod(1.0 - k / i for i in range(n - c + 1, n + 1))


def test_pass_at_k_equals_the_published_product(spark):
    cases = [(n, c) for n in range(1, 12) for c in range(n + 1)] + [(200, 3), (200, 150)]
    frame = spark.createDataFrame(cases, "n bigint, c bigint")
    ks = [1, 2, 5, 10, 70]
    got = frame.select("n", "c", *[S.pass_at_k("n", "c", k).alias(f"k{k}") for k in ks]).collect()
    for row in got:
        for k in (k for k in ks if k <= row["n"]):
            assert row[f"k{k}"] == pytest.approx(published(row["n"], row["c"], k), abs=1e-12)


def test_a_task_with_billions_of_samples_costs_no_more(one):
    n, c = F.lit(3_000_000_000), F.lit(1_000_000_000)
    assert one(S.pass_at_k(n, c, 2)) == pytest.approx(1 - (2 / 3) ** 2, abs=1e-6)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_mean_pass_at_k_and_its_gate(spark, partitions):
    rows = [("a", t, i, i < p) for t, n, p in (("x", 5, 2), ("y", 3, 0)) for i in range(n)]
    verdicts = spark.createDataFrame(rows, "benchmark string, task_id string, i int, passed boolean")
    counts = task_pass_counts(verdicts.repartition(partitions))
    got = {r["k"]: r["pass_at_k"] for r in mean_pass_at_k(counts, [1, 3, 5], ["benchmark"]).collect()}
    assert got[1] == pytest.approx((0.4 + 0) / 2) and got[3] == pytest.approx(published(5, 2, 3) / 2) and got[5] == 0.0


def test_no_tasks_score_zero(spark):
    empty = spark.createDataFrame([], "n bigint, c bigint")
    assert [r["pass_at_k"] for r in mean_pass_at_k(empty, [1, 5]).collect()] == [0.0, 0.0]


@pytest.mark.parametrize(
    ("rows", "options", "plan"),
    [
        (64, dict(batch_size=2, accumulation=4, epochs=2, warmup_ratio=0.25), (8, 16, 4)),
        (0, dict(batch_size=2, accumulation=4, epochs=0.5, warmup_ratio=0.05), (1, 1, 1)),
        (9, dict(batch_size=1, accumulation=8, epochs=1.5), (2, 3, None)),
        (9, dict(batch_size=1, accumulation=8, epochs=1.0, warmup_ratio=0.5, warmup_steps=-3), (2, 2, 0)),
    ],
)
def test_step_plan(one, rows, options, plan):
    assert tuple(one(S.step_plan(F.lit(rows), **options))) == plan


def test_summary_line_and_names(one):
    scores = F.create_map(F.lit("pass@1"), F.lit(0.25), F.lit("pass@10"), F.lit(1.0))
    line = S.summary_line(F.lit("MBPP"), F.lit(0.5), scores, F.lit(0.12345))
    assert one(line) == "MBPP -> SyntaxRate: 0.5000, pass@1: 0.2500, pass@10: 1.0000, CodeBLEU: 0.1235"
    assert one(S.safe_model_name(F.lit("a/b c"))) == "a__b_c"
    assert one(S.run_stamp(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "20240102_030405"


def brute_codebleu(pairs):
    def grams(words, n):
        return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))

    def smooth(top, bottom):
        return (top or 0.1) / bottom

    c_len = sum(len(c.split()) for c, _ in pairs)
    r_len = sum(len(r.split()) for _, r in pairs)
    brevity = 1.0 if c_len > r_len else (math.exp(1 - r_len / c_len) if c_len else 0.0)
    plain, weighted = [], []
    for n in range(1, 5):
        top = bottom = w_top = w_bottom = 0
        for c, r in pairs:
            cs, rs = grams(c.split(), n), grams(r.split(), n)
            weight = lambda g: 0.2 if n == 1 and g[0] not in B.KEYWORDS else 1.0  # noqa: B023, E731
            top += sum((cs & rs).values())
            bottom += max(1, sum(cs.values()))
            w_top += sum(v * weight(g) for g, v in (cs & rs).items())
            w_bottom += max(1, sum(v * weight(g) for g, v in rs.items()))
        plain.append((top, bottom))
        weighted.append((w_top, w_bottom))

    def bleu(parts):
        return brevity * math.exp(sum(math.log(smooth(*p)) for p in parts) / 4) if parts[0][0] else 0.0

    def share(extract):
        found = wanted = 0
        for c, r in pairs:
            trees = [Y.parse_python(c), Y.parse_python(r)]
            cs, rs = (Counter(extract(t)) if t else Counter() for t in trees)
            found, wanted = found + sum((cs & rs).values()), wanted + sum(rs.values())
        return found / wanted if wanted else 0.0

    parts = [bleu(plain), bleu(weighted), share(Y.subtree_signatures), share(Y.dataflow_edges)]
    return [*parts, (sum(parts[:3]) + (parts[3] or 1.0)) / 4]


CODES = [
    "def f(a):\n    b = a + 1\n    return b\n",
    "def g(x):\n    y = x + 1\n    return y\n",
    "for i in range(3):\n    print(i)",
    "x = 1",
    "not python at all (",
    "",
    "return return if if if",
]


@pytest.mark.parametrize("partitions", [1, 5])
def test_codebleu_equals_a_plain_computation(spark, partitions):
    rows = [(g, i, c, r) for g, chunk in (("a", CODES), ("b", CODES[:3]), ("c", CODES[3:]))
            for i, (c, r) in enumerate(itertools.product(chunk, CODES))]
    frame = spark.createDataFrame(rows, "grp string, i int, candidate string, reference string").repartition(3)
    scores = B.code_bleu(frame, ["grp", "i"], ["grp"], partitions)
    valid = {r["grp"]: r["syntax_rate"] for r in scores.collect()}
    for grp in "abc":
        own = [Y.parse_python(c) is not None for g, _, c, _ in rows if g == grp]
        assert valid[grp] == pytest.approx(sum(own) / len(own))
    got = {r["grp"]: list(r)[1:] for r in scores.drop("syntax_rate").collect()}
    for grp in "abc":
        assert got[grp] == pytest.approx(brute_codebleu([(c, r) for g, _, c, r in rows if g == grp]), abs=1e-9)
    whole = B.code_bleu(frame, ["grp", "i"], partitions=partitions).drop("syntax_rate").first()
    assert list(whole) == pytest.approx(brute_codebleu([(c, r) for _, _, c, r in rows]), abs=1e-9)


def test_codebleu_of_nothing_in_common(spark):
    frame = spark.createDataFrame([(0, "a b", "c d")], "i int, candidate string, reference string")
    row = B.code_bleu(frame, ["i"]).drop("syntax_rate").first()
    assert list(row) == pytest.approx(brute_codebleu([("a b", "c d")])) and row["ngram_match"] == 0.0


def test_items_are_never_shuffled(spark):
    frame = spark.range(10).selectExpr("id", "'a b' AS candidate", "'a c' AS reference")
    plan = B.pair_ngrams(frame, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_ngrams_of_a_pair_in_one_row_make_no_rows(spark):
    """A text's n-grams, four a word, were rows; now a pair passes as a few rows of sums."""
    text = "concat_ws(' ', transform(sequence(0, 4999), n -> concat('w', (n * id) % 997)))"
    frame = spark.range(1, 41).selectExpr("id", f"{text} AS candidate", f"reverse({text}) AS reference")
    sums = B.pair_ngrams(frame, ["id"], 1)
    assert {r["c1"] for r in sums.collect()} == {5000}
    nodes, rows = [sums._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
            continue
        children = node.children()
        nodes += [children.apply(n) for n in range(children.size())]
        if node.nodeName() == "Generate":
            rows.append(node.metrics().apply("numOutputRows").value())
    assert rows and max(rows) <= 4 * 40


def test_texts_of_a_pair_in_one_row_stay_plain_columns(spark):
    """In a struct among the grouping keys they took many times their size on disk (F3)."""
    frame = spark.createDataFrame([(1, "a b", "a"), (2, "c", "c d")], "id int, candidate string, reference string")
    kinds = {f.name: f.dataType.typeName() for f in B._ngram_rows(frame, ["id"]).schema.fields}
    assert "struct" not in kinds.values()
    sums = {r["id"]: (r["m1"], r["c1"], r["r1"], r["m2"]) for r in B.pair_ngrams(frame, ["id"], 2).collect()}
    assert sums == {1: (1, 2, 1, 0), 2: (1, 1, 2, 0)}


def test_ngrams_of_repeated_and_null_pairs(spark):
    """Rows of one pair are counted together; a null text has no words, blanks are Python's."""
    rows = [
        (1, "a b a if", "a a\u00a0b if"), (1, "a c", None), (1, "b", "b a if c"), (2, None, "x y"), (3, "", " \n"),
        (None, "if a", "a if a"), (None, "a", "if"), (4, "p\u2003q\x1cr  p q", "q r p q r"), (5, "é é", "é e"),
    ]
    frame = spark.createDataFrame(rows, "id int, candidate string, reference string").repartition(4)
    got = {r["id"]: r.asDict() for r in B.pair_ngrams(frame, ["id"], 3).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for key, sums in got.items():
        for n in range(1, 5):
            cs, rs = Counter(), Counter()
            for _, c, r in [row for row in rows if row[0] == key]:
                for text, into in ((c, cs), (r, rs)):
                    words = (text or "").split()
                    into.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
            weight = lambda g: 0.2 if n == 1 and g[0] not in B.KEYWORDS else 1.0  # noqa: B023, E731
            both = cs & rs
            assert (sums[f"m{n}"], sums[f"c{n}"], sums[f"r{n}"]) == (both.total(), cs.total(), rs.total())
            assert sums[f"wm{n}"] == pytest.approx(sum(v * weight(g) for g, v in both.items()))
            assert sums[f"wr{n}"] == pytest.approx(sum(v * weight(g) for g, v in rs.items()))


@pytest.mark.parametrize(("limit", "per_task"), [(1 << 20, 10), (0, 10), (0, 10**6)])
def test_lookup_join_with_a_hot_key(spark, limit, per_task):
    large = spark.range(300).selectExpr("IF(id % 3 = 0, 0, id % 20) AS k", "id")
    small = spark.range(15).selectExpr("id AS k", "concat('v', id) AS v")
    got = joins.lookup_join(large, small, ["k"], ["id"], broadcast_bytes=limit, rows_per_task=per_task)
    assert sorted(got.columns) == ["id", "k", "v"]
    want = [(k, i, f"v{k}") for i in range(300) for k in [0 if i % 3 == 0 else i % 20] if k < 15]
    assert sorted(tuple(r) for r in got.select("k", "id", "v").collect()) == sorted(want)
