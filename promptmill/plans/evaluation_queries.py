"""Queries over the completion and scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions import code as C
from promptmill.functions.scores import safe_model_name
from promptmill.functions.text import BLANK_CLASS, LINE_END
from promptmill.operators import codebleu as B
from promptmill.operators import completions as M
from promptmill.operators import metrics, report
from promptmill.plans.catalog import query, sql_strip, table

# Derived columns, written in SQL that Spark and DuckDB read alike.
FENCED = (
    "CASE doc_id % 5 "
    "WHEN 0 THEN concat('Sure:', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'done') "
    "WHEN 1 THEN concat('```', chr(10), text, chr(10), '```') "
    "WHEN 2 THEN concat('```', chr(10), 'first', chr(10), '``` then ```python', chr(10), text, '```') "
    "WHEN 3 THEN concat('x ```python', chr(10), text) "
    "ELSE concat(chr(10), text, ' ') END"
)
DECODED = (
    "CASE turn % 3 WHEN 0 THEN concat('user', chr(10), 'q', chr(10), 'assistant', chr(10), text) "
    "WHEN 1 THEN concat('assistant', chr(10), 'a', chr(10), 'assistant', chr(10), text, ' ') ELSE text END"
)
COMMENT = "concat('# ', replace(replace(text, chr(13), ' '), chr(10), concat(chr(10), '# ')), chr(10))"
SOLUTION = (
    f"concat({COMMENT}, 'def f', doc_id, '(a, b):', chr(10), '    total = a + ', doc_id, chr(10), "
    "'    for i in b:', chr(10), '        total = total + i', chr(10), '    return total', chr(10))"
)
# The solution itself, a renamed variable, or text that does not parse.
ATTEMPT = (
    f"CASE doc_id % 3 WHEN 0 THEN {SOLUTION} WHEN 1 THEN replace({SOLUTION}, 'total', 'acc') "
    f"ELSE concat('def broken(:', chr(10), {COMMENT}) END"
)
PARSES = "doc_id % 3 <> 2"


def sql_code(value: str) -> str:
    """Code of a fenced text; ``value`` is a stripped column."""
    after_python = f"split_part(substr({value}, strpos({value}, '```python') + 9), '```', 1)"
    after_fence = f"split_part(substr({value}, strpos({value}, '```') + 3), '```', 1)"
    return (
        f"CASE WHEN contains({value}, '```python') THEN {sql_strip(after_python)} "
        f"WHEN contains({value}, '```') THEN {sql_strip(after_fence)} ELSE {value} END"
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query(f"""WITH fenced AS (SELECT doc_id, {sql_strip(FENCED)} AS t FROM documents)
SELECT doc_id, {sql_code("t")} AS code FROM fenced""")
def extract_code(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", C.extract_code(F.expr(FENCED)).alias("code"))


@query(f"""WITH decoded AS (SELECT conv_id, turn, {DECODED} AS t FROM conversations)
SELECT conv_id, turn, {sql_strip("string_split(t, concat('assistant', chr(10)))[-1]")} AS answer FROM decoded""")
def extract_answer(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", C.extract_answer(F.expr(DECODED)).alias("answer"))


NAMED = (
    "CASE doc_id % 3 WHEN 0 THEN concat(text, chr(10), 'def  f', doc_id, ' (x):', chr(10), 'def g():') "
    "WHEN 1 THEN concat('async def _h', doc_id, '(', text) ELSE text END"
)


@query(rf"""WITH named AS (SELECT doc_id, {NAMED} AS code FROM documents)
SELECT doc_id, nullif(regexp_extract(code, 'def\s+([a-zA-Z_]\w*)\s*\(', 1), '') AS name FROM named""")
def function_name(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", C.function_name(F.expr(NAMED)).alias("name"))


TASK_PROMPT = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat(text, ' ') END"
TASK_TEXT = "CASE doc_id % 8 WHEN 1 THEN NULL ELSE concat('Write ', text) END"
TASK_CODE = (
    "CASE doc_id % 3 WHEN 0 THEN concat('import re', chr(10), '  def f', doc_id, '(a) -> int: ', chr(13), chr(10), 'pass') "
    "WHEN 1 THEN concat(text, chr(10), 'def one(a): return a', chr(10), 'def two(b):', chr(10)) ELSE NULL END"
)


@query(f"""WITH tasks AS (
  SELECT doc_id, {sql_strip(f"coalesce(nullif({TASK_PROMPT}, ''), {TASK_TEXT}, '')")} AS task,
    list_filter(list_transform(string_split_regex(coalesce({TASK_CODE}, ''), '{LINE_END}'), lambda l: {sql_strip("l")}),
      lambda l: starts_with(l, 'def ') AND ends_with(l, ':'))[1] AS header
  FROM documents
)
SELECT doc_id, CASE WHEN header IS NULL THEN task
  ELSE concat(task, chr(10), 'Python function: ', {sql_strip("header[5:-2]")}) END AS prompt FROM tasks""")
def mbpp_prompt(spark: SparkSession, folder: str) -> DataFrame:
    prompt = C.mbpp_prompt(F.expr(TASK_PROMPT), F.expr(TASK_TEXT), F.expr(TASK_CODE))
    return documents(spark, folder).select("doc_id", prompt.alias("prompt"))


SETUP = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat('setup = ', doc_id, ' ') END"


@query(f"""WITH parts AS (
  SELECT [coalesce({SETUP}, ''), 'import re', ' ', concat(' import m', doc_id)] AS lead_in,
    concat('assert f(', doc_id, ')', chr(10), text) AS body, doc_id FROM documents
)
SELECT doc_id, array_to_string(list_concat(
  list_filter(list_transform(lead_in, lambda p: {sql_strip("p")}), lambda p: p <> ''), [{sql_strip("body")}]), chr(10)) AS program
FROM parts""")
def mbpp_test(spark: SparkSession, folder: str) -> DataFrame:
    program = C.mbpp_test(
        F.expr(SETUP),
        F.expr("array('import re', ' ', concat(' import m', doc_id))"),
        F.expr("array(concat('assert f(', doc_id, ')'), text)"),
    )
    return documents(spark, folder).select("doc_id", program.alias("program"))


STUB = "concat('def f', doc_id, '(x):', chr(10), '    # ', replace(text, chr(10), ' '), chr(10))"
COMPLETION = (
    f"CASE doc_id % 4 WHEN 0 THEN concat({STUB}, '    return x') WHEN 1 THEN '    return 1  ' "
    f"WHEN 2 THEN concat(' ', chr(10)) ELSE concat('```python', chr(10), '  y = 2', chr(10), '```') END"
)


@query(f"""WITH drafts AS (
  SELECT doc_id, {STUB} AS stub, rtrim({STUB}, concat(' ', chr(10))) AS head, {sql_strip(COMPLETION)} AS t FROM documents
), coded AS (SELECT *, {sql_code("t")} AS code FROM drafts)
SELECT doc_id, CASE WHEN code = '' THEN head WHEN starts_with(code, head) THEN code
  ELSE concat(head, chr(10), code) END AS candidate,
  concat({sql_strip("stub")}, '    return x') AS reference FROM coded""")
def humaneval_candidate(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id",
        C.humaneval_candidate(F.expr(STUB), F.expr(COMPLETION)).alias("candidate"),
        C.humaneval_reference(F.expr(STUB), F.lit("    return x")).alias("reference"),
    )


ENTRY = "CASE doc_id % 7 WHEN 0 THEN ' ' ELSE concat('f.', doc_id) END"
CHECKED = (
    "CASE doc_id % 3 WHEN 0 THEN concat(text, chr(10), 'check( f.', doc_id, ' )') "
    "WHEN 1 THEN concat(text, ' check(fx', doc_id, ')  ') ELSE text END"
)


@query(rf"""WITH programs AS (
  SELECT doc_id, rtrim({CHECKED}, concat(' ', chr(10))) AS body, trim({ENTRY}) AS name FROM documents
)
SELECT doc_id, CASE WHEN name = '' OR regexp_matches(body, concat('check\s*\(\s*\Q', name, '\E\s*\)')) THEN body
  ELSE concat(body, chr(10), chr(10), 'check(', name, ')') END AS program FROM programs""")
def humaneval_test(spark: SparkSession, folder: str) -> DataFrame:
    program = C.humaneval_test(F.expr(CHECKED), F.expr(ENTRY))
    return documents(spark, folder).select("doc_id", program.alias("program"))


FENCED_TURN = f"CASE conv_id % 2 WHEN 0 THEN concat('```python', chr(10), {DECODED}, chr(10), '``` ok') ELSE {DECODED} END"
NESTED_TURN = f"concat('assistant', chr(10), {FENCED_TURN})"


@query(f"""WITH answers AS (
  SELECT conv_id, turn, {sql_strip(f"string_split({NESTED_TURN}, concat('assistant', chr(10)))[-1]")} AS t FROM conversations
)
SELECT conv_id, turn, {sql_code("t")} AS text FROM answers""")
def completions_clean(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return M.clean_completions(turns.select("conv_id", "turn", F.expr(NESTED_TURN).alias("text")))


# Completions of 40 tasks: sample number and task from the document number.
SAMPLED = [
    "CASE doc_id % 2 WHEN 0 THEN 'humaneval' ELSE 'mbpp' END AS benchmark",
    "CAST(doc_id % 40 AS STRING) AS task_id",
    "CAST(floor(doc_id / 40) AS INT) AS sample_idx",
]
ITEM = [
    "CASE item_id % 2 WHEN 0 THEN 'humaneval' ELSE 'mbpp' END AS benchmark",
    "CAST(item_id AS STRING) AS task_id",
]


@query(f"""WITH answers AS (
  SELECT {", ".join(SAMPLED)}, {sql_strip("string_split(text, concat('assistant', chr(10)))[-1]")} AS t FROM documents
),
completions AS (SELECT benchmark, task_id, sample_idx, {sql_code("t")} AS t FROM answers),
tasks AS (SELECT {", ".join(ITEM)}, text AS reference, rtrim(text, concat(' ', chr(10))) AS head FROM benchmark),
coded AS (SELECT *, {sql_code("t")} AS code FROM completions JOIN tasks USING (benchmark, task_id))
SELECT benchmark, task_id, sample_idx, reference, concat(reference, chr(10), 'check(f)') AS test,
  CASE WHEN benchmark = 'mbpp' THEN t WHEN code = '' THEN head WHEN starts_with(code, head) THEN code
    ELSE concat(head, chr(10), code) END AS candidate
FROM coded""")
def pair_candidates(spark: SparkSession, folder: str) -> DataFrame:
    completions = documents(spark, folder).selectExpr(*SAMPLED, "text")
    items = table(spark, folder, "benchmark").selectExpr(
        *ITEM, "text AS prompt", "text AS reference", "concat(text, chr(10), 'check(f)') AS test"
    )
    return M.pair_candidates(M.clean_completions(completions), items)


def event_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "CASE user_id % 2 WHEN 0 THEN 'humaneval' ELSE 'mbpp' END AS benchmark",
        "CAST(user_id AS STRING) AS task_id",
        "event_type <> 'error' AS passed",
    )


EVENT_COUNTS = """counts AS (
  SELECT CASE user_id % 2 WHEN 0 THEN 'humaneval' ELSE 'mbpp' END AS benchmark, CAST(user_id AS STRING) AS task_id,
    count(*) AS n, count(*) FILTER (event_type <> 'error') AS c
  FROM events GROUP BY ALL
)"""


@query(f"WITH {EVENT_COUNTS} SELECT benchmark, task_id, n::BIGINT AS n, c::BIGINT AS c FROM counts")
def task_pass_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.task_pass_counts(event_verdicts(spark, folder))


def sql_pass_at_k(k: str) -> str:
    """The published product over the last c samples."""
    product = f"list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - {k} / i::DOUBLE))"
    return f"CASE WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - {product} END"


@query(f"""WITH {EVENT_COUNTS}, ks AS (SELECT unnest([1, 5, 10])::BIGINT AS k)
SELECT benchmark, k, round(CASE WHEN min(n) >= k THEN avg({sql_pass_at_k("k")}) ELSE 0.0 END, 6)::DOUBLE AS pass_at_k
FROM counts, ks GROUP BY benchmark, k""")
def pass_at_k(spark: SparkSession, folder: str) -> DataFrame:
    counts = metrics.task_pass_counts(event_verdicts(spark, folder))
    scores = metrics.mean_pass_at_k(counts, [1, 5, 10], ["benchmark"])
    return scores.withColumn("pass_at_k", F.round("pass_at_k", 6))


@query(f"""WITH counts AS (
  SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY l_orderkey
), ks AS (SELECT unnest([1, 5])::BIGINT AS k)
SELECT k, round(CASE WHEN min(n) >= k THEN avg({sql_pass_at_k("k")}) ELSE 0.0 END, 6)::DOUBLE AS pass_at_k
FROM counts, ks GROUP BY k""")
def pass_at_k_gated(spark: SparkSession, folder: str) -> DataFrame:
    """Some orders have one line only, so k = 5 scores zero."""
    verdicts = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_returnflag = 'R' AS passed")
    scores = metrics.mean_pass_at_k(metrics.task_pass_counts(verdicts, ["l_orderkey"]), [1, 5])
    return scores.withColumn("pass_at_k", F.round("pass_at_k", 6))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Two samples per document, not always numbered from 0; the first is scored against the solution."""
    return documents(spark, folder).select(
        F.expr("CASE doc_id % 2 WHEN 0 THEN 'humaneval' ELSE 'mbpp' END").alias("benchmark"),
        F.col("doc_id").cast("string").alias("task_id"),
        F.explode(F.expr("array(int(doc_id % 3), int(doc_id % 3 + 1))")).alias("sample_idx"),
        F.expr(ATTEMPT).alias("candidate"),
        F.expr(SOLUTION).alias("reference"),
        "lang",
    )


@query("""WITH tasks AS (
  SELECT CASE doc_id % 2 WHEN 0 THEN 'humaneval' ELSE 'mbpp' END AS benchmark, doc_id FROM documents WHERE doc_id % 5 <> 0
),
samples AS (
  SELECT CASE doc_id % 2 WHEN 0 THEN 'humaneval' ELSE 'mbpp' END AS benchmark, doc_id, 2 AS n FROM documents WHERE doc_id % 7 <> 0
)
SELECT benchmark, count(t.doc_id) AS tasks, sum(coalesce(n, 0))::BIGINT AS samples,
  count(*) FILTER (s.doc_id IS NULL) AS silent_tasks,
  coalesce(sum(n) FILTER (t.doc_id IS NULL), 0)::BIGINT AS stray_samples
FROM tasks t FULL JOIN samples s USING (benchmark, doc_id) GROUP BY benchmark""")
def pairing_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks that nobody answered, and answers to no task."""
    tried = attempts(spark, folder)
    asked = tried.filter("task_id % 5 <> 0").select("benchmark", "task_id").distinct()
    return M.pairing_counts(tried.filter("task_id % 7 <> 0"), asked)


@query(f"""SELECT lang, round(avg(CASE WHEN {PARSES} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS syntax_rate
FROM documents GROUP BY lang""")
def syntax_rate(spark: SparkSession, folder: str) -> DataFrame:
    first = M.first_candidates(attempts(spark, folder))
    return metrics.syntax_rate(first, ["lang"]).withColumn("syntax_rate", F.round("syntax_rate", 6))


def sql_items(sides: str) -> str:
    """CTEs up to ``per_pair``: matches of n-grams over ``sides(grp, pair_id, is_ref, text)``."""
    grams = "\n  UNION ALL ".join(
        f"SELECT grp, pair_id, is_ref, {n} AS n, "
        f"unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM words"
        for n in range(1, B.ORDERS + 1)
    )
    keywords = ", ".join(f"'{word}'" for word in B.KEYWORDS)
    return f"""sides AS ({sides}),
words AS (
  SELECT grp, pair_id, is_ref, list_filter(string_split_regex(text, '[{BLANK_CLASS}]+'), lambda x: x <> '') AS w FROM sides
),
grams AS ({grams}),
counted AS (
  SELECT grp, pair_id, n, gram, count(*) FILTER (NOT is_ref) AS c, count(*) FILTER (is_ref) AS r,
    CASE WHEN n = 1 AND gram NOT IN ({keywords}) THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM grams GROUP BY ALL
),
per_pair AS (
  SELECT grp, pair_id, n, sum(least(c, r)) AS m, sum(c) AS c, sum(r) AS r, sum(least(c, r) * weight) AS wm, sum(r * weight) AS wr
  FROM counted GROUP BY grp, pair_id, n
)"""


def sql_scores(sides: str) -> str:
    """CTEs up to ``scores(grp, ngram_match, weighted_ngram_match)``."""
    def mean(top: str, bottom: str) -> str:
        logs = f"sum(ln(CASE WHEN {top} = 0 THEN 0.1 ELSE {top} END / {bottom}))"
        return f"CASE WHEN min(CASE WHEN n = 1 THEN {top} END) = 0 THEN 0.0 ELSE exp({logs} / 4.0) END"

    return f"""{sql_items(sides)},
pair_totals AS (SELECT grp, count(DISTINCT pair_id) AS pairs FROM sides GROUP BY grp),
corpus AS (
  SELECT grp, n, sum(m)::DOUBLE AS m, sum(greatest(c, 1)) - count(*) + any_value(pairs) AS c, sum(wm) AS wm,
    sum(greatest(wr, 1)) - count(*) + any_value(pairs) AS wr, sum(c) AS c_len, sum(r) AS r_len
  FROM per_pair JOIN pair_totals USING (grp) GROUP BY grp, n
),
lengths AS (SELECT grp, c_len::DOUBLE AS c_len, r_len::DOUBLE AS r_len FROM corpus WHERE n = 1),
means AS (SELECT grp, {mean("m", "c")} AS plain, {mean("wm", "wr")} AS weighted FROM corpus GROUP BY grp),
scores AS (
  SELECT grp, bp * plain AS ngram_match, bp * weighted AS weighted_ngram_match
  FROM means JOIN (SELECT grp, CASE WHEN c_len > r_len THEN 1.0 ELSE exp(1 - r_len / c_len) END AS bp FROM lengths) USING (grp)
)"""


NEIGHBOURS = """SELECT 0 AS grp, a.doc_id AS pair_id, false AS is_ref, a.text AS text
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
  UNION ALL SELECT 0, a.doc_id, true, b.text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"""


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a candidate, the next one as its reference."""
    texts = documents(spark, folder).select("doc_id", F.col("text").alias("candidate"))
    following = texts.select((F.col("doc_id") - F.lit(1)).alias("doc_id"), F.col("candidate").alias("reference"))
    return texts.join(following, "doc_id")


@query(f"""WITH {sql_items(NEIGHBOURS)}
SELECT n::INT AS n, sum(m)::BIGINT AS matched, sum(c)::BIGINT AS candidate_items, sum(r)::BIGINT AS reference_items
FROM per_pair GROUP BY n""")
def bleu_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    sums = B.pair_ngrams(neighbours(spark, folder), ["doc_id"]).agg(
        *[F.sum(f"{side}{n}").alias(f"{side}{n}") for side in "mcr" for n in B.NGRAM_KINDS]
    )
    by_order = [
        F.struct(
            F.lit(n).alias("n"),
            F.col(f"m{n}").alias("matched"),
            F.col(f"c{n}").alias("candidate_items"),
            F.col(f"r{n}").alias("reference_items"),
        )
        for n in B.NGRAM_KINDS
    ]
    return sums.select(F.inline(F.array(*by_order)))


@query(f"""WITH {sql_scores(NEIGHBOURS)}
SELECT round(ngram_match, 6)::DOUBLE AS ngram_match, round(weighted_ngram_match, 6)::DOUBLE AS weighted_ngram_match
FROM scores""")
def bleu_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = B.ngram_bleu(neighbours(spark, folder), ["doc_id"])
    return scores.select(*[F.round(name, 6).alias(name) for name in scores.columns])


SIDES = f"""SELECT lang AS grp, doc_id AS pair_id, false AS is_ref, {ATTEMPT} AS text FROM documents
  UNION ALL SELECT lang, doc_id, true, {SOLUTION} FROM documents"""


@query(f"""WITH {sql_scores(SIDES)},
parsed AS (SELECT lang AS grp, avg(CASE WHEN {PARSES} THEN 1.0 ELSE 0.0 END) AS valid FROM documents GROUP BY lang)
SELECT grp AS lang, round(ngram_match, 6)::DOUBLE AS ngram_match, round(weighted_ngram_match, 6)::DOUBLE AS weighted_ngram_match,
  round(valid, 6)::DOUBLE AS syntax_match, round(valid, 6)::DOUBLE AS dataflow_match,
  round(0.25 * ngram_match + 0.25 * weighted_ngram_match + 0.25 * valid + 0.25 * valid, 6)::DOUBLE AS codebleu
FROM scores JOIN parsed USING (grp)""")
def codebleu(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts that parse have the shape and the data flow of the solution; others have none."""
    first = M.first_candidates(attempts(spark, folder))
    scores = B.code_bleu(first, ["lang", "task_id"], ["lang"])
    rounded = [F.round(name, 6).alias(name) for name in scores.columns if name not in ("lang", "syntax_rate")]
    return scores.select("lang", *rounded)


BENCHMARK = "CASE doc_id % 2 WHEN 0 THEN 'humaneval' ELSE 'mbpp' END"
REPORT_SQL = f"""WITH {EVENT_COUNTS},
{sql_scores(SIDES.replace("SELECT lang AS grp", f"SELECT {BENCHMARK} AS grp").replace("SELECT lang,", f"SELECT {BENCHMARK},"))},
syntax AS (
  SELECT CASE doc_id % 2 WHEN 0 THEN 'humaneval' ELSE 'mbpp' END AS benchmark,
    avg(CASE WHEN {PARSES} THEN 1.0 ELSE 0.0 END) AS syntax_rate FROM documents GROUP BY ALL
),
passed AS (
  SELECT benchmark, avg({sql_pass_at_k("1")}) AS pass_at_1, avg({sql_pass_at_k("10")}) AS pass_at_10
  FROM counts GROUP BY benchmark
),
bleu AS (
  SELECT grp AS benchmark, 0.25 * ngram_match + 0.25 * weighted_ngram_match + 0.5 * syntax_rate AS codebleu
  FROM scores JOIN syntax ON grp = benchmark
),
report AS (SELECT * FROM syntax JOIN passed USING (benchmark) JOIN bleu USING (benchmark))"""


def full_report(spark: SparkSession, folder: str) -> DataFrame:
    return report.metrics_report(attempts(spark, folder), event_verdicts(spark, folder), "10,1")


@query(f"""{REPORT_SQL}
SELECT benchmark, round(syntax_rate, 6)::DOUBLE AS syntax_rate, round(pass_at_1, 6)::DOUBLE AS pass_at_1,
  round(pass_at_10, 6)::DOUBLE AS pass_at_10, round(codebleu, 6)::DOUBLE AS codebleu FROM report""")
def metrics_report(spark: SparkSession, folder: str) -> DataFrame:
    scores = full_report(spark, folder)
    return scores.select(
        "benchmark",
        F.round("syntax_rate", 6).alias("syntax_rate"),
        F.round(F.col("pass_at_k")["pass@1"], 6).alias("pass_at_1"),
        F.round(F.col("pass_at_k")["pass@10"], 6).alias("pass_at_10"),
        F.round("codebleu", 6).alias("codebleu"),
    )


@query(f"""{REPORT_SQL}
SELECT benchmark, concat(CASE benchmark WHEN 'mbpp' THEN 'MBPP' ELSE 'HumanEval' END, ' -> SyntaxRate: ',
  printf('%.4f', syntax_rate::DOUBLE), ', pass@1: ', printf('%.4f', pass_at_1::DOUBLE), ', pass@10: ',
  printf('%.4f', pass_at_10::DOUBLE), ', CodeBLEU: ', printf('%.4f', codebleu::DOUBLE)) AS line, 'org__tiny_model' AS model_safe FROM report""")
def metric_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = report.summaries(full_report(spark, folder))
    return lines.withColumn("model_safe", safe_model_name(F.lit("org/tiny model")))
