import re

import pytest
from pyspark.sql import functions as F

from promptmill.functions import code as C
from promptmill.functions import pyparse as Y
from promptmill.operators.metrics import syntax_rate


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("  x = 1 \n", "x = 1"),
        ("```\na\n``` then ```python\nb\n```", "b"),
        ("```py\nx=1\n```", "py\nx=1"),
        ("```python3\nx\n```", "3\nx"),
        ("see ```python\nopen", "open"),
        ("```python\nx````python\ny", "x"),
        ("```", ""),
        ("", ""),
    ],
)
def test_extract_code(one, text, code):
    assert one(C.extract_code(F.lit(text))) == code


@pytest.mark.parametrize(
    ("text", "answer"),
    [("assistant\nA assistant\nB", "B"), (" plain ", "plain"), ("assistant\n", ""), ("assistant", "assistant")],
)
def test_extract_answer(one, text, answer):
    assert one(C.extract_answer(F.lit(text))) == answer


@pytest.mark.parametrize(
    "code", ["x\ndef  f1 (a): pass\ndef g(): pass", "def é(x)", "def _a\u3000é(", "class A: pass", "undef f(", "def fé(x)"]
)
def test_function_name_like_the_python_pattern(one, code):
    match = re.search(r"def\s+([a-zA-Z_]\w*)\s*\(", code)
    assert one(C.function_name(F.lit(code))) == (match.group(1) if match else None)


@pytest.mark.parametrize(
    ("prompt", "text", "code", "expected"),
    [
        (" P ", "T", "import re\ndef f(a) -> int:\n  return 1", "P\nPython function: f(a) -> int"),
        ("", "T", "x = 1", "T"),
        (None, None, None, ""),
        ("P", None, "  def g( b ) :\r\n", "P\nPython function: g( b )"),
        ("P", None, "def one(): return 1\ndef two():", "P\nPython function: two()"),
        ("P", None, "def  :\ndef two():", "P"),
    ],
)
def test_mbpp_prompt(one, prompt, text, code, expected):
    cells = [F.lit(v).cast("string") for v in (prompt, text, code)]
    assert one(C.mbpp_prompt(*cells)) == expected


@pytest.mark.parametrize(
    ("setup", "imports", "tests", "expected"),
    [
        (" ", ["import re", " "], ["assert a", "assert b"], "import re\nassert a\nassert b"),
        ("s = 1", None, ["a"], "s = 1\na"),
        (None, None, [" a "], "a"),
        ("s", None, [" "], "s\n"),
    ],
)
def test_mbpp_test(one, setup, imports, tests, expected):
    array = lambda v: (F.array(*[F.lit(x) for x in v]) if v is not None else F.lit(None)).cast("array<string>")
    assert one(C.mbpp_test(F.lit(setup).cast("string"), array(imports), array(tests))) == expected


@pytest.mark.parametrize(
    ("prompt", "completion", "expected"),
    [
        ("def f():\n", "", "def f():"),
        ("def f():\n", "```python\ndef f():\n  return 1\n```", "def f():\n  return 1"),
        ("def f():\n", "    return 1", "def f():\nreturn 1"),
        ("", " ", ""),
    ],
)
def test_humaneval_candidate(one, prompt, completion, expected):
    assert one(C.humaneval_candidate(F.lit(prompt), F.lit(completion))) == expected


@pytest.mark.parametrize(
    ("test", "name", "expected"),
    [
        ("x\ncheck( f )", "f", "x\ncheck( f )"),
        ("x\ncheck( f ) ", "g", "x\ncheck( f )\n\ncheck(g)"),
        ("check(fxg)", "f.g", "check(fxg)\n\ncheck(f.g)"),
        ("check(f.g)", "f.g", "check(f.g)"),
        ("t", "  ", "t"),
        ("check\u3000(a\\Eb)", "a\\Eb", "check\u3000(a\\Eb)"),
        ("t", "a\\Eb.*", "t\n\ncheck(a\\Eb.*)"),
    ],
)
def test_humaneval_test(one, test, name, expected):
    assert one(C.humaneval_test(F.lit(test), F.lit(name))) == expected


def test_humaneval_reference_has_no_line_break(one):
    assert one(C.humaneval_reference(F.lit("def f():\n"), F.lit("  return 1"))) == "def f():  return 1"


@pytest.mark.parametrize(
    ("code", "valid"),
    [("x = 1", True), ("def f(:", False), ("", True), ("\0", False), ("(" * 5000, False), ("-" * 200_000 + "1", False)],
)
def test_validity_never_aborts(code, valid):
    assert (Y.parse_python(code) is not None) is valid


def test_syntax_rate(spark):
    schema = "benchmark string, candidate string"
    frame = spark.createDataFrame([("a", "x = 1"), ("a", "x ="), ("b", None)], schema)
    assert {r["benchmark"]: r["syntax_rate"] for r in syntax_rate(frame, ["benchmark"]).collect()} == {"a": 0.5, "b": 0.0}
    assert syntax_rate(frame.limit(0)).first()["syntax_rate"] == 0.0


def test_structure_ignores_names_but_not_shape():
    shape = lambda code: Y.subtree_signatures(Y.parse_python(code))
    flow = lambda code: Y.dataflow_edges(Y.parse_python(code))
    assert shape("a = b + 1") == shape("x = y + 2") != shape("x = y * 2")
    assert flow("def f(a):\n  b = a\n  return b") == [
        "var_0 comesFrom var_0",
        "var_1 computedFrom var_0",
        "var_1 comesFrom var_1",
    ]
    assert flow("for i in x:\n  t = t + i") == flow("for k in y:\n  s = s + k")
    assert flow("x += 1")[0] == "var_0 computedFrom var_0"


def test_dataflow_follows_reaching_definitions():
    flow = lambda code: Y.dataflow_edges(Y.parse_python(code))
    # Both branches reach the read.
    assert flow("if c:\n  x = 1\nelse:\n  x = 2\ny = x")[-2:] == ["var_0 comesFrom var_0,var_0", "var_1 computedFrom var_0"]
    # A later definition hides an earlier one; only one reaches.
    assert "var_0 comesFrom var_0" in flow("x = 1\nx = 2\ny = x")
    # A local shadows the outer name; the outer read still sees its own definition once.
    inner = flow("x = 1\ndef g():\n  x = 2\n  return x\nz = x")
    assert inner.count("var_0 comesFrom var_0") == 2 and "var_0 comesFrom var_0,var_0" not in inner
    # Nested functions read their closure.
    assert flow("def g(a):\n  def h():\n    return a\n  return h")[0] == "var_0 comesFrom var_0"
    # Loop-carried values: the value from before the loop and from the body both reach.
    looped = flow("x = 0\nwhile x < 3:\n  x = x + 1\nprint(x)")
    assert looped[-1] == "var_0 comesFrom var_0,var_0" and looped.count("var_0 comesFrom var_0,var_0") == 3
    # A break leaves with the state before the assignment, which joins the state after it.
    assert flow("x = 0\nfor i in r:\n  if i:\n    break\n  x = i\nprint(x)")[-1] == "var_0 comesFrom var_0,var_0"
    # Comprehension variables are read inside the comprehension only.
    comp = flow("y = [v for v in z if v]\nprint(v)")
    assert comp.count("var_1 comesFrom var_1") == 2 and comp[-1] != "var_1 comesFrom var_1"
    # Code that returns first: what follows is unreachable.
    assert flow("def f():\n  return 1\n  x = 2\n  y = x") == []
