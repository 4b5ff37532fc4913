"""Completion clean-up, benchmark prompts and test programs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptmill.functions.text import BLANK_CLASS, as_column, rstrip, split_lines, strip, text_after

# Fences and the turn marker looked for in model output.
PYTHON_FENCE = "```python"
FENCE = "```"
ASSISTANT_MARK = "assistant\n"

# Unicode letters and digits count as word characters, as in Python patterns.
FUNCTION_NAME = rf"def[{BLANK_CLASS}]+([a-zA-Z_][\p{{L}}\p{{N}}_]*)[{BLANK_CLASS}]*\("


def extract_code(text: Column | str) -> Column:
    """Body of the first python fence, else of the first fence, else the whole text."""
    text = strip(text)

    def body(fence: str) -> Column:
        return strip(F.substring_index(text_after(text, fence), FENCE, 1))

    return (
        F.when(F.contains(text, F.lit(PYTHON_FENCE)), body(PYTHON_FENCE))
        .when(F.contains(text, F.lit(FENCE)), body(FENCE))
        .otherwise(text)
    )


def extract_answer(text: Column | str) -> Column:
    """What follows the last assistant marker, or the whole text."""
    return strip(F.substring_index(as_column(text), ASSISTANT_MARK, -1))


def clean_completion(text: Column | str) -> Column:
    return extract_code(extract_answer(text))


def function_name(code: Column | str) -> Column:
    """Name of the first function defined, null if none."""
    return F.nullif(F.regexp_extract(as_column(code), FUNCTION_NAME, 1), F.lit(""))


def mbpp_prompt(prompt: Column, text: Column, code: Column) -> Column:
    """Task text, then the first function signature of the solution on a new line."""
    blank = F.lit("")
    task = strip(F.coalesce(F.nullif(prompt, blank), F.nullif(text, blank), blank))
    lines = F.transform(split_lines(strip(F.coalesce(code, blank))), strip)
    headers = F.filter(lines, lambda line: F.startswith(line, F.lit("def ")) & F.endswith(line, F.lit(":")))
    header = F.get(headers, F.lit(0))
    signature = strip(F.substr(header, F.lit(5), F.length(header) - F.lit(5)))
    return F.when(signature != "", F.concat(task, F.lit("\nPython function: "), signature)).otherwise(task)


def mbpp_test(setup: Column, imports: Column, tests: Column) -> Column:
    """Setup code, imports and assertions as one program; blank parts are left out."""
    blank = F.lit("")
    none = F.array().cast("array<string>")
    setup_part = F.array(strip(F.coalesce(setup, blank)))
    import_parts = F.transform(F.coalesce(imports, none), lambda line: strip(F.coalesce(line, blank)))
    body = strip(F.array_join(F.coalesce(tests, none), "\n"))
    kept = F.filter(F.concat(setup_part, import_parts), lambda part: part != "")
    return F.array_join(F.concat(kept, F.array(body)), "\n")


def humaneval_candidate(prompt: Column | str, completion: Column | str) -> Column:
    """A whole program: the completion itself if it repeats the prompt, else prompt + code."""
    head = rstrip(prompt)
    code = extract_code(completion)
    return (
        F.when(code == "", head)
        .when(F.startswith(code, head), code)
        .otherwise(rstrip(F.concat(head, F.lit("\n"), code)))
    )


def humaneval_test(test: Column | str, entry_point: Column | str) -> Column:
    """The test text, with a call of ``check`` appended unless it is already there."""
    body = rstrip(test)
    name = strip(entry_point)
    quoted = F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    call = F.concat(
        F.lit(rf"check[{BLANK_CLASS}]*\([{BLANK_CLASS}]*"), quoted, F.lit(rf"[{BLANK_CLASS}]*\)")
    )
    return F.when((name == "") | F.regexp_like(body, call), body).otherwise(
        F.concat(body, F.lit("\n\ncheck("), name, F.lit(")"))
    )


def humaneval_reference(prompt: Column | str, canonical_solution: Column | str) -> Column:
    """The stripped prompt directly followed by the solution."""
    return F.concat(strip(prompt), as_column(canonical_solution))
