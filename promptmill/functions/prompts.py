"""Column mapping, prompt normalisation, chat messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptmill.functions.text import as_column, strip

# An input field holding one of these words counts as "no input".
NO_INPUT_WORDS = ("<noinput>", "< noinput >", "none", "null", "n/a")

# Fields tried after the mapped one, in this order.
INSTRUCTION_FALLBACKS = ("instruction", "prompt", "question")
INPUT_FALLBACKS = ("input", "query")
OUTPUT_FALLBACKS = ("output", "response", "answer", "completion")

# The public ChatML markers.
TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>"


def first_present(available: Sequence[str], names: Sequence[str]) -> Column:
    """First non-null of ``names`` as a string, else the empty string.

    Names absent from ``available`` are resolved away while the plan is built. A
    present but empty string wins over later names: only null falls through.
    """
    wanted = [name for name in dict.fromkeys(names) if name in set(available)]
    picked = [F.col(f"`{name}`").cast("string") for name in wanted]
    return F.coalesce(*picked, F.lit(""))


def normalize_prompt(instruction: Column | str, input_text: Column | str) -> Column:
    """Instruction, then the input on its own line unless it says "no input"."""
    head, extra = strip(instruction), strip(input_text)
    has_input = (extra != "") & ~F.lower(extra).isin(*NO_INPUT_WORDS)
    return (
        F.when(has_input & (head != ""), F.concat_ws("\n", head, extra))
        .when(has_input, extra)
        .otherwise(head)
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(user_prompt: Column | str) -> Column:
    return F.array(_message("user", as_column(user_prompt)))


def chat_messages(user_prompt: Column | str, assistant_response: Column | str) -> Column:
    return F.array(
        _message("user", as_column(user_prompt)),
        _message("assistant", as_column(assistant_response)),
    )


def render_chat(messages: Column | str, add_generation_prompt: bool = False) -> Column:
    """Messages as ChatML text, optionally ending in an opened assistant turn."""
    turns = F.transform(
        as_column(messages),
        lambda m: F.concat(
            F.lit(TURN_OPEN), m["role"], F.lit("\n"), m["content"], F.lit(TURN_CLOSE + "\n")
        ),
    )
    text = F.array_join(turns, "")
    if add_generation_prompt:
        return F.concat(text, F.lit(f"{TURN_OPEN}assistant\n"))
    return text
