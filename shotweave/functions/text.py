"""Text pieces: sentences, numbers, responses, token masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotweave.functions.labels import MISSING

# Fixed value: first number of a text. An exponent is never part of it.
NUMBER_PATTERN = r"-?\d+\.?\d*"
BLANKS = " \t\n\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def front_sentences(text: Column) -> Column:
    """Everything before the last ``". "``; empty for a single sentence."""
    parts = F.split(text, "[.] ")
    return F.concat_ws(". ", F.slice(parts, F.lit(1), F.size(parts) - 1))


def last_sentence(text: Column) -> Column:
    return F.element_at(F.split(text, "[.] "), -1)


def first_number(text: Column) -> Column:
    """First number in the text, NULL if there is none."""
    return F.regexp_substr(text, F.lit(NUMBER_PATTERN)).try_cast("double")


def compact_number(text: Column) -> Column:
    """As :func:`first_number` after removing spaces (for decoded truth texts)."""
    return first_number(F.replace(text, F.lit(" "), F.lit("")))


def response(text: Column, marker: str) -> Column:
    """Stripped text between the first and second marker; empty if there is no marker."""
    return strip(F.split_part(text, F.lit(marker), F.lit(2)))


def words(text: Column) -> Column:
    """Blank-separated tokens. The default tokenizer of :func:`response_mask`."""
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda t: t != "")


def close_tokens(tokens: Column, max_tokens: int, end: str) -> Column:
    """Cut at ``max_tokens``; add the end token if there is room and it is not already last."""
    cut = F.slice(tokens, 1, max_tokens)
    room = (F.size(cut) < max_tokens) & F.coalesce(F.element_at(F.slice(F.reverse(cut), 1, 1), 1) != end, F.lit(True))
    return F.when(F.size(cut) == 0, F.array(F.lit(end))).when(room, F.concat(cut, F.array(F.lit(end)))).otherwise(cut)


def response_mask(full_tokens: Column, user_length: Column) -> Column:
    """Label tokens in which everything up to the answer is the missing-label sentinel."""
    masked = F.array_repeat(F.lit(str(MISSING)), user_length.cast("int"))
    rest = F.greatest(F.size(full_tokens) - user_length, F.lit(0))
    return F.concat(masked, F.slice(full_tokens, user_length + 1, rest))


def answer_tokens(full_tokens: Column, user_length: Column) -> Column:
    """Only the tokens of the answer, as the evaluation step wants them."""
    return F.slice(full_tokens, user_length + 1, F.greatest(F.size(full_tokens) - user_length, F.lit(0)))
