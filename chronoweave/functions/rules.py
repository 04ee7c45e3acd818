"""Instruction rules, reward parsers and text scores as column expressions; null texts give null unless said."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and the underscore of any script; Java's own \\w and \\b know ASCII only in part.
WORD = r"[\p{L}\p{N}_]"


def _parts(text: Column, literal: str) -> Column:
    return F.split(text, re.escape(literal), -1)


def word_total(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


def keyword_count(text: Column, word: str) -> Column:
    return F.regexp_count(F.lower(text), F.lit(f"(?<!{WORD}){re.escape(word.lower())}(?!{WORD})")).cast("long")


def sentence_count(text: Column) -> Column:
    return F.size(F.split(text, "[.?] ", -1)).cast("long")


def paragraph_starts(text: Column, nth: int, word: str) -> Column:
    return F.coalesce(F.startswith(F.trim(F.try_element_at(F.split(text, "\n\n", -1), F.lit(nth))), F.lit(word)), F.lit(False))


def has_postscript(text: Column, mark: str) -> Column:
    return F.contains(text, F.lit(mark)) & (F.length(F.trim(F.split_part(text, F.lit(mark), F.lit(2)))) > 0)


def chosen(text: Column, options: list[str]) -> Column:
    """Whether the text stands in one of the options; the direction kept here is text in option."""
    return F.exists(F.array(*map(F.lit, options)), lambda o: F.contains(o, text))


def sections(text: Column, mark: str) -> Column:
    p = _parts(text, mark)
    return (F.size(p) - (F.trim(p[0]) == "").cast("int")).cast("long")


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull() | text.isNull() & F.lit(None).cast("boolean")


def repeats(text: Column, prompt: Column) -> Column:
    return F.startswith(text, prompt)


def two_responses(text: Column) -> Column:
    p = _parts(text, "******")
    return (F.size(p) == 2) & (F.trim(p[0]) != F.trim(F.try_element_at(p, F.lit(2))))


def capital_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?<!{WORD})[A-Z]+(?!{WORD})")).cast("long")


def without_prefix(text: Column, prefix: str) -> Column:
    return F.regexp_replace(text, f"^{re.escape(prefix)}", "")


def without(text: Column, literals: list[str]) -> Column:
    for x in literals:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def choice_reward(text: Column, answer: Column) -> Column:
    """1 if the last boxed answer starts, in upper case, with the answer's letter."""
    boxed = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^{}]*)\}")), F.lit(-1))
    return F.when(F.upper(F.left(F.trim(boxed), F.lit(1))) == answer, 1.0).otherwise(0.0)


def length_reward(n: Column, free: int, most: int) -> Column:
    """0 up to ``free``, falling evenly to -1 at ``most``."""
    return F.round(F.when(n <= free, 0.0).when(n >= most, -1.0).otherwise(-(n - free) / (most - free)), 6)


def number_in(text: Column) -> Column:
    """The text as a number, or the first number in it."""
    found = F.regexp_extract(text, r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0)
    return F.coalesce(text.try_cast("double"), found.try_cast("double"))


def path_config(path: Column) -> dict[str, Column]:
    """The parts bwr, qm, uf and cm of a path; ``unknown`` where it has none."""
    pattern = r"bwr(\d+)_qm(\w+)_uf(\w+)_cm(\w+)"
    return {k: F.coalesce(F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")), F.lit("unknown")) for i, k in enumerate(("bwr", "qm", "uf", "cm"))}


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, one numpy row a token of ``a``."""
    codes: dict = {}
    y = np.array([codes.setdefault(x, len(codes)) for x in b], dtype=np.int64)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        if x in codes:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == codes[x])))
    return int(row[-1])


def _rouge(a: str, b: str) -> float:
    a, b = (re.findall(r"[a-z0-9]+", x.lower()) for x in (a, b))
    if not a or not b:
        return 0.0
    return 2 * lcs_length(a, b) / (len(a) + len(b))


def rouge_l(prediction: Column, reference: Column) -> Column:
    """ROUGE-L F1 of lower-cased alphanumeric tokens, without stemming; null texts score 0."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_rouge(a or "", b or "") for a, b in zip(x, y)], dtype=float)

    return score(prediction, reference)
