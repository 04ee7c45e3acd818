"""Scorers and text rules by name: each row goes to the one that it names, all in one scan.

A rule or scorer is a builder of a column from a text and from arguments that are columns, too, so rows may carry
arguments of their own. ``checked`` reads the rule's name and arguments from a JSON column, ``scored`` sends rows to
reward scorers by tag. Unknown names in a call raise; a row that names no known rule scores 0, as does one whose
arguments are missing; a null text scores as the empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import rules
from chronoweave.functions import text as tx

#: Arguments that rules may read.
ARGUMENTS = "func_name string, keyword_list array<string>, forbidden_words array<string>, word string, letter string, N int, quantifier string, first_word string, i int, postscript_marker string, options array<string>, section_splitter string, original_prompt string, end_phrase string"


def _compared(n: Column, bound: Column, quantifier: Column, slack: Column) -> Column:
    return F.when(quantifier == "at least", n >= bound).when(quantifier == "at most", n <= bound).when(quantifier == "around", F.abs(n - bound) <= slack).otherwise(False)


def _has(t: Column, words: Column, every: bool) -> Column:
    found = lambda w: F.contains(F.lower(t), F.lower(w))
    return F.forall(words, found) if every else ~F.exists(words, found)


def _count(t: Column, part: Column) -> Column:
    """How often a literal occurs, occurrences not overlapping."""
    return ((F.length(t) - F.length(F.replace(t, part, F.lit("")))) / F.length(part)).cast("int")


def _paragraphs(t: Column, a: Column) -> Column:
    p = F.split(t, "\n\n", -1)
    return (F.size(p) == a.N) & F.startswith(F.trim(F.try_element_at(p, a.i)), a.first_word)


def _postscript(t: Column, a: Column) -> Column:
    at = F.instr(t, a.postscript_marker)
    return (at > 0) & (F.length(F.btrim(F.substring(t, at, F.length(t)), F.lit(" \t\n\r"))) > F.length(a.postscript_marker))


def _sections(t: Column, a: Column) -> Column:
    return _count(t, a.section_splitter) + 1 - F.startswith(t, a.section_splitter).cast("int") == a.N


_WORDS = r"[ \t-\r]+"
#: Text rules: (text, arguments) -> boolean column.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "verify_keywords": lambda t, a: _has(t, a.keyword_list, True),
    "verify_keyword_frequency": lambda t, a: rules.word_total(t) == a.N,  # counts all words, as the rule that it repeats
    "validate_forbidden_words": lambda t, a: _has(t, a.forbidden_words, False),
    "verify_letter_frequency": lambda t, a: (F.length(a.letter) == 1) & (_count(t, a.letter) == a.N),
    "verify_paragraph_count": lambda t, a: (F.size(tx.paragraphs(t)) == a.N) & F.forall(tx.paragraphs(t), lambda p: F.btrim(p, F.lit(" \t\n\r")) != ""),
    "validate_word_constraint": lambda t, a: _compared(F.size(F.filter(F.split(t, _WORDS), lambda w: w != "")), a.N, a.quantifier, F.greatest(F.bround(a.N * 0.1), F.lit(1))),
    "verify_sentence_constraint": lambda t, a: _compared(F.size(F.split(t, r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s", -1)), a.N, a.quantifier, F.lit(1)),
    "validate_paragraphs": _paragraphs,
    "verify_postscript": _postscript,
    "validate_placeholders": lambda t, a: tx.placeholders(t) >= a.N,
    "verify_bullet_points": lambda t, a: tx.bullets(t) == a.N,
    "validate_title": lambda t, a: tx.has_title(t),
    "validate_choice": lambda t, a: F.exists(a.options, lambda o: F.contains(o, t)),
    "validate_highlighted_sections": lambda t, a: tx.highlights(t) >= a.N,
    "validate_sections": _sections,
    "validate_json_format": lambda t, a: F.coalesce(rules.is_json(t), F.lit(False)),
    "validate_repeat_prompt": lambda t, a: F.startswith(t, a.original_prompt),
    "validate_two_responses": lambda t, a: rules.two_responses(t),
    "validate_uppercase": lambda t, a: t == F.upper(t),
    "validate_lowercase": lambda t, a: t == F.lower(t),
    "validate_frequency_capital_words": lambda t, a: _compared(rules.capital_words(t), a.N, a.quantifier, F.lit(0)),
    "validate_end": lambda t, a: F.endswith(t, a.end_phrase),
    "validate_quotation": lambda t, a: tx.quoted(t),
    "validate_no_commas": lambda t, a: ~F.contains(t, F.lit(",")),
}


def rule(name: str) -> Callable[[Column, Column], Column]:
    if name not in RULES:
        raise ValueError(f"unknown rule {name!r}: expected one of {sorted(RULES)}")
    return RULES[name]


def checked(df: DataFrame, text: str, constraint: str, only: list[str] | None = None, out: str = "score") -> DataFrame:
    """``df`` with ``out``: 1 where the text keeps the rule that the JSON column names, 0 elsewhere; ``only``: the rules to know."""
    t, a = F.coalesce(F.col(text), F.lit("")), F.col("_arguments")
    value = None
    for name in only or RULES:
        kept = rule(name)(t, a)
        value = F.when(a.func_name == name, kept) if value is None else value.when(a.func_name == name, kept)
    return df.withColumn("_arguments", F.from_json(constraint, ARGUMENTS)).withColumn(out, F.coalesce(value, F.lit(False)).cast("double")).drop("_arguments")


def _ends(t: Column) -> Column:
    return rules.without(t, ["<|endoftext|>", "<pad>", "<|im_end|>"])


#: Reward scorers: (response, truth) -> double column.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "think_format": lambda r, truth: tx.think_answer_format(r),
    "repetition": lambda r, truth: tx.repetition(_ends(r), 3, -0.1),
    "long_block": lambda r, truth: F.when(F.exists(F.split(r, _WORDS, -1), lambda x: F.length(x) > 20), -1.0).otherwise(0.0),
    "length": lambda r, truth: F.length(_ends(r)) / 20000.0,
    "choice": lambda r, truth: rules.choice_reward(tx.after_last_think(r), truth),
    "boxed": lambda r, truth: F.coalesce(F.trim(tx.first_boxed(r)) == F.trim(truth), F.lit(False)).cast("double"),
    "yes_no": lambda r, truth: F.contains(F.lower(r), F.lit("yes")).cast("double"),
    "exact": lambda r, truth: (F.trim(tx.after_last_think(_ends(r))) == F.trim(truth)).cast("double"),
}


def scorer(name: str) -> Callable[[Column, Column], Column]:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}: expected one of {sorted(SCORERS)}")
    return SCORERS[name]


def scored(df: DataFrame, tag: str, response: str, truth: str, by_tag: dict[str, str], out: str = "reward") -> DataFrame:
    """``df`` with ``out``: the score of each row's response by the scorer that ``by_tag`` names for its tag, 0 for other tags."""
    r, t = F.coalesce(F.col(response), F.lit("")), F.coalesce(F.col(truth), F.lit(""))
    value = None
    for key, name in by_tag.items():
        one = scorer(name)(r, t).cast("double")
        value = F.when(F.col(tag) == key, one) if value is None else value.when(F.col(tag) == key, one)
    return df.withColumn(out, F.coalesce(value, F.lit(0.0)) if value is not None else F.lit(0.0))
