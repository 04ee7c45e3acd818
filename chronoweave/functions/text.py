"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags(text: Column) -> Column:
    """Map of ``<name>content</name>`` (or ``</>``) to content; the last occurrence wins."""
    pattern = F.lit(r"(?s)<([^>]+)>(.*?)</(?:\1)?>")
    entries = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"))
    keep = F.filter(entries, lambda x: x["k"].isNotNull())
    return F.aggregate(keep, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))


def to_last_period(text: Column, n: int) -> Column:
    """The last ``n`` characters up to their last full stop, without it."""
    tail = F.right(text, F.lit(n)) if n > 0 else F.lit("")
    return F.when(F.locate(".", tail) > 0, F.regexp_extract(tail, r"(?s)^(.*)\.", 1)).otherwise(tail)


def repetition(text: Column, n: int = 3, most: float = -1.0) -> Column:
    """(1 - distinct / all n-grams of words) * most; 0 for fewer than n words."""
    words = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")

    def penalty(w: Column) -> Column:
        k = F.greatest(F.size(w) - n + 1, F.lit(0))
        grams = F.slice(w, F.lit(1), k)
        for j in range(2, n + 1):
            grams = F.zip_with(grams, F.slice(w, F.lit(j), k), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(w) < n, 0.0).otherwise((1 - F.size(F.array_distinct(grams)) / F.size(grams)) * most)

    return F.transform(F.array(words), penalty)[0]  # the words are bound once: an expression would be split again wherever it stands


def first_boxed(text: Column) -> Column:
    """What stands in the first ``\\boxed{...}`` with its braces balanced; null without one."""
    rest = F.when(F.contains(text, F.lit("\\boxed{")), F.substr(text, F.locate("\\boxed{", text) + 7))
    start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), F.when((s["end"] == 0) & (depth == 0), s["i"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step, lambda s: s["end"])
    return F.when(end > 0, F.left(rest, end - 1))


def code_blocks(text: Column, language: str = "python") -> Column:
    """The contents of fenced blocks of a language, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)```{language}\n(.*?)```"), F.lit(1))


def after_last_think(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "</think>", -1), r"^\n+", "")


def think_answer_format(text: Column) -> Column:
    return F.when(text.rlike(r"(?sm)^<think>.*?</think>.*?<answer>.*?</answer>$"), 0.0).otherwise(-1.0)


def score(text: Column, key: str) -> Column:
    """The number after the last ``key``, in any case and with or without brackets; 0 without one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b{key}\b\W*([0-9]+)"), F.lit(1))  # all in one pass: a greedy start would be tried anew at every place
    return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("double"), F.lit(0.0))


# Instruction-following predicates
def contains_all(text: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(F.lower(text), F.lit(w.lower()))
    return out


def contains_none(text: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & ~F.contains(F.lower(text), F.lit(w.lower()))
    return out


def letter_count(text: Column, letter: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))) / len(letter)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))


def words_relation(text: Column, n: int, relation: str) -> Column:
    c = word_count(text)
    return {"at least": c >= n, "at most": c <= n}.get(relation, F.abs(c - n) <= F.greatest(F.round(F.lit(n * 0.1)), F.lit(1)))


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\* \* \*", -1)


def paragraph_count(text: Column, n: int) -> Column:
    p = paragraphs(text)
    return (F.size(p) == n) & F.forall(p, lambda x: F.trim(x) != "")


def bullets(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"^\s*[*-]")))


def placeholders(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[(.*?)\]"))


def highlights(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\*(.*?)\*"))


def has_title(text: Column) -> Column:
    return text.rlike(r"<<(.*?)>>")


def quoted(text: Column) -> Column:
    return F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))
