"""Answers read from free replies: choices, judges' marks, code; as column expressions, null texts give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def choice_answer(text: Column) -> Column:
    """Struct (answer, boxed): what the last ``\\boxed{...}`` holds, else what follows the last "answer is" in any case, else the text."""
    boxed = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^}]+)\}"), F.lit(1)), F.lit(-1))
    after = F.regexp_extract(text, r"(?is)\A.*answer is(.*)\z", 1)
    said = F.lower(text).contains("answer is")
    return F.when(text.isNotNull(), F.struct(F.coalesce(boxed, F.when(said, after), text).alias("answer"), boxed.isNotNull().alias("boxed")))


#: Rewards by manner, (right, boxed) -> reward; fixed values.
CHOICE_REWARDS = {
    "loose": {(True, True): 1.0, (True, False): 1.0, (False, True): -1.0, (False, False): -1.0},
    "soft": {(True, True): 1.0, (True, False): 0.5, (False, True): -0.5, (False, False): -1.0},
    "strict": {(True, True): 1.0, (True, False): -1.0, (False, True): -1.0, (False, False): -1.0},
}


def choice_rewards(text: Column, truth: Column) -> Column:
    """Struct (answer, boxed, right, loose, soft, strict): right if the answer's first capital is the truth's first letter."""

    def judged(a: Column) -> Column:
        right = F.coalesce(F.regexp_extract(a.answer, r"(\p{Lu})", 1) == F.left(truth, F.lit(1)), F.lit(False)) & (F.length(truth) > 0)
        rewards = []
        for name, table in CHOICE_REWARDS.items():
            value = F.when(right & a.boxed, table[True, True]).when(right, table[True, False]).when(a.boxed, table[False, True]).otherwise(table[False, False])
            rewards.append(value.alias(name))
        return F.struct(a.answer.alias("answer"), a.boxed.alias("boxed"), right.alias("right"), *rewards)

    return F.when(text.isNotNull(), F.transform(F.array(choice_answer(text)), judged)[0])


def mark(text: Column, key: str) -> Column:
    """The last number after ``key:``, in any case, brackets or not; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?i){key}:\s*\[?\s*(\d+)"), F.lit(1)), F.lit(-1)).try_cast("double")


def judge_score(text: Column) -> Column:
    """A third each of (mark - 1) / 4 for REL and KNO, 0 where a mark is missing; the mark for the goal is never read and counts as 1."""
    part = lambda k: (F.coalesce(mark(text, k), F.lit(0.0)) - 1) / 4.0 * 0.33
    return F.when(text.isNotNull(), part("REL") + part("KNO"))


def code_answers(text: Column) -> Column:
    """Array of (language, code): fenced blocks after the last marks of a solution or of thinking, those of a known language if there are any.

    A text without a fence and of up to 4,000 characters is one block of Python; a longer one has none.
    """
    known, plain = r"(?s)```(cpp|python|python3|java|javascript|ruby|go)\s*\n*(.*?)```", r"(?s)```\s*\n*(.*?)```"
    strip = lambda x: F.btrim(x, F.lit(" \t\n\r\f"))
    tail = lambda x, m: F.when(F.contains(x, F.lit(m)), strip(F.substring_index(x, m, -1))).otherwise(x)

    def found(t: Column) -> Column:
        blocks = F.arrays_zip(F.regexp_extract_all(t, F.lit(known), F.lit(1)).alias("language"), F.regexp_extract_all(t, F.lit(known), F.lit(2)).alias("code"))
        named = F.transform(blocks, lambda b: F.struct(b.language.alias("language"), strip(b.code).alias("code")))
        bare = F.transform(F.regexp_extract_all(t, F.lit(plain), F.lit(1)), lambda c: F.struct(F.lit(None).cast("string").alias("language"), strip(c).alias("code")))
        fenced = F.when(F.size(named) > 0, named).otherwise(bare)
        alone = F.when(F.length(t) <= 4000, F.array(F.struct(F.lit("python").alias("language"), strip(t).alias("code"))))
        return F.when(F.contains(t, F.lit("```")), fenced).otherwise(F.coalesce(alone, F.slice(bare, F.lit(1), F.lit(0))))

    return F.when(text.isNotNull(), F.transform(F.array(tail(tail(text, "<|begin_of_solution|>"), "</think>")), found)[0])


def without_entry_point(code: Column, language: str = "python") -> Column:
    """Code without what runs it: from the main guard or function on, and from an example of use on.

    Of Python code with a function, lines that are neither indented nor start one go, too, and it ends in one line end.
    """
    strip = lambda x: F.btrim(x, F.lit(" \t\n\r\f"))
    upto = lambda x, m: F.when(F.contains(x, F.lit(m)), strip(F.substring_index(x, m, 1))).otherwise(x)
    if language == "python":
        double, single = 'if __name__ == "__main__":', "if __name__ == '__main__':"
        code = F.when(F.contains(code, F.lit(double)), upto(code, double)).otherwise(upto(code, single))
    elif language == "cpp":
        code = upto(code, "int main()")
    elif language == "go":
        code = F.replace(code, F.lit("package main"), F.lit(""))
    code = upto(code, "# Example usage")
    if language != "python":
        return code
    lines = F.filter(F.split(strip(code), "\n", -1), lambda x: F.startswith(x, F.lit(" ")) | F.startswith(x, F.lit("def ")))
    kept = F.regexp_replace(F.array_join(lines, "\n"), r"(?:\n[ \t\f\r]*)+$", "")
    return F.when(F.contains(code, F.lit("def")), F.concat(kept, F.lit("\n"))).otherwise(code)


def normal_spaces(text: Column) -> Column:
    """Runs of blanks as one, none at the start or end of a line, no white space at either end."""
    out = F.regexp_replace(F.regexp_replace(text, r"\n +(?=\S|\n)", "\n"), " {2,}", " ")
    return F.replace(F.btrim(out, F.lit(" \t\n\r\f")), F.lit(" \n"), F.lit("\n"))


def has_thought_and_code(text: Column) -> Column:
    return (F.contains(text, F.lit("</think>")) & F.contains(text, F.lit("```"))).cast("int")
