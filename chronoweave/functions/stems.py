"""English suffix stripping by Porter's published rules (1980), and ROUGE-L on stems."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions.rules import lcs_length

# Suffixes and their replacements of steps 2 to 4 of the published rules.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """Each letter as v or c; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(stem))))


def _short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    end = _longest(w, ("ed", "ing"))
    if end is None or "v" not in _shape(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _short_end(w) else w


def _replaced(w: str, table: dict[str, str]) -> str:
    end = _longest(w, table)
    return w[: -len(end)] + table[end] if end and _measure(w[: -len(end)]) else w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) < 3:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP2), _STEP3)
    end = _longest(w, _STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of a-z and 0-9; those of over three letters as stems."""
    return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (text or "").lower())]


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of stemmed tokens; 0 where either side has none."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(map(tokens, x), map(tokens, y)):
            out.append(2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0)
        return pd.Series(out, dtype=float)

    return score(prediction, reference)
