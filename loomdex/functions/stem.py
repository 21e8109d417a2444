"""English stemmer over upper-case words, by steps of suffix rules.

Within a step rules are tried in order; one applies if the word ends with its suffix, the measure of what stands before is
above the rule's and its condition holds. A rule that fails there lets later rules of the step be tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWELS = "AEIOU"


def measure(stem: str) -> int:
    """Number of changes from vowels to consonants. Y is a vowel after a consonant only."""
    n, was_vowel, first = 0, False, True
    for c in stem:
        vowel = c in VOWELS or (c == "Y" and not first and not was_vowel)
        n += was_vowel and not vowel
        was_vowel, first = vowel, False
    return n


def has_vowel(stem: str) -> bool:
    return bool(stem) and (stem[0] in VOWELS or any(c in "AEIOUY" for c in stem[1:]))


def short_end(stem: str) -> bool:
    """Consonant, vowel, consonant, the last not W, X or Y. Shorter stems do not end so."""
    return len(stem) > 2 and stem[-1] not in "AEIOUWXY" and stem[-2] in "AEIOUY" and stem[-3] not in VOWELS


def _add_e(stem: str) -> bool:
    return measure(stem) == 1 and short_end(stem)


def _drop_e(stem: str) -> bool:
    return measure(stem) == 1 and not short_end(stem)


Rule = tuple[str, str, int, Callable[[str], bool] | None]
# Suffix, replacement, measure to exceed, condition; in the order in which they are tried.
STEPS: dict[str, list[Rule]] = {
    "1a": [("SSES", "SS", -1, None), ("IES", "I", -1, None), ("SS", "SS", -1, None), ("S", "", -1, None)],
    "1b": [("EED", "EE", 0, None), ("ED", "", -1, has_vowel), ("ING", "", -1, has_vowel)],
    "1b1": [("AT", "ATE", -1, None), ("BL", "BLE", -1, None), ("IZ", "IZE", -1, None)]
    + [(c + c, c, -1, None) for c in "BDFGMNPRTWX"]
    + [("", "E", -1, _add_e)],
    "1c": [("Y", "I", -1, has_vowel)],
    "2": [
        ("ATIONAL", "ATE", 0, None), ("TIONAL", "TION", 0, None), ("ENCI", "ENCE", 0, None), ("ANCI", "ANCE", 0, None),
        ("IZER", "IZE", 0, None), ("ABLI", "ABLE", 0, None), ("ALLI", "AL", 0, None), ("ENTLI", "ENT", 0, None),
        ("ELI", "E", 0, None), ("OUSLI", "OUS", 0, None), ("IZATION", "IZE", 0, None), ("ATION", "ATE", 0, None),
        ("ATOR", "ATE", 0, None), ("ALISM", "AL", 0, None), ("IVENESS", "IVE", 0, None), ("FULNES", "FUL", 0, None),
        ("OUSNESS", "OUS", 0, None), ("ALITI", "AL", 0, None), ("IVITI", "IVE", 0, None), ("BILITI", "BLE", 0, None),
    ],
    "3": [
        ("ICATE", "IC", 0, None), ("ATIVE", "", 0, None), ("ALIZE", "AL", 0, None), ("ICITI", "IC", 0, None),
        ("ICAL", "IC", 0, None), ("FUL", "", 0, None), ("NESS", "", 0, None),
    ],
    "4": [
        ("AL", "", 1, None), ("ANCE", "", 1, None), ("ENCE", "", 1, None), ("ER", "", 1, None), ("IC", "", 1, None),
        ("ABLE", "", 1, None), ("IBLE", "", 1, None), ("ANT", "", 1, None), ("EMENT", "", 1, None), ("MENT", "", 1, None),
        ("ENT", "", 1, None), ("SION", "S", 1, None), ("TION", "T", 1, None), ("OU", "", 1, None), ("ISM", "", 1, None),
        ("ATE", "", 1, None), ("ITI", "", 1, None), ("OUS", "", 1, None), ("IVE", "", 1, None), ("IZE", "", 1, None),
    ],
    "5a": [("E", "", 1, None), ("E", "", -1, _drop_e)],
    "5b": [("LL", "L", 1, None)],
}


def _step(word: str, rules: list[Rule]) -> tuple[str, str | None]:
    for suffix, new, least, condition in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if measure(stem) > least and (condition is None or condition(stem)):
                return stem + new, suffix
    return word, None


def stem(word: str) -> str:
    """Stem of an upper-case word; words of one letter stay."""
    if len(word) < 2:
        return word
    word, _ = _step(word, STEPS["1a"])
    word, used = _step(word, STEPS["1b"])
    if used in ("ED", "ING"):
        word, _ = _step(word, STEPS["1b1"])
    for name in ("1c", "2", "3", "4", "5a", "5b"):
        word, _ = _step(word, STEPS[name])
    return word


def stems(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, stem) of the distinct words of a column: each is stemmed once, however often it occurs. Only words of the
    letters A to Z are changed; stems are lower-case."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"word": pdf["word"], "stem": [stem(w.upper()).lower() if w.isascii() and w.isalpha() else w for w in pdf["word"]]})

    distinct = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    return distinct.mapInPandas(run, "word string, stem string")
