"""Analysers: expressions from a text column to an array of words, chosen by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions import korean

#: Words are runs of letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: Longest word kept, in bytes.
MAX_WORD = 39


def cut(word: Column, most: int = MAX_WORD) -> Column:
    """The word's first bytes, at most so many; a character that is cut in two goes."""
    raw = F.encode(word, "UTF-8")
    inner = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")
    # the character that the next byte belongs to begins up to three bytes before it
    keep = F.when(~inner(most + 1), most).when(~inner(most), most - 1).when(~inner(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(word) <= most, word).otherwise(F.substring(raw, F.lit(1), keep).cast("string"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def whitespace(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != "")


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters within words; a word of one character stays whole."""
    return F.flatten(F.transform(words(text), bigrams_of))


def bigrams_of(word: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))
    return F.when(F.length(word) < 2, F.array(word)).otherwise(pairs)


def concatenated(text: Column) -> Column:
    """One word: all letters and digits, upper-case, as far as a word may be long."""
    joined = F.substring(F.upper(F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "")), 1, MAX_WORD)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.array(joined))


REGISTRY: dict[str, Callable[[Column], Column]] = {
    "word": words, "whitespace": whitespace, "bigram": bigrams, "concat": concatenated,
    "morpheme": lambda t: korean.morphemes(words(t)), "noun": lambda t: korean.nouns(words(t)), "compound": lambda t: korean.nouns_and_parts(words(t)), "part": lambda t: korean.parts_of_nouns(words(t)),
}


def register(name: str, analyzer: Callable[[Column], Column]) -> None:
    """Adds an analyser, or replaces one."""
    REGISTRY[name] = analyzer


def analyze(text: Column, analyzer: str = "word") -> Column:
    return REGISTRY[analyzer](text)


def kind(word: Column) -> Column:
    """Class of a token by its first character."""
    first = F.substring(word, 1, 1)
    return (
        F.when(first.rlike(r"[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"), "KOREAN")
        .when(first.rlike(r"[\x{4E00}-\x{9FFF}]"), "CHINESE")
        .when(first.rlike(r"[\x{3040}-\x{30FF}]"), "JAPANESE")
        .when(first.rlike(r"\p{N}"), "NUMBER")
        .when(first.rlike(r"\p{L}"), "ALPHABET")
        .otherwise("SPECIAL")
    )


def tokens(text: Column) -> Column:
    """Words, and single other characters that are no white space, in order."""
    return F.regexp_extract_all(text, F.lit(WORD + r"|[^\p{L}\p{N}\s]"), F.lit(0))


def dispatched(token: Column, count: Column, longest_number: int = 8) -> Column:
    """What becomes of a token, by its class: alphabetic ones are lower-cased, numbers are kept only up to a length and among
    other tokens, special ones are dropped (null)."""
    k = kind(token)
    return F.when(k == "NUMBER", F.when((F.length(token) <= longest_number) & (count > 1), token)).when(k == "SPECIAL", F.lit(None)).when(k == "ALPHABET", F.lower(token)).otherwise(token)


def snippet(words_: Column, position: Column, around: int = 5) -> Column:
    """The words from around before a 0-based position to around after it."""
    start = F.greatest(position - around, F.lit(0))
    return F.array_join(F.slice(words_, (start + 1).cast("int"), (position + around - start + 1).cast("int")), " ")


def highlighted(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Text with every whole occurrence of a term marked, whatever its case."""
    import re

    if not terms:
        return text
    pattern = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    return F.regexp_replace(text, pattern, f"{before}$1{after}")
