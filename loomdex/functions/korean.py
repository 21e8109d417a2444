"""Korean word analysis by rules: particles, compounds, syllables, and character sets.

A Hangul word is taken as a noun with a particle, if it ends in one that fits: some particles follow a closed syllable (one
with a final consonant), some an open one, some both. The longest fitting particle that leaves a stem goes. Compound nouns of
four syllables or more are also given in parts of two syllables. Words in other scripts are lower-cased and stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Korean particles by what they follow.
AFTER_CLOSED = ("은", "이", "을", "과", "으로", "이나", "이라", "이며", "이랑", "으로서", "으로써", "이라고")
AFTER_OPEN = ("는", "가", "를", "와", "로", "나", "라", "며", "랑", "로서", "로써", "라고")
AFTER_ANY = ("의", "에", "도", "만", "에서", "에게", "께서", "부터", "까지", "보다", "처럼", "마다", "조차", "밖에", "한테", "에는", "에도", "에서는", "에게서", "까지도")

HANGUL = r"[\x{AC00}-\x{D7A3}]"
# Syllables stand in the order of their 28 finals, none first; number 8 is r.
_OPEN = "".join(chr(0xAC00 + 28 * i) for i in range(399))
_WITH_R = "".join(chr(0xAC00 + 28 * i + 8) for i in range(399))


def _pattern() -> str:
    """A particle that fits what stands before it, at the end of a word; the leftmost match is the longest particle."""
    both = lambda words: "|".join(w for w in words)
    r_open = [p for p in AFTER_OPEN if p.startswith("로")]  # these also follow a final r, and their long forms do not
    r_closed = [p for p in AFTER_CLOSED if p.startswith("으로")]
    groups = [
        (f"[{_OPEN}]", [p for p in AFTER_OPEN if p not in r_open]),
        (f"[{_OPEN}{_WITH_R}]", r_open),
        (f"[{HANGUL}&&[^{_OPEN}]]", [p for p in AFTER_CLOSED if p not in r_closed]),
        (f"[{HANGUL}&&[^{_OPEN}{_WITH_R}]]", r_closed),
        (HANGUL, AFTER_ANY),
    ]
    return "(?:" + "|".join(f"(?<={before})(?:{both(words)})" for before, words in groups) + ")$"


PARTICLE = _pattern()


def particle(word: Column) -> Column:
    """The particle at the end of a Hangul word, "" for none."""
    return F.when(word.rlike(f"^{HANGUL}+$"), F.regexp_extract(word, PARTICLE, 0)).otherwise("")


def stem(word: Column) -> Column:
    return F.when(word.rlike(f"^{HANGUL}+$"), F.regexp_replace(word, PARTICLE, "")).otherwise(word)


def compounds(noun: Column) -> Column:
    """Parts of two syllables, the last one of three if their number is odd, of a noun of four syllables or more; none of others."""
    n = F.floor(F.length(noun) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(noun, 2 * i - 1, F.when(i == n, F.lit(3)).otherwise(F.lit(2))))
    return F.when(noun.rlike(f"^{HANGUL}{{4,}}$"), pieces).otherwise(F.array().cast("array<string>"))


def _mapped(words: Column, each) -> Column:
    return F.flatten(F.transform(words, each))


def morphemes(words: Column) -> Column:
    """Stems and particles, in order (analyser 100)."""
    return _mapped(words, lambda w: F.filter(F.array(stem(w), particle(w)), lambda x: x != ""))


def nouns(words: Column) -> Column:
    """Stems without particles (analyser 10)."""
    return F.transform(words, stem)


def nouns_and_parts(words: Column) -> Column:
    """Stems, each followed by its parts (analyser 11)."""
    return _mapped(words, lambda w: F.concat(F.array(stem(w)), compounds(stem(w))))


def parts_of_nouns(words: Column) -> Column:
    """Parts of compound stems in their place, other stems whole (analyser 12)."""
    return _mapped(words, lambda w: F.when(F.size(compounds(stem(w))) > 0, compounds(stem(w))).otherwise(F.array(stem(w))))


def _decoded(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for raw in frames:
        yield raw.map(lambda b: None if b is None else bytes(b).decode("cp949", "ignore"))


def _encoded(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in frames:
        yield texts.map(lambda t: None if t is None else t.encode("cp949", "ignore"))


def from_cp949(raw: Column | str) -> Column:
    """Text of CP949 bytes; bytes that are no character are skipped."""
    return F.pandas_udf(_decoded, "string")(raw)


def to_cp949(text: Column | str) -> Column:
    """CP949 bytes of a text; characters that it lacks are skipped."""
    return F.pandas_udf(_encoded, "binary")(text)
