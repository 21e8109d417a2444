"""Scalar functions on strings, dates and code points, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"
#: Size of the dictionary's hash table.
BUCKETS = 8903


def get_item(src: Column, name: str, until: str | None = None, size: int | None = None) -> Column:
    """What follows the first occurrence of name, up to until or the end, cut to size - 1; null without the name."""
    at = F.instr(src, name)
    rest = F.substring(src, at + len(name), F.length(src))
    value = rest if until is None else F.substring_index(rest, until, 1)
    value = value if size is None else F.substring(value, 1, size - 1)
    return F.when(at > 0, value)


def count_elements(src: Column, mark: str) -> Column:
    """Elements between marks: a mark at the end adds none, one at the start is not counted, "" has none."""
    marks = F.length(src) - F.length(F.replace(src, F.lit(mark), F.lit("")))
    inner = marks - src.startswith(mark).cast("int")
    return F.when(src == "", 0).otherwise(inner + (~src.endswith(mark)).cast("int")).cast("int")


def get_element(src: Column, mark: str, n: int) -> Column:
    """Element number n from 0; a mark at the start is skipped. "" if there is none."""
    trimmed = F.when(src.startswith(mark), F.substring(src, F.lit(2), F.length(src))).otherwise(src)
    return F.coalesce(F.get(F.split(trimmed, f"\\Q{mark}\\E"), F.lit(n)), F.when(src.isNotNull(), ""))


def split_value(src: Column) -> Column:
    """struct(name, value) of "name=value" at the first "=", the name in upper case; null without one."""
    at = F.instr(src, "=")
    return F.when(at > 0, F.struct(F.upper(F.substring(src, F.lit(1), at - 1)).alias("name"), F.substring(src, at + 1, F.length(src)).alias("value")))


def trimmed(src: Column, side: str = "both") -> Column:
    f = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side]
    return f(src, F.lit(BLANKS))


def equal_ci(a: Column, b: Column, n: int | None = None) -> Column:
    cut = (lambda c: c) if n is None else (lambda c: F.substring(c, 1, n))
    return F.lower(cut(a)) == F.lower(cut(b))


def find_ci(needle: Column, text: Column) -> Column:
    """1-based place of needle whatever its case; 0 without."""
    return F.call_function("locate", F.lower(needle), F.lower(text))


def elf_hash(src: Column) -> Column:
    """32-bit shifting hash over the bytes of the text."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(src)), lambda i: F.conv(F.substring(F.hex(F.encode(src, "UTF-8")), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))

    def step(h: Column, byte: Column) -> Column:
        h = F.shiftleft(h, 4) + byte
        high = h.bitwiseAND(F.lit(0xF0000000))
        return h.bitwiseXOR(F.shiftright(high, 24)).bitwiseAND(F.lit(0x0FFFFFFF))

    return F.when(src == "", F.lit(0).cast("long")).otherwise(F.aggregate(codes, F.lit(0).cast("long"), step))


def bucket(src: Column, size: int = BUCKETS) -> Column:
    return elf_hash(src) % size


def url_to_site(url: Column) -> Column:
    """Host of a URL without a leading "www.", with a following /~user."""
    return F.regexp_extract(url, r"^[^/]*/[^/]*/(?:www\.)?([^/]*(?:/~[^/]*)?)", 1)


def upper_first(src: Column, n: int) -> Column:
    return F.concat(F.upper(F.substring(src, 1, n)), F.substring(src, F.lit(n + 1), F.length(src)))


def replace_char(src: Column, old: str, new: str) -> Column:
    return F.translate(src, old, new)


def binary(n: Column, size: int) -> Column:
    """Zero-padded binary digits of the low size bytes."""
    return F.right(F.lpad(F.bin(n), 64, "0"), F.lit(8 * size))


#: strftime letters in the patterns of date_format().
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh"}


def formatted(ts: Column, pattern: str) -> Column:
    """A time by a pattern of strftime()."""
    parts = re.findall("%[^%]|(?:%%|[^%])+|%$", pattern)
    if any(p[0] == "%" and p[1:2] != "%" and p not in _STRFTIME for p in parts):
        raise ValueError(f"cannot format times by {pattern!r}")
    quoted = lambda p: "'" + p.replace("%%", "%").replace("'", "''") + "'"
    return F.date_format(ts, "".join(_STRFTIME[p] if p in _STRFTIME else quoted(p) for p in parts))


def now(pattern: str) -> Column:
    """The current time, one for the whole query."""
    return formatted(F.current_timestamp(), pattern)


def yyyymmdd(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def seconds_between(start: Column, end: Column, digits: int | None = 4) -> Column:
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    return seconds if digits is None else F.round(seconds, digits)


def dit_items(record: Column) -> Column:
    """Map of a record NAME=value^NAME=value^."""
    return F.str_to_map(F.rtrim(record, F.lit("^")), F.lit(r"\^"), F.lit("="))


def attr_query(query: Column) -> Column:
    """Map of key:value&key:value."""
    return F.str_to_map(query, F.lit("&"), F.lit(":"))


def jamo(syllable: Column) -> Column:
    """struct(initial, medial, final) of a Hangul syllable's first character; nulls for others."""

    raw = F.encode(F.substring(syllable, 1, 1), "UTF-16BE")
    code = F.conv(F.hex(raw), 16, 10).cast("int") - 0xAC00
    fine = F.substring(syllable, 1, 1).rlike(r"[\x{AC00}-\x{D7A3}]")
    return F.struct(F.when(fine, F.floor(code / 588).cast("int")).alias("initial"), F.when(fine, F.floor((code % 588) / 28).cast("int")).alias("medial"), F.when(fine, code % 28).alias("final"))


def hangul_order(word: Column) -> list[Column]:
    """Sort keys: non-empty first, then words that begin in Hangul, then by code points."""
    return [(word == "").cast("int"), F.when(word.rlike(r"^[\x{AC00}-\x{D7A3}]"), 0).otherwise(1), word]
