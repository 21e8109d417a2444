from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomdex.functions import scalars as sc
from loomdex.functions import korean, stem, text
from loomdex.plans.hooks import DECLINE, Hooks


@pytest.mark.parametrize(
    ("word", "want"),
    [("CARESSES", "CARESS"), ("PONIES", "PONI"), ("CATS", "CAT"), ("AGREED", "AGRE"), ("PLASTERED", "PLASTER"), ("MOTORING", "MOTOR"), ("HOPPING", "HOP"), ("FALLING", "FALL"), ("HISSING", "HISS"),
     ("FILING", "FILE"), ("HAPPY", "HAPPI"), ("SKY", "SKY"), ("RELATIONAL", "RELAT"), ("ADOPTION", "ADOPT"), ("ACTION", "ACTION"), ("CONTROLL", "CONTROLL"), ("ROLLERCOLL", "ROLLERCOL"), ("HOPEFULNESS", "HOPEFUL"), ("A", "A"), ("RATE", "RATE"), ("CEASE", "CEAS")],
)
def test_stems(word, want):
    assert stem.stem(word) == want


def test_measure():
    assert [stem.measure(w) for w in ("", "TR", "EE", "TREE", "Y", "BY", "TROUBLE", "OATS", "TREES", "IVY", "TROUBLES", "PRIVATE", "OATEN")] == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def elf(s: str) -> int:
    h = 0
    for b in s.encode():
        h = (h << 4) + b
        g = h & 0xF0000000
        if g:
            h ^= g >> 24
        h &= ~g
    return h & 0xFFFFFFFF


def test_scalars(spark):
    words = ["", "a", "longer words hash too", "über", "한국어 문서", "x" * 50]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", sc.elf_hash(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in rows} == {w: elf(w) for w in words}

    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    lit = F.lit
    assert [one(sc.count_elements(lit(s), "^")) for s in ("", "a", "a^b", "a^b^", "^a", "^")] == [0, 1, 2, 2, 1, 0]
    assert [one(sc.get_element(lit(s), "^", n)) for s, n in (("a^b", 0), ("a^b", 1), ("a^b", 2), ("^a^b", 0), ("a^^c", 1))] == ["a", "b", "", "a", ""]
    assert one(sc.get_item(lit("x:1&Key:2&k:3"), "Key:", "&")) == "2" and one(sc.get_item(lit("Key:2"), "Key:", "&", 1)) == "" and one(sc.get_item(lit("a"), "b")) is None
    assert tuple(one(sc.split_value(lit("name=a=b")))) == ("NAME", "a=b") and one(sc.split_value(lit("none"))) is None
    assert [one(sc.url_to_site(lit(u))) for u in ("http://www.a.org/x", "http://b.org/~me/y", "http://c.org", "nothing")] == ["a.org", "b.org/~me", "c.org", ""]
    assert one(sc.trimmed(lit(" \t a b\r\n"))) == "a b" and one(sc.binary(lit(5), 1)) == "00000101"
    assert tuple(one(sc.jamo(lit("한")))) == (18, 0, 4) and tuple(one(sc.jamo(lit("a")))) == (None, None, None)
    assert one(sc.dit_items(lit("HIT=3^DID=9^OID=k^")))["DID"] == "9"


def test_analysers(spark):
    def run(s, name):
        return spark.range(1).select(text.analyze(F.lit(s), name).alias("x")).first().x

    assert run("Hello, wörld 42!", "word") == ["hello", "wörld", "42"]
    assert run(" a\t b\r\nc ", "whitespace") == ["a", "b", "c"]
    assert run("abc d", "bigram") == ["ab", "bc", "d"]
    assert run("ab-c d", "concat") == ["ABCD"] and run("...", "concat") == []
    kinds = spark.createDataFrame([(w,) for w in ("한글", "漢字", "カナ", "x", "7", "!")], "w string").select(text.kind(F.col("w")).alias("k")).collect()
    assert [r.k for r in kinds] == ["KOREAN", "CHINESE", "JAPANESE", "ALPHABET", "NUMBER", "SPECIAL"]
    got = spark.range(1).select(text.highlighted(F.lit("The other the."), ["the"]).alias("x")).first().x
    assert got == "<b>The</b> other <b>the</b>."
    assert text.REGISTRY.keys() >= {"word", "whitespace", "bigram", "concat"}


def test_korean(spark):
    d = spark.createDataFrame([(w,) for w in ("학교는", "학교에서", "학생이", "학생가", "서울로", "서울으로", "집으로", "집로", "는", "나무", "도서관까지도", "abc는", "정보검색", "정보검색은", "정보검색이론", "")], "w string")
    got = {r.w: (r.s, r.p) for r in d.select("w", korean.stem(F.col("w")).alias("s"), korean.particle(F.col("w")).alias("p")).collect()}
    assert got["학교는"] == ("학교", "는") and got["학교에서"] == ("학교", "에서") and got["학생이"] == ("학생", "이") and got["도서관까지도"] == ("도서관", "까지도")
    # a particle that does not fit the final consonant stays
    assert got["학생가"] == ("학생가", "") and got["서울로"] == ("서울", "로") and got["서울으로"] == ("서울으", "로") and got["집으로"] == ("집", "으로") and got["집로"] == ("집로", "")
    assert got["는"] == ("는", "") and got["나무"] == ("나무", "") and got["abc는"] == ("abc는", "") and got[""] == ("", "")
    for name, want in (("morpheme", ["정보검색", "은", "ab"]), ("noun", ["정보검색", "ab"]), ("compound", ["정보검색", "정보", "검색", "ab"]), ("part", ["정보", "검색", "ab"])):
        assert spark.range(1).select(text.analyze(F.lit("정보검색은 AB"), name).alias("x")).first().x == want
    assert spark.range(1).select(text.analyze(F.lit("정보검색이론"), "part").alias("x")).first().x == ["정보", "검색", "이론"]
    rows = spark.createDataFrame([("한국 abc é",), (None,), ("",)], "t string").select(korean.from_cp949(korean.to_cp949("t")).alias("b"), korean.from_cp949(F.lit(b"\xc7\xd1a\xff")).alias("x")).collect()
    assert [r.b for r in rows] == ["한국 abc ", None, ""] and rows[0].x == "한a"


def test_words_are_cut_by_bytes(spark):
    words = ["a" * 39, "a" * 40, "é" * 20, "a" + "é" * 20, "한" * 13, "한" * 14, "", "x" * 38 + "é", "\U0001f600" * 10]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.cut(F.col("w")).alias("c")).collect()
    assert all(r.c == r.w.encode()[:39].decode("utf-8", "ignore") for r in rows)


def test_times_by_strftime(spark):
    row = spark.sql("select timestamp'2024-03-05 16:07:09' as t").select(sc.formatted(F.col("t"), "%d/%m/%Y it's %H:%M 100%%").alias("a"), sc.now("%Y").alias("y")).first()
    assert row.a == "05/03/2024 it's 16:07 100%" and row.y.isdigit()
    with pytest.raises(ValueError):
        sc.now("%Q")


def test_hooks():
    h, calls = Hooks(), []
    h.register("x", "last", lambda v: calls.append("last") or v, after=["first", "absent"])
    h.register("x", "first", lambda v: calls.append("first") or DECLINE)
    assert h.run_first("x", 3) == 3 and calls == ["first", "last"] and h.run_all("x", 1) == [DECLINE, 1]
    assert h.run_first("none") is DECLINE and h.run_all("none") == []
    with pytest.raises(ValueError):
        h.register("x", "first", len, after=["last"])
