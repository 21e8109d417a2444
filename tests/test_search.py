from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from loomdex.operators import index, search
from loomdex.plans.dialect import DialectError
from loomdex.plans.engine import Engine
from loomdex.schema import Collection, Field

C = Collection("tiny", (Field("title", 0, weight=2.0), Field("body", 1)), {"kind": "enum", "n": "integer"}, {"RED": 1, "BLUE": 2}, {"all": ("title", "body")})
ROWS = [
    (1, "a b", "c a b\nd e", 1, 10),
    (2, "b a", "a c b", 2, None),
    (3, "", "a a a", 1, 5),
    (4, "end", "begin\nb c a", 2, 0),
    (5, None, None, None, None),
    (6, "abc abd", "xbc a x x b", 1, 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, title string, body string, kind int, n int").cache()


def ids(docs, expression, **options):
    return {r.doc_id for r in search.search(docs, expression, C, search.Options(**options)).collect()}


def test_operators(docs):
    assert ids(docs, "a & c") == {1, 2, 4}
    assert ids(docs, "d + begin") == {1, 4}
    assert ids(docs, "a ! c") == {3, 6}
    assert ids(docs, '"a b"') == {1}
    assert ids(docs, "title:a") == {1, 2} and ids(docs, "title:(a + end) & c") == {1, 2, 4}
    assert ids(docs, "all:e") == {1}
    assert ids(docs, "body:a /0/ body:c") == {1, 2, 4}
    # two words stand between in document 6
    assert ids(docs, "body:a /1/ body:b") == {1, 2, 4} and ids(docs, "body:a /2/ body:b") == {1, 2, 4, 6}
    assert ids(docs, "ab*") == {6} and ids(docs, "*bc") == {6}
    assert ids(docs, "abx%1") == {6}
    assert ids(docs, "SYN:q", synonyms={"q": ["d", "end"]}) == {1, 4}
    assert ids(docs, "PARA:(a b c)") == {1, 2, 4} and ids(docs, "PARA:(a d)") == set()
    assert ids(docs, "NATURAL:(d end zzz)") == {1, 4}
    assert ids(docs, "BIGRAM:abd") == {6}
    assert ids(docs, "zzz") == set()


def test_laws(docs):
    everything = ids(docs, "a")
    for left, right in (("a", "c"), ("b", '"a b"'), ("a", "ab*")):
        assert ids(docs, f"({left}) & ({right})") == ids(docs, f"({right}) & ({left})")
        assert ids(docs, f"(({left}) & ({right})) + (({left}) ! ({right}))") == ids(docs, left)
    assert everything == {1, 2, 3, 4, 6}


def test_relevance_counts_weighted_hits(docs):
    got = {r.doc_id: r.relevance for r in search.search(docs, "a + b^3 ! zz", C).collect()}

    def hits(s, w):
        return len(re.findall(rf"\b{w}\b", s or ""))

    want = {i: 2.0 * (hits(t, "a") + 3 * hits(t, "b")) + hits(b, "a") + 3 * hits(b, "b") for i, t, b, *_ in ROWS}
    assert got == {i: s for i, s in want.items() if s}


def test_index_gives_what_the_scan_gives(docs):
    p = index.postings(docs, C)
    for e in ("a & c", "a ! c", '"a b"', "title:a + ab*", "*bc", "abx%1", "body:a /2/ body:b", "a^2 + b"):
        scan = {tuple(r) for r in search.search(docs, e, C).select("doc_id", "relevance").collect()}
        assert {tuple(r) for r in search.search(docs, e, C, postings=p).select("doc_id", "relevance").collect()} == scan, e
    with pytest.raises(DialectError):
        search.search(docs, "PARA:(a b)", C, postings=p)


def test_postings_and_lexicon(docs):
    p = index.postings(docs, C)
    assert {(r.doc_id, r.field, r.pos) for r in p.where("word = 'b'").collect()} == {(1, 0, 1), (1, 1, 2), (2, 0, 0), (2, 1, 2), (4, 1, 1), (6, 1, 4)}
    lexicon = index.lexicon(index.document_words(docs, C))
    lex = lexicon.orderBy("word_id").collect()
    assert [r.word for r in lex] == sorted(r.word for r in lex) and [r.word_id for r in lex] == list(range(1, len(lex) + 1))
    assert index.check(p, lexicon).count() == 0 and index.check(p.where("doc_id > 1"), lexicon).count() > 0
    lists = {(r.word, r.doc_id): r for r in index.posting_lists(p).collect()}
    assert lists["b", 1].field_mask == 3 and [tuple(h) for h in lists["b", 1].hits] == [(0, 1), (1, 2)]


def test_written_index(spark, docs, tmp_path):
    p, loose, tight = index.postings(docs, C), str(tmp_path / "loose"), str(tmp_path / "tight")
    index.write(p, loose, 8, 3)
    table = index.read(spark, loose)
    assert {tuple(r) for r in table.drop("bucket").collect()} == {tuple(r) for r in p.collect()}
    found = index.lookup(table, ["b", "c"], 8)
    assert found.count() == 6 + p.where("word = 'c'").count() and index.lookup(table, [], 8).count() == 0
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in scan or "PartitionFilters: [isnotnull(bucket" in scan
    files = {f.rsplit("/", 1)[0].rsplit("=", 1)[1] for f in found.inputFiles()}
    assert len(files) <= 8
    index.defragment(spark, loose, tight)
    copied = index.read(spark, tight)
    assert {tuple(r) for r in copied.collect()} == {tuple(r) for r in table.collect()} and len(copied.inputFiles()) == copied.select("bucket").distinct().count()
    parts = [str(tmp_path / f"p{i}") for i in range(2)]
    index.distribute(p, parts)
    assert spark.read.parquet(*parts).count() == p.count() and spark.read.parquet(parts[1]).where("doc_id % 2 = 0").count() == 0


def test_search_in_a_written_index_reads_its_words_buckets(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    index.write(index.postings(docs, C), path)
    ids_only = docs.select("doc_id")
    for e in ("a & c", "a ! c", '"a b"', "body:a /2/ body:b", "ab*", "NUMERIC:1~5 + a"):
        scan = {tuple(r) for r in search.search(docs, e, C).select("doc_id", "relevance").collect()}
        found = search.search(ids_only, e, C, postings=index.read(spark, path))
        assert {tuple(r) for r in found.collect()} == scan, e
    # two documents of posting lists {1, 2} and {2, 3}
    two = spark.createDataFrame([(1, "x"), (2, "x y"), (3, "y")], "doc_id long, title string").withColumn("body", F.lit(""))
    assert [r.doc_id for r in search.search(two, "x & y", C).collect()] == [2]


def test_numbers_relations_and_stems(spark):
    d = spark.createDataFrame([(1, "7 007 x", ""), (2, "12 things", "abc"), (3, "thinging 1000000000000000000", ""), (4, "", "other")], "doc_id long, title string, body string")
    assert ids(d, "NUMERIC:7") == {1} and ids(d, "NUMERIC:8~") == {2} and ids(d, "NUMERIC:~12") == {1, 2} and ids(d, "NUMERIC:8~9") == set()
    with pytest.raises(DialectError):
        ids(d, "NUMERIC:x")
    assert ids(d, "REL:q", related={"q": {"a": ["abc"], "b": ["other", "abc"]}}) == {2, 4} and ids(d, "REL:abc") == {2}
    assert ids(d, "MORP:thing") == {2, 3} and ids(d, "MORP:zzz") == set() and ids(d, "MORP:things & abc") == {2}
    assert ids(d, "MORP:q", stems={"q": ["abc"]}) == {2}
    sensible = spark.createDataFrame([(1, "sensibility", ""), (2, "sensible", ""), (3, "happy happily", "")], "doc_id long, title string, body string")
    for w in ("sensibility", "sensible", "happy"):
        same = {r.doc_id for r in sensible.collect() if any(search.stem_word(x) == search.stem_word(w) for x in r.title.split())}
        assert ids(sensible, f"MORP:{w}") == same


def test_engine(docs):
    e = Engine(docs, C)
    assert [r.doc_id for r in e.run("SELECT doc_id SEARCH a WHERE n IS NOT NULL ORDER_BY n DESC LIMIT 1, 2").collect()] == [6, 3]
    assert [r.doc_id for r in e.run("SELECT * SEARCH a WHERE kind = RED AND n BETWEEN 5 AND 10 ORDER_BY RELEVANCY DESC").collect()] == [1, 3, 6]
    groups = e.run("SELECT * SEARCH a VIRTUAL_ID kind ( GROUP_BY kind LIMIT 1, 1 ORDER_BY RELEVANCY DESC ) ORDER_BY RELEVANCY DESC").collect()
    assert [(g.kind, g.size) for g in groups] == [(1, 1), (2, 1)]
    first = e.count("SELECT * SEARCH a c LIMIT 1").first()
    assert (first.result_count, first.parsed_query) == (3, "(a & c)")
    assert {r.kind: r["count"] for r in e.facets("SELECT * SEARCH a", "kind").collect()} == {1: 3, 2: 2}
    assert [r.doc_id for r in Engine(docs, C, index.postings(docs, C)).run("SELECT doc_id SEARCH a c ORDER_BY RELEVANCY DESC, n DESC LIMIT 2").collect()] == [1, 2]


def test_empty_table(docs):
    e = Engine(docs.limit(0), C)
    assert e.run("SELECT * SEARCH a").count() == 0 and e.count("SELECT * SEARCH a").first().result_count == 0
