from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomdex.operators import store
from loomdex.operators import where as wh
from loomdex.schema import DOCUMENTS, parse_declarations
from loomdex.sources import documents as src
from loomdex.streaming import spool


def test_versions_and_tombstones(spark):
    v = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, "y"), ("m", 5, "w")], "oid string, docid int, body string")
    got = {r.oid: (r.docid, r.body, r.versions, r.old_version) for r in store.latest(v, "oid", "docid").collect()}
    assert got == {"k": (3, "z", 3, 2), "m": (5, "w", 1, None)}
    d = spark.createDataFrame([(1,), (2,), (3,)], "docid int")
    marked = store.mark_deleted(d, d.where("docid < 3"), "docid")
    back = store.undelete(marked, d.where("docid = 2"), "docid")
    assert {r.docid for r in back.where("not deleted").collect()} == {2, 3}
    assert {r.docid for r in store.delete(d, d.where("docid = 2"), "docid").collect()} == {1, 3}
    changed = store.update(back.select("docid", F.lit("a").alias("x"), F.lit(1).alias("y")), spark.createDataFrame([(1, "b", None)], "docid int, x string, y int"), "docid")
    assert {tuple(r) for r in changed.collect()} == {(1, "b", 1), (2, "a", 1), (3, "a", 1)}


def test_positions(spark):
    d = spark.createDataFrame([("one two  three",), ("",), ("é b",)], "t string")
    assert [r.x for r in d.select(store.from_word(F.col("t"), 1).alias("x")).collect()] == ["two three", "", "b"]
    assert [r.x for r in d.select(store.from_byte(F.col("t"), 1).alias("x")).collect()] == ["ne two  three", "", " b"]


def test_conditions(spark):
    d = spark.createDataFrame([(i, ["a", "b"][: i % 3], "x/y" if i % 2 else "x") for i in range(6)], "n int, tags array<string>, c string")

    def ns(source, arrays=frozenset()):
        return [r.n for r in d.where(wh.condition(source, {"TWO": 2}, arrays)).orderBy("n").collect()]

    assert ns("n = TWO") == [2] and ns("n NOT IN (1, 2, 3)") == [0, 4, 5]
    assert ns("tags IN ('a')", frozenset({"tags"})) == [0, 1, 3, 4] and ns("tags COMMON ('b', 'z')", frozenset({"tags"})) == [2, 5]
    assert ns("n & 1 = 1") == [1, 3, 5] and ns("NOT n BETWEEN 1 AND 4") == [0, 5] and ns("n + 1 | 1 * 2 > 6") == [5]
    assert [r.n for r in d.where(wh.category(F.col("c"), "x", "below")).collect()] == list(range(6))
    assert [r.n for r in d.where(wh.legacy("n:1,2&c:x")).collect()] == [2]


def test_declarations():
    c = parse_declarations("DocAttrField date Integer\nDocAttrField kind Enum\nEnum KOR 6\nField 0 title yes 10 10 no\nField 1 note no 0 0 no # stored only")
    assert c.enums == {"KOR": 6} and [f.name for f in c.indexed] == ["title"] and c.struct().fieldNames() == ["doc_id", "title", "note", "date", "kind"]
    assert DOCUMENTS.struct()["title"].metadata["weight"] == 2.0


def test_xml(spark, tmp_path):
    xml = '<Document><OID>k1</OID><TITLE><![CDATA[A <B> C]]></TITLE><Body Lang="EN">x &amp; y</Body></Document>'
    (tmp_path / "1.xml").write_text(xml)
    row = spark.createDataFrame([(xml,)], "x string").select(src.xml_field(F.col("x"), "/document/title").alias("t"), src.xml_field(F.col("x"), '//BODY[@lang="EN"]').alias("b"), src.xml_attribute(F.col("x"), "/Document/body", "LANG").alias("a")).first()
    assert tuple(row) == ("A <B> C", "x & y", "EN")
    read = src.read_xml_documents(spark, str(tmp_path), DOCUMENTS).first()
    assert (read.oid, read.title, read.body) == ("k1", "A <B> C", "x & y")
    (tmp_path / "dit.txt").write_text("HIT=3^DID=7^OID=a^\nOID=b^\n")
    assert {(r.hit, r.did, r.oid) for r in src.read_dit(spark, str(tmp_path / "dit.txt")).collect()} == {(3, 7, "a"), (0, -1, "b")}
    src.write_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_spool(spark, tmp_path):
    inbox, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    inbox.mkdir()

    def put(name, *records):
        (inbox / name).write_text("\n".join(json.dumps(r) for r in records))

    put("1.json", {"oid": "a", "seq": 1, "status": "CD", "title": "t", "body": "first words"}, {"oid": "b", "seq": 2, "status": "CD", "title": "t", "body": "more"}, {"oid": None, "seq": 3, "status": "CD"})
    spool.ingest(spark, str(inbox), out, at, DOCUMENTS).awaitTermination()
    assert {r.oid for r in spool.current(spark, out).collect()} == {"a", "b"}
    put("2.json", {"oid": "a", "seq": 4, "status": "CD", "title": "t", "body": "second"}, {"oid": "b", "seq": 5, "status": "DEL"})
    spool.ingest(spark, str(inbox), out, at, DOCUMENTS).awaitTermination()
    assert [(r.oid, r.body) for r in spool.current(spark, out).collect()] == [("a", "second")]
    assert spark.read.parquet(f"{out}/records").count() == 5
    assert spark.read.parquet(f"{out}/postings").where("word = 'second'").count() == 1


def test_paging(spark):
    d = spark.range(25)
    assert [r.id for r in store.page(d, [F.col("id")], 3).collect()] == [20, 21, 22, 23, 24]
    assert store.top_of_groups(d.withColumn("g", F.col("id") % 2), "g", [F.col("id")], 2, 1).count() == 4
