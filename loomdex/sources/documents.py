"""Readers and writers: XML documents, record files, pages, and results as XML, JSON or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.scalars import dit_items
from loomdex.schema import Collection

#: Largest document text, in characters.
MAX_DOCUMENT = 10 << 20


def xml_field(xml: Column, path: str) -> Column:
    """Text at /root/child, //element or name[@attr="v"], whatever the case of element names."""
    return F.xpath_string(lower_tags(xml), F.lit(_lower_path(path)))


def xml_attribute(xml: Column, path: str, name: str) -> Column:
    return F.xpath_string(lower_tags(xml), F.lit(f"{_lower_path(path)}/@{name.lower()}"))


def _lower_path(path: str) -> str:
    import re

    return re.sub(r'("[^"]*")|([^"]+)', lambda m: m[1] or m[2].lower(), path)


def lower_tags(xml: Column) -> Column:
    """Element and attribute names in lower case; text, attribute values and CDATA stay. Lower-casing is done piece by piece."""
    pieces = F.regexp_extract_all(xml, F.lit(r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|\"[^\"]*\"|</?[A-Za-z][^\s>/\"]*|\s[A-Za-z_:][^\s=>\"]*(?==)|[^<\"\s]+|."), F.lit(0))
    tag = r"^</?[A-Za-z]|^\s[A-Za-z_:]"
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(tag), F.lower(p)).otherwise(p)), "")


def read_xml_documents(spark: SparkSession, path: str, collection: Collection) -> DataFrame:
    """(oid, one column per field) from files that hold one XML document each."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("xml"))
    low = files.withColumn("xml", lower_tags(F.col("xml")))
    fields = [F.xpath_string("xml", F.lit(f"/document/{f.name}")).alias(f.name) for f in collection.fields]
    return low.select(F.xpath_string("xml", F.lit("/document/oid")).alias("oid"), *fields)


def read_dit(spark: SparkSession, path: str) -> DataFrame:
    """(hit, did, oid, items) from lines NAME=value^NAME=value^; a missing HIT is 0, a missing DID -1."""
    lines = spark.read.text(path).where("value <> ''").withColumn("items", dit_items(F.col("value")))
    return lines.select(F.coalesce(F.try_element_at("items", F.lit("HIT")).cast("int"), F.lit(0)).alias("hit"), F.coalesce(F.try_element_at("items", F.lit("DID")).cast("long"), F.lit(-1)).alias("did"), F.try_element_at("items", F.lit("OID")).alias("oid"), "items")


def filter_pages(pages: DataFrame, host: str = ".*", path: str = ".*", url_col: str = "url") -> DataFrame:
    """Pages whose host and path match regular expressions as a whole."""
    parts = r"^[^/]*//([^/?#]*)([^?#]*)"
    h, p = F.regexp_extract(url_col, parts, 1), F.regexp_extract(url_col, parts, 2)
    return pages.where(h.rlike(f"^(?:{host})$") & p.rlike(f"^(?:{path})$"))


def links(html: Column) -> Column:
    """Targets of the page's links."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1))


def as_xml(rows: DataFrame, row: str = "doc") -> DataFrame:
    """One XML string per row: <doc><field name="..">..</field></doc>."""

    def escaped(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            v = F.replace(v, F.lit(raw), F.lit(safe))
        return F.concat(F.lit(f'<field name="{c}">'), v, F.lit("</field>"))

    return rows.select(F.concat(F.lit(f"<{row}>"), *[escaped(c) for c in rows.columns], F.lit(f"</{row}>")).alias("xml"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
