"""Document store operations: versions by key, tombstones, attribute updates, field access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the greatest version, and the version before it as old_version (null for the first).

    Spark keeps two rows per key and task before the shuffle, and counts combine before theirs, so a key with very many
    versions does not meet one task."""
    columns = [c for c in versions.columns if c not in (key, version)]
    by = Window.partitionBy(key).orderBy(F.desc(version), *[F.desc(c) for c in columns])
    two = versions.withColumn("__r", F.row_number().over(by)).where("__r <= 2")
    best = two.groupBy(key).agg(F.max(F.when(F.col("__r") == 1, F.struct(version, *columns))).alias("v"), F.max(F.when(F.col("__r") == 2, F.col(version))).alias("old_version"))
    return best.join(versions.groupBy(key).agg(F.count("*").alias("versions")), key).select(key, "v.*", "versions", "old_version")


#: Limits of packed documents: number of fields, and characters of a name.
PACKED_FIELDS, PACKED_NAME = 50, 19


def packed(fields: Column) -> Column:
    """Map of a document's fields from array<struct<name, value>>: the first PACKED_FIELDS, names cut to PACKED_NAME characters; of
    equal names the first counts. Fields without a name are left out."""
    cut = F.transform(F.slice(F.filter(fields, lambda f: f["name"].isNotNull()), 1, PACKED_FIELDS), lambda f: F.struct(F.substring(f["name"], 1, PACKED_NAME).alias("name"), f["value"].alias("value")))
    names = F.transform(cut, lambda f: f["name"])
    return F.map_from_entries(F.filter(cut, lambda f, i: F.array_position(names, f["name"]) == i + 1))


def delete(docs: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """docs without those named in gone."""
    return docs.join(gone.select(on).distinct(), on, "left_anti")


def mark_deleted(docs: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """docs with deleted set for those in gone; a tombstone that undelete() can clear."""
    marks = gone.select(on).distinct().withColumn("deleted", F.lit(True))
    return docs.join(marks, on, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def undelete(docs: DataFrame, back: DataFrame, on: str) -> DataFrame:
    marks = back.select(on).distinct().withColumn("__back", F.lit(True))
    return docs.join(marks, on, "left").withColumn("deleted", F.col("deleted") & F.col("__back").isNull()).drop("__back")


def update(docs: DataFrame, changes: DataFrame, on: str) -> DataFrame:
    """docs with the non-null values of changes, by key; other columns and rows stay."""
    columns = [c for c in changes.columns if c != on]
    renamed = changes.select(on, *[F.col(c).alias(f"__new_{c}") for c in columns])
    return docs.join(renamed, on, "left").select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in docs.columns])


def from_word(text: Column, position: Column | int) -> Column:
    """The text's words from a 0-based position on, joined by one space."""
    words = F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != "")
    at = F.lit(position) if isinstance(position, int) else position
    return F.array_join(F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))), " ")


def from_byte(text: Column, position: int) -> Column:
    """The text from a 0-based byte on; bytes of a character cut in two are dropped."""
    rest = F.substring(F.hex(F.encode(text, "UTF-8")), F.lit(2 * position + 1), F.lit(2147483647))
    return F.decode(F.unhex(F.regexp_replace(rest, "^(?:[89AB][0-9A-F])+", "")), "UTF-8")


def facets(docs: DataFrame, *attrs: str) -> DataFrame:
    """(attribute, value, count) for several attributes, from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attrs]))
    return docs.select(pairs.alias("p")).select("p.*").groupBy("attribute", "value").agg(F.count("*").alias("count"))


def top_of_groups(docs: DataFrame, group: str, order: list[Column], count: int, offset: int = 0) -> DataFrame:
    """Rows number offset + 1 to offset + count of each group, with rank. Spark keeps only that many per group and task before
    the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return docs.withColumn("rank", F.row_number().over(w)).where((F.col("rank") > offset) & (F.col("rank") <= offset + count))


def page(docs: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """Page number from 1, of at most 100 rows."""
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    return docs.orderBy(*order).offset((number - 1) * size).limit(size)
