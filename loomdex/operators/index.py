"""Positional inverted index as tables: postings, lexicon, forward index, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.schema import Collection
from loomdex.session import kept


def postings(docs: DataFrame, collection: Collection, analyzer: str | None = None) -> DataFrame:
    """(doc_id, field, pos, word): one row per indexed word; pos counts from 0 within the field. Words are cut to MAX_WORD
    bytes; empty ones keep their position and are left out. No shuffle: rows come straight from the scan."""
    per_field = [F.struct(F.lit(f.number).alias("field"), F.coalesce(text.analyze(F.col(f.name), analyzer or f.analyzer), F.array().cast("array<string>")).alias("words")) for f in collection.indexed]
    rows = docs.select(F.col(collection.id_col).alias("doc_id"), F.explode(F.array(*per_field)).alias("f"))
    rows = rows.select("doc_id", F.col("f.field").alias("field"), F.posexplode("f.words").alias("pos", "word"))
    return rows.where("word <> ''").withColumn("word", text.cut(F.col("word")))


def document_words(docs: DataFrame, collection: Collection) -> DataFrame:
    """(doc_id, word): the distinct words of each document, found within its row."""
    fields = [F.coalesce(text.analyze(F.col(f.name), f.analyzer), F.array().cast("array<string>")) for f in collection.indexed]
    cut = F.transform(F.filter(F.concat(*fields), lambda w: w != ""), lambda w: text.cut(w))
    return docs.select(F.col(collection.id_col).alias("doc_id"), F.explode(F.array_distinct(cut)).alias("word"))


def lexicon(found: DataFrame) -> DataFrame:
    """(word_id, word, df) from (doc_id, word), distinct, as document_words() gives them; ids are dense from 1 in code point
    order of words.

    Words are range-partitioned and numbered within partitions; the partitions' sizes, one row each, give the offsets, so
    no task numbers all words. The ranges come from a sample, so that the partitions are written before both reads."""
    counted = found.groupBy("word").agg(F.count("*").alias("df"))
    part = kept(counted.repartitionByRange("word").withColumn("p", F.spark_partition_id()), "lexicon")
    sizes = part.groupBy("p").count()
    offsets = sizes.select("p", (F.sum("count").over(Window.orderBy("p")) - F.col("count")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("word"))
    return part.join(F.broadcast(offsets), "p").select((rank + F.col("offset")).cast("long").alias("word_id"), "word", "df")


def posting_lists(found: DataFrame) -> DataFrame:
    """(word, doc_id, field_mask, hits array<struct<field, pos>>): a document's hits of a word in order."""
    hits = F.sort_array(F.collect_list(F.struct("field", "pos"))).alias("hits")
    return found.groupBy("word", "doc_id").agg(field_mask().alias("field_mask"), hits)


def field_mask() -> Column:
    return F.expr("bit_or(shiftleft(1, field))")


def document_frequency(docs: DataFrame, collection: Collection) -> DataFrame:
    """(word, df, hits): a document adds one to df of each of its words, and each of its words one to hits. Both are sums
    that combine before the one shuffle."""
    once = document_words(docs, collection).select("word", F.lit(1).alias("d"), F.lit(0).alias("h"))
    every = postings(docs, collection).select("word", F.lit(0).alias("d"), F.lit(1).alias("h"))
    return once.union(every).groupBy("word").agg(F.sum("d").alias("df"), F.sum("h").alias("hits"))


def forward(found: DataFrame) -> DataFrame:
    """(doc_id, field, words array<string>): words of each field in order of position."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "word")))
    return found.groupBy("doc_id", "field").agg(F.transform(ordered, lambda x: x["word"]).alias("words"))


def check(found: DataFrame, words: DataFrame) -> DataFrame:
    """Words whose document frequency in the lexicon is not what the postings say: (word, expected, found), 0 where a side lacks it."""
    real = found.groupBy("word").agg(F.count_distinct("doc_id").alias("found"))
    both = words.select("word", F.col("df").alias("expected")).join(real, "word", "full")
    both = both.select("word", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("expected <> found")


def write(found: DataFrame, path: str, buckets: int = 64, files: int = 4) -> None:
    """Postings as Parquet in path, a folder for each bucket of words, sorted by word and document. A bucket has files parts by
    document, so that a word of a third of all postings makes no single file; more buckets suit larger tables. Reads of a
    word touch its bucket, and in it the row groups that may hold the word."""
    b = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(files)).cast("int")
    rows = found.withColumns({"bucket": b, "part": part}).repartition("bucket", "part")
    rows.sortWithinPartitions("bucket", "word", "doc_id", "field", "pos").drop("part").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, field, pos, word, bucket) as written; lookups are by lookup()."""
    return spark.read.parquet(path)


def lookup(table: DataFrame, words: list[str], buckets: int = 64) -> DataFrame:
    """Postings of these words: their buckets only are listed and read."""
    asked = F.array(*[F.lit(w) for w in words])
    spark = table.sparkSession
    wanted = [r[0] for r in spark.range(1).select(F.explode(asked).alias("w")).select(F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int")).distinct().collect()]
    return table.where(F.col("bucket").isin(*wanted) & F.col("word").isin(*words)) if words else table.where(F.lit(False))


def defragment(spark: SparkSession, path: str, to: str, files: int = 1) -> None:
    """The index in path, copied to another folder with so many files a bucket, in order: after many small appends a lookup opens few."""
    rows = read(spark, path)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(files)).cast("int")
    rows = rows.withColumn("part", part).repartition("bucket", "part").sortWithinPartitions("bucket", "word", "doc_id", "field", "pos")
    rows.drop("part").write.partitionBy("bucket").parquet(to)


def distribute(found: DataFrame, paths: list[str]) -> None:
    """Postings over several folders, document n in folder n modulo their number; read them together as one table."""
    for i, path in enumerate(paths):
        found.where(F.pmod("doc_id", F.lit(len(paths))) == i).write.parquet(path)


def posting_slice(found: DataFrame, skip: int, count: int) -> DataFrame:
    """Postings number skip + 1 to skip + count of every word, in order of document, field and position. The bound on the rank
    lets Spark keep that many per word and task before the shuffle, so that a frequent word meets no single task whole."""
    w = Window.partitionBy("word").orderBy("doc_id", "field", "pos")
    return found.withColumn("n", F.row_number().over(w)).where((F.col("n") > skip) & (F.col("n") <= skip + count))
