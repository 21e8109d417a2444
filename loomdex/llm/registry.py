"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import chat, embed_dedup, jaccard, langid, media, mixing, pii, spm, substring, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))
    return d.withColumnRenamed("__pii_count", "n_entities")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op3_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.deduplicate(table(spark, sf_dir, "embeddings"))


def op4_byte_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs made by chat.swapped_replies() from all conversations."""
    p = chat.pairs(*chat.swapped_replies(table(spark, sf_dir, "conversations")))
    return p.select(F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", "chosen", chat.shown(F.col("chosen_mask")).alias("chosen_mask"), "rejected", chat.shown(F.col("rejected_mask")).alias("rejected_mask"))


def op7_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a list made by urlfilter.dated_list() from all their hosts."""
    pages = table(spark, sf_dir, "pages")
    v = urlfilter.verdicts(urlfilter.dated_pages(pages), urlfilter.dated_list(pages))
    return v.select("page_id", urlfilter.host(F.col("url")).alias("host"), F.col("day").cast("string").alias("day"), "blocked", "entry", F.col("entry_since").cast("string").alias("entry_since"))


def op8_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(table(spark, sf_dir, "documents"))


def op9_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_surrogates,
        op2_media_columns,
        op3_pca_tiles,
        op4_byte_recurrent,
        op5_curriculum_mix,
        op6_preference_pairs,
        op7_dated_url_lists,
        op8_sentencepiece_spans,
        op9_count_min_substrings,
        op10_chosen_path_join,
    )
}
SQL: dict[str, str] = {
    "op3_pca_tiles": embed_dedup.SQL,
    "op6_preference_pairs": chat.SQL,
    "op7_dated_url_lists": urlfilter.SQL,
    "op9_count_min_substrings": substring.SQL,
    "op10_chosen_path_join": jaccard.SQL,
}
