"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, gam, langid, licenses, mixing, ogg, perplexity, sigtree, urlfilter

#: The vocabulary of the encoding query, in the folder of public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path and pre-token pattern of the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(_read(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_probe(spark, _read(spark, sf_dir, "conversations")))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), *vocabulary())


def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_read(spark, sf_dir, "documents"))


def op5_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(_read(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.join(_read(spark, sf_dir, "documents"))


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_quality_perplexity,
        op2_chat_format,
        op3_bpe_round_trip,
        op4_license_sentences,
        op5_language_profiles,
        op6_url_filter,
        op7_ogg_media,
        op8_jaccard_join,
        op9_quality_gam,
        op10_mix_sources,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_sentences": licenses.oracle(),
        "op6_url_filter": urlfilter.oracle(),
        "op10_mix_sources": mixing.PLAN_SQL.replace("{docs}", "documents"),
    }
