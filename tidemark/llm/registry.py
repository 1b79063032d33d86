"""Queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.common import cut, table
from tidemark.llm.mixing import mix, reached, source_rates
from tidemark.llm.spam import spam_pages
from tidemark.llm.tokens import count_tokens, encode


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of the target sources with their tokens, and the targets."""
    targets = table(spark, sf_dir, "mix_targets")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").filter(F.col("source").isNotNull())
    return count_tokens(docs, keep=["doc_id", "source"]), targets


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of a target source with the number of times the mix uses it."""
    sized, targets = _sized(spark, sf_dir)
    return mix(sized, targets)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    sized, targets = _sized(spark, sf_dir)
    mixed = cut(mix(sized, targets))
    return reached(mixed, source_rates(mixed, targets))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of which the mix holds every document as often as allowed and still less than wanted."""
    return p8_shares(spark, sf_dir).filter("short").select("source")


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that looks like a list, with its evidence and verdict."""
    return spam_pages(table(spark, sf_dir, "documents").select("doc_id", "repo", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_pages(spark, sf_dir).filter("spam").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p7_ids, p8_found, p8_mix, p8_shares, p9_found, p9_pages)}


def oracle_sql() -> dict[str, str]:
    return {}
