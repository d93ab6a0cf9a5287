"""The queries opN_<name> of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, htmltext, minhash, packing, quality, sharding, toxicity, urlfilter, warc
from .common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of ``documents`` with ``benchmark``: 13 aligned tokens with 2 substitutions at most."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every url of ``pages``, with canonical links and refreshes of the pages as alias edges."""
    pages = read(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.page_edges(pages))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector of ``embeddings`` whose id is divisible by 100, among all others."""
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC files with a dictionary and read back."""
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``."""
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of ``documents``, each with the whole table's mixture of sources."""
    return sharding.interleave(read(spark, sf_dir, "documents"), 24)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` on 2-word shingles at 0.8."""
    return minhash.near_duplicates(spark, read(spark, sf_dir, "documents"), width=2, percent=80)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every text of ``documents`` lies in bins of 2048 tokens."""
    return packing.best_fit(read(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of ``documents``."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_ann": op3_ann,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_packing": op8_packing,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.SQL,
    "op2_url_filter": urlfilter.sql(),
    "op4_warc": warc.SQL,
    "op6_sharding": sharding.SQL,
    "op7_minhash_dedup": minhash.SQL,
}
