"""The registered queries of the corpus operators: one per operator, over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import filter_audit, html_extraction, license_scan, merkle, near_dedup, ogg, packing, pii, quality_rules, sentence_pieces, suffix_dedup, url_filters, warc
from daybook.llm.common import table
from daybook.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "tokenizer"]

URL_RULES = [
    url_filters.Rule("block", "com", "/en/"),
    url_filters.Rule("allow", "example.com", "/en/7"),
    url_filters.Rule("allow", "net", "/de/"),
    url_filters.Rule("block", "example.net", "/de/8"),
    url_filters.Rule("block", "org", "/es/"),
]


def tokenizer(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extraction.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(table(spark, sf_dir, "documents"))


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"))
    named = [F.col(f"counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *named, "base_failed", "kept")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables label documents; a page carries the outcome of the document with its number.
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = string.ascii_uppercase
    lowered = merkle.leaf(text=F.translate("text", capitals, capitals.lower()))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return merkle.verified(table(spark, sf_dir, "documents"), F.when(tampered, lowered))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_pii, op3_ogg, op4_quality_rules, op5_best_fit_packing,
        op6_url_filters, op7_sentence_pieces, op8_license_scan, op9_minhash_near_dedup, op10_suffix_array_dedup,
        op11_merkle_manifest, op12_filter_audit, op13_warc,
    )
}
