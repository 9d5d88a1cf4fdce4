"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    bitplanes, byte_bpe, host_quality, license_scan, main_text, ngram_join, packing, pseudonyms, severity_model, spelling,
    vector_tiles, warc_bundles, whitening,
)

#: Folder of the public tokenizers' vocabulary files, unless a caller names another.
RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Stands for a secret that a deployment keeps elsewhere.
KEY = "corpus pseudonyms, key 1"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *host_quality.COUNTS, "base_failed", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(RANKS))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.extracted(pages, main_text.train(pages))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.replaced(table(spark, sf_dir, "documents"), KEY)


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc_bundles.written_and_read(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tiles.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.written_and_read(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


def op9_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = severity_model.train(documents, table(spark, sf_dir, "labels"))
    return severity_model.graded(documents, model)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_host_quality, op2_byte_bpe, op3_main_text, op4_packing, op5_pseudonyms, op6_warc_bundles, op7_vector_tiles,
        op8_bitplanes, op9_severity, op10_ngram_join, op11_spelling, op12_licenses, op13_whitening,
    )
}
