"""The queries of this subpackage: each applies its operator, with production parameters, to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, html_extract, line_dedup, minhash, periodic_runs, substring_dedup, url_filter, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"), window=50, with_text=False)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_deduplicate, read_archives

    files = archive_and_deduplicate(_table(spark, sf_dir, "pages"), min_bytes=0)
    return read_archives(spark, files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import link_embeddings

    return link_embeddings(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import ALONE, dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"), alone=ALONE).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "hits")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    bad = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).otherwise(1)
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(_table(spark, sf_dir, "pages"), outcomes).drop("bad_rate", "bad_bound")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import select_by_importance

    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"), "toxic")
    return select_by_importance(_table(spark, sf_dir, "documents"), labels)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages")).drop("path")


def encoder():
    import public_tokenizers

    from .packing import byte_bpe

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), encoder, capacity=1024, end_id=0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress_vectors

    return compress_vectors(_table(spark, sf_dir, "embeddings"))[0]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import find_periodic_runs, repeated_by_id

    return find_periodic_runs(_table(spark, sf_dir, "documents"), rewrite=repeated_by_id, with_text=False)


def word_encoder():
    import public_tokenizers

    from .vector_packing import word_bpe

    return word_bpe(public_tokenizers.path("word_bpe_49k.json"))


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_packing import pack_vectors

    return pack_vectors(_table(spark, sf_dir, "documents"), word_encoder, capacity=2048, end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_embedding_dedup, op4_line_dedup, op5_decontaminate, op6_url_filter, op7_quality, op8_minhash_dedup, op9_html_extract, op10_packing, op11_vector_codes, op12_periodic_runs, op13_vector_packing)}
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": substring_dedup.SQL, "op2_warc": warc.SQL, "op3_embedding_dedup": embedding_dedup.SQL, "op4_line_dedup": line_dedup.SQL, "op5_decontaminate": decontaminate.SQL, "op6_url_filter": url_filter.SQL, "op8_minhash_dedup": minhash.SQL, "op9_html_extract": html_extract.SQL, "op11_vector_codes": vector_codes.SQL, "op12_periodic_runs": periodic_runs.SQL}
