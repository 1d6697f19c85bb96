"""The text operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagepath.llm import fingerprints as order_minhash
from stagepath.llm import (
    checks_sql,
    classifier,
    collocations,
    html_text,
    jaccard,
    lexical,
    packing,
    quality,
    secret_scan,
    sentencepiece_bpe,
    sharding,
    toxicity,
    warc,
)
from stagepath.llm.common import held_staging, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and the verdict of the rules on words and on shared lines."""
    judged = quality.judge(table(spark, sf_dir, "documents"), held_staging(spark))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_words", "removed_lines",
    )


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), held_staging(spark))
    return found.select(
        "doc_id", "start", F.length("value").alias("length"),
        F.sha2("value", 256).alias("value_sha256"), "is_secret",
        F.round("chance", 6).alias("chance"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior chance of every document that it is good, and the verdict."""
    return classifier.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_staging(spark)
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of SentencePiece ids, their checksum, and a digest of what they decode to."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path(sentencepiece_bpe.MODEL)
    return sentencepiece_bpe.encode_documents(docs, path).select(
        "doc_id",
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 2048 tokens, a row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"), held_staging(spark), with_ids=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back, a row per capture."""
    staging = held_staging(spark)
    path = staging.path("archives")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, blocks=False)
    assembled = staging.save(warc.assemble(found), "captures")

    def page(fields) -> object:
        return F.when(fields["page-id"] != "", fields["page-id"].cast("long"))

    return warc.resolve_revisits(assembled).select(
        page(F.get("metadata", F.lit(0))["fields"]).alias("page_id"),
        F.coalesce("response.payload_bytes", "stored.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page(F.col("stored.fields")).alias("refers_to"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in eight contiguous shards of nearly equal bytes."""
    placed = sharding.contiguous_shards(table(spark, sf_dir, "documents"), held_staging(spark), 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of 5-word shingles and its near-duplicate group."""
    return jaccard.near_groups(table(spark, sf_dir, "documents"), held_staging(spark))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every document and its edited text."""
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"), held_staging(spark))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of every document that it is toxic."""
    return toxicity.score(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_staging(spark)
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for every benchmark item."""
    return lexical.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), held_staging(spark)
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 most closely bound phrases of two and three words."""
    return collocations.collocations(table(spark, sf_dir, "documents"), held_staging(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_secret_scans": op2_secret_scans,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_packing": op5_packing,
        "op6_warc": op6_warc,
        "op7_sharding": op7_sharding,
        "op8_html_extraction": op8_html_extraction,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_fingerprints": op10_fingerprints,
        "op11_toxicity": op11_toxicity,
        "op12_lexical_search": op12_lexical_search,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return checks_sql.oracle_sql()
