"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import (
    alignment,
    centroids,
    decontamination,
    html_text,
    language_id,
    near_duplicates,
    personal_data,
    pieces,
    quality_model,
    quality_rules,
    substrings,
    toxicity,
    warc,
)
from foliant.llm.common import table
from foliant.llm.oracle import ORACLE_SQL
from foliant.llm.stages import BYTE_MODEL, PIECE_MODEL


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.visible_text(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, models)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(personal_data.KINDS)],
        F.sha2(personal_data.as_text(F.col("base")), 256).alias("base_sha256"),
        personal_data.as_text(F.col("spans")).alias("spans"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.read_records(warc.write_packages(pages))
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.held_out(mod=3, of=1)
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    found = quality_model.quality_scores(table(spark, sf_dir, "documents"), labels)
    predicted = (F.col("score") >= 0.5).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op9_pieces(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    known = pieces.read_pieces(spark, model_file)
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), known), known)
    return found.select(
        "doc_id",
        "n_words",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", F.col("start_word").cast("long").alias("start_word"))


def op11_alignment(
    spark: SparkSession, sf_dir: str, byte_file: str = BYTE_MODEL, piece_file: str = PIECE_MODEL
) -> DataFrame:
    found = alignment.link_digests(table(spark, sf_dir, "documents"), byte_file=byte_file, piece_file=piece_file)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.held_out(mod=4, of=2)
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), labels)
    predicted = (F.col("score") >= 0.3).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.clusters(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_language_id,
        op3_substring_dedup,
        op4_personal_data,
        op5_warc,
        op6_near_duplicates,
        op7_quality_rules,
        op8_quality_model,
        op9_pieces,
        op10_decontamination,
        op11_alignment,
        op12_toxicity,
        op13_centroids,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
