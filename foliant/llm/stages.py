"""The stages of the corpus pipeline: (spark, docs, sf_dir) to the documents that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import unused
from foliant.llm import decontamination, near_duplicates, personal_data, pieces, quality_rules
from foliant.llm.common import table

#: Vocabulary files outside the repository; parameters of what uses them.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects. A null or empty text goes, as it has too few words; repeated rows
    are judged each; a null id is as good as any; other columns stay, whatever their names."""
    name = unused("rejected_by", docs)
    return quality_rules.judge(docs, result_col=name).where(F.col(name).isNull()).select(*docs.columns)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (by SimHash, verified, with an exact way for what that misses), the document with
    the smallest id. Null and empty texts are one group; of rows that repeat an id and a text one stays; rows without an
    id stay; other columns stay, whatever their names."""
    return near_duplicates.representatives(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Null and empty texts hold none and stay, as all do if there is no item;
    repeated rows are judged each; other columns stay, whatever their names."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a tag in place of personal data, and n_chars of the new text. A null text stays null; repeated
    rows get equal texts; a null id stays null; other columns stay, whatever their names."""
    redacted = personal_data.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    """doc_id, n_words, n_pieces, ids of each document. A null or empty text has no ids; repeated rows are encoded each;
    a null id stays null; other columns are not returned."""
    known = pieces.read_pieces(spark, model_file)
    encoded = pieces.encode(docs, known)
    return encoded.select("doc_id", "n_words", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality_rules", keep_by_rules),
    ("near_duplicates", keep_representatives),
    ("decontamination", keep_uncontaminated),
    ("personal_data", redact_personal_data),
    ("pieces", encode_pieces),
]
