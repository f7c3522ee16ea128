"""A corpus pipeline of five stages: language, repeated lines, near duplicates, source weights, sequences.

Each stage takes the documents that its predecessor kept, as (spark, docs, sf_dir), and returns a DataFrame. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import jaccard, language_id, line_dedup, mixing, packing
from siltstone.llm._common import materialize, seal, table


def with_text_length(docs: DataFrame) -> DataFrame:
    """n_chars again for texts that have changed; a null text keeps what it had."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null or has no letter, or whose language is ambiguous. Equal texts stay or go together; an empty
    table, or one without any lang, keeps nothing. Columns of the input stay as they are, whatever they are called."""
    sealed, open_ = seal(docs, "doc_id", "text", "lang")
    return open_(language_id.identify(sealed).filter("_lang <> 'und' and not _ambiguous"))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that an earlier one has. Null and empty texts stay as they are; rows that share a
    doc_id are one document, and those with a null doc_id lose nothing."""
    sealed, open_ = seal(docs, "doc_id", "text")
    return with_text_length(open_(line_dedup.dedup_lines(sealed)))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates stays. Texts without words are classes of their own,
    null and empty ones too; rows that share a doc_id stay or go together, and those with a null doc_id stay."""
    return jaccard.dedup_near(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are emitted as often as their source's rate has it; a document may be repeated, or be left out. Null
    texts have size 0 and are drawn like others; null sources are one source; repeated rows are each emitted as often."""
    return mixing.mix_sources(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids and their places in sequences. A repeated document's pieces are repeated; a
    null or empty text is one piece of one id. Pieces of one length take their places in the order of doc_id, piece and crc."""
    return packing.pack(docs)


STAGES = [("language", stage_language), ("lines", stage_lines), ("near_duplicates", stage_near), ("mix", stage_mix), ("pack", stage_pack)]

#: Tokenizing, classifying and packing are not SQL; the tests hold run() against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
