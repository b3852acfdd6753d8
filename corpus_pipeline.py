"""A corpus pipeline over documents: each stage reads what the one before it has written.

Stages keep other columns, whatever their names, and repeated rows together. The first drops null and empty texts, which have no
words; the later ones let them pass, if they get any. A null doc_id is an id that comes before all others where lines are compared, and
is kept among near-duplicates only if none of its group has an id. Texts may be of any length; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm import decontaminate, line_dedup, minhash_dedup, quality_rules, sentencepiece_codec
from pixelframe.llm.common import cut, table

#: A pair just at 80 % misses all of 36 bands of 6 with a chance of (1 - .8^6)^36, about 1 in 55,000.
NEAR = (minhash_dedup.NearDup(words=5, similarity_pct=80, bands=36, rows=6), minhash_dedup.NearDup())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the document and host rules."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars follows the text. A document of which nothing stays goes."""
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates.

    Links are those of five-word shingles from 80 %, which find copies with cut or added passages, and those
    of three-word shingles from 85 %, which bear more scattered edits; a group may have both.
    """
    return minhash_dedup.keep_one_of_each(docs, *NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold too much of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and n_ids."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_dedup", near_duplicates), ("decontaminate", decontaminated), ("sentencepiece", encoded)]

#: The ids of the last stage can't be made in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k < len(STAGES) - 1 else docs
    return docs
