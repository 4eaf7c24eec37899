"""A training corpus from raw documents: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.llm import decontam, jaccard, packing, quality, suffix
from sitepulse.llm.common import kept, scratch, table
from sitepulse.llm.queries import tokenizer_path
from sitepulse.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are rejected, repeated rows judged alike, long texts whole."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more), the least doc_id.

    Candidates are found by SimHash fingerprints in pivot tables, and by MinHash bands what differs in more bits.  Null and empty texts are copies of each other; of equal rows one stays; long texts are
    compared whole; an empty table stays empty.
    """
    ship(spark)
    return jaccard.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes or more, or passages of 50 words, that stand elsewhere too; n_chars follows.

    Null and empty texts stay so; repeated rows lose what they share; an empty table stays empty.
    """
    ship(spark)
    cut = suffix.remove_repeats(docs, suffix.LEAST, (suffix.PASSAGE_BYTES, suffix.PASSAGE_WORDS))
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of the benchmark; null and empty texts have none, long ones are searched whole."""
    ship(spark)
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens at most; null and empty texts are one piece of one id, long ones are cut."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), 1024, end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no form for the hashes, byte strings and tokens of the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder before the next starts, and what it wrote in between is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            docs = kept(out, name.replace(" ", "-"))
    return docs
