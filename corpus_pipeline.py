"""The corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. What a
stage returns is written as Parquet to the shared folder and read again as the next one's docs. In every stage a null text
counts as empty (and stays null), ids may be null or repeat, very long texts are read whole, an empty table gives an empty one,
and further columns are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import packing, pii, simhash, suffix_dedup, toxicity
from chronofold.llm.common import table, written


#: Bytes from which a passage that stands twice is cut out: some 40 words; passages of over 50 words hold as many.
PASSAGE_BYTES = 240


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars says how long the text is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects (score 0.5 or more) go; null and empty texts stay, copies share their fate."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id: links are of 4/5 of the five-word shingles, or more,
    found by SimHash and checked. Null and empty texts are one group; of rows repeated in id and text one stays."""
    return simhash.without_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of PASSAGE_BYTES bytes that stand twice are cut out of their texts; the documents stay, also those
    without any text left. Of repeated rows each loses what stands in the other."""
    return _counted(suffix_dedup.without_repeats(docs, PASSAGE_BYTES))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds; of spans that meet the first one names all. Documents stay."""
    return _counted(pii.masked(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised, cut and packed into sequences of 2048 tokens, a row for each piece; null and empty texts are the end id."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: No stage but the last could be said in SQL; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what the last one returns. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
