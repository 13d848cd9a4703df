"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

toxicity       texts that are predicted toxic go
simhash        of each group of near-duplicates, the document with the smallest id stays
suffix_dedup   strings of 200 bytes that start more than once go from all texts
decontaminate  words hit by benchmark windows go from their texts
pack           what is left, as pieces of token sequences

All stages but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querent.llm import decontamination, packing, simhash, suffix_dedup, tables, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash", simhash.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("decontaminate", decontamination.stage),
    ("pack", packing.stage),
]

#: SQL cannot express the stages; tests hold each against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = tables.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
