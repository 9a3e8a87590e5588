"""The corpus pipeline: every stage takes (spark, docs, sf_dir) and its result is the next stage's documents.

Quality rules drop documents, the n-gram Jaccard join keeps one of each group of near copies, suffix-array dedup cuts
repeated bytes out of the texts, personal data is masked, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogcheck.llm import ngram_join, packing, pii, quality, repeats
from catalogcheck.llm import textkit as tk

STAGES = [
    ("quality_rules", quality.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("suffix_dedup", repeats.stage),
    ("personal_data", pii.stage),
    ("best_fit_packing", packing.stage),
]

#: Compression ratios, random fields and packing have no SQL form; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tk.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
