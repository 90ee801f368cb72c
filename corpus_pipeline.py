"""The corpus pipeline: documents to training sequences, in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm.common import store, table
from tapeworks.llm.decontamination import drop_contaminated
from tapeworks.llm.importance import keep_quality
from tapeworks.llm.packing import pack_stage
from tapeworks.llm.near_copies import keep_one
from tapeworks.llm.surrogates import replace_stage

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_stage),
    ("packing", pack_stage),
]

#: No SQL for trained models, tokenizers and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
