"""Language ID, exact dedup, near-duplicate join, source mixing and packing, one after another over the documents.

Defined cases: documents whose text is null, empty or without a letter go at the first
stage; of equal texts the largest doc_id stays (a null one only where no other is), of
linked texts the smallest; repeated rows are equal texts; a null source is a source of
its own, the last; very long texts count whole and are packed in pieces; other columns, whatever their
names, are carried on to the last stage, which returns pieces; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from behaviorframe.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from behaviorframe.llm._common import documents, drop, keep

STAGES = [
    ("language_id", language_id.stage),
    ("exact_dedup", exact_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("mix_sources", mixing.stage),
    ("best_fit_packing", packing.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's documents; once that is written, what the stage read goes."""
    docs, kept = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        if kept is not None:
            drop(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # trained and tokenizer stages; tested against a brute-force version
