"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, pieces."""

from __future__ import annotations

from foliant.llm.common import table
from foliant.llm.stages import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Near duplicates, induced patterns and Viterbi paths have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
