"""A corpus pipeline of five of the operators: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriflume.llm import bin_slack, decontaminate, group_join, line_dedup, toxicity
from veriflume.llm.common import cut, read
from veriflume.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts are scored like any other. Without labels of both classes general insults and patterns decide; where none of
    these is found either, or there are no documents, all stay. Repeated rows share a fate. All columns stay as they are, whatever their
    names; a text of any length is scored whole.
    """
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents that consist of nothing else.

    Null and empty texts stay; rows with one doc_id and one text are one document; a null doc_id comes first; n_chars follows.
    """
    return line_dedup.dedup(docs, drop_emptied=True)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8.

    The smallest doc_id stays, with all its rows; documents without words and rows without a doc_id stay.
    """
    return group_join.drop_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and empty texts stay, and an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 2048 tokens.

    A null or empty text is the end id alone; repeated rows are packed each for itself; an empty table gives no rows.
    """
    return bin_slack.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: the learned first stage and the tokenizer of the last have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
