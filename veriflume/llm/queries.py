"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bin_slack, chat_format, decontaminate, filter_audit, group_join, itq_dedup, language_kernel, line_dedup, periodic_runs, radix_dedup, style_tree, toxicity, url_filter
from .common import read
from .oracles import ORACLES  # noqa: F401


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(read(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents"), detail=True)


def op5_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.dedup(read(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.removed(read(spark, sf_dir, "documents")).drop("kept")


def op7_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_kernel.identify(read(spark, sf_dir, "documents"))


def op8_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.join(read(spark, sf_dir, "documents"))


def op9_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_incremental_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.format_turns(chat_format.attempted(read(spark, sf_dir, "conversations"))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.detect(periodic_runs.planted(read(spark, sf_dir, "documents"))))


QUERIES = {
    f.__name__: f
    for f in (op1_style_tree, op2_url_filter, op3_toxicity, op4_line_dedup, op5_itq_dedup, op6_suffix_dedup, op7_language_kernel, op8_group_join, op9_bin_slack, op10_decontaminate, op11_incremental_render, op12_filter_audit, op13_periodic_runs)
}
