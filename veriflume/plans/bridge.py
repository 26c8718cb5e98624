"""Domain views over the driver's tables. The SQL runs unchanged in Spark and in DuckDB, so oracles share it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

ACTIVITY = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS activity_id,
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS seq,
       CAST(l_partkey AS VARCHAR(20)) AS compound_id,
       CASE WHEN l_partkey % 97 = 0 THEN '' ELSE p_name END AS smiles,
       concat('T', l_suppkey % 10) AS target_id,
       CASE l_returnflag WHEN 'A' THEN 'IC50' WHEN 'N' THEN 'EC50' ELSE CASE WHEN l_quantity < 10 THEN 'Ki' ELSE 'IC50' END END AS activity_type,
       CASE WHEN l_extendedprice < 950 THEN NULL ELSE l_extendedprice END AS value,
       CASE l_linenumber WHEN 2 THEN 'uM' WHEN 5 THEN '%' WHEN 6 THEN 'ug.mL-1' ELSE 'nM' END AS unit,
       CASE WHEN l_linestatus = 'O' AND l_discount >= 0.09 THEN '>' ELSE '=' END AS relation,
       concat('A', l_suppkey % 50) AS assay_id,
       CASE WHEN l_tax >= 0.08 THEN 'A' ELSE 'B' END AS assay_type,
       CASE WHEN l_quantity <= 44 THEN 9 WHEN l_quantity <= 47 THEN 5 END AS confidence_score,
       CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'Outside typical range' END AS data_validity_comment,
       l_quantity = 1 AS potential_duplicate,
       CASE WHEN l_linenumber = 3 THEN round(-log10(l_extendedprice * 1e-9), 2) + CASE WHEN l_tax = 0.03 THEN 0.5 ELSE 0 END END AS pchembl_value,
       CASE WHEN l_linenumber = 6 AND l_tax < 0.04 THEN p_retailprice END AS molecular_weight
FROM {lineitem} LEFT JOIN {part} ON l_partkey = p_partkey
"""

#: the same, for an oracle's WITH clause
ACTIVITY_CTE = "activity AS (" + ACTIVITY.format(lineitem="lineitem", part="part") + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ACTIVITY, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, label, score) of a screen: lower scores are better."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("seq"), F.col("quality").alias("label"), (F.col("n_chars") / F.lit(100.0)).alias("score"))


SCORED_CTE = "scored AS (SELECT doc_id AS seq, quality AS label, n_chars / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, word, bits): 64-bit fingerprints packed in one BIGINT, from the signs of shifted components."""
    e = table(spark, sf_dir, "embeddings")
    bit = lambda x, i: F.when(x > 0.02, F.pow(F.lit(2.0), F.least(i, F.lit(61))).cast("long")).otherwise(F.lit(0).cast("long"))
    word = F.aggregate(F.transform("embedding", bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), word.alias("word")).withColumn("bits", F.bit_count("word").cast("long"))


FINGERPRINT_CTE = "fp AS (SELECT vec_id AS id, label AS grp, list_sum(list_transform(range(0, 61), lambda i: CASE WHEN embedding[i + 1] > 0.02 THEN 1::BIGINT << i ELSE 0 END))::BIGINT + CASE WHEN greatest(embedding[62], embedding[63], embedding[64]) > 0.02 THEN 1::BIGINT << 61 ELSE 0 END AS word FROM embeddings), fpb AS (SELECT *, bit_count(word)::BIGINT AS bits FROM fp)"


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p, f): truths, predictions and one feature of a regression, from orders."""
    o = table(spark, sf_dir, "orders")
    y = F.log10("o_totalprice")
    return o.select(F.col("o_orderkey").alias("id"), y.alias("y"), (y * 0.9 + 0.5 + (F.col("o_custkey") % 7) * 0.01).alias("p"), (F.col("o_custkey") % 100).cast("double").alias("f"))


REGRESSION_CTE = "reg AS (SELECT o_orderkey AS id, log10(o_totalprice) AS y, log10(o_totalprice) * 0.9::DOUBLE + 0.5::DOUBLE + (o_custkey % 7) * 0.01::DOUBLE AS p, (o_custkey % 100)::DOUBLE AS f FROM orders)"
