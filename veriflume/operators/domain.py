"""Applicability domains: mean distance to the k nearest training rows, leverage, and a similarity floor, all of which must agree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .knn import nearest
from .quantiles import percentiles


def knn_distance(rows: DataFrame, train: DataFrame, k: int = 5, exclude_self: bool = False) -> DataFrame:
    """(id, knn_distance): mean Euclidean distance to the k nearest training rows (fewer if there are fewer)."""
    near = nearest(rows, train, k, exclude_self=exclude_self)
    return near.select("id", (F.aggregate("near.d", F.lit(0.0), lambda s, x: s + x) / F.size("near")).alias("knn_distance"))

def knn_threshold(train: DataFrame, k: int = 5, percentile: float = 0.95) -> DataFrame:
    """One row: the percentile of the training rows' mean distances to their k nearest other ones."""
    return percentiles(cut(knn_distance(train, train, k, True)), ["knn_distance"], [percentile]).select(F.get("values", F.lit(0)).alias("knn_threshold"))


def gram(train: DataFrame) -> np.ndarray:
    """X'X of rows with an intercept: partial sums on the executors, one small matrix on the driver."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.hstack([np.ones((len(pdf), 1)), np.stack(pdf["features"]).astype(float)])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": range(total.size), "v": total.ravel()})

    got = train.select("features").mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
    p = int(len(got) ** 0.5)
    return got["v"].to_numpy().reshape(p, p)


def leverages(rows: DataFrame, inverse: np.ndarray) -> DataFrame:
    """(id, leverage) of rows against training rows with this inverse of their Gram matrix."""
    shared = rows.sparkSession.sparkContext.broadcast(inverse)  # (features + 1)^2 numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.hstack([np.ones((len(pdf), 1)), np.stack(pdf["features"]).astype(float)])
                yield pd.DataFrame({"id": pdf["id"], "leverage": np.einsum("ij,jk,ik->i", x, shared.value, x)})

    return rows.select("id", "features").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, leverage double")


def leverage(rows: DataFrame, train: DataFrame) -> tuple[DataFrame, float]:
    """((id, leverage), warning threshold 3(p+1)/n)."""
    inverse = np.linalg.pinv(gram(train))
    return leverages(rows, inverse), 3 * len(inverse) / train.count()


@dataclass(frozen=True)
class Domain:
    """What training rows say of how far a model may be trusted: fitted once, with the model, and kept with it."""

    reference: DataFrame
    k: int
    percentile: float
    limit: float | None
    inverse: np.ndarray
    n_train: int

    @classmethod
    def fit(cls, train: DataFrame, k: int = 5, percentile: float = 0.95) -> Domain:
        """Of training rows (id, features), which are written out: their own distances are taken here and never again."""
        reference = cut(train.select("id", "features"))
        limit = knn_threshold(reference, k, percentile).first()[0]
        return cls(reference, k, percentile, limit, np.linalg.pinv(gram(reference)), reference.count())

    @property
    def leverage_limit(self) -> float:
        return 3 * len(self.inverse) / self.n_train

    def assess(self, rows: DataFrame, similarity: DataFrame | None = None, floor: float = 0.3, use_leverage: bool = True) -> DataFrame:
        """(id, knn_distance, knn_threshold, leverage, leverage_threshold, max_similarity, in_domain, methods_disagree, reasons).

        In the domain only if every method says so. similarity: (id, similarity) to the most similar training row.
        """
        out, far = knn_distance(rows, self.reference, self.k).withColumn("knn_threshold", F.lit(self.limit).cast("double")), F.col("knn_distance")
        calls = [(far <= F.col("knn_threshold"), F.format_string(f"the {self.k} nearest training rows are %.3f away on average, over %.3f", far, "knn_threshold"))]
        if use_leverage:
            out = out.join(leverages(rows, self.inverse), "id").withColumn("leverage_threshold", F.lit(float(self.leverage_limit)))
            calls.append((F.col("leverage") <= F.col("leverage_threshold"), F.format_string("leverage %.3f is over %.3f", "leverage", "leverage_threshold")))
        if similarity is not None:
            out = out.join(similarity.select("id", F.col("similarity").alias("max_similarity")), "id", "left")
            calls.append((F.coalesce(F.col("max_similarity") >= floor, F.lit(False)), F.concat(F.lit("the most similar training row is only "), F.coalesce(F.format_string("%.3f", "max_similarity"), F.lit("unknown")), F.lit(f" similar, under {floor:g}"))))
        every, some = calls[0][0], calls[0][0]
        for c, _ in calls[1:]:
            every, some = every & c, some | c
        return out.withColumn("in_domain", every).withColumn("methods_disagree", some & ~every).withColumn("reasons", F.array_compact(F.array(*[F.when(~c, text) for c, text in calls])))

    def save(self, path: str) -> None:
        """The training rows and the fitted numbers, under a folder that Spark writes."""
        spark = self.reference.sparkSession
        self.reference.write.parquet(f"{path}/reference")
        fitted = [(self.k, self.percentile, self.limit, self.n_train, self.inverse.ravel().tolist())]
        spark.createDataFrame(fitted, "k int, percentile double, limit double, n_train long, inverse array<double>").coalesce(1).write.parquet(f"{path}/fitted")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Domain:
        r = spark.read.parquet(f"{path}/fitted").first()
        p = int(len(r["inverse"]) ** 0.5)
        return cls(spark.read.parquet(f"{path}/reference"), r["k"], r["percentile"], r["limit"], np.array(r["inverse"]).reshape(p, p), r["n_train"])


def assess(rows: DataFrame, train: DataFrame, k: int = 5, percentile: float = 0.95, similarity: DataFrame | None = None, floor: float = 0.3, use_leverage: bool = True) -> DataFrame:
    """The verdicts of a domain fitted to training rows for this once; see Domain."""
    return Domain.fit(train, k, percentile).assess(rows, similarity, floor, use_leverage)


def coverage(assessed: DataFrame) -> DataFrame:
    """(n, coverage): the share of rows inside the domain; NULL of none."""
    return assessed.agg(F.count("*").alias("n"), F.avg(F.col("in_domain").cast("double")).alias("coverage"))
