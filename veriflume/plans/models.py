"""Queries on models, their baselines and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modelling, ranking
from ..operators.ranking import regression_metrics
from ..operators.bootstrap import times_sql
from .bridge import SCORED_CTE, scored, table
from .registry import query

Y = "list_sum(embedding[1:8]::DOUBLE[])"


def _training(spark, d, n: int = 64):
    """(id, features, label): vectors, or their first n components, and the sum of their first eight as the label."""
    v = table(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return v.select("id", F.slice("features", 1, n).alias("features"), F.aggregate(F.slice("features", 1, 8), F.lit(0.0), lambda a, x: a + x).alias("label"))


def _sides(t):
    return t.where("id % 5 <> 0"), t.where("id % 5 = 0")


def _modelled(spark, d, kind, n=64, **settings):
    train, test = _sides(_training(spark, d, n))
    return modelling.predict_raw(modelling.fit(train, kind, with_domain=False, **settings), test).select("id", "label", "prediction")


@query()
def rf_predict(spark, d):
    """500 trees, as deep as they grow up to 30 levels."""
    return _modelled(spark, d, "forest")


@query()
def gbt_predict(spark, d):
    """300 rounds."""
    return _modelled(spark, d, "boosting")


XY = f"xy AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, {Y} AS label FROM embeddings WHERE embedding IS NOT NULL)"
RIDGE = f"""{XY}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(label) AS ml FROM xy WHERE id % 5 <> 0),
s AS (SELECT any_value(mx) AS mx, any_value(my) AS my, any_value(ml) AS ml, 1 + sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, 1 + sum((y - my) * (y - my)) AS yy, sum((x - mx) * (label - ml)) AS xl, sum((y - my) * (label - ml)) AS yl FROM xy, m WHERE id % 5 <> 0),
pred AS (SELECT id, label, ml + (x - mx) * (yy * xl - xy * yl) / (xx * yy - xy * xy) + (y - my) * (xx * yl - xy * xl) / (xx * yy - xy * xy) AS prediction FROM xy, s WHERE id % 5 = 0)"""


@query(f"WITH {RIDGE} SELECT id, round(label, 6) AS label, round(prediction, 5) AS prediction FROM pred")
def ridge_predict(spark, d):
    """Of two features, for which the solution can be written out."""
    return _modelled(spark, d, "ridge", 2).select("id", F.round("label", 6).alias("label"), F.round("prediction", 5).alias("prediction"))


@query(f"WITH {RIDGE} SELECT count(*) AS n, round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 4) AS r2, round(sqrt(avg((label - prediction) ** 2)), 4) AS rmse, round(avg(abs(label - prediction)), 4) AS mae FROM pred")
def model_metrics(spark, d):
    m = regression_metrics(_modelled(spark, d, "ridge", 2), "label", "prediction")
    return m.select("n", *[F.round(c, 4).alias(c) for c in ("r2", "rmse", "mae")])


@query()
def forest_spread(spark, d):
    """Predictions of 500 trees as quantities: their uncertainty is the trees' spread."""
    train, test = _sides(_training(spark, d))
    out = modelling.predict(modelling.fit(train, "forest"), test)
    return out.select("id", "predicted.value", "predicted.uncertainty", "predicted.in_domain", "predicted.origin")


@query()
def forest_importances(spark, d):
    """Of 500 trees."""
    return modelling.fit(_sides(_training(spark, d))[0], "forest", with_domain=False).importances(spark)


@query(f"SELECT vec_id AS id, round({Y}, 6) AS label, 64 AS n_features FROM embeddings WHERE embedding IS NOT NULL")
def training_set(spark, d):
    points = _training(spark, d).select("id", F.concat(F.lit("C"), F.col("id").cast("string")).alias("smiles"), "label", F.lit("derived").alias("origin"), F.lit(None).cast("double").alias("uncertainty"), "features")
    out = modelling.build_training_set(points.drop("features"), lambda p: p.select("id").join(points.select("id", "features"), "id"))
    return out.select("id", F.round("label", 6).alias("label"), F.size("features").alias("n_features"))


@query("WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, row_number() OVER (ORDER BY ('0x' || substr(md5('5:' || vec_id), 1, 8))::BIGINT, vec_id) AS k, label FROM embeddings) SELECT a.vec_id AS id, b.label FROM r a JOIN r b ON a.i = b.k")
def label_permutation(spark, d):
    return modelling.permuted(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), 5)


@query("SELECT origin, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'measured' WHEN 'click' THEN 'derived' ELSE 'predicted' END AS origin, value FROM events) WHERE value IS NULL OR origin = 'predicted' GROUP BY 1")
def label_provenance(spark, d):
    origin = F.when(F.col("event_type") == "view", "measured").when(F.col("event_type") == "click", "derived").otherwise("predicted")
    return modelling.label_problems(table(spark, d, "events").select(origin.alias("origin"), F.col("value").alias("label")))


NEAREST = f"e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {Y} AS label FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT a.id, a.label, b.label AS predicted, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM e a, e b WHERE a.id % 5 = 0 AND b.id % 5 <> 0), nn AS (SELECT id, label, predicted FROM n WHERE r = 1)"


@query(f"WITH {NEAREST} SELECT id, round(label, 6) AS label, round(predicted, 6) AS predicted FROM nn")
def nn_baseline(spark, d):
    return modelling.neighbour_predictions(*_sides(_training(spark, d))).select("id", *[F.round(c, 6).alias(c) for c in ("label", "predicted")])


@query(f"WITH {NEAREST}, m AS (SELECT avg(label) AS q FROM e WHERE id % 5 <> 0) SELECT round(1 - sum((label - q) ** 2) / (var_pop(label) * count(*)), 6) AS mean_r2, round(sqrt(avg((label - q) ** 2)), 6) AS mean_rmse, round(stddev_pop(label), 6) AS label_spread, round(1 - sum((label - predicted) ** 2) / (var_pop(label) * count(*)), 6) AS nn_r2, round(sqrt(avg((label - predicted) ** 2)), 6) AS nn_rmse FROM nn, m")
def baseline_bundle(spark, d):
    b = modelling.baselines(*_sides(_training(spark, d)))
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean_r2", "mean_rmse", "label_spread", "nn_r2", "nn_rmse")])


@query()
def permutation_bar(spark, d):
    """Ridge refitted to twenty permutations of its labels: the mean and 95th percentile of its scores."""
    train, test = _sides(_training(spark, d))
    b = modelling.baselines(train, test, neighbours=False, fit_predict="ridge")
    return b.select("permutation_mean", "permutation_p95", "n_permutations")


@query()
def model_evaluation(spark, d):
    """One row of whether ridge on all components is a working model: intervals, baselines, leaks, findings and the verdict."""
    train, test = _sides(_training(spark, d))
    out = modelling.predict_raw(modelling.fit(train, "ridge", with_domain=False), test)
    return modelling.evaluate(train, test, out, fit_predict="ridge", split_strategy="every fifth")


FOUND = "CASE WHEN spread < 0.3 THEN 'narrow labels;' ELSE '' END || CASE WHEN r2 - mean <= 0.05 THEN 'no better than the mean' ELSE 'beats the mean' END || CASE WHEN nn IS NULL THEN '' WHEN r2 <= nn THEN ';no better than the nearest neighbour' ELSE ';beats the nearest neighbour' END || CASE WHEN r2 <= bar THEN ';within permuted labels' ELSE ';clears permuted labels' END || CASE WHEN r2 > 0.95 THEN ';too good to be true' ELSE '' END"


@query(f"SELECT findings, count(*) AS n FROM (SELECT {FOUND} AS findings FROM (SELECT (event_id % 100) / 100.0::DOUBLE AS r2, (event_id % 7) / 10.0::DOUBLE AS mean, CASE WHEN event_id % 5 > 0 THEN (event_id % 11) / 20.0::DOUBLE END AS nn, (event_id % 13) / 20.0::DOUBLE AS bar, (event_id % 3) / 5.0::DOUBLE AS spread FROM events)) GROUP BY 1")
def baseline_findings(spark, d):
    e, h = F.col("event_id"), lambda m, q: (F.col("event_id") % m) / F.lit(q)
    f = modelling.findings(h(100, 100.0), h(7, 10.0), F.when(e % 5 > 0, h(11, 20.0)), h(13, 20.0), h(3, 5.0))
    return table(spark, d, "events").groupBy(F.array_join(f, ";").alias("findings")).agg(F.count("*").alias("n"))


DRAWN = f"{SCORED_CTE}, {times_sql('scored', 1000)}, s AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS ix FROM scored), x AS (SELECT rep, label::DOUBLE AS y, score / 100 AS p FROM drawn JOIN s USING (ix) UNION ALL SELECT -1, label, score / 100 FROM scored), r AS (SELECT *, rank() OVER (PARTITION BY rep ORDER BY y) + (count(*) OVER (PARTITION BY rep, y) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY rep ORDER BY p) + (count(*) OVER (PARTITION BY rep, p) - 1) / 2.0::DOUBLE AS b FROM x), v AS (SELECT rep, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae, corr(a, b) AS spearman FROM r GROUP BY rep), l AS (UNPIVOT v ON r2, rmse, mae, spearman INTO NAME metric VALUE v)"


@query(f"WITH {DRAWN} SELECT metric, round(any_value(v) FILTER (WHERE rep < 0), 5) AS estimate, round(quantile_cont(v, 0.025) FILTER (WHERE rep >= 0), 5) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE rep >= 0), 5) AS high FROM l GROUP BY 1")
def evaluation(spark, d):
    """Intervals of every metric over a thousand resamples of a screen's labels and scores."""
    df = scored(spark, d).select("seq", F.col("label").cast("double").alias("y"), (F.col("score") / 100).alias("p"))
    return ranking.evaluate(df).select("metric", *[F.round(c, 5).alias(c) for c in ("estimate", "low", "high")])


SPLITS = "SELECT (event_id % 97) / 100.0::DOUBLE AS la, (event_id % 97) / 100.0::DOUBLE + (event_id % 31) / 100.0::DOUBLE AS ha, (event_id % 89) / 100.0::DOUBLE AS lb, (event_id % 89) / 100.0::DOUBLE + (event_id % 29) / 100.0::DOUBLE AS hb FROM events"


@query(f"SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN NOT (ha < lb OR hb < la) THEN 'not resolved' WHEN lb - la > 0.2 THEN 'analogues carry the score' ELSE 'modest gap' END AS verdict FROM ({SPLITS})) GROUP BY 1")
def split_comparison(spark, d):
    h = lambda m: (F.col("event_id") % m) / F.lit(100.0)
    la, lb = h(97), h(89)
    v = modelling.compare_splits(lb - la, modelling.overlaps(la, la + h(31), lb, lb + h(29)))
    return table(spark, d, "events").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))
