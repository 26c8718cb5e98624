"""Queries on ranks, metrics, screens and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import background, modelling, ranking, screening, triage
from ..operators.bootstrap import times_sql
from .bridge import REGRESSION_CTE, SCORED_CTE, regression, scored, table
from .registry import query


@query(f"WITH {SCORED_CTE} SELECT seq, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rank FROM scored")
def avg_ranks(spark, d):
    return ranking.average_ranks(scored(spark, d), "score").select("seq", "rank")


@query(f"WITH {REGRESSION_CTE}, r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS b FROM reg) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, d):
    return ranking.spearman(regression(spark, d), "y", "p").select(F.round("spearman", 6).alias("spearman"))


@query(f"WITH {REGRESSION_CTE} SELECT count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(corr(y, p), 6) AS pearson FROM reg")
def regression_metrics(spark, d):
    return ranking.regression_metrics(regression(spark, d)).select("n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae", "pearson")])


@query(f"WITH {REGRESSION_CTE}, m AS (SELECT avg(y) FILTER (WHERE id % 5 <> 0) AS q FROM reg) SELECT count(*) AS n, round(1 - sum((y - q) * (y - q)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - q) * (y - q))), 6) AS rmse, round(stddev_pop(y), 6) AS label_spread FROM reg, m WHERE id % 5 = 0")
def mean_baseline(spark, d):
    r = regression(spark, d).withColumnRenamed("y", "label").drop("p")
    return modelling.mean_baseline(r.where("id % 5 <> 0"), r.where("id % 5 = 0")).select("n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "label_spread")])


@query(f"WITH {SCORED_CTE}, {times_sql('scored', 1000)}, s AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS ix FROM scored), x AS (SELECT rep, label::DOUBLE AS y, score / 100 AS p FROM drawn JOIN s USING (ix)), v AS (SELECT rep, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS v FROM x GROUP BY rep), w AS (SELECT label::DOUBLE AS y, score / 100 AS p FROM scored) SELECT (SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) FROM w) AS estimate, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS defined FROM v")
def bootstrap_r2(spark, d):
    df = scored(spark, d).select("seq", F.col("label").cast("double").alias("y"), (F.col("score") / 100).alias("p"))
    return ranking.bootstrap(df, ranking.weighted_r2()).select(*[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")], "defined")


@query(f"WITH {REGRESSION_CTE}, e AS (SELECT list_sort(list_distinct(quantile_cont(f, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM reg), b AS (SELECT y, len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: x <= f)) AS bin FROM reg, e), g AS (SELECT count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM b GROUP BY bin) SELECT round(greatest(0, 1 - sum(ss - s * s / n) / (sum(ss) - sum(s) * sum(s) / sum(n))), 6) AS binned_r2 FROM g")
def binned_r2(spark, d):
    return ranking.binned_r2(regression(spark, d), "f", "y").select(F.round("binned_r2", 6).alias("binned_r2"))


@query(f"WITH {REGRESSION_CTE} SELECT 'f' AS feature, round(corr(f, y), 6) AS correlation, false AS leaks FROM reg UNION ALL SELECT 'p', round(corr(p, y), 6), true FROM reg")
def leakage_screen(spark, d):
    return ranking.leakage_screen(regression(spark, d), ["f", "p"], "y").select("feature", F.round("correlation", 6).alias("correlation"), "leaks")


AUC = "SELECT label, rank() OVER (ORDER BY -score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored"


@query(f"WITH {SCORED_CTE}, r AS ({AUC}), n AS (SELECT sum(label)::BIGINT AS n_actives, (count(*) - sum(label))::BIGINT AS n_decoys, sum(r) FILTER (WHERE label = 1) AS s FROM r) SELECT n_actives, n_decoys, round((s - n_actives * (n_actives + 1) / 2.0::DOUBLE) / (n_actives * n_decoys), 9) AS auc FROM n")
def auc_roc(spark, d):
    return ranking.auc(scored(spark, d)).withColumn("auc", F.round("auc", 9))


def _ef(fraction):
    return f"WITH {SCORED_CTE}, n AS (SELECT count(*) AS n, sum(label) AS a, greatest(1, round_even({fraction} * count(*), 0))::BIGINT AS t FROM scored), top AS (SELECT label FROM (SELECT label, row_number() OVER (ORDER BY score, seq) AS r FROM scored), n WHERE r <= t) SELECT t AS n_top, (SELECT sum(label)::BIGINT FROM top) AS hits, round((SELECT sum(label) FROM top) / (a * t / n::DOUBLE), 9) AS ef, round(least(t, a) / (a * t / n::DOUBLE), 9) AS max_ef FROM n"


@query(_ef(0.01))
def enrichment_factor_1(spark, d):
    return ranking.enrichment_factor(scored(spark, d), 0.01).select("n_top", "hits", F.round("ef", 9).alias("ef"), F.round("max_ef", 9).alias("max_ef"))


@query(_ef(0.05))
def enrichment_factor_5(spark, d):
    return ranking.enrichment_factor(scored(spark, d), 0.05).select("n_top", "hits", F.round("ef", 9).alias("ef"), F.round("max_ef", 9).alias("max_ef"))


@query(f"WITH {SCORED_CTE}, k AS (SELECT label, row_number() OVER (ORDER BY score, seq) AS r, count(*) OVER () AS n, sum(label) OVER () AS a FROM scored), s AS (SELECT any_value(n)::DOUBLE AS n, any_value(a)::DOUBLE AS a, sum(CASE WHEN label = 1 THEN exp(-20.0::DOUBLE * r / n) ELSE 0 END) AS s FROM k), x AS (SELECT *, a / n AS q FROM s) SELECT round(s / (q * (1 - exp(-20.0::DOUBLE)) / (exp(20.0::DOUBLE / n) - 1)) * q * sinh(10.0::DOUBLE) / (cosh(10.0::DOUBLE) - cosh(10.0::DOUBLE - 20 * q)) + 1 / (1 - exp(20 * (1 - q))), 6) AS bedroc FROM x")
def bedroc(spark, d):
    return ranking.bedroc(scored(spark, d)).select(F.round("bedroc", 6).alias("bedroc"))


SCREENED = f"""WITH {SCORED_CTE}, {times_sql('scored', 2000)}, s AS (SELECT *, row_number() OVER (ORDER BY score, seq) - 1 AS ix, row_number() OVER (ORDER BY score, seq) AS pos, count(*) OVER () AS n, sum(label) OVER () AS a FROM scored),
x AS (SELECT rep, label, score FROM drawn JOIN s USING (ix) UNION ALL SELECT -1, label, score FROM scored), g AS (SELECT rep, score, count(*) FILTER (WHERE label = 1) AS a, count(*) FILTER (WHERE label = 0) AS d FROM x GROUP BY rep, score),
u AS (SELECT rep, sum(d * (below + a / 2.0::DOUBLE)) / nullif(sum(a) * sum(d), 0) AS auc FROM (SELECT *, coalesce(sum(a) OVER (PARTITION BY rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) GROUP BY rep),
i AS (SELECT any_value(auc) FILTER (WHERE rep < 0) AS auc, quantile_cont(auc, 0.025) FILTER (WHERE rep >= 0) AS low, quantile_cont(auc, 0.975) FILTER (WHERE rep >= 0) AS high FROM u),
t AS (SELECT any_value(n)::DOUBLE AS n, any_value(a)::DOUBLE AS a, any_value(greatest(1, round_even(0.01 * n, 0))) AS k1, any_value(greatest(1, round_even(0.05 * n, 0))) AS k5, count(*) FILTER (WHERE label = 1 AND pos <= greatest(1, round_even(0.01 * n, 0))) AS h1, count(*) FILTER (WHERE label = 1 AND pos <= greatest(1, round_even(0.05 * n, 0))) AS h5, sum(CASE WHEN label = 1 THEN exp(-20.0::DOUBLE * pos / n) ELSE 0 END) AS s FROM s),
b AS (SELECT *, a / n AS q FROM t)
SELECT a::BIGINT AS n_actives, (n - a)::BIGINT AS n_decoys, round(auc, 6) AS auc, round(low, 6) AS auc_low, round(high, 6) AS auc_high, round(h1 / (a * k1 / n), 6) AS ef1, round(h5 / (a * k5 / n), 6) AS ef5,
  round(s / (q * (1 - exp(-20.0::DOUBLE)) / (exp(20.0::DOUBLE / n) - 1)) * q * sinh(10.0::DOUBLE) / (cosh(10.0::DOUBLE) - cosh(10.0::DOUBLE - 20 * q)) + 1 / (1 - exp(20 * (1 - q))), 6) AS bedroc, round(least(k1, a) / (a * k1 / n), 6) AS max_ef1,
  CASE WHEN low > 0.5 THEN 'separates' WHEN high - low <= 0.3 THEN 'does not separate' ELSE 'inconclusive' END AS verdict, CASE WHEN high - low > 0.2 THEN ceil(least(a, n - a) * pow((high - low) / 0.2, 2))::BIGINT END AS compounds_needed
FROM b, i"""


@query(SCREENED)
def analyse_enrichment(spark, d):
    """One row of what a screen says: 2,000 resamples of its area, both enrichment factors, BEDROC and the verdict."""
    out = ranking.analyse_enrichment(scored(spark, d)).drop("gap_warning")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


INTERVALS = "SELECT event_id, (event_id % 97) / 100.0::DOUBLE AS low, (event_id % 97) / 100.0::DOUBLE + (event_id % 31 + 10) / 100.0::DOUBLE AS high FROM events"


def _intervals(spark, d):
    low = (F.col("event_id") % 97) / F.lit(100.0)
    return table(spark, d, "events").select("event_id", low.alias("low"), (low + (F.col("event_id") % 31 + 10) / F.lit(100.0)).alias("high"))


@query(f"SELECT CASE WHEN low > 0.5 THEN 'separates' WHEN high - low <= 0.3 THEN 'does not separate' ELSE 'inconclusive' END AS verdict, count(*) AS n FROM ({INTERVALS}) GROUP BY 1")
def enrichment_verdict(spark, d):
    return _intervals(spark, d).groupBy(ranking.verdict(F.col("low"), F.col("high")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"SELECT needed, count(*) AS n FROM (SELECT ceil(8 * pow((high - low) / 0.2::DOUBLE, 2))::BIGINT AS needed FROM ({INTERVALS})) GROUP BY 1")
def compounds_needed(spark, d):
    return _intervals(spark, d).groupBy(ranking.compounds_needed(F.lit(8), F.col("low"), F.col("high")).alias("needed")).agg(F.count("*").alias("n"))


@query("SELECT (event_id % 2 = 0 AND event_id % 60 >= 30 AND (event_id % 100) / 100.0::DOUBLE - (event_id % 7) / 10.0::DOUBLE > 0.05::DOUBLE AND (event_id % 100) / 100.0::DOUBLE > (event_id % 11) / 20.0::DOUBLE AND (event_id % 100) / 100.0::DOUBLE > (event_id % 13) / 20.0::DOUBLE) AS defensible, count(*) AS n FROM events GROUP BY 1")
def is_defensible(spark, d):
    e, h = F.col("event_id"), lambda m, q: (F.col("event_id") % m) / F.lit(q)
    flag = ranking.is_defensible(h(100, 100.0), e % 60, h(7, 10.0), h(11, 20.0), h(13, 20.0), e % 2)
    return table(spark, d, "events").groupBy(flag.alias("defensible")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq) AS rn, count(*) OVER (PARTITION BY label) AS g, min(seq) OVER (PARTITION BY label) AS f FROM scored) SELECT seq, label, row_number() OVER (ORDER BY rn, g DESC, f) AS position FROM r")
def interleave(spark, d):
    return background.interleave(scored(spark, d)).select("seq", "label", "position")


@query(f"WITH {SCORED_CTE}, s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq) AS k FROM scored), t AS (SELECT * FROM s WHERE (k - 1) % 6 = 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq) AS rn, count(*) OVER (PARTITION BY label) AS g, min(seq) OVER (PARTITION BY label) AS f FROM t) SELECT seq, label, row_number() OVER (ORDER BY rn, g DESC, f) AS position FROM r")
def shard_by_label(spark, d):
    return background.shard(scored(spark, d), 6, 2).select("seq", "label", "position")


RESULTS = "SELECT event_id AS seq, (event_id % 3 = 0)::INT AS label, CASE WHEN event_id % 10 = 1 THEN NULL ELSE -value / 10 END AS best_score, CASE WHEN event_id % 10 = 1 THEN event_type || ': failed' END AS error, value AS elapsed, (15 + event_id % 30)::INT AS heavy_atoms FROM events"


def _results(spark, d):
    e, bad = table(spark, d, "events"), F.col("event_id") % 10 == 1
    return e.select(F.col("event_id").alias("seq"), (F.col("event_id") % 3 == 0).cast("int").alias("label"), F.when(~bad, -F.col("value") / 10).alias("best_score"), F.when(bad, F.concat("event_type", F.lit(": failed"))).alias("error"), F.col("value").alias("elapsed"), (F.col("event_id") % 30 + 15).cast("int").alias("heavy_atoms"))


@query(f"SELECT label, count(*) AS n, count(error) AS n_failed, round(count(error) / count(*)::DOUBLE, 9) AS failure_rate FROM ({RESULTS}) GROUP BY 1")
def failure_rates(spark, d):
    return screening.accounting(_results(spark, d)).withColumn("failure_rate", F.round("failure_rate", 9))


@query(f"SELECT split_part(error, ':', 1) AS reason, count(*) AS n FROM ({RESULTS}) WHERE error IS NOT NULL GROUP BY 1")
def failure_reasons(spark, d):
    return screening.failure_reasons(_results(spark, d))


@query("SELECT event_id, event_type FROM (SELECT *, coalesce(sum(value::DECIMAL(18, 4)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events) WHERE s <= 1000")
def time_budget_prefix(spark, d):
    e = table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    return screening.budget_prefix(e, 1000, "value", "event_id", ["event_type"]).select("event_id", "event_type")


@query(f"SELECT seq, round(best_score / heavy_atoms, 9) AS ligand_efficiency FROM ({RESULTS})")
def ligand_efficiency(spark, d):
    return _results(spark, d).select("seq", F.round(screening.ligand_efficiency(F.col("best_score"), F.col("heavy_atoms")), 9).alias("ligand_efficiency"))


@query(f"WITH r AS ({RESULTS}), t AS (SELECT quantile_cont(best_score, 0.5) AS t FROM r WHERE label = 1), f AS (SELECT seq, best_score IS NOT NULL AS assessed, coalesce(best_score <= t, false) AS passing, coalesce(best_score <= t AND abs(best_score - t) > 2.5, false) AS dist FROM r, t WHERE label = 0) SELECT seq, passing, (SELECT count(*) FILTER (WHERE dist) FROM f) AS n_distinguishable, CASE WHEN (SELECT count(*) FILTER (WHERE dist) FROM f) = 0 THEN assessed ELSE passing END AS kept FROM f")
def triage_raw(spark, d):
    r = _results(spark, d)
    return triage.by_score(r.where("label = 0"), r.where("label = 1").select("best_score")).select("seq", "passing", "n_distinguishable", "kept")


@query(f"WITH r AS (SELECT *, best_score / heavy_atoms AS e FROM ({RESULTS})), t AS (SELECT quantile_cont(e, 0.5) AS t FROM r WHERE label = 1), f AS (SELECT seq, e IS NOT NULL AS assessed, coalesce(e <= t, false) AS passing, coalesce(e <= t AND abs(e - t) * heavy_atoms > 2.5, false) AS dist FROM r, t WHERE label = 0) SELECT seq, passing, (SELECT count(*) FILTER (WHERE dist) FROM f) AS n_distinguishable, CASE WHEN (SELECT count(*) FILTER (WHERE dist) FROM f) = 0 THEN assessed ELSE passing END AS kept FROM f")
def triage_efficiency(spark, d):
    r = _results(spark, d).withColumn("ligand_efficiency", screening.ligand_efficiency(F.col("best_score"), F.col("heavy_atoms")))
    return triage.by_efficiency(r.where("label = 0"), r.where("label = 1").select("ligand_efficiency")).select("seq", "passing", "n_distinguishable", "kept")


@query("SELECT c_mktsegment AS segment, count(DISTINCT c_nationkey) AS n_receptors, count(DISTINCT c_nationkey) <= 1 AND count(DISTINCT c_mktsegment) <= 1 AS poolable FROM customer GROUP BY 1")
def pool_guards(spark, d):
    df = table(spark, d, "customer").withColumn("segment", F.col("c_mktsegment"))
    return triage.pool_check(df, ["c_nationkey", "c_mktsegment"], "segment").select("segment", F.col("n_c_nationkey").alias("n_receptors"), "poolable")


@query(f"WITH {SCORED_CTE} SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_actives, count(*) FILTER (WHERE abs(score - 5) > 2.5) AS n_far, count(*) FILTER (WHERE score < 2) AS n_right FROM scored")
def score_checks(spark, d):
    s = scored(spark, d).withColumnRenamed("score", "best_score").withColumn("error", F.lit(None).cast("string"))
    r = screening.scored(s)
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_actives"), F.count_if(screening.distinguishable(F.col("score"), F.lit(5.0))).alias("n_far"), F.count_if(screening.pose_is_correct(F.col("score"))).alias("n_right"))


@query("SELECT round(median(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - median(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS shift FROM orders")
def arm_shift(spark, d):
    return triage.median_shift(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O").select(F.round("shift", 6).alias("shift"))


@query("WITH t AS (SELECT o_orderstatus AS arm, median(o_totalprice) AS threshold FROM orders GROUP BY 1) SELECT arm, count(*) AS n, count(*) FILTER (WHERE o_totalprice <= threshold / 2) AS n_passing FROM orders JOIN t ON o_orderstatus = arm GROUP BY 1")
def arm_pass_rates(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "arm")
    limits = o.groupBy("arm").agg((F.percentile("o_totalprice", F.lit(0.5)) / 2).alias("threshold"))
    return triage.pass_rates(o, "o_totalprice", "arm", limits).select("arm", "n", "n_passing")


LEFT = f"r AS (SELECT *, best_score / heavy_atoms AS e FROM ({RESULTS})), t AS (SELECT quantile_cont(e, 0.5) AS t FROM r WHERE label = 1), f AS (SELECT seq, coalesce(e <= t, false) AS kept, coalesce(e <= t AND abs(e - t) * heavy_atoms > 2.5, false) AS dist, e IS NOT NULL AS assessed FROM r, t WHERE label = 0), k AS (SELECT seq FROM f WHERE CASE WHEN (SELECT count(*) FILTER (WHERE dist) FROM f) = 0 THEN assessed ELSE kept END)"


@query(f"WITH {LEFT} SELECT CASE WHEN seq % 4 = 0 THEN 'no strong feature' WHEN seq % 6 = 1 THEN 'joined molecules' ELSE 'left' END AS fate, count(*) AS n FROM k GROUP BY 1")
def triage_survivors(spark, d):
    r = _results(spark, d).withColumn("ligand_efficiency", screening.ligand_efficiency(F.col("best_score"), F.col("heavy_atoms")))
    c = r.where("label = 0").withColumn("retains_strong_feature", F.when(F.col("seq") % 4 == 0, False).when(F.col("seq") % 4 == 1, True)).withColumn("duplicated_motifs", F.when(F.col("seq") % 6 == 1, F.create_map(F.lit("amidine"), F.lit(2))))
    rows = triage.survivors(triage.by_efficiency(c, r.where("label = 1").select("ligand_efficiency")), True)
    return rows.groupBy(F.coalesce("set_aside", F.lit("left")).alias("fate")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED_CTE}, p AS (SELECT label AS key, min(score) AS low FROM scored WHERE seq % 3 = 0 GROUP BY 1) SELECT seq, low FROM scored LEFT JOIN p ON key = label")
def attached_properties(spark, d):
    s = scored(spark, d)
    known = s.where("seq % 3 = 0").select("label", F.col("score").alias("low"))
    return screening.attach(s, known, "label").select("seq", "low")

@query("SELECT substr(sha256(string_agg(p_name || ':' || p_partkey, chr(10) ORDER BY p_partkey)), 1, 16) AS signature FROM part")
def signature(spark, d):
    return triage.signature(table(spark, d, "part").select("p_partkey", F.concat_ws(":", "p_name", "p_partkey").alias("v")), "v", "p_partkey")


@query("SELECT o_orderstatus AS arm, count(o_totalprice) AS n, round(min(o_totalprice), 6) AS low, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(median(o_totalprice), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, round(max(o_totalprice), 6) AS high FROM orders GROUP BY 1")
def arm_compare(spark, d):
    df = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "arm")
    return triage.five_numbers(df, "o_totalprice", "arm").select("arm", "n", *[F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query("SELECT round(max(b) - min(a), 6) AS spread, round(max(b - a), 6) AS within, CASE WHEN max(b) - min(a) <= 1e-6 THEN 'deterministic' WHEN max(b - a) <= 1e-6 THEN 'varies with the setting' ELSE 'varies by itself' END AS verdict FROM (SELECT p_size, min(p_retailprice) AS a, max(p_retailprice) AS b FROM part GROUP BY 1)")
def determinism_probe(spark, d):
    return triage.determinism(table(spark, d, "part"), "p_size", "p_retailprice").select(F.round("spread", 6).alias("spread"), F.round("within", 6).alias("within"), "verdict")


@query("SELECT o_orderpriority AS label, count(*) AS n, round(max(o_totalprice) - min(o_totalprice), 6) AS spread, max(o_totalprice) - min(o_totalprice) > 2.5 AND count(*) > 1 AS determined FROM orders GROUP BY 1")
def pose_spread(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("b"), F.min("o_totalprice").alias("a"))
    s = screening.pose_spread(F.array("a", "b"))
    return per.select("label", "n", F.round(s["spread"], 6).alias("spread"), (s["determined"] & (F.col("n") > 1)).alias("determined"))
