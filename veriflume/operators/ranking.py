"""Ranks, rank correlations, regression metrics, and the enrichment statistics of a screen (lower scores are better).

Places in one global order are taken over ranges of the order (running_total), so no task sorts everything; ranks count distinct
values first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .quantiles import percentiles


def running_total(df: DataFrame, order: list, amount: Column | None = None, out: str = "before") -> DataFrame:
    """df with the sum of amount (1 if not given) over all rows before each in a total order, without sorting all rows in one task.

    Rows are dealt to ranges of the order, written once, and summed a range at a time; what comes before a range is added from a table
    with one row a range. Rows that tie in the order get an arbitrary one of their places.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(1).cast("long") if amount is None else amount
    dealt = cut(df.withColumn("__amount", value).repartitionByRange(n, *cols).withColumn("__range", F.spark_partition_id()))
    whole = dealt.groupBy("__range").agg(F.sum("__amount").alias("__sum"))
    earlier = whole.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))  # a row a range
    within = F.coalesce(F.sum("__amount").over(Window.partitionBy("__range").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__within", within).join(F.broadcast(earlier), "__range").withColumn(out, F.col("__within") + F.col("__earlier")).drop("__amount", "__range", "__within", "__earlier")


def counter_hash(*parts: Column) -> Column:
    """A reproducible 32-bit number of its parts: the first 8 hex digits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """df with 1-based ranks of value, ties sharing their mean."""
    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    ranks = running_total(counts, [value], F.col("__n"), "__before").select(F.col(value).alias("__v"), (F.col("__before") + (F.col("__n") + 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, df[value].eqNullSafe(ranks["__v"])).drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    return average_ranks(average_ranks(df, a, "__a"), b, "__b").agg(F.corr("__a", "__b").alias("spearman"))


def regression_metrics(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """n, r2 (against the variance of the truths; NULL if they do not vary), rmse, mae, pearson."""
    miss = F.col(truth) - F.col(predicted)
    total = F.var_pop(truth) * F.count("*")
    return df.agg(F.count("*").alias("n"), F.when(F.var_pop(truth) > 0, 1 - F.sum(miss * miss) / total).alias("r2"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(F.abs(miss)).alias("mae"), F.corr(truth, predicted).alias("pearson"))


def auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by the Mann-Whitney count, ties one half; NULL with one class. df: (label, score)."""
    by = by or []
    per = df.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("d"))
    if by:
        w = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        wins = per.withColumn("below", F.coalesce(F.sum("a").over(w), F.lit(0)))
    else:
        wins = running_total(per, ["score"], F.col("a"), "below")
    # a decoy loses to every active with a lower score
    out = wins.groupBy(*by).agg(F.sum(F.col("d") * (F.col("below") + F.col("a") / F.lit(2.0))).alias("w"), F.sum("a").alias("n_actives"), F.sum("d").alias("n_decoys"))
    return out.select(*by, "n_actives", "n_decoys", F.when((F.col("n_actives") > 0) & (F.col("n_decoys") > 0), F.col("w") / (F.col("n_actives") * F.col("n_decoys"))).alias("auc"))


def ordered_by_score(df: DataFrame) -> DataFrame:
    """df with position: 1-based order by (score, seq)."""
    return running_total(df, ["score", "seq"]).withColumn("position", F.col("before") + 1).drop("before")


def enrichment_factor(df: DataFrame, fraction: float) -> DataFrame:
    """n_top, hits, ef and its ceiling at a fraction of the list; ties keep input order (seq); n_top is rounded half to even."""
    sizes = df.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("a"))
    n, a = sizes.first()
    n_top = max(1, round(fraction * n))
    expected = a * n_top / n if n else 0
    top = ordered_by_score(df).where(F.col("position") <= n_top)  # places over ranges: a share of a large table is no bounded top-k
    ceiling = min(n_top, a) / expected if expected else None
    return top.agg(F.lit(n_top).cast("long").alias("n_top"), F.count_if(F.col("label") == 1).alias("hits"), F.try_divide(F.count_if(F.col("label") == 1).cast("double"), F.lit(expected)).alias("ef"), F.lit(ceiling).cast("double").alias("max_ef"))


def bedroc(df: DataFrame, alpha: float = 20.0) -> DataFrame:
    """Boltzmann-enhanced discrimination of ROC; NULL unless both classes are there."""
    ranked = ordered_by_score(df).crossJoin(F.broadcast(df.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("a"))))  # one row
    s = ranked.groupBy("n", "a").agg(F.sum(F.when(F.col("label") == 1, F.exp(-alpha * F.col("position") / F.col("n"))).otherwise(0.0)).alias("s"))
    r = F.col("a") / F.col("n")
    expected = r * (1 - math.exp(-alpha)) / (F.exp(F.lit(alpha) / F.col("n")) - 1)
    factor = r * math.sinh(alpha / 2) / (F.lit(math.cosh(alpha / 2)) - F.cosh(alpha / 2 - alpha * r))
    value = F.col("s") / expected * factor + 1 / (1 - F.exp(alpha * (1 - r)))
    return s.select(F.when((F.col("a") > 0) & (F.col("a") < F.col("n")), value).alias("bedroc"))


def _bounds(values: DataFrame, resamples: int, confidence: float, strict: bool, *by: str) -> DataFrame:
    """(by, low, high, defined) of values (v); undefined resamples are skipped, and with fewer than half defined there are no bounds."""
    tail = (1 - confidence) / 2
    got = values.groupBy(*by).agg(F.count("v").alias("defined"), F.percentile("v", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    enough = F.col("defined") * 2 >= resamples
    q = F.when(enough, F.col("q"))
    if strict:
        q = q.otherwise(F.raise_error(F.lit("fewer than half of the resamples are defined")).cast("array<double>"))
    return got.select(*by, q[0].alias("low"), q[1].alias("high"), "defined")


def bootstrap(df: DataFrame, metric: Column, resamples: int = 1000, seed: int = 0, confidence: float = 0.95, order: str = "seq", strict: bool = False) -> DataFrame:
    """estimate, low, high of a weighted metric over resamples with replacement. metric: a Column over the rows and `times`.

    Undefined resamples are skipped; fewer than half defined gives NULL bounds, or an error if strict. Any metric will do, at the price of a
    row for each row and resample inside Spark; evaluate() and analyse_enrichment() exchange states instead.
    """
    from .bootstrap import resampled

    values = resampled(df, resamples, seed, order).groupBy("rep").agg(metric.alias("v"))
    whole = df.withColumn("times", F.lit(1)).agg(metric.alias("estimate"))
    return whole.crossJoin(_bounds(values, resamples, confidence, strict)).select("estimate", "low", "high", "defined")  # 1 x 1 rows


def weighted_ranks(drawn: DataFrame, value: str, out: str) -> DataFrame:
    """drawn (rep, times) with the mean rank that a value's copies share within its resample; rows without a value are left out.

    Rows are exchanged by their resample only, so ranks of several values, and what is summed of them, share one exchange.
    """
    upto, peers = Window.partitionBy("rep").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("rep", value)
    return drawn.where(F.col(value).isNotNull()).withColumn(out, F.sum("times").over(upto) - (F.sum("times").over(peers) - 1) / F.lit(2.0))


#: of sums over a resample: what each metric is made of
PARTS = {"__y": lambda y, p: y, "__yy": lambda y, p: y * y, "__m": lambda y, p: (y - p) * (y - p), "__a": lambda y, p: F.abs(y - p)}


def evaluate(df: DataFrame, resamples: int = 1000, seed: int = 0, truth: str = "y", predicted: str = "p", order: str = "seq", confidence: float = 0.95) -> DataFrame:
    """(metric, estimate, low, high, defined) of r2, rmse, mae and spearman, all over the same resamples.

    The first three exchange sums, a row for each resample and chunk of rows. Ranks need the drawn rows of each resample in order.
    """
    from .bootstrap import bounds, resampled, sums

    rows = df.select(order, F.col(truth).cast("double").alias("y"), F.col(predicted).cast("double").alias("p"))
    parts = rows.withColumns({c: f(F.col("y"), F.col("p")) for c, f in PARTS.items()})
    got = sums(parts, list(PARTS), resamples, seed, order).toPandas()  # a row a resample
    spread = got["__yy"] - got["__y"] ** 2 / got["n"]
    got["r2"] = (1 - got["__m"] / spread).where(spread > 1e-12 * got["__yy"].abs().clip(lower=1e-300))
    got["rmse"], got["mae"] = (got["__m"] / got["n"]) ** 0.5, got["__a"] / got["n"]
    a, b, t = F.col("__a"), F.col("__b"), F.col("times")
    n, sa, sb = F.sum(t), F.sum(t * a), F.sum(t * b)
    wide = lambda s, x: F.sum(t * x * x) - s * s / n
    rho = F.when((wide(sa, a) > 1e-9) & (wide(sb, b) > 1e-9), (F.sum(t * a * b) - sa * sb / n) / F.sqrt(wide(sa, a) * wide(sb, b)))
    once = rows.withColumns({"rep": F.lit(-1).cast("long"), "times": F.lit(1).cast("long")})
    drawn = resampled(rows, resamples, seed, order).unionByName(once).select("rep", "times", "y", "p").repartition(min(resamples + 1, 200), "rep")  # a fixed number: small as files, they are long to sort
    ranked = weighted_ranks(weighted_ranks(drawn, "y", "__a"), "p", "__b").groupBy("rep").agg(rho.alias("spearman")).toPandas()
    out = []
    for name, values in (*((m, got[["rep", m]]) for m in ("r2", "rmse", "mae")), ("spearman", ranked)):
        whole, each = values.loc[values["rep"] < 0, name], values.loc[values["rep"] >= 0, name]
        known = lambda x: None if x is None or x != x else float(x)
        out.append((name, known(whole.iat[0]), *bounds(each.tolist(), resamples, confidence)))
    return df.sparkSession.createDataFrame(out, "metric string, estimate double, low double, high double, defined long")


def analyse_enrichment(df: DataFrame, resamples: int = 2000, seed: int = 0, alpha: float = 20.0, confidence: float = 0.95, gap_warning: str = "", width: float = 0.30, target: float = 0.20) -> DataFrame:
    """One row of what a screen (seq, label, score) says: n_actives, n_decoys, auc, auc_low, auc_high, ef1, ef5, bedroc, max_ef1, verdict,
    compounds_needed for an interval of width target (NULL if it is narrower already), gap_warning.

    Places in the ranking are taken once; enrichment factors and BEDROC are sums over them, and the bootstrap draws chunks of it.
    With one class, what needs two is NULL and the verdict is 'inconclusive'.
    """
    from .bootstrap import areas, bounds

    placed = ordered_by_score(df.select("seq", "label", "score"))
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.count_if(F.col("label") == 1), F.lit(0)).alias("a"), F.coalesce(F.count_if(F.col("label") == 0), F.lit(0)).alias("d")).first()
    n, a, d = size
    active = F.col("label") == 1
    top = {f: max(1, round(f * n)) for f in (0.01, 0.05)}
    got = placed.agg(*[F.count_if(active & (F.col("position") <= k)).alias(f"h{k}") for k in dict.fromkeys(top.values())], F.sum(F.when(active, F.exp(-alpha * F.col("position") / n)).otherwise(0.0)).alias("s")).first() if n else None
    ef = {f: got[f"h{k}"] / (a * k / n) if a else None for f, k in top.items()} if n else dict.fromkeys(top)
    estimate = auc(df).first()["auc"]
    low = high = bedroc_ = None
    if a and d:
        r = a / n
        bedroc_ = got["s"] / (r * (1 - math.exp(-alpha)) / math.expm1(alpha / n)) * r * math.sinh(alpha / 2) / (math.cosh(alpha / 2) - math.cosh(alpha / 2 - alpha * r)) + 1 / (1 - math.exp(alpha * (1 - r)))
        low, high, _ = bounds([x["auc"] for x in areas(df, resamples, seed).collect()], resamples, confidence)  # a number a resample
    says = "inconclusive" if low is None else "separates" if low > 0.5 else "does not separate" if high - low <= width else "inconclusive"
    needed = math.ceil(min(a, d) * ((high - low) / target) ** 2) if low is not None and high - low > target and min(a, d) else None
    row = (a, d, estimate, low, high, ef[0.01], ef[0.05], bedroc_, min(top[0.01], a) / (a * top[0.01] / n) if a else None, says, needed, gap_warning)
    return df.sparkSession.createDataFrame([row], "n_actives long, n_decoys long, auc double, auc_low double, auc_high double, ef1 double, ef5 double, bedroc double, max_ef1 double, verdict string, compounds_needed long, gap_warning string")


def weighted_r2(truth: str = "y", predicted: str = "p") -> Column:
    t, y, miss = F.col("times"), F.col(truth), F.col(truth) - F.col(predicted)
    n, s, ss = F.sum(t), F.sum(t * y), F.sum(t * y * y)
    spread = ss - s * s / n
    return F.when(spread > 0, 1 - F.sum(t * miss * miss) / spread)


def binned_r2(df: DataFrame, feature: str, target: str, bins: int = 10) -> DataFrame:
    """Share of the target's variance explained by quantile bins of one feature, 0 at least and where bins collapse."""
    return binned_r2s(df, [feature], target, bins).select("binned_r2")


def binned_r2s(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, binned_r2) of many features together: their edges by one selection, their bins in one pass.

    A bin is a group of few sums, so only a row for each feature and bin meets in the end.
    """
    df = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("__y"))
    edges = percentiles(df, features, [i / bins for i in range(bins + 1)])
    inner = {r["column"]: sorted(set(r["values"]))[1:-1] if r["n"] else [] for r in edges.collect()}  # a row a feature
    place = lambda f: F.size(F.filter(F.lit(inner[f]).cast("array<double>"), lambda x: x <= F.col(f)))
    long = df.select("__y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), place(f).alias("bin")) for f in features])).alias("x")).select("__y", "x.*")
    per = long.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("ss"))
    whole = per.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"))
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    flat = F.col("feature").isin([f for f in features if not inner[f]])  # under three edges
    return whole.select("feature", F.when(flat | (total <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("within") / total)).alias("binned_r2"))


def leakage_screen(df: DataFrame, features: list[str], target: str, max_correlation: float = 0.95, max_binned: float = 0.9, bins: int = 10) -> DataFrame:
    """(feature, correlation, binned_r2, leaks) of features that vary, all of them in the same few passes."""
    spread = df.agg(F.stddev_pop(target).alias("y"), *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    vary = [f for f in features if spread[f"s_{f}"]]
    if not vary or not spread["y"]:
        return df.sparkSession.createDataFrame([], "feature string, correlation double, binned_r2 double, leaks boolean")
    stats = df.agg(*[F.corr(f, target).alias(f) for f in vary]).first()  # of what varies: it divides by the spread
    r = df.sparkSession.createDataFrame([(f, stats[f]) for f in vary], "feature string, correlation double")
    out = binned_r2s(df, vary, target, bins).join(F.broadcast(r), "feature").select("feature", "correlation", "binned_r2")  # a row a feature
    return out.withColumn("leaks", F.coalesce(F.abs("correlation") >= max_correlation, F.lit(False)) | (F.col("binned_r2") >= max_binned))


def verdict(low: Column, high: Column, width: float = 0.30) -> Column:
    return F.when(low > 0.5, "separates").when(high - low <= width, "does not separate").otherwise("inconclusive")


def compounds_needed(smaller_group: Column, low: Column, high: Column, width: float = 0.20) -> Column:
    return F.ceil(smaller_group * F.pow((high - low) / width, F.lit(2.0)))


def is_defensible(r2: Column, n_test: Column, mean_r2: Column, permutation_p95: Column, neighbour_r2: Column, n_warnings: Column) -> Column:
    return (n_warnings == 0) & (n_test >= 30) & mean_r2.isNotNull() & F.coalesce(r2 - mean_r2 > 0.05, F.lit(False)) & F.coalesce(r2 > permutation_p95, F.lit(True)) & F.coalesce(r2 > neighbour_r2, F.lit(True))
