"""Queries on similarity, neighbours, splits, matched controls and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import domain, features, matching, similarity, split
from ..session import cut
from .bridge import FINGERPRINT_CTE, fingerprints, table
from .registry import query

TANIMOTO = "coalesce(bit_count(a.word & b.word) / nullif(a.bits + b.bits - bit_count(a.word & b.word), 0)::DOUBLE, 0)"


@query(f"WITH {FINGERPRINT_CTE} SELECT a.id, count(*) AS n_refs, round(avg({TANIMOTO}), 9) AS mean_similarity, round(max({TANIMOTO}), 9) AS max_similarity FROM fpb a, fpb b WHERE b.grp = 0 GROUP BY a.id")
def tanimoto_matrix(spark, d):
    fp = fingerprints(spark, d)
    return similarity.matrix(fp, fp.where("grp = 0")).groupBy("id").agg(F.count("*").alias("n_refs"), F.round(F.avg("similarity"), 9).alias("mean_similarity"), F.round(F.max("similarity"), 9).alias("max_similarity"))


@query(f"WITH {FINGERPRINT_CTE} SELECT a.id AS a, b.id AS b, round({TANIMOTO}, 9) AS similarity FROM fpb a JOIN fpb b ON a.id < b.id WHERE a.bits > 0 AND b.bits > 0 AND {TANIMOTO} >= 0.5")
def tanimoto_pairs(spark, d):
    return similarity.similar_pairs(fingerprints(spark, d), 0.5).withColumn("similarity", F.round("similarity", 9))


NEAREST = f"SELECT id, ref, s FROM (SELECT a.id, b.id AS ref, {TANIMOTO} AS s, row_number() OVER (PARTITION BY a.id ORDER BY {TANIMOTO} DESC, b.id) AS r FROM fpb a, fpb b WHERE b.grp = 0) WHERE r = 1"


@query(f"WITH {FINGERPRINT_CTE} SELECT id, ref, round(s, 9) AS similarity FROM ({NEAREST})")
def nearest_reference(spark, d):
    fp = fingerprints(spark, d)
    return similarity.nearest(fp, fp.where("grp = 0")).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {FINGERPRINT_CTE}, n AS ({NEAREST}), k AS (SELECT DISTINCT word FROM fpb WHERE grp = 0), x AS (SELECT n.*, fpb.word IN (SELECT word FROM k) AS e FROM n JOIN fpb USING (id)) SELECT id, e AS is_exact, NOT e AND s < 0.85 AS is_novel, CASE WHEN e THEN 'exact' WHEN s >= 0.85 THEN 'near' WHEN s >= 0.4 THEN 'analogue' ELSE 'distant' END AS band FROM x")
def novelty_verdict(spark, d):
    fp = fingerprints(spark, d)
    known = fp.where("grp = 0")
    return similarity.novelty(similarity.nearest(fp, known).join(fp.select("id", "word"), "id"), known).select("id", "is_exact", "is_novel", "band")


@query(f"WITH RECURSIVE {FINGERPRINT_CTE}, o AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM fpb), step(k, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, word BIGINT, bits BIGINT)[] UNION ALL SELECT o.k, CASE WHEN len(list_filter(kept, lambda x: bit_count(x.word & o.word) / nullif(x.bits + o.bits - bit_count(x.word & o.word), 0)::DOUBLE >= 0.6)) > 0 THEN kept ELSE list_append(kept, {{'id': o.id, 'word': o.word, 'bits': o.bits}}) END FROM step JOIN o ON o.k = step.k + 1) SELECT unnest(kept).id AS id FROM step WHERE k = (SELECT max(k) FROM o)")
def diverse_subset(spark, d):
    return similarity.diverse_subset(fingerprints(spark, d), 0.6)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


PAIRS = "SELECT a.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b WHERE {where}"
KNN = "SELECT id, avg(d) AS k FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM ({pairs})) WHERE r <= 5 GROUP BY id"


@query("SELECT id, round(k, 6) AS knn_distance FROM (" + KNN.format(pairs=PAIRS.format(where="a.label < 2 AND b.label >= 2")) + ")")
def knn_distance(spark, d):
    v = _vectors(spark, d)
    return domain.knn_distance(v.where("label < 2"), v.where("label >= 2")).select("id", F.round("knn_distance", 6).alias("knn_distance"))


@query("SELECT round(quantile_cont(k, 0.95), 6) AS knn_threshold FROM (" + KNN.format(pairs=PAIRS.format(where="a.label >= 5 AND b.label >= 5 AND a.vec_id <> b.vec_id")) + ")")
def knn_threshold(spark, d):
    return domain.knn_threshold(_vectors(spark, d).where("label >= 5")).select(F.round("knn_threshold", 6).alias("knn_threshold"))


@query("WITH t AS (SELECT quantile_cont(k, 0.95) AS t FROM (" + KNN.format(pairs=PAIRS.format(where="a.label >= 5 AND b.label >= 5 AND a.vec_id <> b.vec_id")) + ")) SELECT id, k <= t AS in_domain FROM (" + KNN.format(pairs=PAIRS.format(where="a.label < 5 AND b.label >= 5")) + "), t")
def domain_verdict(spark, d):
    v = _vectors(spark, d)
    return domain.assess(v.where("label < 5"), v.where("label >= 5"), use_leverage=False).select("id", "in_domain")


TWO = "SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"
LEVERAGE = f"t AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM ({TWO}) WHERE label >= 5), det AS (SELECT *, n * (xx * yy - xy * xy) - sx * (sx * yy - xy * sy) + sy * (sx * xy - xx * sy) AS d FROM t)"


@query(f"WITH {LEVERAGE}, h AS (SELECT id, n, ((xx * yy - xy * xy) + 2 * (sy * xy - sx * yy) * x + 2 * (sx * xy - sy * xx) * y + (n * yy - sy * sy) * x * x + 2 * (sx * sy - n * xy) * x * y + (n * xx - sx * sx) * y * y) / d AS h FROM ({TWO}), det WHERE label < 5) SELECT id, round(h, 6) AS leverage, h > 9 / n AS is_outside FROM h")
def leverage(spark, d):
    """Of two features, for which the inverse can be written out."""
    v = _vectors(spark, d).withColumn("features", F.slice("features", 1, 2))
    lev, limit = domain.leverage(v.where("label < 5"), v.where("label >= 5"))
    return lev.select("id", F.round("leverage", 6).alias("leverage"), (F.col("leverage") > limit).alias("is_outside"))


@query("WITH t AS (SELECT quantile_cont(k, 0.95) AS t FROM (" + KNN.format(pairs=PAIRS.format(where="a.label >= 5 AND b.label >= 5 AND a.vec_id <> b.vec_id")) + ")) SELECT count(*) AS n, round(avg((k <= t)::INT), 9) AS coverage FROM (" + KNN.format(pairs=PAIRS.format(where="a.label < 5 AND b.label >= 5")) + "), t")
def domain_coverage(spark, d):
    v = _vectors(spark, d)
    return domain.coverage(domain.assess(v.where("label < 5"), v.where("label >= 5"), use_leverage=False)).withColumn("coverage", F.round("coverage", 9))


SCAFFOLD = "SELECT p_partkey AS ix, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END AS scaffold FROM part"


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("ix"), F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.col("p_name")).alias("scaffold"))


@query(f"SELECT scaffold, count(*) AS n FROM ({SCAFFOLD}) GROUP BY 1")
def scaffold_groups(spark, d):
    return split.by_scaffold(_parts(spark, d))


@query(f"WITH g AS (SELECT scaffold, count(*) AS c FROM ({SCAFFOLD}) GROUP BY 1) SELECT sum(c)::BIGINT AS n, 0::BIGINT AS n_unparseable, coalesce(sum(c) FILTER (WHERE scaffold = ''), 0)::BIGINT AS n_acyclic, count(*) FILTER (WHERE scaffold <> '') AS n_scaffolds, round(max(c) FILTER (WHERE scaffold <> '') / sum(c)::DOUBLE, 9) AS largest_share, count(*) FILTER (WHERE scaffold <> '' AND c = 1) AS n_singletons, count(*) FILTER (WHERE scaffold <> '') < 10 AS few_scaffolds, max(c) FILTER (WHERE scaffold <> '') / sum(c)::DOUBLE > 0.5 AS dominated FROM g")
def scaffold_summary(spark, d):
    return split.diversity(_parts(spark, d)).withColumn("largest_share", F.round("largest_share", 9))


def _split_sql(order):
    return f"""WITH RECURSIVE p AS ({SCAFFOLD}), k AS (SELECT ix, CASE WHEN scaffold = '' THEN '<acyclic:' || ix || '>' ELSE scaffold END AS grp FROM p),
g AS (SELECT grp, count(*) AS size FROM k GROUP BY 1), o AS (SELECT grp, size, row_number() OVER (ORDER BY {order}) AS r FROM g), n AS (SELECT count(*)::DOUBLE AS n FROM k),
step(r, tr, te, grp, side) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, '', '' UNION ALL
  SELECT o.r, tr + CASE WHEN (1 - 0.2::DOUBLE - 0.0::DOUBLE) * n - tr > 0.2::DOUBLE * n - te THEN size ELSE 0 END, te + CASE WHEN (1 - 0.2::DOUBLE - 0.0::DOUBLE) * n - tr > 0.2::DOUBLE * n - te THEN 0 ELSE size END, o.grp, CASE WHEN (1 - 0.2::DOUBLE - 0.0::DOUBLE) * n - tr > 0.2::DOUBLE * n - te THEN 'train' ELSE 'test' END FROM step JOIN o ON o.r = step.r + 1, n)
SELECT ix, side AS partition FROM k JOIN step USING (grp)"""


@query(_split_sql("size DESC, grp"))
def scaffold_split(spark, d):
    return split.scaffold_split(_parts(spark, d)).select("ix", "partition")


SEEDED = " UNION ALL ".join(f"SELECT *, {k} AS repeat FROM ({_split_sql(f'substr(sha256({chr(39)}{k}:{chr(39)} || grp), 1, 16)')})" for k in range(5))


@query(SEEDED)
def repeated_splits(spark, d):
    return split.repeated(_parts(spark, d), 5).select("ix", "partition", "repeat")


@query(_split_sql("substr(sha256('7:' || grp), 1, 16)"))
def scaffold_split_seeded(spark, d):
    return split.scaffold_split(_parts(spark, d), seed=7).select("ix", "partition")


@query(f"SELECT scaffold, 2::BIGINT AS sides FROM ({SCAFFOLD}) WHERE scaffold <> '' GROUP BY scaffold HAVING count(DISTINCT ix % 2) > 1")
def split_leak_check(spark, d):
    return split.leaks(_parts(spark, d).withColumn("partition", F.when(F.col("ix") % 2 == 0, "train").otherwise("test")))


@query("SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_placed FROM part")
def split_coverage(spark, d):
    return split.coverage(split.scaffold_split(_parts(spark, d)))


@query("WITH r AS (SELECT p_partkey AS ix, row_number() OVER (ORDER BY ('0x' || substr(md5('3:' || p_partkey), 1, 8))::BIGINT, p_partkey) AS k, count(*) OVER () AS n FROM part) SELECT ix, CASE WHEN k <= greatest(1, round_even(0.2 * n, 0)) THEN 'test' ELSE 'train' END AS partition FROM r")
def random_split(spark, d):
    return split.random_split(_parts(spark, d), seed=3).select("ix", "partition")


TOL = {"price": 25.0, "size": 3.0, "kind": 0.0}
PROPS = "SELECT p_partkey AS id, p_retailprice AS price, p_size AS size, p_partkey % 4 AS kind, (p_partkey % 20 = 0)::INT AS label FROM part"
MATCH = f"p AS ({PROPS}), pairs AS (SELECT a.id AS active, c.id AS candidate, abs(a.price - c.price) / 25 + abs(a.size - c.size) / 3.0::DOUBLE AS distance FROM p a JOIN p c ON a.label = 1 AND c.label = 0 AND a.kind = c.kind WHERE abs(a.price - c.price) <= 25 AND abs(a.size - c.size) <= 3)"


def _props(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), (F.col("p_partkey") % 4).alias("kind"), (F.col("p_partkey") % 20 == 0).cast("int").alias("label"))


def _roles(spark, d):
    p = _props(spark, d)
    return p.where("label = 1"), p.where("label = 0")


@query(f"WITH {MATCH} SELECT active, count(*) AS n, round(min(distance), 6) AS closest FROM pairs GROUP BY 1")
def decoy_pairs(spark, d):
    return matching.closest_controls(*_roles(spark, d), TOL, "price").select("active", "n", F.round("closest", 6).alias("closest"))


@query(f"WITH {MATCH} SELECT active, candidate FROM pairs WHERE candidate NOT IN (SELECT id FROM p WHERE size > 30)")
def decoy_exclusion(spark, d):
    sim = _props(spark, d).select(F.col("id").alias("candidate"), (F.col("size") / 100.0).alias("similarity"))
    actives, candidates = _roles(spark, d)
    kept = matching.drop_similar(candidates.withColumnRenamed("id", "candidate"), sim, 0.30).withColumnRenamed("candidate", "id")
    return matching.tolerance_pairs(actives, kept, TOL, "price").select("active", "candidate")


CHOSEN = f"""WITH RECURSIVE {MATCH}, c AS (SELECT active, list({{'candidate': candidate, 'distance': round(distance, 9)}} ORDER BY round(distance, 9), candidate) AS cs FROM pairs GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY active) AS k FROM c),
step(k, taken, active, mine) AS (SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT, []::STRUCT(candidate BIGINT, distance DOUBLE)[] UNION ALL SELECT o.k, list_concat(taken, list_transform(list_filter(o.cs, lambda x: NOT list_contains(taken, x.candidate))[1:3], lambda x: x.candidate)), o.active, list_filter(o.cs, lambda x: NOT list_contains(taken, x.candidate))[1:3] FROM step JOIN o ON o.k = step.k + 1)
SELECT active, x.candidate AS candidate, x.distance AS distance FROM (SELECT active, unnest(mine) AS x FROM step WHERE k > 0)"""


@query(CHOSEN)
def decoy_select(spark, d):
    return matching.match(*_roles(spark, d), TOL, "price", 3, digits=9)


@query(f"SELECT property, round(gap, 6) AS gap FROM (SELECT 'price' AS property, avg(price) FILTER (WHERE label = 1) - avg(price) FILTER (WHERE label = 0) AS gap FROM ({PROPS}) UNION ALL SELECT 'size', avg(size) FILTER (WHERE label = 1) - avg(size) FILTER (WHERE label = 0) FROM ({PROPS}))")
def property_gap(spark, d):
    return matching.property_gap(_props(spark, d), ["price", "size"]).select("property", F.round("gap", 6).alias("gap"))


BALANCED = """WITH RECURSIVE s AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier), m AS (SELECT avg(v) AS m FROM s WHERE id % 3 = 0),
f AS (SELECT list({'id': id, 'v': v}) AS kept, greatest(2, floor(0.6::DOUBLE * count(*)))::BIGINT AS least FROM s WHERE id % 3 <> 0),
step(i, kept) AS (SELECT 0, kept FROM f UNION ALL SELECT i + 1, list_filter(kept, lambda x: x.id <> best.id) FROM (
  SELECT i, kept, n, t, m, least, abs(m - t / n) / 500 AS worst, list_min(list_transform(kept, lambda x: {'e': abs(m - (t - x.v) / (n - 1)) / 500, 'id': x.id})) AS best
  FROM (SELECT i, step.kept AS kept, len(step.kept) AS n, list_sum(list_transform(step.kept, lambda x: x.v)) AS t, m, least FROM step, m, f)) WHERE n > least AND worst > 1 AND best.e < worst)
SELECT unnest(kept).id AS id FROM step WHERE i = (SELECT max(i) FROM step)"""


@query(BALANCED)
def balance_selection(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("logp"))
    return matching.balance(s.where("id % 3 = 0"), s.where("id % 3 <> 0"), {"logp": 500.0}).select("id")


#: twenty named patterns of words that stand for features
NAMED = {f"f{i:02d}": w for i, w in enumerate("the and of to in is was for with on der die und de la le et que en los".split())}


def _counts(spark, d):
    docs = table(spark, d, "documents")
    words = F.split(F.lower("text"), r"\s+")
    hits = F.filter(words, lambda w: w.isin(list(NAMED.values())))
    uses = lambda v: F.size(F.filter("__h", lambda w: w == F.lit(v)))
    counts = F.map_from_entries(F.array(*[F.struct(F.lit(k), uses(v)) for k, v in NAMED.items()]))
    return docs.select("doc_id", "lang", hits.alias("__h")).select("doc_id", "lang", counts.alias("counts"))


WORDS = "w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x IN (" + ", ".join(f"'{w}'" for w in NAMED.values()) + ")) AS ws FROM documents), names(feature, word) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, w in NAMED.items()) + ")"
PREV = "SELECT feature, avg(CASE WHEN list_contains(ws, word) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, count(*) AS n FROM w, names WHERE {where} GROUP BY 1"


@query(f"WITH {WORDS} SELECT feature, round(p, 9) AS prevalence, n FROM (" + PREV.format(where="lang = 'fr'") + ")")
def feature_prevalence(spark, d):
    return features.prevalence(_counts(spark, d).where("lang = 'fr'"), list(NAMED)).withColumn("prevalence", F.round("prevalence", 9))


@query(f"WITH {WORDS}, a AS (" + PREV.format(where="lang = 'fr'") + "), b AS (" + PREV.format(where="lang <> 'fr'") + "), e AS (SELECT feature, a.p AS pa, b.p AS pb, CASE WHEN b.p > 0 THEN a.p / b.p WHEN a.p > 0 THEN 'inf'::DOUBLE END AS r, CASE WHEN a.p < 0.5 THEN NULL WHEN b.p <= 0 OR a.p / b.p >= 1.5 THEN 'conserved' ELSE 'ubiquitous' END AS kind FROM a JOIN b USING (feature)), x AS (SELECT max(least(r, 1000)) AS best FROM e WHERE kind = 'conserved') SELECT feature, kind, round(least(r, 1000), 6) AS ratio, coalesce(best >= 3, false) AS can_discriminate, coalesce(kind = 'conserved' AND best >= 3 AND least(r, 1000) >= best / 2, false) AS strong FROM e, x")
def feature_profile(spark, d):
    c = _counts(spark, d)
    p = features.profile(features.prevalence(c.where("lang = 'fr'"), list(NAMED)), features.prevalence(c.where("lang <> 'fr'"), list(NAMED)), 0.5)
    return p.select("feature", "kind", F.round(F.least("enrichment", F.lit(1000.0)), 6).alias("ratio"), "can_discriminate", "strong")


@query(f"WITH {WORDS} SELECT doc_id, len(list_filter(['de', 'la', 'le'], lambda x: list_contains(ws, x))) AS n_present, 3 - len(list_filter(['de', 'la', 'le'], lambda x: list_contains(ws, x))) AS n_missing, list_contains(ws, 'le') AS has_strong, len(list_filter(ws, lambda x: x = 'le')) > 1 AS duplicated FROM w")
def candidate_check(spark, d):
    name = {w: k for k, w in NAMED.items()}
    out = features.check(_counts(spark, d), [name["de"], name["la"], name["le"]], [name["le"]], True)
    return out.select("doc_id", F.size("present").cast("long").alias("n_present"), F.size("missing").cast("long").alias("n_missing"), (F.size("strong_present") > 0).alias("has_strong"), (F.size("duplicated") > 0).alias("duplicated"))


@query(f"WITH {WORDS}, c AS (SELECT len(list_filter(['de', 'la', 'le'], lambda x: list_contains(ws, x))) AS k, list_contains(ws, 'le') AS s, len(list_filter(ws, lambda x: x = 'le')) > 1 AS dup FROM w) SELECT count(*) AS n, count(*) FILTER (WHERE k > 0) AS n_retaining, count(*) FILTER (WHERE k = 0) AS n_flagged, count(*) FILTER (WHERE k > 0 AND NOT s) AS n_weak_only, count(*) FILTER (WHERE dup) AS n_duplicated FROM c")
def feature_screen_counts(spark, d):
    name = {w: k for k, w in NAMED.items()}
    return features.screen_counts(features.check(_counts(spark, d), [name["de"], name["la"], name["le"]], [name["le"]], True))


BEST = "coalesce(max(CASE WHEN b.p > 0 THEN a.p / b.p WHEN a.p > 0 THEN 1000 END) FILTER (WHERE a.p > 0 AND feature IN ({})), 0)"


def _both(names):
    return ", ".join(f"'{k}'" for k, w in NAMED.items() if w in names)


ANCHORS, PLAIN = ("de", "la", "le", "et", "les"), ("the", "and", "in", "on")


@query(f"WITH {WORDS}, a AS (" + PREV.format(where="lang = 'fr'") + "), b AS (" + PREV.format(where="lang <> 'fr'") + f"), x AS (SELECT {BEST.format(_both(ANCHORS))} AS anchor, {BEST.format(_both(PLAIN))} AS incidental FROM a JOIN b USING (feature)) SELECT round(anchor, 6) AS anchor, round(incidental, 6) AS incidental, CASE WHEN anchor >= 3 AND incidental < 3 THEN 'separates' WHEN anchor >= 3 THEN 'enriches everything' ELSE 'nothing stands out' END AS verdict FROM x")
def background_two_sided(spark, d):
    c = _counts(spark, d)
    p = features.profile(features.prevalence(c.where("lang = 'fr'"), list(NAMED)), features.prevalence(c.where("lang <> 'fr'"), list(NAMED)), 0.5)
    of = lambda ws: [k for k, w in NAMED.items() if w in ws]
    return features.two_sided(p, of(ANCHORS), of(PLAIN)).select(F.round("anchor", 6).alias("anchor"), F.round("incidental", 6).alias("incidental"), "verdict")


PICKED = CHOSEN.replace("SELECT active, x.candidate AS candidate, x.distance AS distance FROM (SELECT active, unnest(mine) AS x FROM step WHERE k > 0)", "SELECT (SELECT count(*) * 3 FROM p WHERE label = 1) AS n_wanted, count(*) AS n_found, round(avg(abs(a.price - c.price)), 6) AS price, round(avg(abs(a.size - c.size)), 6) AS size, count(*) >= 0.5 * (SELECT count(*) * 3 FROM p WHERE label = 1) AND avg(abs(a.price - c.price)) <= 25 AND avg(abs(a.size - c.size)) <= 3 AS adequate FROM (SELECT active, unnest(mine) AS x FROM step WHERE k > 0) y JOIN p a ON a.id = y.active JOIN p c ON c.id = y.x.candidate")


@query(PICKED)
def match_quality(spark, d):
    actives, candidates = _roles(spark, d)
    chosen = matching.match(actives, candidates, TOL, "price", 3, digits=9)
    q = matching.match_quality(cut(chosen), actives, candidates, TOL, 3)
    return q.select("n_wanted", "n_found", *[F.round(F.col("mean_gaps")[c], 6).alias(c) for c in ("price", "size")], "adequate")
