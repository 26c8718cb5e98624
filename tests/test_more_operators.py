"""Backgrounds, matching, triage, models, generation and reports against loops and hand-made cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriflume.functions import molecules
from veriflume.functions import quantity as Q
from veriflume.operators import background, blocks, curate, domain, features, generation, guards, matching, modelling, ranking, reports, screening, structure, triage


def loop(rows, limit, excluded):
    """The rotation, one row at a time: what is taken, and the excluded and duplicate rows passed over."""
    queues = {}
    for s, q, m, smiles in sorted(rows, key=lambda r: (r[0], r[1])):
        queues.setdefault(s, []).append((q, m, smiles))
    at, taken, seen, n_x, n_d = dict.fromkeys(queues, 0), [], set(), 0, 0
    while len(taken) < limit:
        moved = False
        for s in sorted(queues):
            if len(taken) >= limit:
                break
            while at[s] < len(queues[s]):
                q, m, smiles = queues[s][at[s]]
                at[s] += 1
                if not smiles:
                    continue
                if m in excluded:
                    n_x += 1
                elif m in seen:
                    n_d += 1
                else:
                    seen.add(m)
                    taken.append((s, q, m))
                    moved = True
                    break
        if not moved:
            break
    return taken, n_x, n_d


@pytest.mark.parametrize("seed", range(4))
def test_rotation_with_shared_molecules(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{rng.randint(0, 3)}", i, f"m{rng.randint(0, 60)}", rng.choice(["C", "CC", ""])) for i in range(200)]
    excluded = {f"m{i}" for i in range(0, 60, 9)}
    df = spark.createDataFrame(rows, "source string, seq long, molecule_id string, smiles string")
    known = spark.createDataFrame([(m,) for m in excluded], "molecule_id string")
    limit = rng.choice([5, 20, 500])
    taken, n_x, n_d = loop(rows, limit, excluded)
    got = [(r["source"], r["seq"], r["molecule_id"]) for r in background.assemble(df, limit, known, smiles="smiles").orderBy("turn", "source").collect()]
    assert got == taken
    a = background.account(df, limit, known, smiles="smiles").first()
    assert (a["n"], a["n_excluded"], a["n_duplicates"]) == (len(taken), n_x, n_d) and sum(a["per_source"].values()) == len(taken)


def test_contributions_and_exclusion(spark):
    df = spark.createDataFrame([("a", "m1", "C", 1, None), ("a", "m1", "C", 2, None), ("a", "m2", "", 3, None), ("a", "m3", "C", 4, None), ("b", None, "C", 1, None), ("c", None, None, 0, "timeout")], "source string, molecule_id string, smiles string, seq long, error string")
    kept, failed = background.contributions(df, 5, ["a", "b", "c", "d"])
    assert sorted(r["molecule_id"] for r in kept.collect()) == ["m1", "m3"]
    assert {r["source"]: r["reason"] for r in failed.collect()} == {"b": "no activities with structures", "c": "timeout", "d": "no activities with structures"}
    rest, n = background.exclude(df, spark.createDataFrame([("m1",), (None,)], "molecule_id string"), "molecule_id")
    assert rest.count() == 4 and n.first()["n_excluded"] == 2


def test_permissive_policy_keeps_what_converts(spark):
    from test_operators import records_of

    cases = [({"smiles": " "}, "missing_structure"), ({"value": 1.0, "unit": "fM"}, "implausible_pactivity"), ({"confidence_score": None}, None), ({"assay_type": "A"}, None), ({"pchembl_value": 4.0}, None), ({"relation": ">"}, "censored_measurement"), ({"potential_duplicate": True, "activity_type": "Ki"}, None)]
    df = records_of(spark, *[c for c, _ in cases])
    assert [r["rule"] for r in curate.apply_rules(df, curate.PERMISSIVE).orderBy("seq").collect()] == [w for _, w in cases]
    loose = curate.CurationPolicy(exact_relation=False)
    assert curate.apply_rules(df, loose).where("seq = '0005'").first()["rule"] == "unconvertible_value"
    words = {r["seq"]: r["detail"] for r in curate.curate(df)[1].collect()}
    assert words["0005"] == "relation '>' is a bound, not a value" and words["0001"] == "pActivity 15.00 is not within 2.0 to 12.0" and words["0004"] == "pActivity 7.00, but 4.00 by the source"


def test_block_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (90, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    for k, own in ((1, False), (4, True)):
        got = {r["id"]: [(n["d"], n["ref"]) for n in r["near"]] for r in blocks.nearest(df, df, k, blocks.euclidean, exclude_self=own, size=20).collect()}
        for i in range(90):
            want = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(90) if not (own and i == j))[:k]
            assert [j for _, j in got[i]] == [j for _, j in want] and np.allclose([d for d, _ in got[i]], [d for d, _ in want])
    assert blocks.nearest(df.where("false"), df, 1, blocks.euclidean).count() == 0 == blocks.nearest(df, df.where("false"), 1, blocks.euclidean).count()


def test_tolerance_pairs_leave_missing_properties_out(spark):
    rng = random.Random(5)
    some = lambda v: None if rng.random() < 0.2 else v
    make = lambda n: [(i, some(float(rng.randint(0, 60))), some(float(rng.randint(0, 5))), some(float(rng.randint(0, 1)))) for i in range(n)]
    a, c = make(15), make(40)
    tol = {"w": 10.0, "l": 1.0, "q": 0.0}
    want = {}
    for i, *p in a:
        for j, *r in c:
            gaps = [(abs(x - y), t) for x, y, t in zip(p, r, tol.values()) if x is not None and y is not None]
            if all(g <= t for g, t in gaps):
                want[i, j] = sum(g / (t or 1.0) for g, t in gaps)
    df = lambda rows: spark.createDataFrame(rows, "id long, w double, l double, q double")
    got = {(r["active"], r["candidate"]): r["distance"] for r in matching.tolerance_pairs(df(a), df(c), tol, "w").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert matching.shared_properties(df(a), df(c)) == ["l", "q", "w"]


def test_match_quality(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 200.0)], "id long, molecular_weight double")
    c = spark.createDataFrame([(10, 110.0), (11, 190.0), (12, 0.0)], "id long, molecular_weight double")
    chosen = spark.createDataFrame([(1, 10), (2, 11)], "active long, candidate long")
    near = spark.createDataFrame([(10, 0.1), (11, 0.2), (12, 0.9)], "candidate long, similarity double")
    q = matching.match_quality(chosen, a, c, {"molecular_weight": 25.0}, 2, near).first()
    assert (q["n_wanted"], q["n_found"], q["mean_gaps"], q["max_similarity"], q["adequate"]) == (4, 2, {"molecular_weight": 10.0}, 0.2, True)
    assert q["unmet"] == {"actives left short": 2, "controls too alike, over 0.25": 1}
    assert "2 of 4 decoys" in reports.decoys(matching.match_quality(chosen, a, c, {"molecular_weight": 25.0}, 2, near))
    assert "WARNING" in reports.decoys(matching.match_quality(chosen, a, c, {"molecular_weight": 5.0}, 2))


def test_survivors(spark):
    rows = [(0, -0.3, True, False, {}), (1, -0.2, True, None, {}), (2, -0.5, True, True, {"amidine": 2}), (3, -0.1, True, True, None), (4, -0.9, False, True, {})]
    t = spark.createDataFrame(rows, "seq long, ligand_efficiency double, kept boolean, retains_strong_feature boolean, duplicated_motifs map<string,int>").withColumns({"withheld": F.lit(False), "n_distinguishable": F.lit(2), "threshold": F.lit(-0.1)})
    s = triage.survivors(t, True)
    assert {r["seq"]: r["set_aside"] for r in s.collect()} == {0: "no strong feature", 1: None, 2: "joined molecules", 3: None}
    assert [r["seq"] for r in triage.presented(s, False).collect()] == [1, 3]
    assert triage.survivors(t, False).where("set_aside IS NULL").count() == 3
    assert "1 set aside without a strong feature, 1 as joined molecules, 2 left" in reports.triage(triage.triage_counts(t, s))


def test_signature_of_any_size(spark, monkeypatch):
    values = [(i, None if i == 9 else f"v{i % 7}") for i in range(50)]
    want = hashlib.sha256("\n".join(v for _, v in values if v is not None).encode()).hexdigest()[:16]
    df = spark.createDataFrame(values, "k long, v string")
    for ranges in (32, 3):
        monkeypatch.setattr(triage, "RANGES", ranges)
        assert triage.signature(df, "v", "k").first()["signature"] == want == triage.signature(df.repartition(3), "v", "k").first()["signature"]
    assert triage.signature(df.where("false"), "v", "k").first()["signature"] == hashlib.sha256().hexdigest()[:16]


def training(spark, n=300):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, 4))
    y = 7 + 1.5 * x[:, 0] - 0.8 * x[:, 1] + 0.3 * x[:, 2] ** 2 + 0.1 * rng.standard_normal(n)
    return spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, features array<double>, label double")


def test_models(spark):
    t = training(spark)
    train, test = t.where("id % 4 > 0"), t.where("id % 4 = 0")
    forest = modelling.fit(train, "forest", trees=30)
    raw = {r["id"]: r["prediction"] for r in modelling.predict_raw(forest, test).collect()}
    trees = modelling._trees(forest, spark)
    assert len(trees) == 30
    got = {r["id"]: r for r in modelling.predict(forest, test).collect()}
    for i, r in got.items():
        q = r["predicted"]
        assert abs(q["value"] - raw[i]) < 1e-9 and q["uncertainty"] > 0 and q["origin"] == "predicted" and q["in_domain"] is not None and "forest" in q["source"]
    x = np.array([r["features"] for r in test.orderBy("id").collect()])
    each = []
    for feature, threshold, left, right, value in trees:
        out = []
        for row in x:
            at = 0
            while left[at] >= 0:
                at = left[at] if row[feature[at]] <= threshold[at] else right[at]
            out.append(value[at])
        each.append(out)
    ids = sorted(got)
    assert np.allclose([raw[i] for i in ids], np.mean(each, 0)) and np.allclose([got[i]["predicted"]["uncertainty"] for i in ids], np.std(each, 0))
    assert forest.importances(spark).first()["feature"] == "f0" and modelling.fit(train, "ridge").importances(spark) is None
    assert forest.card()["rows"] == 225 and forest.card()["label"]["name"] == "pActivity" and forest.notes == ()
    with pytest.raises(modelling.LabelError):
        modelling.predict_raw(forest, test, ("f1", "f0", "f2", "f3"))
    for bad in (train.limit(5), train.withColumn("label", F.lit(1.0)), train.withColumn("features", F.array(F.lit(float("nan"))))):
        with pytest.raises(modelling.LabelError):
            modelling.fit(bad, "ridge")
    assert modelling.fit(train.limit(20), "ridge").notes[0].startswith("only 20")


def test_baselines_and_evaluation(spark):
    t = training(spark)
    train, test = t.where("id % 4 > 0"), t.where("id % 4 = 0")
    closure = modelling.make_fit_predict("ridge", train, test)
    out = closure(train.select("id", "label"))
    b = modelling.baselines(train, test, fit_predict=closure, n_permutations=3).first()
    assert b["mean_r2"] < 0.01 and 0 < b["nn_r2"] < 1 and b["permutation_p95"] < 0.5 and b["n_permutations"] == 3
    metrics = ranking.evaluate(out.select(F.col("id").alias("seq"), F.col("label").alias("y"), F.col("prediction").alias("p")), 30)
    rows = {r["metric"]: r for r in metrics.collect()}
    assert rows["r2"]["low"] <= rows["r2"]["estimate"] <= rows["r2"]["high"] and rows["spearman"]["estimate"] > 0.8 and rows["r2"]["estimate"] > b["nn_r2"]
    text = reports.evaluation(metrics, 225, 75, "random split", ["f0 alone predicts the label"], ["beats the mean"])
    assert "r2 0." in text and "LEAKAGE: f0" in text and "beats the mean" in text
    with pytest.raises(ValueError):
        ranking.bootstrap(spark.createDataFrame([(0, 1.0, 1.0)], "seq long, y double, p double"), ranking.weighted_r2(), 10)
    flat = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "seq long, y double, p double")
    assert ranking.bootstrap(flat, ranking.weighted_r2(), 10).first()["low"] is None
    with pytest.raises(Exception, match="half of the resamples"):
        ranking.bootstrap(flat, ranking.weighted_r2(), 10, strict=True).collect()


def test_training_sets_refuse_bad_labels(spark):
    points = training(spark, 20).select("id", F.lit("C").alias("smiles"), "label", F.lit("measured").alias("origin"), F.lit(0.1).alias("uncertainty"))
    describe = lambda p: p.select("id", F.array(F.col("id").cast("double")).alias("features"))
    assert modelling.build_training_set(points, describe).count() == 20
    for bad, how in ((points.withColumn("origin", F.lit("predicted")), describe), (points.withColumn("label", F.lit(None).cast("double")), describe), (points, lambda p: describe(p).where("id > 3")), (points, lambda p: p.select("id", F.array(F.lit(float("inf"))).alias("features"))), (points.where("false"), describe)):
        with pytest.raises(modelling.LabelError):
            modelling.build_training_set(bad, how)


def test_candidates_are_scored(spark):
    t = training(spark)
    fitted = modelling.fit(t, "ridge")
    c = t.limit(5).select("id", F.lit("C").alias("smiles"))
    out, notes = modelling.score_candidates(fitted, c, lambda rows: rows.join(t.select("id", "features"), "id"))
    assert out.where("predicted.value IS NOT NULL").count() == 5 and notes
    ranked = generation.ranked(out.select(F.col("id").alias("seq"), F.col("predicted.value").alias("prediction"), Q.is_rankable(F.col("predicted")).alias("rankable")))
    p = [r["prediction"] for r in ranked.orderBy("rank").collect()]
    assert p == sorted(p, reverse=True)


def test_domain_reasons(spark):
    t = training(spark)
    far = spark.createDataFrame([(999, [50.0, 50.0, 50.0, 50.0])], "id long, features array<double>")
    sim = spark.createDataFrame([(999, 0.1)], "id long, similarity double")
    r = domain.assess(far, t, similarity=sim).first()
    assert not r["in_domain"] and len(r["reasons"]) == 3 and not r["methods_disagree"]
    assert domain.coverage(domain.assess(t, t)).first()["coverage"] > 0.8


def test_boxes_and_warnings(spark):
    rows = [("S", i, f"ATOM  {i:5d}  CA  ALA A{i:4d}    {i * 1.0:8.3f}{0.0:8.3f}{i % 3 * 2.0:8.3f}  1.00  0.00           C") for i in range(1, 40)]
    rows += [("S", 50 + i, f"HETATM{i:5d}  C1  LIG B   1    {i * 0.5:8.3f}{i * 1.0:8.3f}{i * 0.2:8.3f}  1.00  0.00           C") for i in range(9)]
    rows += [("S", 0, "EXPDTA    X-RAY DIFFRACTION"), ("S", 90, "ATOM     99  CB BALA A   1      xx.000   0.000   0.000"), ("N", 0, "HETATM    1  C1 ALIG B   1       1.000   2.000   3.000  1.00  0.00           C")]
    lines = spark.createDataFrame(rows, "structure_id string, line_no long, value string")
    w = {r["structure_id"]: r["warnings"] for r in structure.warnings(lines).collect()}
    assert w["S"] == ["1 coordinate lines cannot be read", "no resolution, though by X-ray"] and w["N"] == ["alternative positions A: the first is kept", "no protein atoms"]
    a = structure.atoms(lines)
    lig = structure.best_ligand(structure.ligands(a))
    box = structure.box_from_ligand(a, lig).first()
    assert box["n_atoms"] == 9 and box["derived_from"] == "ligand LIG" and any("only 9" in x for x in box["warnings"])
    assert structure.box_from_residues(a, [3, 4], "A").first()["warnings"][-1].startswith("nothing is said") and structure.box_from_residues(a, [999]).count() == 0
    assert "no evidence" in structure.blind_box(a).first()["warnings"][-1]
    text = {r["structure_id"]: r["text"].split("\n") for r in structure.structure_text(a).collect()}
    assert text["S"][-1] == "END" and len(text["S"]) == 49 and structure.atoms(spark.createDataFrame([("S", i, x) for i, x in enumerate(text["S"])], lines.schema)).count() == 48
    c = structure.alpha_carbons(a, "A")
    pairs = structure.paired(c.withColumn("key", F.col("key") + 7), c, -7)
    assert pairs.count() == 39 and structure.kabsch(pairs)[3] < 1e-5 and not structure.trusted_fit(0.1, 39) and structure.trusted_fit(0.1, 50)
    chains = structure.chains(a)
    assert structure.by_size(chains).where("structure_id = 'S'").first()["chain"] == "A" and structure.receptor_chains(chains).count() == 3
    states = {r["structure_id"]: r["state"] for r in guards.usable_structures(a, structure.ligands(a), chains).collect()}
    assert states == {"S": "usable", "N": "no ligand"}


def test_poses_and_redocking(spark):
    text = "MODEL 1\nATOM      1  C   LIG A   1       1.000   2.000   3.000  1.00  0.00     0.000 C \nATOM      2  H   LIG A   1       9.000   9.000   9.000  1.00  0.00     0.000 HD\nENDMDL\nMODEL 2\nATOM      1  C   LIG A   1       4.000   2.000   3.000  1.00  0.00     0.000 C \nENDMDL\n"
    p = spark.createDataFrame([(text,)], "t string").select(screening.poses(F.col("t")).alias("p")).first()["p"]
    assert [[tuple(x) for x in m] for m in p] == [[(1.0, 2.0, 3.0)], [(4.0, 2.0, 3.0)]]
    crystal = spark.createDataFrame([("L", 0, 1.0, 2.0, 3.0), ("M", 0, 0.0, 0.0, 0.0)], "ligand string, ix int, x double, y double, z double")
    poses = spark.createDataFrame([("L", 1, -9.0, [(2.0, 2.0, 3.0)], None), ("L", 2, -8.0, [(1.0, 2.0, 3.0)], None), ("M", 1, None, None, "engine unavailable")], "ligand string, rank int, score double, points array<struct<x: double, y: double, z: double>>, error string")
    got = {r["ligand"]: r for r in structure.redock(crystal, poses).collect()}
    assert got["L"]["rmsd"] == 1.0 and got["L"]["passed"] and got["M"]["rmsd"] is None and not got["M"]["passed"] and got["M"]["detail"] == "engine unavailable"


def test_screen_budget_and_toolchain(spark):
    lig = spark.createDataFrame([(i, "C", 1) for i in range(3)], "seq long, smiles string, label int").coalesce(1)
    out = screening.screen(lig, lambda s: (-5.0, 1, None), budget_seconds=-1.0)
    assert {r["reason"]: r["n"] for r in screening.failure_reasons(out).collect()} == {"not run": 3}
    assert {r["component"] for r in screening.toolchain(spark).collect()} == {"vina", "meeko", "obabel"}
    with pytest.raises(ValueError):
        screening.scored(out.withColumn("label", F.lit(None).cast("int")))
    ok = screening.screen(lig, lambda s: (-5.0, 1, None))
    assert screening.scored(ok).count() == 3 and "3 of 3 docked" in reports.screen(screening.accounting(ok), screening.failure_reasons(ok))


def test_features_of_a_screen(spark):
    active = spark.createDataFrame([({"amidine": 1, "aromatic_ring": 1},)] * 12, "counts map<string,int>")
    other = spark.createDataFrame([({"aromatic_ring": 1},)] * 30 + [({"amidine": 1},)], "counts map<string,int>")
    cand = spark.createDataFrame([({"amidine": 2},), ({"aromatic_ring": 1},), ({},), (None,)], "counts map<string,int>")
    profile, checked = features.screen(cand, active, other, molecules.FEATURES)
    c = features.screen_counts(checked).first()
    assert tuple(c) == (4, 1, 2, 0, 1) and "strongest: amidine" in reports.features(profile, features.screen_counts(checked))
    assert features.two_sided(profile, ["amidine"], ["aromatic_ring"]).first()["verdict"] == "separates"


@pytest.mark.parametrize("smiles", ["CCO", "CC(=O)Oc1ccccc1C(=O)O", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "O=c1c(O)c(-c2ccc(O)c(O)c2)oc2cc(O)cc(O)c12", "N#Cc1ccccc1-c1ccccc1", "C1CC2CCC1C2", "C[N+](C)(C)CC(=O)[O-]", "O=[N+]([O-])c1ccc(Cl)cc1", "c1nn[nH]n1", "C1CC1[C@H](F)Br"])
def test_written_structures_are_the_same(smiles):
    m, _ = molecules.parse(smiles)
    text = molecules.write(m, molecules.largest(m))
    again, error = molecules.parse(text)
    assert error is None and molecules.key(again, molecules.largest(again)) == molecules.key(m, molecules.largest(m))
    for fragment, _, ends in molecules.pieces(smiles):
        assert molecules.parse(fragment)[1] is None and molecules.parse(molecules.closed(fragment) or "C")[1] is None


def test_descriptors_by_hand():
    d = lambda s: dict(zip([c.split()[0] for c in molecules.STRUCT.split(", ")], molecules.describe(s)))
    aspirin = d("CC(=O)Oc1ccccc1C(=O)O")
    assert round(aspirin["tpsa"], 2) == 63.6 and aspirin["rotatable_bonds"] == 3 and aspirin["aromatic_rings"] == 1 and round(aspirin["fraction_csp3"], 3) == 0.111
    assert round(d("Cn1cnc2c1c(=O)n(C)c(=O)n2C")["tpsa"], 2) == 61.82 and d("CC(C)Cc1ccc(cc1)C(C)C(=O)O")["rotatable_bonds"] == 4
    assert d("C[C@H](N)C(=O)O")["stereocentres"] == 1 and d("CCO")["stereocentres"] == 0 and d("O=S")["tpsa"] is not None
    for s, want in (("CC(N)=N", "amidine"), ("NC(=N)N", "guanidine"), ("CS(=O)(=O)NC", "sulfonamide"), ("CC(O)C", "hydroxyethylene"), ("NC(=O)N", "urea"), ("c1ccncc1", "aminopyridine"), ("c1nn[nH]n1", "tetrazole"), ("c1ccc2ccccc2c1", "fused_aromatic"), ("CP(=O)(O)O", "phosphate"), ("CN(C)C", "tertiary_aliphatic_amine"), ("CNC", "secondary_aliphatic_amine"), ("Clc1ccccc1", "halogen_on_aromatic")):
        assert molecules.features(molecules.parse(s)[0])[want] >= 1, s
    assert set(molecules.FEATURES) >= set(molecules.features(molecules.parse("CC(=O)NC")[0])) == {"amide"}


def test_standardisation(spark):
    assert molecules.standardised("[Na+].[O-]C(=O)c1ccccc1")[:1] == molecules.standardised("OC(=O)c1ccccc1")[:1]
    got = molecules.standardised("C[NH3+].[Cl-]")
    assert got[0] == "CN" and got[3] and got[4] and molecules.standardised("bad(")[5]
    df = spark.createDataFrame([("CCO",), ("OCC",), (None,), ("C(",)], "smiles string")
    keys = [r["standard"] and r["standard"]["key"] for r in molecules.standardise_table(df).collect()]
    assert len(keys) == 4 and len({k for k in keys if k}) == 1
    row = df.withColumn("s", molecules.structure(F.col("smiles"))).select(molecules.combined_row(F.col("s")).alias("v")).collect()
    assert len(row[0]["v"]) == len(molecules.combined_names()) == 2060 and row[3]["v"] is None


def test_generation_orchestrated(spark):
    actives = spark.createDataFrame([("NC(=N)c1ccccc1",), ("CCc1ccccc1",), ("OCCc1ccncc1",)], "smiles string")
    policy = generation.GenerationPolicy(min_heavy_atoms=6, anchors=("amidine",), max_similarity_to_kept=2.0)
    out, report = generation.generate(actives, actives, policy)
    assert report["n_anchor_fragments"] == 1 and report["n_plain_fragments"] >= 4 and report["n_generated"] == sum(report["attrition"].values()) + report["n_kept"]
    kept = [r["smiles"] for r in out.where("drop_stage IS NULL").collect()]
    assert kept and all(molecules.anchors_of(s, ("amidine",)) == 1 for s in kept) and "already_known" in report["attrition"]
    assert "kept" in reports.generation(report, generation.audit(actives, policy))
    again, _ = generation.generate(actives, actives, policy)
    assert sorted(r["smiles"] for r in again.collect()) == sorted(r["smiles"] for r in out.collect())
    none, report = generation.generate(actives, actives, generation.GenerationPolicy(anchors=("phosphate",)))
    assert "unconstrained" in report["notes"][0]
    _, report = generation.generate(spark.createDataFrame([("CCO",)], "smiles string"), actives)
    assert "too few" in report["notes"][0] and "0 kept" in reports.generation(report)


def test_pinned_structures(spark):
    words = [0b1111, 0b1111, 0b11110000, 0b1110]
    df = spark.createDataFrame([(i, 25 if i else 99, 1.5, w) for i, w in enumerate(words)], "id long, heavy_atoms int, resolution double, word long").withColumn("bits", F.bit_count("word").cast("long"))
    assert sorted(r["id"] for r in generation.select_diverse(df).collect()) == [1, 2]
    assert sorted(r["id"] for r in generation.select_diverse(df, pinned=0).collect()) == [0, 2]


def test_quantity_notes_and_reports(spark):
    q = Q.with_notes(Q.quantity(F.lit(1.0), "derived", notes=F.array(F.lit("a"))), "b", "c")
    assert spark.range(1).select(q.alias("q")).first()["q"]["notes"] == ["a", "b", "c"]
    a = background.account(spark.createDataFrame([("s", 1, "m")], "source string, seq long, molecule_id string"), 10)
    assert "too few" in reports.background(a)
    text = reports.enrichment({"n_actives": 3, "n_decoys": 4, "auc": 0.6, "auc_low": 0.3, "auc_high": 0.9, "ef1": 2.0, "ef5": None, "max_ef1": 2.3, "bedroc": 0.5, "verdict": "inconclusive", "compounds_needed": 70, "gap_warning": "logp differs"})
    assert "about 70 compounds" in text and "[0.300, 0.900]" in text and "EF 5 % not defined" in text and "WARNING: logp differs" in text and "handful" in text
    assert "large enough" in reports.gaps(spark.createDataFrame([("logp", 3.0, True)], "property string, gap double, concerning boolean"))


def test_permutations_in_one_fit_equal_refits(spark):
    t = training(spark)
    train, test = t.where("id % 4 > 0"), t.where("id % 4 = 0")
    labels = {r["id"]: r["labels"] for r in modelling.permuted_labels(train, 3, 7).collect()}
    for k in range(3):
        one = {r["id"]: r["label"] for r in modelling.permuted(train.select("id", "label"), 7 + k).collect()}
        assert all(labels[i][k] == one[i] for i in one) and len(one) == len(labels)
    together = modelling.permuted_ridge_scores(train, test, 3, 7)
    apart = modelling.permutation_scores(modelling.make_fit_predict("ridge", train, test), train, 3, 7)
    assert np.allclose(together, apart, atol=1e-6)
    assert modelling.permuted_ridge_scores(train, test.withColumn("label", F.lit(2.0)), 2) == []


def test_evaluation_in_one_call(spark):
    t = training(spark)
    train, test = t.where("id % 4 > 0"), t.where("id % 4 = 0")
    out = modelling.predict_raw(modelling.fit(train, "ridge", with_domain=False), test)
    r = modelling.evaluate(train, test, out, fit_predict="ridge", resamples=60).first()
    assert (r["n_train"], r["n_test"], r["n_permutations"], r["leaking_features"], r["defensible"]) == (225, 75, 20, [], True)
    assert r["r2_low"] <= r["r2"] <= r["r2_high"] and r["spearman_low"] is not None and r["notes"] == [] and "beats the mean" in r["findings"]
    told = train.withColumn("features", F.concat("features", F.array(F.col("label") * 2)))
    same = test.withColumn("features", F.concat("features", F.array(F.col("label") * 2)))
    r = modelling.evaluate(told, same, modelling.predict_raw(modelling.fit(told, "ridge", with_domain=False), same), resamples=30, names=["a", "b", "c", "d", "twice"]).first()
    assert r["leaking_features"] == ["twice"] and not r["defensible"] and r["permutation_p95"] is None


def test_model_is_kept_with_its_domain(spark, tmp_path, monkeypatch):
    from pyspark.ml import Pipeline, PipelineModel

    from veriflume.operators import estimators

    t = training(spark)
    train, test = t.where("id % 4 > 0"), t.where("id % 4 = 0")
    for kind, settings in (("ridge", "{}"), ("forest", '{"trees": 20}')):
        made = estimators.ActivityRegressor(kind=kind, settings=settings, labelName="pIC50", names=["a", "b", "c", "d"]).fit(train)
        first = {r["id"]: (r["prediction"], r["predicted"]["in_domain"], r["predicted"]["source"]) for r in made.transform(test).collect()}
        made.write().overwrite().save(str(tmp_path / kind))
        fitted = []
        monkeypatch.setattr(domain, "knn_threshold", lambda *a, **b: fitted.append(1))
        back = estimators.ActivityModel.load(str(tmp_path / kind))
        again = {r["id"]: (r["prediction"], r["predicted"]["in_domain"], r["predicted"]["source"]) for r in back.transform(test).collect()}
        monkeypatch.undo()
        assert again == first and len(first) == 75 and back.uid == made.uid and not fitted  # the training rows' own distances are not taken again
        assert back.fitted.card() == made.fitted.card() and back.fitted.names == ("a", "b", "c", "d") and {v[1] for v in first.values()} >= {True}
    pipe = Pipeline(stages=[estimators.ActivityRegressor(kind="ridge")])
    pipe.write().overwrite().save(str(tmp_path / "pipe"))
    assert Pipeline.load(str(tmp_path / "pipe")).getStages()[0].getOrDefault("kind") == "ridge"
    pipe.fit(train).write().overwrite().save(str(tmp_path / "fitted"))
    assert PipelineModel.load(str(tmp_path / "fitted")).transform(test).count() == 75
    with pytest.raises(modelling.LabelError):
        modelling.predict(modelling.fit(train, "ridge", with_domain=False), test)


def test_groups_are_kept_apart(spark):
    rng = np.random.default_rng(3)
    a = [(i, f"g{i % 3}", *map(float, rng.normal(size=3) * 10)) for i in range(60)]
    b = [(100 + i, f"g{i % 2}", *map(float, rng.normal(size=3) * 10)) for i in range(50)] + [(900, None, 0.0, 0.0, 0.0)]
    schema = "ix long, grp string, x double, y double, z double"
    got = {r["grp"]: r["rmsd"] for r in structure.nearest_rmsd(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "grp").collect()}
    for g in ("g0", "g1"):
        d = [min(sum((p - q) ** 2 for p, q in zip(x[2:], y[2:])) for y in b if y[1] == g) for x in a if x[1] == g]
        assert abs(got[g] - (sum(d) / len(d)) ** 0.5) < 1e-9
    assert set(got) == {"g0", "g1"}


def test_rejections_keep_first_seen_order(spark):
    rows = spark.createDataFrame([(3, "b"), (1, "c"), (2, "a"), (4, "c"), (5, "b"), (9, "a")], "seq long, rule string")
    assert [tuple(r) for r in curate.summary(rows).collect()] == [("c", 2), ("a", 2), ("b", 2)]


def test_prevalence_counts_what_rows_have(spark):
    from veriflume.operators import features

    rows = spark.createDataFrame([({"a": 2, "b": 0},), ({"a": 1, "c": 5},), (None,), ({},)], "counts map<string,int>")
    assert {tuple(r) for r in features.prevalence(rows, ["a", "b", "z"]).collect()} == {("a", 2 / 3, 3), ("b", 0.0, 3), ("z", 0.0, 3)}
    assert {tuple(r) for r in features.prevalence(rows.where("false"), ["a"]).collect()} == {("a", 0.0, 0)}
