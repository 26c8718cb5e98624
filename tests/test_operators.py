"""Properties and hand-computed cases of the library's operators."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veriflume.functions import quantity as Q
from veriflume.functions import units
from veriflume.operators import background, curate, features, matching, ranking, screening, similarity, split, structure, triage
from veriflume.sources import paged, records

BASE = dict(activity_id="ACT1", seq="1", compound_id="C1", smiles="CCO", target_id="T1", activity_type="IC50", value=100.0, unit="nM", relation="=", assay_id="", assay_type="B", confidence_score=9, data_validity_comment=None, potential_duplicate=False, pchembl_value=None, molecular_weight=None)
SCHEMA = "activity_id string, seq string, compound_id string, smiles string, target_id string, activity_type string, value double, unit string, relation string, assay_id string, assay_type string, confidence_score int, data_validity_comment string, potential_duplicate boolean, pchembl_value double, molecular_weight double"


def records_of(spark, *changes):
    return spark.createDataFrame([tuple({**BASE, "activity_id": f"ACT{i}", "seq": f"{i:04d}", **c}.values()) for i, c in enumerate(changes)], SCHEMA)


CASES = [({}, None), ({"confidence_score": 5}, "low_target_confidence"), ({"confidence_score": None}, "low_target_confidence"), ({"assay_type": "A"}, "wrong_assay_type"), ({"assay_type": " b "}, None), ({"activity_type": "Ki"}, "incommensurable_endpoint"), ({"activity_type": "Inhibition"}, "incommensurable_endpoint"),
         ({"data_validity_comment": "Outside typical range"}, "source_flagged_invalid"), ({"potential_duplicate": True}, "potential_duplicate"), ({"relation": ">"}, "censored_measurement"), ({"relation": None}, None), ({"smiles": "  "}, "missing_structure"), ({"unit": "%"}, "unconvertible_value"),
         ({"value": 1.0, "unit": "fM"}, "implausible_pactivity"), ({"pchembl_value": 4.0}, "pchembl_disagreement"), ({"value": None}, "unconvertible_value"), ({"value": float("nan")}, "unconvertible_value"), ({"value": float("inf")}, "unconvertible_value")]


def test_rules_one_field_at_a_time(spark):
    got = {r["activity_id"]: r["rule"] for r in curate.apply_rules(records_of(spark, *[c for c, _ in CASES])).collect()}
    assert got == {f"ACT{i}": rule for i, (_, rule) in enumerate(CASES)}


def test_units(spark):
    cases = [(100.0, "nM", "IC50", 7.0), (100.0, " µM ", "IC50", 4.0), (100.0, "μM", "IC50", 4.0), (0.1, "uM", "IC50", 7.0), (6.5, "", "pIC50", 6.5), (0.0, "nM", "IC50", None), (-1.0, "nM", "IC50", None), (1.0, "mg/kg", "IC50", None), (1.0, "parsec", "IC50", None)]
    df = spark.createDataFrame(cases, "value double, unit string, kind string, want double")
    p, reason = units.pactivity(F.col("value"), F.col("unit"), F.col("kind"), F.lit("="), F.lit(None).cast("double"))
    for r in df.select("*", p.alias("p"), reason.alias("reason")).collect():
        assert (r["p"] is None) == (r["want"] is None) and (r["p"] is None) == (r["reason"] is not None)
        assert r["want"] is None or abs(r["p"] - r["want"]) < 1e-9
    heavy = spark.range(1).select(*[units.pactivity(F.lit(1.0), F.lit("g/L"), F.lit("IC50"), F.lit("="), F.lit(w))[0].alias(n) for n, w in (("a", 1000.0), ("b", -1.0))]).first()
    assert abs(heavy["a"] - 3) < 1e-9 and heavy["b"] is None


def test_accounting_and_order_independence(spark):
    changes = [c for c, _ in CASES] + [{"value": 100.0 * 10**k, "compound_id": "C2"} for k in (0, 2)]
    want = None
    for seed in range(3):
        rows = records_of(spark, *changes).collect()
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA)
        a = curate.accounting(df).first()
        assert a["balanced"] and a["n_input"] == len(changes)
        points, rejected = curate.curate(df)
        now = (sorted(map(str, points.collect())), sorted(map(str, rejected.collect())))
        assert want in (None, now)
        want = now
    assert any(r["rule"] == "irreconcilable_replicates" for r in rejected.collect())


@pytest.mark.parametrize("values, p, n", [((7.0, 7.2, 7.4), 7.2, 3), ((7.0, 7.1, 7.2, 7.9), 7.15, 4), ((8.0, 5.0), None, 2)])
def test_aggregation(spark, values, p, n):
    df = spark.createDataFrame([(f"{i}", f"a{i}", "C", "T", "IC50", "S", v) for i, v in enumerate(values)], "seq string, activity_id string, compound_id string, target_id string, activity_type string, smiles string, pactivity double")
    r = curate.aggregate(df).first()
    assert r["n_measurements"] == n and (r["rule"] == "irreconcilable_replicates") == (p is None)
    assert p is None or abs(r["pactivity"] - p) < 1e-9
    assert r["source_activity_ids"] == [f"a{i}" for i in range(n)]


def test_quantities(spark):
    q = Q.quantity(F.lit(1.5), "measured", F.lit("nM"), F.lit("lab"))
    r = spark.range(1).select(Q.label(q).alias("l"), Q.problem(Q.quantity(F.lit(1.0), "measured")).alias("p"), Q.problem(q).alias("ok"), Q.weakest(F.lit("measured"), F.lit("heuristic")).alias("w"), Q.map_value(q, F.lit(3.0), "predicted", F.lit("twice")).alias("m"), Q.from_json(Q.to_json(q)).alias("j")).first()
    assert r["l"] == "1.500 nM [measured]" and r["p"] == "measured without source" and r["ok"] is None and r["w"] == "heuristic"
    assert r["m"]["origin"] == "predicted" and r["m"]["source"] == "twice <- lab" and r["j"]["value"] == 1.5


def test_auc_ef_bedroc_by_hand(spark):
    make = lambda rows: spark.createDataFrame(rows, "seq long, label int, score double")
    perfect = make([(i, int(i < 5), float(i)) for i in range(20)])
    assert ranking.auc(perfect).first()["auc"] == 1.0
    assert ranking.auc(make([(i, int(i >= 15), float(i)) for i in range(20)])).first()["auc"] == 0.0
    assert ranking.auc(make([(i, i % 2, 1.0) for i in range(10)])).first()["auc"] == 0.5
    assert ranking.auc(make([(i, 1, 1.0) for i in range(3)])).first()["auc"] is None
    ef = ranking.enrichment_factor(perfect, 0.25).first()
    assert ef["hits"] == 5 and ef["ef"] == 4.0 and ef["max_ef"] == 4.0
    assert ranking.bedroc(perfect).first()["bedroc"] > 0.99


def test_split_is_disjoint_and_covers(spark):
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(2, 15))]
        for test in (0.1, 0.2, 0.3, 0.5):
            placed = split.assign(sorted(sizes, reverse=True), sum(sizes), test, 0.0)
            assert set(placed) == {"train", "test"}
    df = spark.createDataFrame([(i, s) for i, s in enumerate("a" * 40 + "b" * 25 + "c" * 20 + "d" * 15)], "ix long, scaffold string")
    out = split.scaffold_split(df, 0.25)
    assert split.leaks(out).count() == 0 and split.coverage(out).first()["n_placed"] == 100
    with pytest.raises(split.SplitError):
        split.scaffold_split(df.where("scaffold = 'a'"))


def one_by_one(sizes, test, validation, balanced=True):
    """The sides of groups in order, each decided by itself; None where a side cannot be filled."""
    n = sum(sizes)
    quota = {"test": test * n, "validation": validation * n, "train": (1 - test - validation) * n}
    live, filled, out = [p for p in quota if quota[p] > 0], dict.fromkeys(quota, 0), []
    for s in sizes:
        if balanced:
            side = max(live, key=lambda p: (quota[p] - filled[p], -quota[p], p))
        else:
            side = next((p for p in ("test", "validation") if quota[p] and filled[p] < quota[p]), "train")
        filled[side] += s
        out.append(side)
    for side in live:
        if not filled[side] and quota[side] >= 1:
            donor = max((p for p in live if p != side), key=out.count)
            if out.count(donor) < 2:
                return None
            i = min((i for i, p in enumerate(out) if p == donor), key=lambda i: abs(sizes[i] - quota[side]))
            filled[side], filled[donor], out[i] = sizes[i], filled[donor] - sizes[i], side
    return out if filled["test"] and filled["train"] else None


def test_runs_of_groups_are_arithmetic():
    rng = random.Random(9)
    for _ in range(400):
        test, validation, balanced = rng.choice([0.1, 0.2, 0.5]), rng.choice([0.0, 0.1, 0.3]), rng.random() < 0.8
        runs = sorted({rng.randint(1, 30): rng.randint(1, 60) for _ in range(rng.randint(1, 6))}.items(), reverse=True)
        sizes = [s for s, m in runs for _ in range(m)]
        state, got = split.Filling(split._quotas(sum(sizes), test, validation), balanced), []
        plan = [x for s, m in runs for x in state.run(s, m)]
        for many, turns in plan:
            got += [turns[i % len(turns)] for i in range(many)]
        again = split.Filling(split._quotas(sum(sizes), test, validation), balanced)
        want = []
        for s in sizes:
            want.append(again.next())
            again.put(want[-1], s)
        assert got == want and (state.filled, state.groups) == (again.filled, again.groups)
        assert len(plan) <= 8 * len(runs)


@pytest.mark.parametrize("seed", [None, 7])
def test_scaffold_split_against_a_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(split, "BLOCK", 6)
    rng, key = random.Random(2), lambda g: hashlib.sha256(f"{seed}:{g}".encode()).hexdigest()[:16]
    for sizes, test, validation, balanced in (([40, 25, 20, 15], 0.25, 0.0, True), ([rng.randint(1, 9) for _ in range(25)] + [1] * 20, 0.2, 0.1, True), ([50, 1, 1], 0.2, 0.2, True), ([3] * 14, 0.3, 0.3, False)):
        groups = {f"g{i:02d}": s for i, s in enumerate(sizes)}
        rows = [(g, i) for g, s in groups.items() for i in range(s)]
        df = spark.createDataFrame([(k, g) for k, (g, _) in enumerate(rows)] + [(9000 + i, "") for i in range(4)] + [(9999, None)], "ix long, scaffold string")
        groups |= {f"<acyclic:{9000 + i}>": 1 for i in range(4)}
        order = sorted(groups, key=(lambda g: (-groups[g], g)) if seed is None else key)
        want = one_by_one([groups[g] for g in order], test, validation, balanced)
        if want is None:
            with pytest.raises(split.SplitError):
                split.scaffold_split(df, test, validation, seed, balanced)
            continue
        side = dict(zip(order, want))
        got = split.scaffold_split(df, test, validation, seed, balanced).collect()
        assert {r["ix"]: r["partition"] for r in got} == {r["ix"]: side[r["scaffold"] or f"<acyclic:{r['ix']}>"] for r in got} and len(got) == len(rows) + 4
        if seed and validation == 0:
            for repeat in range(3):
                seeded = sorted(groups, key=lambda g: hashlib.sha256(f"{4 + repeat}:{g}".encode()).hexdigest()[:16])
                side = dict(zip(seeded, one_by_one([groups[g] for g in seeded], test, 0.0)))
                rows_ = split.repeated(df, 3, test, 4).where(f"repeat = {repeat}").collect()
                assert all(r["partition"] == side[r["scaffold"] or f"<acyclic:{r['ix']}>"] for r in rows_) and len(rows_) == len(got)


def test_scaffold_split_of_many_singletons(spark):
    df = spark.range(30_000).selectExpr("id AS ix", "IF(id % 3 = 0, concat('s', id % 600), '') AS scaffold")
    got = dict(split.scaffold_split(df, 0.2).groupBy("partition").count().collect())
    assert got == {"train": 24_000, "test": 6_000}


def test_diverse_subset_against_a_loop(spark):
    words = [random.Random(i).getrandbits(20) | random.Random(i // 3).getrandbits(20) for i in range(60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, word long").withColumn("bits", F.bit_count("word").cast("long"))
    kept: list[int] = []
    sim = lambda a, b: (a & b).bit_count() / (a | b).bit_count()
    for i, w in enumerate(words):
        if all(sim(w, words[j]) < 0.7 for j in kept):
            kept.append(i)
    assert sorted(r["id"] for r in similarity.diverse_subset(df, 0.7).collect()) == kept


def match_one_by_one(pairs, k):
    taken, out = set(), []
    for a in sorted({p[0] for p in pairs}):
        mine = sorted((d, c) for x, c, d in pairs if x == a and c not in taken)[:k]
        taken |= {c for _, c in mine}
        out += [(a, c) for _, c in mine]
    return sorted(out)


PAIRS = "active long, candidate long, distance double"


@pytest.mark.parametrize("cell", [500_000, 30, 5])
def test_greedy_match_against_a_loop(spark, cell):
    rng = random.Random(3)
    pairs = [(a, c, round(rng.random(), 1)) for a in range(12) for c in range(30) if rng.random() < 0.3]
    pairs += [(a, 5, 0.05) for a in range(20, 60)]  # many want one candidate
    got = matching.greedy_match(spark.createDataFrame(pairs, PAIRS), 2, cell)
    assert sorted((r["active"], r["candidate"]) for r in got.collect()) == match_one_by_one(pairs, 2)
    assert matching.greedy_match(spark.createDataFrame([], PAIRS)).count() == 0


@pytest.mark.parametrize("rows", [4_000_000, 10])
def test_match_and_counts_of_many_copies(spark, rows):
    """Kinds are compared, not copies; ties of distance over several kinds go by id, and missing properties are left out."""
    rng = random.Random(5)
    some = lambda: (rng.choice([100.0, 101.0, 110.0, 126.0]), rng.choice([1.0, 2.0, 4.0, None]), rng.choice([0, 1]))
    a, c = [(i, *some()) for i in range(60)], [(1_000 - 3 * i, *some()) for i in range(150)]
    tol = {"w": 25.0, "s": 2.0, "k": 0.0}
    gap = lambda x, y: [None if u is None or v is None else abs(u - v) for u, v in zip(x[1:], y[1:])]
    pairs = [(x[0], y[0], sum(0.0 if v is None else v / (t or 1.0) for v, t in zip(g, tol.values()))) for x in a for y in c for g in [gap(x, y)] if all(v is None or v <= t for v, t in zip(g, tol.values()))]
    df = lambda r: spark.createDataFrame(r, "id long, w double, s double, k int")
    assert sorted((r["active"], r["candidate"], r["distance"]) for r in matching.tolerance_pairs(df(a), df(c), tol, "w").collect()) == sorted(pairs)
    want = {x: (len(d), min(d)) for x in {p[0] for p in pairs} if (d := [p[2] for p in pairs if p[0] == x])}
    assert {r["active"]: (r["n"], r["closest"]) for r in matching.closest_controls(df(a), df(c), tol, "w").collect()} == want
    rounded = [(x, y, round(d, 1)) for x, y, d in pairs]
    got = matching.match(df(a), df(c), tol, "w", 2, digits=1, rows=rows)
    assert sorted((r["active"], r["candidate"]) for r in got.collect()) == match_one_by_one(rounded, 2)
    assert {(r["active"], r["candidate"], r["distance"]) for r in got.collect()} <= set(rounded)


def test_greedy_match_of_a_long_chain(spark):
    """Each active's second choice is the first one of the next: everything hangs on the first."""
    n = 5_000
    pairs = [(a, a, 0.1) for a in range(n)] + [(a, a + 1, 0.2) for a in range(n)]
    got = matching.greedy_match(spark.createDataFrame(pairs, PAIRS), 1)
    assert got.count() == n and got.where("active = candidate").count() == n
    got = matching.greedy_match(spark.createDataFrame([(a, c - 1 if c > a else c, d) for a, c, d in pairs if a] + [(0, 0, 0.1)], PAIRS), 1, 2_000)
    assert sorted((r["active"], r["candidate"]) for r in got.collect()) == match_one_by_one([(a, c - 1 if c > a else c, d) for a, c, d in pairs if a] + [(0, 0, 0.1)], 1)


def balance_one_by_one(actives, decoys, tolerances, min_keep=0.6):
    mean = {p: sum(r[p] for r in actives) / len(actives) for p in tolerances}
    left = list(decoys)
    floor = max(2, int(min_keep * len(left)))
    worst = lambda rows: max(abs(mean[p] - sum(r[p] or 0.0 for r in rows) / len(rows)) / t for p, t in tolerances.items())
    while len(left) > floor and worst(left) > 1:
        total = {p: sum(r[p] or 0.0 for r in left) for p in tolerances}
        e = {r["id"]: max(abs(mean[p] - (total[p] - r[p]) / (len(left) - 1)) / t for p, t in tolerances.items() if r[p] is not None) for r in left}
        best = min((round(v, 12), i) for i, v in e.items())
        if not best[0] < worst(left):
            break
        left = [r for r in left if r["id"] != best[1]]
    return sorted(r["id"] for r in left)


@pytest.mark.parametrize("frontier", [500, 20, 2])
def test_balance_against_a_loop(spark, frontier):
    rng = random.Random(6)
    row = lambda i, m: {"id": i, "logp": round(rng.gauss(m, 1), 3), "mw": round(rng.gauss(300 + 30 * m, 40), 1)}
    actives, decoys = [row(i, 0) for i in range(30)], [row(i, 0.9) for i in range(90)]
    schema, tolerances = "id long, logp double, mw double", {"logp": 0.5, "mw": 8.0}
    make = lambda rows: spark.createDataFrame([(r["id"], r["logp"], r["mw"]) for r in rows], schema)
    passes = []
    got = sorted(r["id"] for r in matching.balance(make(actives), make(decoys), tolerances, frontier=frontier, passes=passes).collect())
    assert got == balance_one_by_one(actives, decoys, tolerances) and 54 <= len(got) < 80
    assert len(passes) <= {500: 1, 20: 6, 2: 60}[frontier], passes
    decoys[3]["logp"] = None
    assert sorted(r["id"] for r in matching.balance(make(actives), make(decoys), tolerances, frontier=frontier).collect()) == balance_one_by_one(actives, decoys, tolerances)


def test_balance(spark):
    actives = spark.createDataFrame([(i, 10.0) for i in range(5)], "id long, logp double")
    decoys = spark.createDataFrame([(i, 10.0 if i < 6 else 20.0) for i in range(10)], "id long, logp double")
    passes = []
    assert sorted(r["id"] for r in matching.balance(actives, decoys, {"logp": 0.5}, passes=passes).collect()) == [0, 1, 2, 3, 4, 5] and passes == ["frontier"]


def test_background_turns_and_interleave(spark):
    df = spark.createDataFrame([("a", i, f"a{i}") for i in range(3)] + [("b", i, f"b{i}") for i in range(100)], "source string, seq long, molecule_id string")
    got = [r["source"] for r in background.assemble(df, 60).orderBy("turn", "source").collect()]
    assert got[:6] == ["a", "b"] * 3 and got.count("a") == 3
    lab = spark.createDataFrame([(i, int(i < 3)) for i in range(8)], "seq long, label int")
    assert [r["label"] for r in background.interleave(lab).orderBy("position").collect()] == [0, 1, 0, 1, 0, 1, 0, 0]


@pytest.mark.parametrize("scores, kept, withheld", [([-10.0, -8.0, -4.0, None], 3, True), ([-12.0, -8.0, -4.0, None], 1, False)])
def test_triage_withholds(spark, scores, kept, withheld):
    c = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "seq long, best_score double")
    ref = spark.createDataFrame([(-8.5,), (-8.0,)], "best_score double")
    out = triage.by_score(c, ref).collect()
    assert sum(r["kept"] for r in out) == kept and all(r["withheld"] == withheld for r in out)


def test_features_withheld_without_profile(spark):
    df = spark.createDataFrame([({"a": 2, "b": 1},), (None,)], "counts map<string,int>")
    out = features.check(df, ["a", "c"], ["a"], True).collect()
    assert out[0]["present"] == ["a"] and out[0]["missing"] == ["c"] and out[0]["duplicated"] == {"a": 2} and out[1]["error"]
    assert features.check(df, ["a"], [], False).first()["present"] == []


def test_structures(spark):
    rows = [("S", 1, "ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N"), ("S", 2, "HETATM    2  C1  LIG B   2       1.000   2.000   3.000  1.00  0.00           C"), ("S", 3, "ATOM      3  H   ALA A   1      11.104   6.134  -6.504  1.00  0.00           H"), ("S", 4, "ATOM      4  CA BALA A   1      x1.104   6.134  -6.504"), ("S", 5, "MODEL        2")]
    lines = spark.createDataFrame(rows, "structure_id string, line_no long, value string")
    atoms = structure.atoms(lines)
    got = atoms.orderBy("line_no").collect()
    assert [r["name"] for r in got] == ["N", "C1"] and got[0]["x"] == 11.104 and got[1]["is_hetatm"]
    assert structure.malformed(lines).first()["n_malformed"] == 1
    assert atoms.orderBy("line_no").select(structure.format_atom().alias("v")).first()["v"].startswith(rows[0][2][:66])
    cube = spark.createDataFrame([(i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)], "ix long, x double, y double, z double")
    pairs = cube.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), (-F.col("y") + 3).alias("bx"), F.col("x").alias("by"), (F.col("z") - 1).alias("bz"))
    rotation, a, b, residual, n = structure.kabsch(pairs)
    assert residual < 1e-6 and n == 8
    assert structure.rmsd(cube, cube).first()["rmsd"] == 0.0
    mirrored = pairs.withColumn("bz", -F.col("bz")).withColumn("bx", F.col("bx") + F.col("az") * F.col("ax"))
    assert structure.kabsch(mirrored)[3] > 0.1


def test_screening(spark):
    lig = spark.createDataFrame([(0, "C", 1), (1, "CC", 0)], "seq long, smiles string, label int")
    out = screening.screen(lig, screening.missing_engine)
    assert screening.failure_reasons(out).first()["reason"] == "engine unavailable"
    assert screening.budget_prefix(spark.createDataFrame([(i, 10.0) for i in range(5)], "seq long, elapsed double"), 20.0).count() == 3


def test_paged_source(spark, tmp_path):
    assert paged.pages(2500, 10_000) == [(0, 1000), (1000, 1000), (2000, 500)]
    cache = paged.Cache(str(tmp_path))
    calls = []
    answers = iter([(500, ""), (200, "<html>"), (200, '{"rows": [1]}')])
    got = paged.get("http://x", cache, fetch=lambda u: (calls.append(u), next(answers))[1], sleep=lambda s: None)
    assert got == {"rows": [1]} and len(calls) == 3 and paged.get("http://x", cache, offline=True) == got
    with pytest.raises(paged.SourceError):
        paged.get("http://y", cache, offline=True)
    base = "http://service/rows"
    for at, size in paged.pages(5, 5, 2):
        cache.put(f"{base}?limit={size}&offset={at}", {"rows": [{"id": at + k, "name": f"n{at + k}"} for k in range(size)], "page_meta": {"total_count": 5}})
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").schema("id int, name string").options(key="rows", limit="5", page="2", cache=str(tmp_path), offline="true").load(base)
    assert sorted(r["id"] for r in df.collect()) == [0, 1, 2, 3, 4]


def test_target_resolution_and_sinks(spark, tmp_path):
    t = spark.createDataFrame([("T1", "SINGLE PROTEIN", ["P1"]), ("T2", "PROTEIN FAMILY", ["P1"])], "target_id string, target_type string, accessions array<string>")
    assert records.resolve_target(t, "P1") == "T1"
    with pytest.raises(records.TargetError):
        records.resolve_target(t, "P2")
    assert not records.write_csv(t.where("false").select("target_id"), str(tmp_path / "none"))
    assert records.write_csv(t.select("target_id"), str(tmp_path / "some"))


def test_streaming(spark, tmp_path):
    from veriflume.streaming import running

    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "rule string, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rule string, v int").parquet(str(tmp_path / "in"))
    q = running.attrition(stream).writeStream.outputMode("complete").format("memory").queryName("attrition").start()
    q.processAllAvailable()
    q.stop()
    assert {r["rule"]: r["n"] for r in spark.table("attrition").collect()} == {"a": 2, "b": 1}


def test_streams_beside_attrition(spark, tmp_path):
    from veriflume.streaming import running

    spark.createDataFrame([("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:01:00"), ("b", 2, "2024-01-01 00:02:00"), ("b", 5, "2024-01-01 00:12:00")], "k string, v int, t string").selectExpr("k", "v", "CAST(t AS timestamp) AS t").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, v int, t timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("seen", running.first_seen(stream(), "k", "t"), "append"), ("windows", running.windowed(stream(), "t", "v", "k"), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["k"] for r in spark.table("seen").collect()) == ["a", "b"]
    assert sorted((r["k"], r["n"], r["total"]) for r in spark.table("windows").collect()) == [("a", 2, 2), ("b", 1, 2), ("b", 1, 5)]
    sink, one = running.pooled(str(tmp_path / "pool")), spark.createDataFrame([("s1", 1)], "signature string, v int")
    sink(one, 0)
    sink(one, 1)
    assert spark.read.parquet(str(tmp_path / "pool")).count() == 2
    with pytest.raises(ValueError):
        sink(spark.createDataFrame([("s2", 1)], "signature string, v int"), 2)


def test_rows_for_files(spark):
    df = records_of(spark, {}, {"relation": ">"})
    assert records.flatten_records(df).columns[:3] == ["activity_id", "compound_id", "target_id"]
    points, rejected = curate.curate(df)
    assert [tuple(r) for r in records.flatten_rejections(rejected).collect()] == [("ACT1", "C1", "T1", "censored_measurement", "relation '>' is a bound, not a value")]
    r = records.labelled_points(points).first()
    assert (r["pactivity_label"], r["origin"], r["spread_log_units"], r["activity_types"]) == ("7.000 [derived]", "derived", None, "IC50")
    assert curate.in_order(points).count() == 1 and curate.potency(points, 8.0).count() == 0 == curate.potency(points, None, 6.0).count()


def test_bounds_of_potency_and_citation(spark):
    df = spark.createDataFrame([("a", 8.0), ("b", 5.5), ("c", 8.0), ("d", None)], "compound_id string, pactivity double")
    assert sorted(r[0] for r in curate.potency(df, curate.ACTIVE_FROM).collect()) == ["a", "c"] and curate.potency(df, None, curate.DECOY_TO).count() == 1
    assert [r[0] for r in curate.most_potent(df, 2).collect()] == ["a", "c"]
    c = spark.range(1).select(units.citation(F.lit(""), F.lit("A1"), F.lit(None).cast("string")).alias("c")).first()["c"]
    assert c == "unknown-activity / assay A1"
    q = units.converted(records_of(spark, {}, {"unit": "%"}), keep_steps=True).select(units.as_quantity(F.lit("src")).alias("q")).collect()
    assert q[0]["q"]["source"] == "src: -log10 of 1.000e-07 M" and q[0]["q"]["notes"] == ["type IC50", "from 100.0 nM"] and q[1]["q"]["value"] is None and q[1]["q"]["source"] == "src: unit '%' is no concentration"
