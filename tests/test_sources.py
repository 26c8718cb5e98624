"""The source layer offline, from a seeded response cache, and what is written."""

import json

import pytest
from pyspark.sql import functions as F

from veriflume import cli, session
from veriflume.operators import curate
from veriflume.sources import activities, paged, records

BASE = "http://service/api"


@pytest.fixture
def seeded(tmp_path):
    """A service of one protein with three activities, as its responses."""
    cache = paged.Cache(str(tmp_path / "cache"))
    one = {"targets": [{"target_chembl_id": "T1", "target_type": "SINGLE PROTEIN", "pref_name": "x"}, {"target_chembl_id": "T2", "target_type": "PROTEIN FAMILY"}], "page_meta": {"total_count": 2}}
    cache.put(f"{BASE}/target.json?target_components__accession=P1&limit=50&offset=0", one)
    cache.put(f"{BASE}/target.json?target_components__accession=P1&limit=2&offset=0", one)
    cache.put(f"{BASE}/target.json?target_components__accession=P2&limit=50&offset=0", {"targets": [], "page_meta": {"total_count": 0}})
    found = [
        {"activity_id": 1, "molecule_chembl_id": "M1", "canonical_smiles": "CCO", "standard_type": "IC50", "standard_value": "100", "standard_units": "nM", "standard_relation": "=", "assay_chembl_id": "A1", "potential_duplicate": 0, "pchembl_value": "7.0"},
        {"activity_id": 2, "molecule_chembl_id": "M2", "canonical_smiles": "CCN", "standard_type": "IC50", "standard_value": "not a number", "standard_units": "uM", "standard_relation": None, "assay_chembl_id": "A1", "potential_duplicate": 1},
        {"activity_id": 3, "molecule_chembl_id": "M1", "canonical_smiles": "CCO", "standard_type": "EC50", "standard_value": "1", "standard_units": "uM", "standard_relation": "=", "assay_chembl_id": "A9", "potential_duplicate": 0},
    ]
    answer = {"activities": found, "page_meta": {"total_count": 3}}
    for types, first in (("IC50,EC50", 1000), ("IC50,Ki", 1000), ("IC50,Ki", 8)):
        for size in (first, 3):
            cache.put(f"{BASE}/activity.json?target_chembl_id=T1&standard_type__in={types}&canonical_smiles__isnull=false&limit={size}&offset=0", answer)
    cache.put(f"{BASE}/assay.json?assay_chembl_id__in=A1,A9&limit=50&offset=0", {"assays": [{"assay_chembl_id": "A1", "assay_type": "B", "confidence_score": 5}, {"assay_chembl_id": "A1", "assay_type": "B", "confidence_score": 9}]})
    cache.put(f"{BASE}/status.json", {"chembl_release": "R_1"})
    return cache.folder


def test_fetch_records(spark, seeded):
    found, origin = activities.fetch_records(spark, BASE, "P1", ["IC50", "EC50"], cache=seeded, offline=True)
    got = {r["activity_id"]: r for r in found.collect()}
    assert [got[k]["confidence_score"] for k in "123"] == [9, 9, None] and got["2"]["value"] is None and got["2"]["potential_duplicate"] and got["2"]["relation"] == "="
    assert got["1"]["value"] == 100.0 and got["1"]["assay_type"] == "B" and got["1"]["pchembl_value"] == 7.0 and got["3"]["unit"] == "uM"
    o = origin.first()
    assert (o["n_activities"], o["n_assays"], o["n_missing_assays"], o["release"], o["target_id"]) == (3, 1, 1, "R_1", "T1")
    assert activities.release("http://other", seeded, True) is None
    rules = {r["activity_id"]: r["rule"] for r in curate.apply_rules(found).collect()}
    assert rules == {"1": None, "2": "potential_duplicate", "3": "low_target_confidence"}
    r = spark.range(1).select(*[activities.release_of(F.lit(json.dumps(p))).alias(n) for n, p in (("a", {"chembl_release": "x"}), ("b", {"chembl_db_version": "y", "chembl_release": "x"}), ("c", {}))]).first()
    assert tuple(r) == ("x", "y", None)


def test_background_scan_keeps_failures(spark, seeded):
    kept, failed = activities.scan_background(spark, BASE, {"one": "P1", "two": "P2", "three": "P3"}, 2, cache=seeded, offline=True)
    assert sorted((r["source"], r["molecule_id"]) for r in kept.collect()) == [("one", "M1"), ("one", "M2")]
    assert {r["source"] for r in failed.collect()} == {"two", "three"}
    again, lost = activities.scan_background(spark, BASE, {"one": "P1", "two": "P2", "three": "P3", "four": "P1"}, 2, cache=seeded, offline=True, parallel=3)
    assert sorted((r["source"], r["molecule_id"], r["seq"]) for r in again.collect()) == [("four", "M1", 0), ("four", "M2", 1), ("one", "M1", 0), ("one", "M2", 1)]
    assert {r["source"]: r["reason"].split(":")[0] for r in lost.collect()} == {"two": "no single-protein targets for P2", "three": "not in the cache, and offline"}


def test_pushed_filters_reach_the_address(spark, tmp_path):
    cache = paged.Cache(str(tmp_path))
    for size in (1000, 1):
        cache.put(f"{BASE}/x.json?kind__in=a,b&limit={size}&offset=0", {"rows": [{"id": 1, "kind": "a"}], "page_meta": {"total_count": 1}})
    df = paged.paged(spark, f"{BASE}/x.json", "id int, kind string", "rows", {"kind": "kind"}, cache=str(tmp_path), offline=True)
    assert [tuple(r) for r in df.where(F.col("kind").isin("a", "b")).select("id", "kind").collect()] == [(1, "a")]
    reader = paged.PushingReader(df.schema, {"key": "rows", "path": BASE, "push": "kind=kind"})
    other = paged.EqualTo(("id",), 1)
    assert list(reader.pushFilters([paged.EqualTo(("kind",), "a"), other, paged.IsNotNull(("kind",))])) == [other]
    assert reader.url(0, 5) == f"{BASE}?kind=a&kind__isnull=false&limit=5&offset=0"
    r = paged.cache_report(spark, str(tmp_path)).first()
    assert r["n_entries"] == 2 and r["n_bytes"] > 0


def test_pages_in_parallel(spark, tmp_path):
    cache = paged.Cache(str(tmp_path))
    for at, size in paged.pages(7, 7, 2):
        cache.put(f"{BASE}?limit={size}&offset={at}", {"rows": [{"id": at + k} for k in range(size)], "page_meta": {"total_count": 7}})
    for n in (1, 3):
        df = paged.paged(spark, BASE, "id int", "rows", limit=7, page=2, cache=str(tmp_path), offline=True, parallel=n)
        assert sorted(r["id"] for r in df.collect()) == list(range(7)) and df.rdd.getNumPartitions() == n


def test_search_is_a_request(spark, tmp_path):
    import urllib.parse

    terms = records.search_terms("P1", 2.0, 2)
    assert [n["parameters"]["value"] for n in terms["query"]["nodes"]] == ["P1", "UniProt", 2.0] and terms["request_options"]["paginate"]["rows"] == 2
    cache = paged.Cache(str(tmp_path))
    address = lambda a: f"{BASE}/search?{urllib.parse.urlencode({'json': json.dumps(records.search_terms(a, 2.0, 2), sort_keys=True, separators=(',', ':'))})}"
    cache.put(address("P1"), {"result_set": [{"identifier": "2ABC"}, {"identifier": "1XYZ"}, {"identifier": "9ZZZ"}]})
    cache.put(address("P2"), {"result_set": None})
    got = records.search_service(spark, f"{BASE}/search", ["P1", "P2", "P3"], 2.0, 2, str(tmp_path), True, 2).collect()
    assert sorted((r["accession"], r["rank"], r["structure_id"]) for r in got if r["reason"] is None) == [("P1", 0, "2ABC"), ("P1", 1, "1XYZ")]
    assert [(r["accession"], r["reason"].split(":")[0]) for r in got if r["reason"]] == [("P3", "not in the cache, and offline")]


def test_readers_share_one_interval():
    """Four readers in slots of their own never send two requests within an interval of each other."""
    sent = []
    for reader in range(4):
        clock = [0.0]
        pace = paged.Pace(reader, 4, 0.5, clock=lambda c=clock: c[0], sleep=lambda s, c=clock: c.__setitem__(0, c[0] + s))
        for k in range(6):
            pace.wait()
            sent.append(round(clock[0], 9))
            clock[0] += 0.3 if k % 2 else 0.0  # answers take time
    gaps = [b - a for a, b in zip(sorted(sent), sorted(sent)[1:])]
    assert len(sent) == 24 and min(gaps) > 0.499
    late = paged.Pace(0, 2, 1.0, clock=lambda: 100.0, sleep=lambda s: 1 / 0)
    late.next = 5.0
    late.wait()
    assert late.next == 102.0  # a slot that was missed is not made up for


def test_requests_are_counted(spark, tmp_path):
    cache = paged.Cache(str(tmp_path))
    for at, size in paged.pages(7, 7, 2):
        cache.put(f"{BASE}?limit={size}&offset={at}", {"rows": [{"id": at + k} for k in range(size)], "page_meta": {"total_count": 7}})
    df = paged.paged(spark, BASE, "id int, _request string", "rows", limit=7, page=2, cache=str(tmp_path), offline=True, parallel=2)
    assert tuple(paged.request_counts(df).first()) == (4, 4, 1.0)
    assert tuple(paged.request_counts(df.where("false")).first()) == (0, 0, None)
    mixed = spark.createDataFrame([("hit 0",), ("hit 0",), ("miss 2",), (None,)], "_request string")
    assert tuple(paged.request_counts(mixed).first()) == (2, 1, 0.5)
    cache.put(f"{BASE}/x?k=a,b&limit=50&offset=0", {"rows": [{"id": "a"}, {"id": "b"}]})
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "i string")
    got = paged.batched_lookup(ids, "i", f"{BASE}/x", "k", "rows", "id", "id string, _request string", cache=str(tmp_path), offline=True)
    assert {tuple(r) for r in got.collect()} == {("a", "hit 0"), ("b", "hit 0")}


def test_fetch_text(tmp_path):
    answers = iter([(500, ""), (200, "ATOM")])
    assert paged.fetch_text("http://x", str(tmp_path), "a.pdb", fetch=lambda u: next(answers), sleep=lambda s: None) == "ATOM"
    assert paged.fetch_text("http://x", str(tmp_path), "a.pdb", fetch=lambda u: 1 / 0) == "ATOM"
    with pytest.raises(paged.SourceError):
        paged.fetch_text("http://x", str(tmp_path), "b.pdb", fetch=lambda u: (404, ""), sleep=lambda s: None)


MOL = "x\n  y\n\n  3  2  0  0  0  0            999 V2000\n" + "".join(f"    0.0000    0.0000    0.0000 {e}   0  0\n" for e in "CCO") + "  1  2  1  0\n  2  3  1  0\nM  END"


def test_component_lookup_and_selection(spark, tmp_path):
    df = spark.createDataFrame([(MOL, None), ("bad", '{"smiles": "CCN"}'), (None, None)], "sdf string, doc string")
    got = [tuple(r["c"]) for r in df.select(records.component_smiles(F.col("sdf"), F.col("doc")).alias("c")).collect()]
    assert got == [("CCO", "structure file"), ("CCN", "descriptor"), (None, "none")]
    (tmp_path / "s.json").write_text(json.dumps({"selected": [{"id": "a"}, {"id": "b"}]}, indent=1))
    assert [r["id"] for r in records.read_selection(spark, str(tmp_path / "s.json")).collect()] == ["a", "b"]


@pytest.mark.parametrize("withheld, key", [(True, "candidates_unranked"), (False, "shortlist")])
def test_report_is_one_document(spark, tmp_path, withheld, key):
    df = spark.createDataFrame([(i, -0.1 * (i % 7), True) for i in range(80)], "seq long, ligand_efficiency double, kept boolean").withColumn("withheld", F.lit(withheld))
    assert records.write_report(df, str(tmp_path / "r"), receptor="1ABC") == key
    doc = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()))
    assert len(doc[key]) == 50 and doc["n_candidates"] == 80 and doc["receptor"] == "1ABC" and doc["triage_withheld"] == withheld
    e = [r["ligand_efficiency"] for r in doc[key]]
    assert (e == sorted(e)) != withheld


def test_scratch_is_deleted(spark, tmp_path):
    from pathlib import Path

    df = session.cut(spark.range(3).toDF("id"))
    folder = Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists() and df.count() == 3
    session.release(df)
    assert not folder.exists()
    other = session.cut(spark.range(2).toDF("id"))
    where = Path(other.inputFiles()[0].removeprefix("file:")).parent
    session.clear_scratch(spark)
    assert not where.exists()


def test_cli(spark, seeded, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build", lambda: spark)
    assert cli.main(["fetch", "P1", "--service", BASE, "--cache", seeded, "--offline", "--out", str(tmp_path / "out")]) == 0
    assert "3 measurements: 1 points from 1, 2 rejected" in capsys.readouterr().out
    rows = spark.read.csv(str(tmp_path / "out" / "points"), header=True).collect()
    assert [r["compound_id"] for r in rows] == ["M1"] and rows[0]["pactivity_label"] == "7.000 [derived]"
    tails = ["O", "N", "c1ccccc1", "C1CCCCC1", "c1ccncc1", "C1CCNCC1", "c1ccoc1", "C1CC1", "c1ccsc1"]
    points = [(f"C{i}", "C" * (1 + i % 7) + tails[i % 9], 5.0 + 0.2 * (i % 7) + 0.01 * i, None) for i in range(60)]
    spark.createDataFrame(points, "compound_id string, smiles string, pactivity double, uncertainty double").write.parquet(str(tmp_path / "points"))
    assert cli.main(["validate", str(tmp_path / "points"), "--resamples", "20"]) == 0
    out = capsys.readouterr().out
    assert "ridge, scaffold split" in out and "r2" in out and "CAUTION" in out and "20 permutations of the labels" in out and "defensible" in out
    assert cli.main(["curate", str(tmp_path / "none"), "x"][:0] + ["query", "unit_kinds", "/root/testdata/sf0.001"]) == 0
