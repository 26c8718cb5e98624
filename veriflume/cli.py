"""python -m veriflume.cli COMMAND: fetch or curate measurements, validate a model of them, pool shards, compare two arms, or run queries."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions import molecules
from .operators import curate, modelling, reports, split, triage
from .session import build, cut
from .sources import activities, records


def validate(points, kind: str = "ridge", resamples: int = 200) -> str:
    """The report of a model of curated points (compound_id, smiles, pactivity, uncertainty) on scaffolds it has not seen."""
    rows = points.select(F.col("compound_id").alias("id"), "smiles", F.col("pactivity").alias("label"), F.lit("derived").alias("origin"), "uncertainty")
    made = rows.withColumn("s", molecules.structure(F.col("smiles")))
    made = made.withColumn("features", molecules.descriptor_row(F.col("s"))[0]).where("features IS NOT NULL").cache()
    data = modelling.build_training_set(made.select(*rows.columns), lambda _: made.select("id", "features"))
    data = data.join(made.select("id", F.col("s.scaffold").alias("scaffold")), "id")
    sides = split.scaffold_split(data, ix="id").cache()
    train, test = (sides.where(F.col("partition") == p) for p in ("train", "test"))
    names = tuple(molecules.AVAILABLE)
    out = cut(modelling.predict_raw(modelling.fit(train, kind, names, with_domain=False), test).select("id", "prediction"))
    refit = "ridge" if kind == "ridge" else modelling.make_fit_predict(kind, train, test)
    r = modelling.evaluate(train, test, out, list(names), refit, resamples=resamples).first()
    metrics = spark_rows(train, [(m, r[m], r[f"{m}_low"], r[f"{m}_high"]) for m in ("r2", "rmse", "mae", "spearman")])
    bar = [] if r["permutation_p95"] is None else [f"{r['n_permutations']} permutations of the labels score {r['permutation_mean']:.3f} on average, {r['permutation_p95']:.3f} at the 95th percentile"]
    leaks = [f"{n} alone gives the label away" for n in r["leaking_features"]]
    return reports.evaluation(metrics, r["n_train"], r["n_test"], f"{kind}, scaffold split", leaks, findings=[*r["findings"], *bar, "defensible" if r["defensible"] else "not defensible"])


def spark_rows(like, rows):
    return like.sparkSession.createDataFrame(rows, "metric string, estimate double, low double, high double")


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="veriflume", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("curate", help="Parquet of activity records to points and rejections")
    one.add_argument("records")
    one.add_argument("out")
    one.add_argument("--statistic", choices=["median", "mean"], default="median")
    one.add_argument("--max-spread", type=float, default=1.0)
    one.add_argument("--permissive", action="store_true")
    fetch = commands.add_parser("fetch", help="activities of a protein, curated, as CSV")
    fetch.add_argument("accession")
    fetch.add_argument("--service", required=True, help="address of the web service")
    fetch.add_argument("--activity-types", nargs="+", default=["IC50", "EC50"])
    fetch.add_argument("--max-records", type=int, default=8000)
    fetch.add_argument("--cache", help="folder of responses, shared by executors")
    fetch.add_argument("--offline", action="store_true")
    fetch.add_argument("--out", required=True)
    valid = commands.add_parser("validate", help="whether a model of curated points (Parquet) beats trivial baselines on unseen scaffolds")
    valid.add_argument("points")
    valid.add_argument("--model", choices=["forest", "boosting", "ridge"], default="ridge")
    valid.add_argument("--resamples", type=int, default=200)
    two = commands.add_parser("combine", help="pool shard files of one experiment and triage their candidates")
    two.add_argument("shards")
    two.add_argument("out")
    three = commands.add_parser("compare", help="five-number summaries of two arms' efficiencies")
    three.add_argument("arms", nargs=2)
    four = commands.add_parser("query", help="run a registered query")
    four.add_argument("name")
    four.add_argument("tables")
    args = top.parse_args(argv)
    spark = build()
    if args.command == "curate":
        df = spark.read.parquet(args.records)
        policy = curate.PERMISSIVE if args.permissive else curate.CurationPolicy()
        how = curate.AggregationPolicy(max_spread=args.max_spread, statistic=args.statistic)
        points, rejected = curate.curate(df, policy, how)
        points.write.mode("overwrite").parquet(f"{args.out}/points")
        rejected.write.mode("overwrite").parquet(f"{args.out}/rejections")
        curate.accounting(df, policy, how).show(truncate=False)
    elif args.command == "fetch":
        found, origin = activities.fetch_records(spark, args.service, args.accession, args.activity_types, args.max_records, args.cache, args.offline)
        found = found.cache()
        points, rejected = curate.curate(found)
        origin.show(truncate=False)
        print(reports.curation(curate.accounting(found), curate.summary(rejected)))
        if records.write_csv(curate.in_order(records.labelled_points(points)).coalesce(1), f"{args.out}/points"):
            records.write_csv(records.flatten_rejections(rejected), f"{args.out}/rejections")
    elif args.command == "validate":
        print(validate(spark.read.parquet(args.points), args.model, args.resamples))
    elif args.command == "combine":
        shards = records.read_shards(spark, args.shards)
        odd = triage.pool_problems(shards, [c for c in ("receptor_id", "box_signature", "ligand_signature", "curation_signature", "exhaustiveness") if c in shards.columns])
        if odd:
            raise SystemExit(f"refused: the shards differ in {', '.join(odd)}")
        reference = shards.select(F.explode("reference_efficiencies").alias("ligand_efficiency"))
        print(records.write_report(triage.by_efficiency(records.shard_candidates(shards), reference), args.out))
    elif args.command == "compare":
        both = None
        for name, path in zip("ab", args.arms):
            arm = records.shard_candidates(records.read_shards(spark, path)).select("ligand_efficiency").withColumn("arm", F.lit(name))
            both = arm if both is None else both.unionByName(arm)
        triage.five_numbers(both, "ligand_efficiency", "arm").show()
    else:
        from .catalog import QUERIES

        QUERIES[args.name](spark, args.tables).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
