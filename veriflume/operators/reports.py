"""Reports for readers: a few lines of text from tables of a row or a few. What was left out is always said."""

from __future__ import annotations

from pyspark.sql import DataFrame


def counts(df: DataFrame, name: str, n: str = "n") -> list[str]:
    """Lines of a small table of names and counts, the largest first."""
    rows = sorted(((r[n], str(r[name])) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    return [f"  {k:>8} {text}" for k, text in rows]


def curation(accounted: DataFrame, summary: DataFrame) -> str:
    """accounting() and summary() of a curation."""
    a = accounted.first()
    lines = [f"{a['n_input']} measurements: {a['n_points']} points from {a['n_kept_measurements']}, {a['n_rejected']} rejected"]
    lines += counts(summary, "rule")
    if not a["balanced"]:
        lines.append("  WARNING: some measurements are unaccounted for")
    if a["n_input"] and not a["n_points"]:
        lines.append("  WARNING: no points; look at the rules before taking it for a lack of data")
    return "\n".join(lines)


def generation(report: dict, audit: DataFrame | None = None) -> str:
    """The report of generate(), and the audit of its policy."""
    lines = [f"{report['n_fragments']} fragments, {report['n_generated']} structures, {report.get('n_kept', 0)} kept"]
    lines += [f"  {n:>8} {stage}" for stage, n in sorted(report["attrition"].items(), key=lambda x: (-x[1], x[0]))]
    if report["n_anchor_fragments"] or report["n_plain_fragments"]:
        lines.append(f"  anchored fragments {report['n_anchor_fragments']}, others {report['n_plain_fragments']}; repeated anchors {report['n_anchor_escapes']}, lost anchors {report['n_anchor_lost']}")
    lines += [f"  {note}" for note in report["notes"]]
    suspect = False
    if audit is not None:
        a = audit.first()
        suspect = bool(a["suspect"])
        if a["pass_rate"] is not None:
            lines.append(f"  the same filters pass {a['pass_rate']:.0%} of {a['n']} known actives" + (f"; most fail at {a['dominant_rule']}" if a["dominant_rule"] else ""))
    if report["n_generated"] and not report.get("n_kept"):
        lines.append("  WARNING: nothing was kept" + (", and the filters reject known actives too: they do not suit this target" if suspect else ""))
    elif report["n_generated"] and report["n_kept"] / report["n_generated"] < 0.01:
        lines.append("  under one in a hundred was kept")
    return "\n".join(lines)


def evaluation(metrics: DataFrame, n_train: int, n_test: int, split: str, warnings: list[str] = (), findings: list[str] = ()) -> str:
    """The rows of evaluate(), leakage warnings and what the baselines say."""
    rows = {r["metric"]: r for r in metrics.collect()}
    lines = [f"{split}: {n_train} training rows, {n_test} test rows"]
    for name in ("r2", "rmse", "mae", "spearman"):
        r = rows.get(name)
        if r is None or r["estimate"] is None:
            lines.append(f"  {name}: not defined")
        else:
            lines.append(f"  {name} {r['estimate']:.3f}" + (f" [{r['low']:.3f}, {r['high']:.3f}]" if r["low"] is not None else ", no interval"))
    if n_test < 30:
        lines.append(f"  CAUTION: {n_test} test rows say little")
    r2 = rows.get("r2")
    if r2 is not None and r2["low"] is not None and r2["high"] - r2["low"] > 0.3:
        lines.append(f"  CAUTION: the interval of r2 is {r2['high'] - r2['low']:.2f} wide")
    lines += [f"  LEAKAGE: {w}" for w in warnings]
    return "\n".join([*lines, *(f"  {f}" for f in findings)])


def enrichment(row) -> str:
    """The row of analyse_enrichment(): the area with its interval, enrichment factors, BEDROC, what the decoys' properties allow to say, the
    verdict, and how many compounds would settle an open question."""
    r = row.asDict() if hasattr(row, "asDict") else dict(row)
    known = lambda k, digits=2: "not defined" if r.get(k) is None else f"{r[k]:.{digits}f}"
    interval = f" [{r['auc_low']:.3f}, {r['auc_high']:.3f}]" if r.get("auc_low") is not None else ", no interval"
    lines = [f"{r['n_actives']} actives, {r['n_decoys']} decoys: AUC {known('auc', 3)}{interval}"]
    lines += [f"  EF 1 % {known('ef1')} of at most {known('max_ef1')}, EF 5 % {known('ef5')}, BEDROC {known('bedroc', 3)}"]
    if r.get("gap_warning"):
        lines.append(f"  WARNING: {r['gap_warning']}")
    said = {"separates": "the screen ranks actives before decoys", "does not separate": "the screen does not rank actives before decoys: a result, not a fault", "inconclusive": "the screen is too small to tell: this is no evidence either way"}
    lines.append(f"  {r['verdict']}: {said[r['verdict']]}")
    if r["verdict"] == "inconclusive" and r.get("compounds_needed"):
        lines.append(f"  about {r['compounds_needed']} compounds a group would settle it")
    if max(1, round(0.01 * (r["n_actives"] + r["n_decoys"]))) < 5:
        lines.append("  the first hundredth is a handful of compounds: its enrichment factor hangs on single ones")
    return "\n".join(lines)


def background(account: DataFrame, failed: DataFrame | None = None) -> str:
    a = account.first()
    lines = [f"{a['n']} background compounds of {len(a['per_source'])} sources; {a['n_excluded']} known on the target and {a['n_duplicates']} duplicates passed over"]
    lines += [f"  {n:>8} {k}" for k, n in sorted((a["per_family"] or a["per_source"]).items(), key=lambda x: (-x[1], x[0]))]
    lines += [f"  not read: {r['source']}: {r['reason']}" for r in (failed.collect() if failed is not None else [])]
    return "\n".join(lines if a["usable"] else [*lines, "  too few compounds or families to tell anything against"])


def decoys(quality: DataFrame) -> str:
    q = quality.first()
    lines = [f"{q['n_found']} of {q['n_wanted']} decoys; largest similarity to an active {q['max_similarity']:.3f}"]
    lines += [f"  {k}: mean difference {v:.2f}" for k, v in sorted(q["mean_gaps"].items())]
    lines += [f"  {n:>8} {k}" for k, n in sorted(q["unmet"].items(), key=lambda x: (-x[1], x[0]))]
    return "\n".join(lines if q["adequate"] else [*lines, "  WARNING: enrichment against these may be that of their properties"])


def gaps(property_gaps: DataFrame) -> str:
    rows = sorted(property_gaps.collect(), key=lambda r: r["property"])
    return "\n".join(["mean of actives less mean of decoys"] + [f"  {r['property']}: {r['gap']:+.2f}{'  large enough to tell them apart' * bool(r['concerning'])}" for r in rows])


def triage(counted: DataFrame) -> str:
    c = counted.first()
    if c["withheld"]:
        lines = [f"WITHHELD: none of {c['n_candidates']} candidates lies further from the threshold {c['threshold']:.3f} than the method's error; all are given, unranked"]
    else:
        lines = [f"{c['n_passing']} of {c['n_candidates']} candidates reach {c['threshold']:.3f}; {c['n_distinguishable']} by more than the method's error"]
    return "\n".join([*lines, f"  {c['n_no_strong_feature']} set aside without a strong feature, {c['n_joined']} as joined molecules, {c['n_survivors']} left"])


def features(profile: DataFrame, counted: DataFrame) -> str:
    c, strong = counted.first(), sorted(r["feature"] for r in profile.where("strong").collect())
    lines = [f"{c['n_retaining']} of {c['n']} candidates keep a conserved feature, {c['n_flagged']} none, {c['n_weak_only']} only weak ones, {c['n_duplicated']} a strong one twice"]
    return "\n".join([*lines, "  strongest: " + (", ".join(strong) or "none: the check is withheld")])


def screen(accounted: DataFrame, reasons: DataFrame) -> str:
    """accounting() and failure_reasons() of a screen."""
    rows = sorted(accounted.collect(), key=lambda r: str(r["label"]))
    lines = [f"label {r['label']}: {r['n'] - r['n_failed']} of {r['n']} docked" for r in rows]
    rates = [r["failure_rate"] for r in rows]
    return "\n".join([*lines, *counts(reasons, "reason"), *(["  WARNING: the groups fail unevenly"] if rates and max(rates) - min(rates) > 0.1 else [])])
