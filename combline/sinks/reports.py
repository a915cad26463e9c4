"""Documents and text reports of an analysis. They are for people: only result rows of colonies, regions and events are collected."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from combline.operators import scoring, steps
from combline.plans.analysis import Analysis

_EPOCH = datetime(1970, 1, 1)


def local_time(wall: int | None, sep: str = "T") -> str | None:
    """Seconds of a wall clock in words."""
    return None if wall is None else (_EPOCH + timedelta(seconds=int(wall))).isoformat(sep)


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _by(rows: list[dict], key: str) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def run_metadata(a: Analysis) -> dict[str, Any]:
    """Counts and the span of one run; silent colonies are listed apart and do not count as compared."""
    span = a.readings.agg(F.min("wall").alias("a"), F.max("wall").alias("z"), F.count(F.lit(1)).alias("n")).first()
    q = a.flags.agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("flag") == "excluded").alias("excluded")).first()
    f = a.features.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("region_id").alias("r"), F.min("days_observed").alias("lo"), F.max("days_observed").alias("hi"), F.sum("weight_event_count").alias("e"), F.count_if(F.col("weight_event_count") > 0).alias("c")).first()
    return {
        "window_days": a.cfg["window.rolling_window_days"], "start_at": local_time(span["a"]), "end_at": local_time(span["z"]), "sensor_reading_count": span["n"], "valid_sensor_reading_count": span["n"] - q["excluded"],
        "excluded_sensor_reading_count": q["excluded"], "data_quality_issue_count": q["issues"], "colony_count": f["n"], "region_count": f["r"], "region_radius_miles": a.cfg["regions.region_radius_miles"],
        "min_colony_days_observed": round(f["lo"] or 0, 2), "max_colony_days_observed": round(f["hi"] or 0, 2), "weight_event_count": f["e"] or 0, "colonies_with_weight_events": f["c"], "not_reporting_colony_count": a.gaps.count(),
    }


def colony_rows(a: Analysis) -> list[dict[str, Any]]:
    """Per colony: score, status, features, comparisons from worst to best, events from newest to oldest, and flags in words."""
    labels = {m.name: (m.label, m.unit) for m in a.cfg.metrics()}
    compared = _by(_rows(a.comparisons), "colony_id")
    events = _by(_rows(a.events.withColumn("text", steps.described(a.events))), "colony_id")
    # the report shows two: the first by emission
    first = Window.partitionBy("colony_id").orderBy("seq", "flag")
    notes = _by(_rows(a.flags.withColumn("k", F.row_number().over(first)).where("k <= 2").select("colony_id", "k", "ord", "day", "flag", "what")), "colony_id")
    out = []
    for r in sorted(_rows(a.standing), key=lambda r: (r["region_id"], -r["score"], r["colony_id"])):
        c = sorted(compared.get(r["colony_id"], []), key=lambda x: (-x["badness_z"], x["ord"]))
        for x in c:
            x["label"], x["unit"] = labels[x["metric"]]
        e = sorted(events.get(r["colony_id"], []), key=lambda x: -x["wall"])
        flags = [x["text"] for x in reversed(e)]
        if (r.get("weight_pct_change") or 0.0) <= -a.cfg["status.weight_drop_pct_threshold"]:
            flags.append(f"Weight dropped {abs(r['weight_pct_change']):.1f}% during the window.")
        in_order = sorted(c, key=lambda x: x["ord"])
        flags += [f"{x['label']} is {x['badness_z']:.1f} standard deviations worse than peers." for x in in_order if x["badness_z"] >= a.cfg["status.zscore_badness_threshold"]]
        flags += [f"Low confidence: {x['label']} compared against only {x['peer_count']} eligible peers (z-score bounded at ±{x['z_bound']:.1f})." for x in [x for x in in_order if x["confidence"] == "low"][:2]]
        if r.get("excluded_reading_count"):
            flags.append(f"Excluded {r['excluded_reading_count']} sensor readings due to data quality checks.")
        flags += [f"Data quality: {n['flag']} on {n['day']}: {n['what']}" for n in sorted(notes.get(r["colony_id"], []), key=lambda n: n["k"])]
        if r["silent"]:
            gap = r["reporting_gap_days"]
            flags.insert(0, "Not reporting: no sensor readings at all in the cached history." if gap is None else f"Not reporting: no sensor readings for {gap:.1f} days.")
        out.append(r | {"comparisons": c, "weight_events": [_event(x) for x in e], "flags": flags})
    return out


def _event(x: dict) -> dict[str, Any]:
    return {"kind": x["kind"], "observed_at": local_time(x["wall"]), "delta_kg": round(x["delta"], 3), "pct_change": round(x["pct"], 1), "before_kg": round(x["before"], 3), "after_kg": round(x["after"], 3), "corroborated": x["corroborated"]}


def event_row(e: dict[str, Any]) -> str:
    """One event as a line of a table."""
    name = "[corroborated]" if e["corroborated"] else "[isolated]"
    return f"     {e['observed_at'].replace('T', ' ')[:16]}  {e['kind']:<12}  {f'{e["delta_kg"]:+.3f} kg':>11}  {f'({e["pct_change"]:+.1f}%)':>8}  {e['before_kg']:.3f} → {e['after_kg']:.3f} kg  {name}"


def region_rows(colonies: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Per region: sites, counts by status, who stands out, and a sentence."""
    out = []
    for region, rows in sorted(_by(colonies, "region_id").items()):
        pick = lambda s, best=False: sorted((r for r in rows if r["status"] == s), key=lambda r: (r["score"] if best else -r["score"], r["colony_id"]))  # noqa: B023, E731
        good, watch, bad = pick("normal", True)[:2], pick("watch"), pick("underperforming")
        names = lambda x: ", ".join(r["colony_id"] for r in x)
        tail = f"The main underperformers are {names(bad)}." if bad else f"Watch colonies are {names(watch)}." if watch else "No colony is currently underperforming in this region."
        sites = sorted({r["hive_id"] for r in rows})
        out.append({"region_id": region, "site_ids": sites, "site_count": len(sites), "colony_count": len(rows), "normal_count": len(pick("normal")), "watch_count": len(watch), "underperforming_count": len(bad),
                    "performing_well_colonies": good, "watch_colonies": watch, "underperforming_colonies": bad, "summary": f"In region {region}, the strongest colonies are {names(good) or 'no clear leaders yet'}. {tail}"})
    return out


_SHORT = ("colony_id", "hive_id", "colony_side", "score", "status")


def scoring_json(a: Analysis) -> str:
    colonies = colony_rows(a)
    regions = [{k: [{n: r[n] for n in _SHORT} for r in v] if k.endswith("_colonies") else v for k, v in g.items()} for g in region_rows(colonies)]
    return json.dumps({"metadata": run_metadata(a), "regions": regions, "colonies": colonies}, indent=2, default=str)


def _unit(u: str) -> str:
    return f" {u}" if u else ""


def scoring_text(a: Analysis) -> str:
    m, colonies = run_metadata(a), colony_rows(a)
    regions = region_rows(colonies)
    lines = [
        "Regional colony scores", "======================", f"Window: {m['start_at']} to {m['end_at']} ({m['window_days']} days)", f"Regions compared: {m['region_count']}", f"Colonies compared: {m['colony_count']}",
        f"Sensor coverage per colony: {m['min_colony_days_observed']} to {m['max_colony_days_observed']} days",
        f"Valid sensor readings: {m['valid_sensor_reading_count']} of {m['sensor_reading_count']} ({m['excluded_sensor_reading_count']} excluded, {m['data_quality_issue_count']} quality notes)",
    ]
    late = sorted((r for r in colonies if r["reporting_gap_days"] is not None), key=lambda r: (-r["reporting_gap_days"], r["colony_id"]))
    if late:
        lines.append("NOT REPORTING: " + ", ".join(f"{r['colony_id']} ({r['reporting_gap_days']:.1f} days silent)" for r in late))
    lines.append("")
    if not colonies:
        return "\n".join([*lines, "No colony scores available."])
    calm = all(r["status"] == "normal" for r in colonies)
    lines += ["No colony is currently underperforming relative to its regional peer group." if calm else "Colonies are scored within their regions. Regional highlights are listed below.", "", "Regional highlights:"]
    told = lambda x: ", ".join(f"{r['colony_id']} ({r['score']:.1f}, {r['status']})" for r in x) or "none"
    for g in regions:
        lines.append(f"{g['region_id']} (sites: {', '.join(g['site_ids'])}; {g['site_count']} site{'s' * (g['site_count'] != 1)}, {g['colony_count']} colon{'ies' if g['colony_count'] != 1 else 'y'})")
        lines += [f"   - Performing well: {told(g['performing_well_colonies'])}", f"   - Underperforming: {told(g['underperforming_colonies'])}"]
        if g["watch_colonies"]:
            lines.append(f"   - Watch: {told(g['watch_colonies'])}")
    lines += ["", "Ranked colonies by region:"]
    for region, rows in sorted(_by(colonies, "region_id").items()):
        lines.append(f"{region}:")
        for k, r in enumerate(sorted(rows, key=lambda r: (-r["score"], r["colony_id"])), 1):
            if not r["sample_count"]:
                lines.append(f"{k}. {r['colony_id']} - not reporting (no sensor readings in this window)")
            else:
                lines.append(f"{k}. {r['colony_id']} - {r['status']} (underperformance score {r['score']:.1f}/100, weight {r['delta_kg']:+.2f} kg ({r['weight_pct_change']:+.1f}%) over {r['days_observed']:.1f} days)")
            for c in [c for c in r["comparisons"] if c["badness_z"] > 0][:3]:
                low = f" [low confidence: n={c['peer_count']} peers]" if c["confidence"] == "low" else ""
                lines.append(f"   - {c['label']}: {c['value']:.2f}{_unit(c['unit'])} vs peer avg {c['peer_mean']:.2f}{_unit(c['unit'])} (badness z {c['badness_z']:.1f}){low}")
            if r["weight_events"]:
                lines += ["   Weight events (newest first):", *map(event_row, r["weight_events"])]
            lines += [f"   - Flag: {f}" for f in [f for f in r["flags"] if not f.startswith("Likely ")][:4]]
        lines.append("")
    return "\n".join(lines).rstrip()


_SIDE = {"L": "left", "R": "right"}


def sister_rows(a: Analysis) -> list[dict[str, Any]]:
    """Per site: both scores, a status, a summary, and the metrics from the largest impact on."""
    labels = {m.name: (m.label, m.unit) for m in a.cfg.metrics()}
    metrics = _by(_rows(a.sisters), "hive_id")
    out = []
    for s in sorted(_rows(a.sister_sites), key=lambda s: s["hive_id"]):
        ms = sorted(metrics.get(s["hive_id"], []), key=lambda x: (-x["impact"], x["ord"]))
        for x in ms:
            x["label"], x["unit"] = labels[x["metric"]]
        weak, decline = s["weaker_side"], s["declining_side"]
        status = s["verdict"] if s["verdict"] in ("incomplete", "similar") else f"{_SIDE[weak]} colony {s['verdict']}"
        if s["verdict"] == "incomplete":
            text = "This site needs both left and right colony readings before sister comparison is possible."
        elif weak is None:
            text = f"Current condition: the two colonies at {s['hive_id']} look broadly similar on the measured scoring features."
        else:
            why = " and ".join(x["label"] for x in [x for x in ms if x["worse_side"] and x["impact"] > 0][:2] if x["worse_side"] == weak) or "the measured scoring features"
            text = f"Current condition: the {_SIDE[weak]} colony is weaker overall at {s['hive_id']}, mainly because of {why}. Sister scores: L {s['left_score']:.1f} vs R {s['right_score']:.1f}."
        if decline:
            text += f" Trend concern: the {_SIDE[decline]} colony is declining, which should still be watched."
        label = status if not decline else f"similar; {_SIDE[decline]} declining" if weak is None else f"{_SIDE[weak]} currently weaker; {_SIDE[decline]} declining"
        out.append(s | {"status": status, "label": label, "summary": text, "metric_comparisons": ms})
    return out


def sister_json(a: Analysis) -> str:
    sites = sister_rows(a)
    return json.dumps({"metadata": run_metadata(a) | {"sister_site_count": len(sites)}, "sites": sites}, indent=2, default=str)


def sister_text(a: Analysis) -> str:
    m, sites = run_metadata(a), sister_rows(a)
    lines = ["Sister colonies compared", "========================", f"Window: {m['start_at']} to {m['end_at']} ({m['window_days']} days)", f"Sites compared: {len(sites)}", ""]
    for s in sites:
        lines += [f"{s['hive_id']}: {s['label']} (L score {s['left_score']:.1f}, R score {s['right_score']:.1f})", f"  {s['summary']}"]
        top = [x for x in s["metric_comparisons"] if x["worse_side"] and x["impact"] > 0][:3]
        lines += ["  Top sister differences:"] * bool(top)
        lines += [f"  - {x['label']}: L {x['left_value']:.2f}{_unit(x['unit'])} vs R {x['right_value']:.2f}{_unit(x['unit'])}; {_SIDE[x['worse_side']]} worse by {x['raw_gap']:.2f}{_unit(x['unit'])}" for x in top]
        lines.append("")
    return "\n".join(lines).rstrip()


def event_log(events: DataFrame, sites: tuple[str, ...] = ()) -> str:
    """All events, by colony and newest first; of the given sites if any are given."""
    chosen = events.where(F.col("hive_id").isin(*sites)) if sites else events
    lines, n = [], 0
    for colony, rows in sorted(_by(_rows(chosen), "colony_id").items()):
        lines += [f"{colony} ({len(rows)} events)", *(event_row(_event(e)) for e in sorted(rows, key=lambda e: -e["wall"])), ""]
        n += len(rows)
    return "\n".join([*lines, f"Total: {n} events"])


def validation_report(outcomes: DataFrame) -> dict[str, Any]:
    """Rates, counts, offsets of true positives, and the outcome rows by kind."""
    from combline.operators.validation import OUTCOMES, rates

    r = rates(outcomes).first().asDict()
    offsets = outcomes.where("outcome = 'true_positive'").agg(F.min("offset_hours").alias("min"), F.max("offset_hours").alias("max"), F.avg("offset_hours").alias("mean")).first().asDict()
    rows = _by(_rows(outcomes), "outcome")
    return {"precision": r["precision"], "recall": r["recall"], "f1": r["f1"], "confusion": {o: r[o] for o in OUTCOMES}, "offset_hours": offsets} | {f"{o}s": rows.get(o, []) for o in OUTCOMES if o != "true_negative"}


def sensitivity_report(a: Analysis, draws: int = 500, seed: int = 20260727) -> dict[str, Any]:
    """How far ranks move when one weight changes, and when all weights are drawn anew around their values."""
    spark, metrics = a.readings.sparkSession, a.cfg.metrics()

    def agreement(variants: DataFrame) -> DataFrame:
        per = scoring.rank_agreement(scoring.rescored(a.comparisons, variants, a.cfg)).where("variant > 0")
        return per.groupBy("variant").agg(F.max("max_shift").alias("shift"), F.avg("tau").alias("tau"))

    one = agreement(scoring.one_at_a_time(spark, metrics)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("shift") == 0).alias("stable")).first()
    out: dict[str, Any] = {"one_at_a_time_variants": one["n"], "one_at_a_time_ranks_unchanged": one["stable"], "dirichlet": {}}
    for c in (100.0, 20.0):
        r = agreement(scoring.drawn(spark, metrics, c, draws, seed)).agg(F.avg((F.col("shift") == 0).cast("double")).alias("same"), F.avg("tau").alias("mean"), F.min("tau").alias("least"), F.max("shift").alias("shift")).first()
        out["dirichlet"][f"concentration_{int(c)}"] = {"draws": draws, "rank_unchanged_pct": round(100 * (r["same"] or 0), 1), "mean_kendall_tau": r["mean"], "min_kendall_tau": r["least"], "max_rank_shift": r["shift"]}
    return out
