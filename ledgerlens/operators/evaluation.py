"""Evaluation of alerts and scores against labels.

Ranking metrics aggregate by distinct score first and then use running sums, so
neither the rows nor the scores pass through one task.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.profiles import exact_quantiles
from ledgerlens.operators.scans import running
from ledgerlens.session import cut_lineage

COMPONENTS = ("rule", "behavioral", "gnn", "graph_boost")
# Labelled typologies and published comparison numbers.
TYPOLOGIES = (
    "fraud_ring", "structuring", "circular_laundering", "fan_in", "fan_out", "velocity_burst",
    "layering_chain", "dormant_activation", "cross_border_layering", "round_tripping",
)
BENCHMARKS = {
    "Tide_LI": {"precision": 0.612, "recall": 0.541, "f1": 0.574, "auroc": 0.801},
    "Tide_HI": {"precision": 0.718, "recall": 0.623, "f1": 0.667, "auroc": 0.864},
    "MultiGNN": {"precision": 0.791, "recall": 0.712, "f1": 0.749, "auroc": 0.921},
    "MEGA_GNN": {"precision": 0.843, "recall": 0.778, "f1": 0.809, "auroc": 0.951},
}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def eval_frame(truth: DataFrame, alerts: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """One row per transaction of truth, alerts and scored, with label and score.

    Labelled rows take the alert's score, or the stored score when the alert's is
    missing or 0; other rows prefer the stored score over the alert.
    """
    have = set(alerts.columns)
    # of repeated labels of one transaction the first in column order counts
    facts = F.struct("fraud_ring_id", "synthetic_pattern_type", "scenario_severity")
    t = truth.groupBy("transaction_id").agg(F.min(facts).alias("f")).select("transaction_id", "f.*", F.lit(1).alias("_t"))
    if "is_alerted" in have:
        alerts = alerts.where(F.col("is_alerted") == 1)
    score = F.col("transaction_risk_score") if "transaction_risk_score" in have else F.lit(50.0)
    level = F.col("risk_level") if "risk_level" in have else F.lit(None).cast("string")
    a = alerts.groupBy("transaction_id").agg(F.max(score).alias("_as"), F.max_by(level, score).alias("_al"))
    s_cols = set(scored.columns) if scored is not None else set()
    if scored is None:
        s = a.select("transaction_id", F.lit(None).cast("double").alias("_ss"), F.lit(None).cast("int").alias("_sp")).limit(0)
    else:
        pred = F.col("y_pred") if "y_pred" in s_cols else F.lit(0)
        s = scored.groupBy("transaction_id").agg(F.max("y_score").alias("_ss"), F.max_by(pred, "y_score").alias("_sp"))
    j = t.join(a, "transaction_id", "full_outer").join(s, "transaction_id", "full_outer")
    labelled, has_a, has_s = F.col("_t").isNotNull(), F.col("_as").isNotNull(), F.col("_ss").isNotNull()
    use_stored = F.when(labelled, has_s & (F.coalesce("_as", F.lit(0.0)) == 0)).otherwise(has_s)
    return j.select(
        "transaction_id", labelled.cast("int").alias("y_true"),
        F.when(use_stored, F.col("_sp")).otherwise(has_a.cast("int")).alias("y_pred"),
        F.coalesce(F.when(use_stored, F.col("_ss")).otherwise(F.col("_as")), F.lit(0.0)).alias("y_score"),
        F.when(labelled | ~has_s, F.col("_al")).alias("risk_level"),
        "fraud_ring_id", "synthetic_pattern_type", "scenario_severity")


def confusion_metrics(df: DataFrame) -> DataFrame:
    """Rates from TP, FP, FN, TN columns (4 decimals, 0 on empty denominators)."""
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    pn, rn = ratio(tn, tn + fn), ratio(tn, tn + fp)
    r4 = lambda c: F.round(c, 4)
    return df.withColumns({
        "total_alerts": tp + fp, "precision": r4(p), "recall": r4(r), "f1_fraud": r4(f1(p, r)),
        "f1_macro": r4((f1(p, r) + f1(pn, rn)) / 2), "minority_class_f1": r4(f1(p, r)),
        "false_positive_rate": r4(ratio(fp, fp + tn)), "false_negative_rate": r4(ratio(fn, tp + fn))})


def confusion_at(frame: DataFrame, threshold: float) -> DataFrame:
    pos, hit = F.col("y_true") == 1, F.col("y_score") >= threshold
    n = lambda cond: F.count(F.when(cond, 1))
    return confusion_metrics(frame.agg(F.lit(float(threshold)).alias("threshold"), n(pos & hit).alias("TP"), n(~pos & hit).alias("FP"),
                                       n(pos & ~hit).alias("FN"), n(~pos & ~hit).alias("TN")))


def threshold_sweep(frame: DataFrame, step: float = 1.0, top: float = 100.0) -> DataFrame:
    """Confusion metrics at 0, step, ..., top.

    Rows are counted once per step-wide score bin; the cumulative sums then run
    over the bins only.
    """
    steps = int(round(top / step))
    bin_of = F.least(F.lit(steps), F.greatest(F.lit(-1), F.floor(F.col("y_score") / step))).cast("bigint")
    hist = frame.groupBy(bin_of.alias("bin")).agg(
        F.count(F.when(F.col("y_true") == 1, 1)).alias("p"), F.count(F.when(F.col("y_true") != 1, 1)).alias("n"))
    grid = frame.sparkSession.range(-1, steps + 1).select(F.col("id").alias("bin"))
    full = grid.join(hist, "bin", "left").na.fill(0, ["p", "n"])
    below = running(full, [], ["bin"], F.floor(F.col("bin") / 64), {"FN": ("sum", F.col("p")), "TN": ("sum", F.col("n"))})
    tot = hist.agg(F.struct(F.sum("p").alias("p"), F.sum("n").alias("n"))).scalar()
    return confusion_metrics(below.where("bin >= 0").select(
        (F.col("bin") * step).alias("threshold"), (tot["p"] - F.col("FN")).alias("TP"), (tot["n"] - F.col("TN")).alias("FP"), "FN", "TN"))


def best_f1(sweep: DataFrame) -> DataFrame:
    """First threshold with the highest F1 (from unrounded counts)."""
    p, r = ratio(F.col("TP"), F.col("TP") + F.col("FP")), ratio(F.col("TP"), F.col("TP") + F.col("FN"))
    return sweep.orderBy(f1(p, r).desc(), "threshold").limit(1)


def _by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "y_score").agg(
        F.sum(F.col("y_true").cast("bigint")).alias("p"), F.sum((1 - F.col("y_true")).cast("bigint")).alias("n"))


def roc_auc(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with average ranks on ties (null for one class)."""
    keys = keys or []
    scores = running(_by_score(df, keys), keys, ["y_score"], None, {"before": ("sum", F.col("p") + F.col("n"))})
    rank = F.col("before") + (F.col("p") + F.col("n") + 1) / 2.0
    p, n = F.sum("p"), F.sum("n")
    auc = (F.sum(F.col("p") * rank) - p * (p + 1) / 2.0) / (p * n)
    return scores.groupBy(*keys).agg(F.when((p > 0) & (n > 0), auc).alias("roc_auc"))


def pr_curve(frame: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score, highest first."""
    up = running(_by_score(frame, []), [], ["y_score"], None,
                 {"tp": ("sum", F.col("p")), "fp": ("sum", F.col("n"))}, inclusive=True, descending=True)
    pos = frame.agg(F.sum(F.col("y_true").cast("bigint"))).scalar()
    return up.select("y_score", "p", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                     ratio(F.col("tp"), pos).alias("recall"), ratio(F.col("p"), pos).alias("recall_step"))


def average_precision(frame: DataFrame) -> DataFrame:
    return pr_curve(frame).agg(F.coalesce(F.sum(F.col("recall_step") * F.col("precision")), F.lit(0.0)).alias("pr_auc"))


def ring_stats(frame: DataFrame) -> DataFrame:
    fraud = frame.where((F.col("y_true") == 1) & F.col("fraud_ring_id").isNotNull())
    alerted = F.count(F.when(F.col("y_pred") == 1, 1))
    cov = alerted / F.count(F.lit(1))
    return fraud.groupBy("fraud_ring_id").agg(
        F.count(F.lit(1)).alias("total_txns"), alerted.alias("alerted_txns"), cov.alias("coverage"),
        (cov >= 0.5).alias("det_50pct"), (alerted == F.count(F.lit(1))).alias("fully_det"))


def ring_detection(frame: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    full, half = F.count(F.when(F.col("fully_det"), 1)), F.count(F.when(F.col("det_50pct"), 1))
    part = F.count(F.when(F.col("alerted_txns") > 0, 1))
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return ring_stats(frame).agg(
        n.alias("ring_ids_total"), full.alias("rings_fully_detected"), half.alias("rings_50pct_detected"),
        part.alias("rings_partially_detected"), (n - part).alias("rings_missed"),
        r4(ratio(half, n), "fraud_ring_detection_rate"), r4(ratio(part, n), "partial_ring_detection_rate"),
        r4(ratio(full, n), "full_ring_detection_rate"), r4(F.coalesce(F.avg("coverage"), F.lit(0.0)), "mean_ring_coverage"))


def community_match_score(fraud: DataFrame) -> DataFrame:
    """Mean share of each ring's transactions in its most frequent community."""
    per = fraud.groupBy("fraud_ring_id", "community_id").agg(F.count(F.lit(1)).alias("n"))
    ring = per.groupBy("fraud_ring_id").agg((F.max("n") / F.sum("n")).alias("share"))
    return ring.agg(F.round(F.coalesce(F.avg("share"), F.lit(0.0)), 4).alias("community_id_match_score"))


def group_risk_precision(frame: DataFrame) -> DataFrame:
    hit = F.coalesce(F.col("risk_level").isin("Medium", "High", "Critical"), F.lit(False))
    return frame.where("y_true = 1 AND y_pred = 1").agg(
        F.round(F.coalesce(F.avg(F.when(hit, 1.0).otherwise(0.0)), F.lit(0.0)), 4).alias("group_risk_precision"))


def typology_coverage(frame: DataFrame) -> DataFrame:
    """Detection per known typology; unseen ones are listed with 0."""
    per = frame.where("y_true = 1").groupBy(F.col("synthetic_pattern_type").alias("typology")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("y_pred").cast("bigint")).alias("detected"))
    domain = frame.sparkSession.createDataFrame([(t,) for t in TYPOLOGIES], "typology string")
    full = domain.join(per, "typology", "left").na.fill(0, ["total", "detected"])
    return full.withColumn("detection_rate", F.round(ratio(F.col("detected"), F.col("total")), 4))


def overall_detection_rate(frame: DataFrame) -> DataFrame:
    return frame.where("y_true = 1").agg(
        F.round(F.coalesce(F.avg(F.col("y_pred").cast("double")), F.lit(0.0)), 4).alias("overall_detection_rate"))


def pattern_list(col: Column) -> Column:
    """Fired patterns from pipe-joined text or a list literal."""
    text = F.trim(col)
    return (F.when(text.contains("|"), F.transform(F.split(text, r"\|"), lambda x: F.trim(x)))
            .when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array(text)))
            .otherwise(F.array(text)))


def rule_precision(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """Per fired pattern: alerts, alerts on labelled rows, precision."""
    is_list = dict(alerts.dtypes)["triggered_patterns"].startswith("array")
    patterns = F.col("triggered_patterns") if is_list else pattern_list(F.col("triggered_patterns"))
    fired = alerts.select("transaction_id", F.explode(patterns).alias("pattern")).where("pattern <> ''")
    known = truth.select("transaction_id", F.lit(1).alias("_t")).distinct()
    return fired.join(known, "transaction_id", "left").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("triggered"), F.count("_t").alias("true_fraud"),
        F.round(F.count("_t") / F.count(F.lit(1)), 4).alias("precision"))


def latency_stats(alerts: DataFrame, txn: DataFrame) -> DataFrame:
    """Milliseconds from the transaction to its alert; the time comes from the transactions."""
    t = txn.select("transaction_id", F.col("timestamp").alias("_at"))
    ms = alerts.select("transaction_id", "created_at").join(t, "transaction_id").select(
        ((F.unix_micros("created_at") - F.unix_micros("_at")) / 1000.0).alias("ms")).where("ms IS NOT NULL")
    q = exact_quantiles(ms, "ms", {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    m = ms.agg(F.struct(F.avg("ms").alias("mean"), F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.count("ms").alias("n"))).scalar()
    r1 = lambda c: F.round(c, 1)
    return q.select(r1(m["mean"]).alias("mean_ms"), *[r1(F.col(c)).alias(c) for c in ("median_ms", "p95_ms", "p99_ms")],
                    r1(m["lo"]).alias("min_ms"), r1(m["hi"]).alias("max_ms"), m["n"].alias("n"))


def benchmark_comparison(auc: DataFrame, best: DataFrame) -> DataFrame:
    """Differences of one-row ``roc_auc`` and best ``minority_class_f1`` to fixed baselines."""
    base = auc.sparkSession.createDataFrame([(k, v["auroc"], v["f1"]) for k, v in BENCHMARKS.items()], "name string, bm_auroc double, bm_f1 double")
    ours_a, ours_f = F.round(auc.select("roc_auc").scalar(), 4), best.select("minority_class_f1").scalar()
    d = lambda a, b: F.round(a - F.col(b), 4)
    return base.select("name", ours_a.alias("our_roc_auc"), "bm_auroc", d(ours_a, "bm_auroc").alias("delta_auroc"),
                       ours_f.alias("our_best_f1"), "bm_f1", d(ours_f, "bm_f1").alias("delta_f1"),
                       (d(ours_a, "bm_auroc") > 0).alias("beats_auroc"), (d(ours_f, "bm_f1") > 0).alias("beats_f1"))


def quick_evaluate(scored: DataFrame, truth: DataFrame, medium: float = 45.0, high: float = 49.0) -> DataFrame:
    """Precision, recall, F1 at two thresholds, AUROC and truth coverage in one row."""
    known = truth.select("transaction_id", F.lit(1).alias("_t")).distinct()
    flagged = scored.select("transaction_id", "y_score").join(known, "transaction_id", "left").withColumn("y_true", F.coalesce("_t", F.lit(0)))
    pos = F.col("y_true") == 1
    n = lambda cond: F.count(F.when(cond, 1))
    counts = flagged.agg(
        F.count(F.lit(1)).alias("n_scored"), n(pos).alias("n_fraud_in_scored"),
        *[n((pos if want else ~pos) & (hit if got else ~hit)).alias(f"{name}_{tag}")
          for tag, t in (("m", medium), ("h", high)) for hit in [F.col("y_score") >= t]
          for name, want, got in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))])
    out = counts.withColumns({"n_fraud_in_truth": known.agg(F.count(F.lit(1))).scalar(),
                              "auroc": F.round(roc_auc(flagged).scalar(), 4)})
    for tag in ("m", "h"):
        tp, fp, fn = (F.col(f"{x}_{tag}") for x in ("tp", "fp", "fn"))
        p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
        out = out.withColumns({f"precision_{tag}": F.round(p, 4), f"recall_{tag}": F.round(r, 4), f"f1_{tag}": F.round(f1(p, r), 4)})
    return out.withColumn("coverage_pct", F.round(ratio(F.col("n_fraud_in_scored"), F.col("n_fraud_in_truth")) * 100, 2))


def _component_rows(labelled: DataFrame) -> DataFrame:
    return labelled.unpivot(["transaction_id", "y_true"], list(COMPONENTS), "component", "y_score")


def component_auroc(labelled: DataFrame) -> DataFrame:
    """AUROC and class means of every component score."""
    long = _component_rows(labelled)
    mean = lambda v: F.avg(F.when(F.col("y_true") == v, F.col("y_score")))
    means = long.groupBy("component").agg(mean(1).alias("mean_fraud"), mean(0).alias("mean_normal"))
    return roc_auc(long, ["component"]).join(means, "component")


def proportional_weights(auroc: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """Weights proportional to max(0, AUROC - 0.5) plus a small floor."""
    floors = floors or {"rule": 0.02, "graph_boost": 0.02}
    floor = F.lit(0.0)
    for name, v in floors.items():
        floor = F.when(F.col("component") == name, v).otherwise(floor)
    raw = auroc.select("component", (F.greatest(F.lit(0.0), F.col("roc_auc") - 0.5) + floor).alias("raw"))
    return raw.select("component", (F.col("raw") / raw.agg(F.sum("raw")).scalar()).alias("weight"))


def weight_grid(parts: int = 20) -> Column:
    """All weight vectors on the simplex in steps of 1/parts, as a literal array."""
    seq = lambda hi: F.sequence(F.lit(0), hi)
    w = lambda i: i / float(parts)
    return F.flatten(F.transform(seq(F.lit(parts)), lambda a: F.flatten(F.transform(seq(parts - a), lambda b: F.transform(
        seq(parts - a - b), lambda c: F.struct(w(a).alias("w_rule"), w(b).alias("w_behavioral"), w(c).alias("w_gnn"),
                                               w(parts - a - b - c).alias("w_graph")))))))


def tune_weights(labelled: DataFrame, parts: int = 20, decimals: int | None = None) -> DataFrame:
    """AUROC of the weighted sum at every grid point.

    ``decimals`` rounds the sums first (stored scores have two), which bounds the
    distinct scores per weight vector, so map-side counts stay small at any size.
    """
    keys = ["w_rule", "w_behavioral", "w_gnn", "w_graph"]
    rows = labelled.groupBy(*COMPONENTS, "y_true").agg(F.count(F.lit(1)).alias("m")).withColumn("w", F.explode(weight_grid(parts))).select("*", "w.*")
    score = sum((F.col(c) * F.col(k) for c, k in zip(COMPONENTS[1:], keys[1:])), F.col(COMPONENTS[0]) * F.col(keys[0]))
    score = score if decimals is None else F.round(score, decimals)
    counts = rows.groupBy(*keys, score.alias("y_score")).agg(
        F.sum(F.when(F.col("y_true") == 1, F.col("m")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("y_true") == 1, 0).otherwise(F.col("m"))).alias("n"))
    ranked = running(counts, keys, ["y_score"], None, {"before": ("sum", F.col("p") + F.col("n"))}, store=True)
    p, n = F.sum("p"), F.sum("n")
    rank = F.col("before") + (F.col("p") + F.col("n") + 1) / 2.0
    return ranked.groupBy(*keys).agg(((F.sum(F.col("p") * rank) - p * (p + 1) / 2.0) / (p * n)).alias("roc_auc"))


def precision_bands(sweep: DataFrame, targets: tuple[float, ...] = (0.90, 0.99)) -> DataFrame:
    """Best-F1 threshold and, per target, the first threshold from there on with that precision."""
    start = best_f1(sweep).select("threshold").scalar()
    exact = ratio(F.col("TP"), F.col("TP") + F.col("FP"))
    at = lambda t: F.coalesce(F.min(F.when(exact >= t, F.col("threshold"))), F.lit(100.0))
    return sweep.where(F.col("threshold") >= start).agg(
        F.min("threshold").alias("medium_from"), at(targets[0]).alias("high_from"), at(targets[1]).alias("critical_from"))


def score_distribution(labelled: DataFrame) -> DataFrame:
    """Mean, p10, p50 and p90 of the score by class."""
    q = exact_quantiles(labelled, "y_score", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["y_true"])
    return labelled.groupBy("y_true").agg(F.avg("y_score").alias("mean")).join(q, "y_true")


def layer_fire_rates(labelled: DataFrame, group: str, control: str, p: float = 0.90) -> DataFrame:
    """Share of each group in which a component exceeds the control group's p90."""
    long = labelled.unpivot([group], list(COMPONENTS), "component", "v")
    limit = exact_quantiles(long.where(F.col(group) == control), "v", {"limit": p}, ["component"])
    return long.join(limit, "component").groupBy(group, "component").agg(
        F.avg(F.when(F.col("v") > F.col("limit"), 1.0).otherwise(0.0)).alias("fire_rate"), F.count(F.lit(1)).alias("n"))


def merge_scored(fraud: DataFrame, normal: DataFrame, threshold: float = 45.0) -> DataFrame:
    """Union of scored sets; the labelled set wins on repeated ids."""
    both = fraud.withColumn("_o", F.lit(0)).unionByName(normal.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("transaction_id", "_o")]
    first = both.groupBy("transaction_id").agg(F.min_by(F.struct(*cols), "_o").alias("r"))
    return first.select("transaction_id", "r.*").withColumn("y_pred", F.when(F.col("y_score") >= threshold, 1).otherwise(0))


def _metrics(df: DataFrame, section: str, key: str | None = None) -> DataFrame:
    """(section, name, metric, value): a row for each number of each row."""
    cols = [c for c in df.columns if c != key]
    name = F.lit("all") if key is None else F.col(key).cast("string")
    long = df.select(name.alias("name"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("name", cols, "metric", "value")
    return long.where("value IS NOT NULL").select(F.lit(section).alias("section"), "name", "metric", "value")


def evaluation_table(frame: DataFrame, alerts: DataFrame | None = None, truth: DataFrame | None = None, txn: DataFrame | None = None,
                     communities: DataFrame | None = None, threshold: float = 45.0) -> DataFrame:
    """The whole evaluation as rows (section, name, metric, value).

    Sections are the dataset's counts, ranking and threshold metrics, rings, typologies, published benchmarks and, where their inputs
    are given, rules (``alerts`` with patterns, ``truth``), latency (``alerts`` with times, ``txn``) and how well rings match
    communities (``truth``, ``communities`` with transaction_id and community_id).
    """
    frame = cut_lineage(frame)
    sweep = cut_lineage(threshold_sweep(frame))
    best, auc = best_f1(sweep), roc_auc(frame)
    count = lambda cond: F.count(F.when(cond, 1))
    y = F.col("y_true")
    parts = [
        _metrics(frame.agg(F.count(F.lit(1)).alias("n_total"), count(y == 1).alias("n_fraud"), count(y == 0).alias("n_normal"),
                           count(F.col("y_pred") == 1).alias("n_alerted")), "dataset"),
        _metrics(auc, "ranking"), _metrics(average_precision(frame), "ranking"),
        _metrics(confusion_at(frame, threshold), "operational"), _metrics(best, "best_f1"), _metrics(sweep, "threshold", "threshold"),
        _metrics(ring_detection(frame), "rings"), _metrics(group_risk_precision(frame), "rings"),
        _metrics(overall_detection_rate(frame), "typology"), _metrics(typology_coverage(frame), "typology", "typology"),
        _metrics(benchmark_comparison(auc, best), "benchmark", "name"),
    ]
    if alerts is not None and truth is not None:
        parts.append(_metrics(rule_precision(alerts, truth), "rule", "pattern"))
    if alerts is not None and txn is not None:
        parts.append(_metrics(latency_stats(alerts, txn), "latency"))
    if truth is not None and communities is not None:
        parts.append(_metrics(community_match_score(truth.join(communities, "transaction_id")), "rings"))
    return reduce(DataFrame.unionByName, parts)


def evaluation_report(frame: DataFrame, alerts: DataFrame | None = None, truth: DataFrame | None = None,
                      threshold: float = 45.0) -> dict:
    """All metrics as one JSON-ready dict; only aggregates reach the driver."""
    one = lambda df: df.first().asDict()
    rows = lambda df: [r.asDict() for r in df.collect()]
    sweep = threshold_sweep(frame)
    best = best_f1(sweep)
    auc = roc_auc(frame)
    report = {
        "operational_metrics": one(confusion_at(frame, threshold)), "best_f1_metrics": one(best),
        "roc_auc": auc.first()[0], **one(average_precision(frame)), **one(ring_detection(frame)),
        **one(group_risk_precision(frame)), **one(overall_detection_rate(frame)),
        "per_typology": rows(typology_coverage(frame)), "threshold_sweep": rows(sweep.orderBy("threshold")),
        "benchmarks": rows(benchmark_comparison(auc, best)),
    }
    if alerts is not None and truth is not None and "triggered_patterns" in alerts.columns:
        report["per_rule_precision"] = rows(rule_precision(alerts, truth))
    return json.loads(json.dumps(report, default=str))
