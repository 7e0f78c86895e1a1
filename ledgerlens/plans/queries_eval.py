"""Evaluation metrics as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import evaluation as V
from ledgerlens.operators.fusion import risk_level
from ledgerlens.plans import views
from ledgerlens.plans.queries_scoring import ALERTED, alerted
from ledgerlens.plans.registry import CTES, REGISTRY, register, with_ctes

CTES["lvl_alerts"] = "SELECT *, CASE WHEN transaction_risk_score < 45 THEN 'Low' WHEN transaction_risk_score < 47 THEN 'Medium' WHEN transaction_risk_score < 49 THEN 'High' ELSE 'Critical' END AS risk_level FROM alerts"
CTES["frame"] = """SELECT transaction_id, 1 AS y_true, CASE WHEN coalesce(a.transaction_risk_score, 0) = 0 AND s.y_score IS NOT NULL THEN 0 WHEN a.transaction_id IS NOT NULL THEN 1 ELSE 0 END AS y_pred,
 CASE WHEN coalesce(a.transaction_risk_score, 0) = 0 THEN coalesce(s.y_score, 0) ELSE a.transaction_risk_score END AS y_score, a.risk_level, fraud_ring_id, synthetic_pattern_type, scenario_severity
FROM truth LEFT JOIN lvl_alerts a USING (transaction_id) LEFT JOIN stored s USING (transaction_id)
UNION ALL SELECT transaction_id, 0, 0, y_score, NULL, NULL, NULL, NULL FROM stored WHERE transaction_id NOT IN (SELECT transaction_id FROM truth)"""
FRAME = ["txn", "truth", "scored", "stored", "alerts", "lvl_alerts", "frame"]


def frame(spark, d):
    a = views.alerts(spark, d).withColumn("risk_level", risk_level(F.col("transaction_risk_score")))
    return V.eval_frame(views.truth(spark, d), a, views.stored_scores(spark, d))


def labelled_scores(spark, d):
    t = views.truth(spark, d).select("transaction_id", F.lit(1).alias("_t"))
    return views.scored(spark, d).join(t, "transaction_id", "left").withColumn("y_true", F.coalesce("_t", F.lit(0))).drop("_t")


CTES["lab"] = "SELECT s.*, CASE WHEN t.transaction_id IS NULL THEN 0 ELSE 1 END AS y_true FROM scored s LEFT JOIN truth t USING (transaction_id)"
LAB = ["txn", "truth", "scored", "lab"]


@register("eval_frame", with_ctes(FRAME, "SELECT transaction_id, y_true, y_pred, round(y_score, 4) AS y_score, risk_level, fraud_ring_id, synthetic_pattern_type, scenario_severity FROM frame"))
def _frame(spark, d):
    return frame(spark, d)


_COUNTS = "count(*) FILTER (WHERE y_true = 1 AND y_score >= t) AS TP, count(*) FILTER (WHERE y_true = 0 AND y_score >= t) AS FP, count(*) FILTER (WHERE y_true = 1 AND y_score < t) AS FN, count(*) FILTER (WHERE y_true = 0 AND y_score < t) AS TN"
_div = lambda a, b: f"(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END)"
_P, _R = _div("TP", "(TP + FP)"), _div("TP", "(TP + FN)")
_PN, _RN = _div("TN", "(TN + FN)"), _div("TN", "(TN + FP)")
_F1, _F0 = _div(f"2 * {_P} * {_R}", f"({_P} + {_R})"), _div(f"2 * {_PN} * {_RN}", f"({_PN} + {_RN})")
CTES["sweep"] = f"SELECT CAST(t AS DOUBLE) AS t, {_COUNTS} FROM frame, range(0, 101) r(t) GROUP BY t"
CTES["half"] = f"SELECT t, {_COUNTS} FROM frame, (SELECT i * 0.5::DOUBLE AS t FROM range(0, 201) r(i)) GROUP BY t"
_METRICS = f"""t AS threshold, TP, FP, FN, TN, TP + FP AS total_alerts, round({_P}, 4) AS precision, round({_R}, 4) AS recall, round({_F1}, 4) AS f1_fraud, round(({_F1} + {_F0}) / 2, 4) AS f1_macro,
 round({_F1}, 4) AS minority_class_f1, round({_div('FP', '(FP + TN)')}, 4) AS false_positive_rate, round({_div('FN', '(TP + FN)')}, 4) AS false_negative_rate"""
_KEEP = ["threshold", "TP", "FP", "FN", "TN", "total_alerts", "precision", "recall", "f1_fraud", "f1_macro", "minority_class_f1", "false_positive_rate", "false_negative_rate"]


@register("confusion_at_45", with_ctes(FRAME + ["sweep"], f"SELECT {_METRICS} FROM sweep WHERE t = 45"))
def _confusion(spark, d):
    return V.confusion_at(frame(spark, d), 45).select(*_KEEP)


@register("threshold_sweep", with_ctes(FRAME + ["sweep"], f"SELECT {_METRICS} FROM sweep"))
def _sweep(spark, d):
    return V.threshold_sweep(frame(spark, d)).select(*_KEEP)


@register("threshold_sweep_half_steps", with_ctes(FRAME + ["half"], f"SELECT {_METRICS} FROM half"))
def _half(spark, d):
    return V.threshold_sweep(frame(spark, d), 0.5).select(*_KEEP)


@register("best_f1", with_ctes(FRAME + ["sweep"], f"SELECT {_METRICS} FROM sweep ORDER BY {_F1} DESC, t LIMIT 1"))
def _best(spark, d):
    return V.best_f1(V.threshold_sweep(frame(spark, d))).select(*_KEEP)


def _auc(table: str, score: str = "y_score", keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    out, grp = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    peers = f"PARTITION BY {keys + ', ' if keys else ''}{score}"
    return (f"SELECT {out}(sum(rk) FILTER (WHERE y_true = 1) - count(*) FILTER (WHERE y_true = 1) * (count(*) FILTER (WHERE y_true = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y_true = 1) * count(*) FILTER (WHERE y_true = 0)) AS auc "
            f"FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({peers}) - 1) / 2.0 AS rk FROM {table}) {grp}")


@register("roc_auc", with_ctes(FRAME, f"SELECT round(auc, 6) AS roc_auc FROM ({_auc('frame')})"), digits=6)
def _roc(spark, d):
    return V.roc_auc(frame(spark, d))


CTES["prc"] = """SELECT y_score, p, tp / CAST(tp + fp AS DOUBLE) AS pr, tp / CAST(pos AS DOUBLE) AS rc FROM (SELECT y_score, p, sum(p) OVER (ORDER BY y_score DESC) AS tp, sum(n) OVER (ORDER BY y_score DESC) AS fp, sum(p) OVER () AS pos
 FROM (SELECT y_score, sum(y_true) AS p, sum(1 - y_true) AS n FROM frame GROUP BY 1))"""


@register("pr_curve", with_ctes(FRAME + ["prc"], "SELECT round(y_score, 4) AS y_score, round(pr, 6) AS precision, round(rc, 6) AS recall FROM prc"), digits=6, y_score=4)
def _curve(spark, d):
    return V.pr_curve(frame(spark, d)).select("y_score", "precision", "recall")


@register("average_precision", with_ctes(FRAME + ["prc"], "SELECT round(sum(p * pr) / (SELECT sum(y_true) FROM frame), 6) AS pr_auc FROM prc"), digits=6)
def _ap(spark, d):
    return V.average_precision(frame(spark, d))


CTES["rings"] = "SELECT fraud_ring_id, count(*) AS total_txns, count(*) FILTER (WHERE y_pred = 1) AS alerted_txns FROM frame WHERE y_true = 1 GROUP BY 1"


@register("ring_stats", with_ctes(FRAME + ["rings"], "SELECT *, round(alerted_txns / total_txns, 4) AS coverage, alerted_txns / total_txns >= 0.5 AS det_50pct, alerted_txns = total_txns AS fully_det FROM rings"))
def _ring_stats(spark, d):
    return V.ring_stats(frame(spark, d))


@register("ring_detection", with_ctes(FRAME + ["rings"], """SELECT count(*) AS ring_ids_total, count(*) FILTER (WHERE alerted_txns = total_txns) AS rings_fully_detected, count(*) FILTER (WHERE alerted_txns * 2 >= total_txns) AS rings_50pct_detected,
 count(*) FILTER (WHERE alerted_txns > 0) AS rings_partially_detected, count(*) FILTER (WHERE alerted_txns = 0) AS rings_missed, round(count(*) FILTER (WHERE alerted_txns * 2 >= total_txns) / count(*), 4) AS fraud_ring_detection_rate,
 round(count(*) FILTER (WHERE alerted_txns > 0) / count(*), 4) AS partial_ring_detection_rate, round(count(*) FILTER (WHERE alerted_txns = total_txns) / count(*), 4) AS full_ring_detection_rate, round(avg(alerted_txns / total_txns), 4) AS mean_ring_coverage FROM rings"""))
def _ring_detection(spark, d):
    return V.ring_detection(frame(spark, d))


@register("community_match_score", with_ctes(["txn", "truth"], """SELECT round(avg(share), 4) AS community_id_match_score FROM (SELECT fraud_ring_id, max(n) / sum(n) AS share FROM (
 SELECT fraud_ring_id, kyc_level, count(*) AS n FROM truth JOIN txn USING (transaction_id) GROUP BY 1, 2) GROUP BY 1)"""))
def _match(spark, d):
    t = views.txn(spark, d).select("transaction_id", F.col("kyc_level").alias("community_id"))
    return V.community_match_score(views.truth(spark, d).join(t, "transaction_id"))


@register("group_risk_precision", with_ctes(FRAME, "SELECT round(avg(CASE WHEN risk_level IN ('Medium', 'High', 'Critical') THEN 1.0 ELSE 0 END), 4) AS group_risk_precision FROM frame WHERE y_true = 1 AND y_pred = 1"))
def _group_precision(spark, d):
    return V.group_risk_precision(frame(spark, d))


_TYP = ", ".join(f"('{t}')" for t in V.TYPOLOGIES)


@register("typology_coverage", with_ctes(FRAME, f"""SELECT typology, count(transaction_id) AS total, coalesce(sum(y_pred), 0)::BIGINT AS detected, round(coalesce(avg(y_pred), 0), 4) AS detection_rate
FROM (VALUES {_TYP}) v(typology) LEFT JOIN frame ON y_true = 1 AND synthetic_pattern_type = typology GROUP BY 1"""))
def _typology(spark, d):
    return V.typology_coverage(frame(spark, d))


@register("overall_detection_rate", with_ctes(FRAME, "SELECT round(avg(y_pred), 4) AS overall_detection_rate FROM frame WHERE y_true = 1"))
def _overall(spark, d):
    return V.overall_detection_rate(frame(spark, d))


@register("rule_precision", with_ctes(ALERTED + ["truth"], """SELECT pattern, count(*) AS triggered, count(t.transaction_id) AS true_fraud, round(count(t.transaction_id) / count(*), 4) AS precision
FROM (SELECT transaction_id, unnest(string_split(patterns, '|')) AS pattern FROM alerted) LEFT JOIN truth t USING (transaction_id) GROUP BY 1"""))
def _rule_precision(spark, d):
    # the alert file stores the patterns as pipe-joined text
    a = alerted(spark, d).select("transaction_id", F.array_join("triggered_patterns", "|").alias("triggered_patterns"))
    return V.rule_precision(a, views.truth(spark, d))


CTES["lat"] = "SELECT (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000.0 AS ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@register("latency_stats", with_ctes(["lat"], """SELECT round(avg(ms), 1) AS mean_ms, round(median(ms), 1) AS median_ms, round(quantile_cont(ms, 0.95), 1) AS p95_ms, round(quantile_cont(ms, 0.99), 1) AS p99_ms,
 round(min(ms), 1) AS min_ms, round(max(ms), 1) AS max_ms, count(*) AS n FROM lat"""), digits=1)
def _latency(spark, d):
    a = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("transaction_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    t = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    return V.latency_stats(a, t)


_BM = ", ".join(f"('{k}', CAST({v['auroc']} AS DOUBLE), CAST({v['f1']} AS DOUBLE))" for k, v in V.BENCHMARKS.items())


@register("benchmark_comparison", with_ctes(FRAME + ["sweep"], f""", o AS (SELECT (SELECT round(auc, 4) FROM ({_auc('frame')})) AS a, (SELECT round(max({_F1}), 4) FROM sweep) AS f)
SELECT name, a AS our_roc_auc, bm_auroc, round(a - bm_auroc, 4) AS delta_auroc, f AS our_best_f1, bm_f1, round(f - bm_f1, 4) AS delta_f1, round(a - bm_auroc, 4) > 0 AS beats_auroc, round(f - bm_f1, 4) > 0 AS beats_f1
FROM (VALUES {_BM}) b(name, bm_auroc, bm_f1), o"""))
def _benchmarks(spark, d):
    f = frame(spark, d)
    return V.benchmark_comparison(V.roc_auc(f), V.best_f1(V.threshold_sweep(f)))


_PRF = ", ".join(f"""count(*) FILTER (WHERE y_true = 1 AND y_score >= {t}) AS tp_{g}, count(*) FILTER (WHERE y_true = 0 AND y_score >= {t}) AS fp_{g}, count(*) FILTER (WHERE y_true = 1 AND y_score < {t}) AS fn_{g}""" for g, t in (("m", 45), ("h", 49)))


@register("quick_evaluate", with_ctes(LAB, f""", q AS (SELECT count(*) AS n_scored, count(*) FILTER (WHERE y_true = 1) AS n_fraud_in_scored, {_PRF} FROM lab)
SELECT *, (SELECT count(*) FROM truth) AS n_fraud_in_truth, (SELECT round(auc, 4) FROM ({_auc('lab')})) AS auroc, round(tp_m / (tp_m + fp_m), 4) AS precision_m, round(tp_m / (tp_m + fn_m), 4) AS recall_m,
 round(2 * tp_m / (2 * tp_m + fp_m + fn_m), 4) AS f1_m, round(tp_h / (tp_h + fp_h), 4) AS precision_h, round(tp_h / (tp_h + fn_h), 4) AS recall_h, round(2 * tp_h / (2 * tp_h + fp_h + fn_h), 4) AS f1_h,
 round(n_fraud_in_scored / (SELECT count(*) FROM truth) * 100, 2) AS coverage_pct FROM q"""))
def _quick(spark, d):
    return V.quick_evaluate(views.scored(spark, d), views.truth(spark, d))


CTES["parts"] = "UNPIVOT (SELECT transaction_id, y_true, rule, behavioral, gnn, graph_boost FROM lab) ON rule, behavioral, gnn, graph_boost INTO NAME component VALUE v"


@register("component_auroc", with_ctes(LAB + ["parts"], f"""SELECT component, round(auc, 6) AS roc_auc, round(mf, 4) AS mean_fraud, round(mn, 4) AS mean_normal FROM ({_auc('parts', 'v', 'component')})
JOIN (SELECT component, avg(v) FILTER (WHERE y_true = 1) AS mf, avg(v) FILTER (WHERE y_true = 0) AS mn FROM parts GROUP BY 1) USING (component)"""), roc_auc=6)
def _component(spark, d):
    return V.component_auroc(labelled_scores(spark, d))


@register("proportional_weights", with_ctes(LAB + ["parts"], f""", w AS (SELECT component, greatest(0, auc - 0.5) + CASE WHEN component IN ('rule', 'graph_boost') THEN 0.02 ELSE 0 END AS raw FROM ({_auc('parts', 'v', 'component')}))
SELECT component, round(raw / (SELECT sum(raw) FROM w), 6) AS weight FROM w"""), digits=6)
def _proportional(spark, d):
    return V.proportional_weights(V.component_auroc(labelled_scores(spark, d)))


CTES["grid"] = """SELECT a / 20.0::DOUBLE AS w_rule, b / 20.0::DOUBLE AS w_behavioral, c / 20.0::DOUBLE AS w_gnn, (20 - a - b - c) / 20.0::DOUBLE AS w_graph FROM range(0, 21) x(a), range(0, 21) y(b), range(0, 21) z(c) WHERE a + b + c <= 20"""
CTES["mix"] = "SELECT w_rule, w_behavioral, w_gnn, w_graph, y_true, rule * w_rule + behavioral * w_behavioral + gnn * w_gnn + graph_boost * w_graph AS y_score FROM lab, grid"


@register("tune_weights", with_ctes(LAB + ["grid", "mix"], f"SELECT round(w_rule, 4) AS w_rule, round(w_behavioral, 4) AS w_behavioral, round(w_gnn, 4) AS w_gnn, round(w_graph, 4) AS w_graph, round(auc, 4) AS roc_auc FROM ({_auc('mix', 'y_score', 'w_rule, w_behavioral, w_gnn, w_graph')})"))
def _tune(spark, d):
    return V.tune_weights(labelled_scores(spark, d))


@register("precision_bands", with_ctes(FRAME + ["half"], f""", b AS (SELECT t FROM half ORDER BY {_F1} DESC, t LIMIT 1)
SELECT (SELECT t FROM b) AS medium_from, coalesce(min(t) FILTER (WHERE {_P} >= 0.9), 100) AS high_from, coalesce(min(t) FILTER (WHERE {_P} >= 0.99), 100) AS critical_from FROM half WHERE t >= (SELECT t FROM b)"""))
def _bands(spark, d):
    return V.precision_bands(V.threshold_sweep(frame(spark, d), 0.5))


@register("score_distribution", with_ctes(LAB, "SELECT y_true, round(avg(y_score), 4) AS mean, round(quantile_cont(y_score, 0.1), 4) AS p10, round(quantile_cont(y_score, 0.5), 4) AS p50, round(quantile_cont(y_score, 0.9), 4) AS p90 FROM lab GROUP BY 1"))
def _distribution(spark, d):
    return V.score_distribution(labelled_scores(spark, d))


@register("layer_fire_rates", with_ctes(LAB, """, g AS (SELECT l.*, coalesce(t.synthetic_pattern_type, 'NORMAL') AS grp FROM lab l LEFT JOIN truth t USING (transaction_id)),
p AS (UNPIVOT (SELECT grp, rule, behavioral, gnn, graph_boost FROM g) ON rule, behavioral, gnn, graph_boost INTO NAME component VALUE v), q AS (SELECT component, quantile_cont(v, 0.9) AS lim FROM p WHERE grp = 'NORMAL' GROUP BY 1)
SELECT grp, component, round(avg(CASE WHEN v > lim THEN 1.0 ELSE 0 END), 4) AS fire_rate, count(*) AS n FROM p JOIN q USING (component) GROUP BY 1, 2"""))
def _fire(spark, d):
    t = views.truth(spark, d).select("transaction_id", F.col("synthetic_pattern_type").alias("grp"))
    return V.layer_fire_rates(labelled_scores(spark, d).join(t, "transaction_id", "left").na.fill("NORMAL", ["grp"]), "grp", "NORMAL")


@register("merge_scored", with_ctes(LAB, """SELECT transaction_id, round(y_score, 4) AS y_score, source, CASE WHEN y_score >= 45 THEN 1 ELSE 0 END AS y_pred FROM (SELECT transaction_id, y_score, 'labelled' AS source FROM lab WHERE y_true = 1
 UNION ALL SELECT transaction_id, y_score / 2, 'all' FROM lab WHERE y_true = 0)"""))
def _merge(spark, d):
    lab = labelled_scores(spark, d)
    fraud = lab.where("y_true = 1").select("transaction_id", "y_score", F.lit("labelled").alias("source"))
    return V.merge_scored(fraud, lab.select("transaction_id", (F.col("y_score") / 2).alias("y_score"), F.lit("all").alias("source")))


# ---------------------------------------------------------------- the whole report

def _long(section: str, sql: str, key: str | None = None) -> str:
    name, rest = ("'all'", "*") if key is None else (f"{key}::VARCHAR", f"* EXCLUDE ({key})")
    return f"SELECT '{section}' AS section, name, metric, round(value, 4) AS value FROM (UNPIVOT (SELECT {name} AS name_, COLUMNS({rest})::DOUBLE FROM ({sql})) ON COLUMNS(* EXCLUDE (name_)) INTO NAME metric VALUE value) u(name, metric, value)"


_of = lambda name: REGISTRY[name].sql
_REPORT = [
    ("dataset", with_ctes(FRAME, "SELECT count(*) AS n_total, count(*) FILTER (WHERE y_true = 1) AS n_fraud, count(*) FILTER (WHERE y_true = 0) AS n_normal, count(*) FILTER (WHERE y_pred = 1) AS n_alerted FROM frame"), None),
    ("ranking", _of("roc_auc"), None), ("ranking", _of("average_precision"), None), ("operational", _of("confusion_at_45"), None), ("best_f1", _of("best_f1"), None),
    ("threshold", _of("threshold_sweep"), "threshold"), ("rings", _of("ring_detection"), None), ("rings", _of("group_risk_precision"), None), ("rings", _of("community_match_score"), None),
    ("typology", _of("overall_detection_rate"), None), ("typology", _of("typology_coverage"), "typology"), ("benchmark", _of("benchmark_comparison"), "name"), ("rule", _of("rule_precision"), "pattern"),
    ("latency", with_ctes(ALERTED, "SELECT 0.0 AS mean_ms, 0.0 AS median_ms, 0.0 AS p95_ms, 0.0 AS p99_ms, 0.0 AS min_ms, 0.0 AS max_ms, count(*) AS n FROM alerted"), None)]


@register("evaluation_report", " UNION ALL ".join(_long(*part) for part in _REPORT))
def _report(spark, d):
    """Every metric as a row; alerts are created at transaction time here, so latencies are 0."""
    t = views.txn(spark, d)
    a = alerted(spark, d).withColumn("triggered_patterns", F.array_join("triggered_patterns", "|"))
    return V.evaluation_table(frame(spark, d), a, views.truth(spark, d), t, t.select("transaction_id", F.col("kyc_level").alias("community_id")))
