"""Score fusion, alerts and alert queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import clip
from ledgerlens.operators.scans import running

# Fusion weights, alert threshold and level bounds.
WEIGHTS = {"rule": 0.02, "behavioral": 0.18, "gnn": 0.78, "graph": 0.02}
ALERT_THRESHOLD = 45.0
LEVELS = ("Low", "Medium", "High", "Critical")
STATUSES = ("Open", "Investigating", "SAR_Filed", "Closed")


def graph_boost(community_risk: Column, cycle: Column) -> Column:
    return F.when(cycle, F.least(F.lit(100.0), community_risk + 20.0)).otherwise(community_risk)


def fused_score(rule: Column, behavioral: Column, gnn: Column, boost: Column, w: dict[str, float] = WEIGHTS) -> Column:
    return clip(rule * w["rule"] + behavioral * w["behavioral"] + gnn * w["gnn"] + boost * w["graph"])


def risk_level(score: Column) -> Column:
    return F.when(score < 45, "Low").when(score < 47, "Medium").when(score < 49, "High").otherwise("Critical")


def triggered_patterns(rules: Column, behavioral: Column, gnn: Column, cycle: Column) -> Column:
    return F.concat(rules, F.array_compact(F.array(
        F.when(behavioral > 60, F.lit("behavioral_anomaly")), F.when(gnn > 60, F.lit("gnn_structural_anomaly")),
        F.when(cycle, F.lit("cycle_closure")))))


def primary_driver(rule: Column, behavioral: Column, gnn: Column, w: dict[str, float] = WEIGHTS) -> Column:
    """Largest weighted contribution; the earlier one wins a tie."""
    r, b, g = rule * w["rule"], behavioral * w["behavioral"], gnn * w["gnn"]
    return F.when((r >= b) & (r >= g), "rule").when(b >= g, "behavioral").otherwise("gnn")


def explanation(score: Column, driver: Column, rule_texts: Column) -> Column:
    first = F.coalesce(F.try_element_at(rule_texts, F.lit(1)), F.lit(""))
    return F.format_string("Transaction risk %s/100 (primary driver: %s). %s", F.bround(score, 0).cast("int").cast("string"), driver, first)


def fuse(df: DataFrame, w: dict[str, float] = WEIGHTS) -> DataFrame:
    """Add fused score, level, patterns, breakdown and explanation.

    Reads rule_score, triggered_rules, rule_explanations, ensemble_anomaly_score,
    gnn_anomaly_score, sender_community_risk_score and edge_creates_cycle.
    """
    c = F.col
    cycle = F.coalesce(c("edge_creates_cycle"), F.lit(False))
    boost = graph_boost(F.coalesce(c("sender_community_risk_score"), F.lit(0.0)), cycle)
    rule, behav, gnn = c("rule_score"), c("ensemble_anomaly_score"), c("gnn_anomaly_score")
    raw = fused_score(rule, behav, gnn, boost, w)
    r2 = lambda x, n: F.round(x, 2).alias(n)
    return df.withColumns({
        "transaction_risk_score": F.round(raw, 2), "group_risk_score": F.round(raw, 2),
        "risk_level": risk_level(raw), "risk_level_group": risk_level(raw),
        "triggered_patterns": triggered_patterns(c("triggered_rules"), behav, gnn, cycle),
        "score_breakdown": F.struct(r2(rule, "rule"), r2(behav, "behavioral"), r2(gnn, "gnn"), r2(boost, "graph_boost"),
                                    F.struct(*[F.lit(v).alias(k) for k, v in w.items()]).alias("weights")),
        "explanation": explanation(raw, primary_driver(rule, behav, gnn, w), c("rule_explanations"))})


def create_alerts(fused: DataFrame, threshold: float = ALERT_THRESHOLD, created_at: Column | None = None) -> DataFrame:
    """Rows whose rounded score reaches the threshold; ids derive from the transaction."""
    return fused.where(F.col("transaction_risk_score") >= threshold).withColumns({
        "alert_id": F.concat(F.lit("ALERT-"), F.md5("transaction_id")),
        "alert_status": F.lit("Open"), "assigned_to": F.lit(None).cast("string"),
        "created_at": F.current_timestamp() if created_at is None else created_at})


def group_risk(alerts: DataFrame, community: str = "community_id", score: str = "transaction_risk_score") -> DataFrame:
    """Running maximum per community over earlier alerts and this one; an hour with most of the alerts is cut into several ranges."""
    base = alerts.drop("group_risk_score", "risk_level_group")
    out = running(base, [community], ["timestamp", "transaction_id"], None, {"group_risk_score": ("max", F.col(score))}, inclusive=True)
    return out.withColumn("risk_level_group", risk_level(F.col("group_risk_score")))


def get_alerts(alerts: DataFrame, level: str | None = None, status: str | None = None,
               limit: int | None = None, offset: int = 0) -> DataFrame:
    """Alerts, newest first; with ``limit`` one page."""
    if level:
        alerts = alerts.where(F.col("risk_level") == level)
    if status:
        alerts = alerts.where(F.col("alert_status") == status)
    found = alerts.orderBy(F.col("created_at").desc(), "alert_id")
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def update_status(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Apply an append-only log (alert_id, status, assigned_to, updated_at): the
    latest status wins, the latest given assignee stays."""
    at = F.col("updated_at")
    last = events.groupBy("alert_id").agg(
        F.max_by("status", at).alias("_s"), F.max("updated_at").alias("updated_at"),
        F.max_by("assigned_to", F.when(F.col("assigned_to").isNotNull(), at)).alias("_a"))
    return alerts.drop("updated_at").join(last, "alert_id", "left").withColumns({
        "alert_status": F.coalesce("_s", "alert_status"), "assigned_to": F.coalesce("_a", "assigned_to")}).drop("_s", "_a")


def alert_counts(alerts: DataFrame) -> DataFrame:
    """name, n for the total, every level and every status; absent ones are 0."""
    per = alerts.groupBy("risk_level", "alert_status").agg(F.count(F.lit(1)).alias("n"))
    long = per.select("n", F.explode(F.array(F.lit("total"), "risk_level", "alert_status")).alias("name"))
    domain = alerts.sparkSession.createDataFrame([(x,) for x in ("total", *LEVELS, *STATUSES)], "name string")
    return (domain.join(long, "name", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def closed_rate(alerts: DataFrame) -> DataFrame:
    closed = F.count(F.when(F.col("alert_status") == "Closed", 1))
    n = F.count(F.lit(1))
    return alerts.agg(F.when(n > 0, closed / n * 100.0).otherwise(0.0).alias("closed_pct"))


def risk_trend(alerts: DataFrame, last: int | None = None) -> DataFrame:
    """Scores, newest first; with ``last`` the latest so many."""
    found = alerts.orderBy(F.col("created_at").desc(), "alert_id").select("alert_id", "created_at", "transaction_risk_score")
    return found if last is None else found.limit(last)


def pattern_histogram(alerts: DataFrame) -> DataFrame:
    return (alerts.select(F.explode("triggered_patterns").alias("pattern")).groupBy("pattern")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "pattern"))


def live_metrics(graph_stats: DataFrame, alerts: DataFrame, graph_features: DataFrame, profiles: DataFrame) -> DataFrame:
    """name, n: graph size, alert counts and table sizes."""
    stats = graph_stats.select("nodes", "edges").unpivot([], ["nodes", "edges"], "name", "n")
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return (stats.union(alert_counts(alerts)).union(size(graph_features, "accounts_with_features"))
            .union(size(profiles, "communities")))


def refuse_scores(components: DataFrame, w: dict[str, float] = WEIGHTS, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Fused score, level and alert flag from stored component scores."""
    raw = fused_score(F.col("rule"), F.col("behavioral"), F.col("gnn"), F.col("graph_boost"), w)
    score = F.round(raw, 2)
    return components.select("transaction_id", score.alias("y_score"), risk_level(raw).alias("risk_level"),
                             F.when(score >= threshold, 1).otherwise(0).alias("y_pred"))
