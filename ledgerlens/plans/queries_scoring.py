"""Detectors, pair scores, fusion and alerts as registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.operators import anomaly, fusion, graph, pairs, profiles
from ledgerlens.operators import communities as C
from ledgerlens.operators.graph_features import accounts, communities, graph_features
from ledgerlens.operators.rolling import rolling_features
from ledgerlens.plans import scoring, views
from ledgerlens.plans.queries_accounts import FEAT
from ledgerlens.plans.queries_graph import CYCLE, E, GFEAT, PROF, _profiles, edges
from ledgerlens.plans.registry import CTES, register, with_ctes
from ledgerlens.session import cut_lineage, shared_dir
from ledgerlens.sources import readers, sinks

# ---------------------------------------------------------------- detectors


def vectors(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


_DIST = "SELECT a.vec_id AS id, b.vec_id AS nb, sqrt(list_sum([pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2) for x in list_zip(a.embedding, b.embedding)])) AS dist FROM embeddings a, embeddings b"
_NEAR = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS rank FROM dd WHERE id <> nb"
CTES["dd"] = _DIST
CTES["nn"] = f"SELECT * FROM ({_NEAR}) WHERE rank <= 20"


@register("knn", with_ctes(["dd", "nn"], "SELECT id, rank::INTEGER AS rank, round(dist, 4) AS dist FROM nn"))
def _knn(spark, d):
    v = vectors(spark, d)
    return anomaly.knn(v, v, 20, skip_self=True).select("id", "rank", "dist")


_LOF = """, q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS r FROM dd),
rr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS r FROM dd WHERE id <> nb),
kd AS (SELECT id AS nb, max(dist) AS k FROM rr WHERE r <= 50 GROUP BY 1),
den AS (SELECT id AS nb, 1 / (avg(greatest(k, dist)) + 1e-10) AS lrd FROM rr JOIN kd USING (nb) WHERE r <= 50 GROUP BY 1),
raw AS (SELECT id, -avg(lrd) / (1 / (avg(greatest(k, dist)) + 1e-10)) AS lof_raw FROM q JOIN kd USING (nb) JOIN den USING (nb) WHERE r <= 50 GROUP BY id)"""


@register("lof_scores", with_ctes(["dd"], f"{_LOF} SELECT id, round(lof_raw, 4) AS lof_raw FROM raw"))
def _lof(spark, d):
    v = vectors(spark, d)
    return anomaly.lof_score_samples(v, anomaly.fit_lof(v, 50))


@register("lof_score_bands", with_ctes(["dd"], f"""{_LOF}, c AS (SELECT quantile_cont(lof_raw, 0.5) AS p50, quantile_cont(lof_raw, 0.05) AS p05 FROM raw)
SELECT id, round(least(100, greatest(0, (p50 - lof_raw) / coalesce(nullif(p50 - p05, 0), 1e-9) * 100)), 3) AS lof_score FROM raw, c"""), digits=3)
def _lof_score(spark, d):
    """The outlier factor as 0 to 100, calibrated on its own percentiles."""
    v = vectors(spark, d)
    raw = cut_lineage(anomaly.lof_score_samples(v, anomaly.fit_lof(v, 50)))
    c = anomaly.calibration_percentiles(raw, "lof_raw").first()
    return raw.select("id", anomaly.lof_score(F.col("lof_raw"), c["p50"], c["p05"]).alias("lof_score"))


@register("calibration_percentiles", """SELECT round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95,
 round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events""")
def _calibration(spark, d):
    return anomaly.calibration_percentiles(views.table(spark, d, "events"), "value")


def _matrix(spark, d):
    t = views.txn(spark, d)
    gf = cut_lineage(graph_features(graph.build_edges(t)))
    m = cut_lineage(profiles.training_matrix(rolling_features(t), gf))
    return cut_lineage(scoring.model_rows(m, profiles.fit_scaler(m, profiles.MODEL_COLUMNS)))


@register("training_matrix", with_ctes(list(dict.fromkeys([*FEAT, "edges", *GFEAT])), f"""SELECT transaction_id, sender_account, round(tx_velocity_7d, 4) AS tx_velocity_7d, round(coalesce(r, 0), 6) AS pagerank,
 round(coalesce(b, 0), 6) AS betweenness, round(coalesce(fi, 0), 4) AS fan_in_score, round(coalesce(dn, 0), 4) AS community_density, round(coalesce(chi, 0), 4) AS benford_chi2_community,
 round(coalesce((vo - vi) / (vo + vi + 1), 0), 4) + 0.0 AS volume_asymmetry FROM feat LEFT JOIN gfeat ON a = sender_account"""), pagerank=6, betweenness=6)
def _training_matrix(spark, d):
    t = views.txn(spark, d)
    m = profiles.training_matrix(rolling_features(t), graph_features(graph.build_edges(t)))
    return m.select("transaction_id", "sender_account", "tx_velocity_7d", "pagerank", "betweenness", "fan_in_score",
                    "community_density", "benford_chi2_community", "volume_asymmetry")


@register("isolation_forest")
def _forest(spark, d):
    """Random trees have no SQL form; ranking and bounds are tested on fixtures."""
    rows = _matrix(spark, d)
    forest = anomaly.load_forest(anomaly.fit_isolation_forest(rows))
    # scored once: the offset and the result read the same scores
    scored = cut_lineage(rows.select("transaction_id", anomaly.isolation_score_samples(forest).alias("raw")))
    offset = anomaly.isolation_offset(scored, forest, raw="raw")
    return scored.select("transaction_id", "raw", anomaly.isolation_score(F.col("raw"), offset).alias("iso_forest_score"))


@register("reconstruction_error")
def _pca(spark, d):
    """Principal axes are fitted iteratively; checked against numpy in the tests."""
    rows = _matrix(spark, d)
    train, held_out = profiles.train_val_split(rows)
    projection = anomaly.fit_pca(train)
    errors = cut_lineage(held_out.select(anomaly.reconstruction_error(projection).alias("e")))
    cal = anomaly.calibration_percentiles(errors, "e").first()
    err = rows.select("transaction_id", anomaly.reconstruction_error(projection).alias("error"))
    return err.withColumn("autoencoder_score", anomaly.reconstruction_score(F.col("error"), cal["p50"], cal["p95"]))


@register("ensemble_scores", with_ctes(["txn", "scored"], "SELECT transaction_id, round(0.9 * rule + 0.1 * gnn, 4) AS ensemble FROM scored"))
def _ensemble(spark, d):
    return views.scored(spark, d).select("transaction_id", anomaly.ensemble_score(F.col("rule"), F.col("behavioral"), F.col("gnn")).alias("ensemble"))


# ---------------------------------------------------------------- edge preparation and pair scores

CTES["delta"] = """SELECT *, coalesce(least((epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY src ORDER BY timestamp, transaction_id))) / 1000000.0, 604800), 604800) / 604800 AS dt FROM edges"""


@register("edge_time_delta", with_ctes(E + ["delta"], "SELECT transaction_id, round(dt, 6) AS dt_norm FROM delta"), digits=6)
def _delta(spark, d):
    return pairs.edge_time_delta(edges(spark, d)).select("transaction_id", "dt_norm")


def _featured(spark, d):
    t = views.txn(spark, d)
    intl = t.select("transaction_id", (F.col("sender_country") != F.col("receiver_country")).alias("is_international"))
    return pairs.edge_features(graph.build_edges(t).join(intl, "transaction_id"))


CTES["efeat"] = """SELECT d.transaction_id, src, dst, ln(1 + d.amount) / (ln(1 + (SELECT max(amount) FROM edges)) + 1e-9) AS f0,
 CASE WHEN sender_country <> receiver_country THEN 1.0 ELSE 0 END AS f1, dt AS f2 FROM delta d JOIN txn USING (transaction_id)"""


@register("edge_features", with_ctes(E + ["delta", "efeat"], "SELECT transaction_id, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM efeat"), digits=6)
def _edge_features(spark, d):
    return _featured(spark, d).select("transaction_id", *[F.col("edge_features")[i].alias(f"f{i}") for i in range(3)])


@register("even_subsample", with_ctes(E, """, n AS (SELECT count(*) AS n FROM edges), w AS (SELECT DISTINCT least(CAST(round_even(i * (n / 3000.0), 0) AS BIGINT), n - 1) AS j FROM range(0, 3000) r(i), n)
SELECT transaction_id FROM (SELECT transaction_id, row_number() OVER (ORDER BY timestamp, transaction_id) - 1 AS j FROM edges) JOIN w USING (j)"""))
def _subsample(spark, d):
    return pairs.even_subsample(edges(spark, d), 3000).select("transaction_id")


@register("negative_samples", with_ctes(E + ["accts"], """, ix AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS j FROM accts)
SELECT transaction_id, src, draw::INTEGER AS draw, a AS negative_dst FROM (SELECT transaction_id, src, draw, CAST('0x' || substr(md5('42:' || transaction_id || ':' || draw), 1, 8) AS BIGINT) % (SELECT count(*) FROM accts) AS j
 FROM edges, range(0, 3) r(draw)) JOIN ix USING (j)"""))
def _negatives(spark, d):
    return pairs.negative_samples(edges(spark, d), 3)


@register("port_numbers", with_ctes(["txn"], "SELECT transaction_id, sender_account, row_number() OVER (PARTITION BY sender_account ORDER BY timestamp, transaction_id) - 1 AS port_number FROM txn"))
def _ports(spark, d):
    return pairs.port_numbers(views.txn(spark, d))


@register("ego_ids", with_ctes(E + ["accts"], "SELECT a AS account_id, CAST('0x' || right(sha256(a), 1) AS INTEGER) AS ego_id, 1.0::DOUBLE AS own FROM accts"))
def _ego(spark, d):
    a = F.col("account_id")
    return accounts(edges(spark, d)).select("account_id", pairs.ego_id(a).alias("ego_id"), pairs.ego_vector(a)[pairs.ego_id(a)].alias("own"))


@register("message_mean_aggregate", with_ctes(E + ["delta", "efeat", "accts"], """SELECT a AS account_id, round(coalesce((SELECT avg(f0) FROM efeat WHERE src = a), 0), 6) AS fwd0, round(coalesce((SELECT avg(f2) FROM efeat WHERE src = a), 0), 6) AS fwd2,
 round(coalesce((SELECT avg(f0) FROM efeat WHERE dst = a), 0), 6) AS bwd0, round(coalesce((SELECT avg(f1) FROM efeat WHERE dst = a), 0), 6) AS bwd1 FROM accts"""), digits=6)
def _messages(spark, d):
    m = pairs.message_mean_aggregate(_featured(spark, d), 3, "edge_features")
    return m.select("account_id", F.col("forward_mean")[0].alias("fwd0"), F.col("forward_mean")[2].alias("fwd2"),
                    F.col("backward_mean")[0].alias("bwd0"), F.col("backward_mean")[1].alias("bwd1"))


_DOT = "list_sum([CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE) for x in list_zip(a.embedding, b.embedding)])"


@register("pair_scores", f"""SELECT a.vec_id, round(1 / (1 + exp(-coalesce({_DOT}, 0))), 4) AS link_score, round((1 - 1 / (1 + exp(-coalesce({_DOT}, 0)))) * 100, 4) AS gnn_anomaly_score,
 a.embedding IS NOT NULL AS src_known, b.embedding IS NOT NULL AS dst_known FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _pair_scores(spark, d):
    v = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id", "left").withColumns(pairs.pair_score(F.col("embedding"), F.col("other"))).drop("embedding", "other")


@register("account_embeddings")
def _embeddings(spark, d):
    """Factorisation is iterative; its ranking quality is tested."""
    e = edges(spark, d)
    return pairs.score_pairs(views.txn(spark, d), pairs.account_embeddings(e))


@register("embedding_lookup", """SELECT label, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 3) AS total FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings)""", digits=3)
def _lookup(spark, d):
    v = views.table(spark, d, "embeddings").withColumnRenamed("vec_id", "account_id")
    last = v.agg(F.max("account_id")).first()[0]
    return pairs.embedding_lookup(v, last).select("label", F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x).alias("total"))


@register("structural_explanations", with_ctes(["txn", "edges", *CYCLE, "scored"], """SELECT transaction_id, concat_ws('|', CASE WHEN cycle_length > 0 THEN 'cycle_closure (len=' || cycle_length || ')' END, CASE WHEN rule >= 50 THEN 'unknown_sender_in_training_graph' END,
 CASE WHEN behavioral >= 50 THEN 'unknown_receiver_in_training_graph' END, CASE WHEN gnn > 60 THEN 'high_embedding_dissimilarity' END) AS explanations, (graph_boost > 60 OR rule > 10) AS community_anomaly FROM scored JOIN cycle USING (transaction_id)"""))
def _structural(spark, d):
    c = F.col
    j = views.scored(spark, d).join(graph.cycle_closure(edges(spark, d)), "transaction_id")
    return j.select("transaction_id", pairs.structural_explanations(c("edge_creates_cycle"), c("cycle_length"), c("rule") < 50, c("behavioral") < 50, c("gnn")).alias("explanations"),
                    pairs.community_anomaly_flag(c("graph_boost"), c("rule")).alias("community_anomaly"))


# ---------------------------------------------------------------- fusion and alerts

CTES["fused"] = """SELECT *, least(100, greatest(0, 0.02 * rule + 0.18 * behavioral + 0.78 * gnn + 0.02 * boost)) AS raw FROM (
 SELECT s.*, c.cycle_length, CASE WHEN cycle_length > 0 THEN least(100, graph_boost + 20) ELSE graph_boost END AS boost FROM scored s JOIN cycle c USING (transaction_id))"""
_LEVEL = "CASE WHEN {x} < 45 THEN 'Low' WHEN {x} < 47 THEN 'Medium' WHEN {x} < 49 THEN 'High' ELSE 'Critical' END"
FUSED = ["txn", "edges", *CYCLE, "scored", "fused"]


def fused(spark, d):
    """Fixture scores fused with the real cycle flag of every transaction."""
    s = views.scored(spark, d).join(graph.cycle_closure(edges(spark, d)), "transaction_id")
    c = F.col
    return fusion.fuse(s.select(
        "transaction_id", "edge_creates_cycle", c("rule").alias("rule_score"), c("behavioral").alias("ensemble_anomaly_score"),
        c("gnn").alias("gnn_anomaly_score"), c("graph_boost").alias("sender_community_risk_score"),
        F.array(F.lit("R01")).alias("triggered_rules"), F.array(F.lit("R01: first text")).alias("rule_explanations")))


@register("fused_scores", with_ctes(FUSED, f"""SELECT transaction_id, round(raw, 2) AS transaction_risk_score, {_LEVEL.format(x='raw')} AS risk_level, round(boost, 2) AS boost,
 concat_ws('|', 'R01', CASE WHEN behavioral > 60 THEN 'behavioral_anomaly' END, CASE WHEN gnn > 60 THEN 'gnn_structural_anomaly' END, CASE WHEN cycle_length > 0 THEN 'cycle_closure' END) AS triggered_patterns,
 CASE WHEN 0.02 * rule >= 0.18 * behavioral AND 0.02 * rule >= 0.78 * gnn THEN 'rule' WHEN 0.18 * behavioral >= 0.78 * gnn THEN 'behavioral' ELSE 'gnn' END AS driver FROM fused"""), transaction_risk_score=2, boost=2)
def _fused(spark, d):
    return fused(spark, d).select("transaction_id", "transaction_risk_score", "risk_level", F.col("score_breakdown.graph_boost").alias("boost"), "triggered_patterns",
                                  F.regexp_extract("explanation", r"primary driver: (\w+)", 1).alias("driver"))


CTES["alerted"] = f"""SELECT f.transaction_id, t.timestamp, 'ALERT-' || md5(f.transaction_id) AS alert_id, round(raw, 2) AS score, {_LEVEL.format(x='raw')} AS level, kyc_level AS community_id,
 concat_ws('|', 'R01', CASE WHEN behavioral > 60 THEN 'behavioral_anomaly' END, CASE WHEN gnn > 60 THEN 'gnn_structural_anomaly' END, CASE WHEN cycle_length > 0 THEN 'cycle_closure' END) AS patterns,
 CASE WHEN CAST(substr(f.transaction_id, 2) AS BIGINT) % 5 = 0 THEN 'Closed' WHEN CAST(substr(f.transaction_id, 2) AS BIGINT) % 5 = 1 THEN 'Investigating' ELSE 'Open' END AS status
 FROM fused f JOIN txn t USING (transaction_id) WHERE round(raw, 2) >= 45"""
ALERTED = [*FUSED, "alerted"]


def alerted(spark, d):
    """Alerts created at transaction time; kyc_level stands in for the community."""
    t = views.txn(spark, d).select("transaction_id", "timestamp", "sender_account", F.col("kyc_level").alias("community_id"))
    a = fusion.create_alerts(fused(spark, d).join(t, "transaction_id"), created_at=F.col("timestamp"))
    n = F.substring("transaction_id", 2, 20).cast("bigint") % 5
    return a.withColumn("alert_status", F.when(n == 0, "Closed").when(n == 1, "Investigating").otherwise("Open"))


@register("create_alerts", with_ctes(ALERTED, "SELECT alert_id, transaction_id, score AS transaction_risk_score, level AS risk_level FROM alerted"), transaction_risk_score=2)
def _alerts(spark, d):
    return alerted(spark, d).select("alert_id", "transaction_id", "transaction_risk_score", "risk_level")


@register("group_risk", with_ctes(ALERTED, f"""SELECT alert_id, g AS group_risk_score, {_LEVEL.format(x='g')} AS risk_level_group FROM (SELECT *, max(score) OVER (PARTITION BY community_id ORDER BY timestamp, transaction_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM alerted)"""), group_risk_score=2)
def _group(spark, d):
    return fusion.group_risk(alerted(spark, d)).select("alert_id", "group_risk_score", "risk_level_group")


@register("get_alerts", with_ctes(ALERTED, "SELECT alert_id, score AS transaction_risk_score FROM alerted WHERE level = 'Critical' AND status = 'Open'"), transaction_risk_score=2)
def _get(spark, d):
    return fusion.get_alerts(alerted(spark, d), "Critical", "Open").select("alert_id", "transaction_risk_score")


@register("update_status", with_ctes(ALERTED, """SELECT alert_id, CASE WHEN CAST(substr(transaction_id, 2) AS BIGINT) % 2 = 0 THEN 'SAR_Filed' ELSE status END AS alert_status,
 CASE WHEN CAST(substr(transaction_id, 2) AS BIGINT) % 2 = 0 THEN 'ann' END AS assigned_to FROM alerted"""))
def _update(spark, d):
    a = alerted(spark, d)
    even = a.where(F.substring("transaction_id", 2, 20).cast("bigint") % 2 == 0)
    at = lambda s: F.col("timestamp") + F.expr(f"INTERVAL {s} SECONDS")
    log = even.select("alert_id", F.lit("Investigating").alias("status"), F.lit("ann").alias("assigned_to"), at(1).alias("updated_at")).unionByName(
        even.select("alert_id", F.lit("SAR_Filed").alias("status"), F.lit(None).cast("string").alias("assigned_to"), at(2).alias("updated_at")))
    return fusion.update_status(a, log).select("alert_id", "alert_status", "assigned_to")


_COUNTS = """SELECT 'total' AS name, count(*) AS n FROM alerted UNION ALL SELECT v, (SELECT count(*) FROM alerted WHERE level = v) FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) x(v)
UNION ALL SELECT v, (SELECT count(*) FROM alerted WHERE status = v) FROM (VALUES ('Open'), ('Investigating'), ('SAR_Filed'), ('Closed')) x(v)"""


@register("alert_counts", with_ctes(ALERTED, _COUNTS))
def _counts(spark, d):
    return fusion.alert_counts(alerted(spark, d))


@register("live_metrics", with_ctes(list(dict.fromkeys([*ALERTED, "accts"])), f"""{_COUNTS} UNION ALL SELECT 'nodes', (SELECT count(*) FROM accts) UNION ALL SELECT 'edges', (SELECT count(*) FROM edges)
UNION ALL SELECT 'accounts_with_features', (SELECT count(*) FROM accts) UNION ALL SELECT 'communities', 1"""))
def _metrics(spark, d):
    e = edges(spark, d)
    members = communities(e)
    return fusion.live_metrics(graph.graph_stats(e), alerted(spark, d), members, members.select("community_id").distinct())


@register("closed_rate", with_ctes(ALERTED, "SELECT round(100.0 * count(*) FILTER (WHERE status = 'Closed') / count(*), 4) AS closed_pct FROM alerted"))
def _closed(spark, d):
    return fusion.closed_rate(alerted(spark, d))


@register("risk_trend", with_ctes(ALERTED, "SELECT alert_id, epoch_us(timestamp) AS created_at, score AS transaction_risk_score FROM alerted"), transaction_risk_score=2)
def _trend(spark, d):
    return fusion.risk_trend(alerted(spark, d))


@register("pattern_histogram", with_ctes(ALERTED, "SELECT pattern, count(*) AS n FROM (SELECT unnest(string_split(patterns, '|')) AS pattern FROM alerted) GROUP BY 1"))
def _histogram(spark, d):
    return fusion.pattern_histogram(alerted(spark, d))


@register("refuse_scores", with_ctes(["txn", "scored"], f"""SELECT transaction_id, round(raw, 2) AS y_score, {_LEVEL.format(x='raw')} AS risk_level, CASE WHEN round(raw, 2) >= 45 THEN 1 ELSE 0 END AS y_pred
FROM (SELECT *, least(100, greatest(0, 0.02 * rule + 0.18 * behavioral + 0.78 * gnn + 0.02 * graph_boost)) AS raw FROM scored)"""), y_score=2)
def _refuse(spark, d):
    return fusion.refuse_scores(views.scored(spark, d))


@register("community_lookup", with_ctes(PROF, "SELECT c AS community_id, size, pattern AS dominant_pattern FROM risk WHERE c = 3",
                                        {"edges": CTES["pay"]}))
def _community(spark, d):
    return C.community(_profiles(spark, d)[2], 3).select("community_id", "size", "dominant_pattern")


@register("score_transactions")
def _score(spark, d):
    """The whole chain; every layer has its own checked entry."""
    t = views.txn(spark, d)
    scored = scoring.score_transactions(t, scoring.fit_artefacts(t))
    return scored.select("transaction_id", "rule_score", "ensemble_anomaly_score", "gnn_anomaly_score", "transaction_risk_score", "risk_level", "triggered_patterns")


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@register("scored_jsonl", with_ctes(FUSED, """SELECT transaction_id, round(raw, 2) AS y_score, round(rule, 2) AS rule, round(behavioral, 2) AS behavioral, round(gnn, 2) AS gnn, round(boost, 2) AS graph_boost FROM fused"""), digits=2)
def _jsonl(spark, d):
    """Scored records written as JSON lines and read back."""
    path = _scratch(spark)
    sinks.write_scored_jsonl(fused(spark, d), path)
    return readers.score_components(readers.read_scored_jsonl(spark, path))


@register("alerts_table", with_ctes(ALERTED, """SELECT alert_id, transaction_id, score AS transaction_risk_score, '["' || replace(patterns, '|', '","') || '"]' AS triggered_patterns FROM alerted"""), transaction_risk_score=2)
def _table(spark, d):
    """Relational alert rows written twice under one batch and read back once."""
    path = _scratch(spark)
    rows = alerted(spark, d).drop("timestamp")
    for _ in range(2):
        sinks.write_alerts_table(rows, path, 7)
    return spark.read.parquet(path).select("alert_id", "transaction_id", "transaction_risk_score", "triggered_patterns")


@register("read_csv", with_ctes(["txn"], """SELECT transaction_id, epoch_us(timestamp) AS timestamp, sender_account, round(amount, 4) AS amount, transaction_type, payment_channel, kyc_level,
 sender_country <> receiver_country AS is_international FROM txn"""))
def _csv_file(spark, d):
    """Transactions written as CSV with header and read back into the contract."""
    path = _scratch(spark)
    t = views.txn(spark, d)
    t.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).write.option("header", True).csv(path)
    return readers.read_transactions(spark, path, "csv").select("transaction_id", "timestamp", "sender_account", "amount", "transaction_type",
                                                               "payment_channel", "kyc_level", "is_international")


@register("replay_batch", with_ctes(["txn"], "SELECT transaction_id, epoch_us(timestamp) AS timestamp FROM txn ORDER BY timestamp, transaction_id LIMIT 2500"))
def _replay(spark, d):
    return readers.replay_batch(views.txn(spark, d), 2500).select("transaction_id", "timestamp")


@register("alert_file", with_ctes(ALERTED, """SELECT alert_id, transaction_id, community_id, score AS transaction_risk_score, level AS risk_level, patterns AS triggered_patterns, 'R01: "quoted", text' AS rule_explanations,
 '' AS anomaly_drivers, epoch_us(timestamp) AS created_at, status AS alert_status, 2 AS copies FROM alerted"""), transaction_risk_score=2)
def _alert_file(spark, d):
    """Written, appended to and read back."""
    path = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
    none = F.array().cast("array<string>")
    rows = cut_lineage(fusion.group_risk(alerted(spark, d)).withColumns({
        "anomaly_drivers": none, "structural_anomaly_explanations": none, "rule_explanations": F.array(F.lit('R01: "quoted", text'))}))
    for _ in range(2):
        sinks.write_alerts_csv(rows, path)
    cols = ["alert_id", "transaction_id", "community_id", "transaction_risk_score", "risk_level", "triggered_patterns", "rule_explanations", "anomaly_drivers", "created_at", "alert_status"]
    return readers.read_alerts_csv(spark, path).groupBy(*cols).agg(F.count(F.lit(1)).cast("int").alias("copies"))


@register("alert_file_rows", with_ctes(ALERTED, f"""SELECT alert_id, transaction_id, community_id, score AS transaction_risk_score, level AS risk_level, patterns AS triggered_patterns, 'R01: first text' AS rule_explanations, status AS alert_status FROM alerted"""), transaction_risk_score=2)
def _csv(spark, d):
    none = F.array().cast("array<string>")
    rows = fusion.group_risk(alerted(spark, d)).withColumns({"anomaly_drivers": none, "structural_anomaly_explanations": none})
    return sinks.alerts_csv_rows(rows).select("alert_id", "transaction_id", "community_id", "transaction_risk_score", "risk_level", "triggered_patterns", "rule_explanations", "alert_status")
