"""End-to-end pipelines: offline tables and models, then scored transactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import anomaly, communities, fusion, graph, pairs, profiles, rules
from ledgerlens.operators.graph_features import graph_features
from ledgerlens.operators.rolling import FeatureConfig, rolling_features
from ledgerlens.session import cut_lineage


@dataclass(frozen=True)
class Artefacts:
    """Everything scoring looks up; tables stay DataFrames, models are small."""
    graph_features: DataFrame
    community_risk: DataFrame
    community_profiles: DataFrame
    embeddings: DataFrame
    scaler: profiles.Scaler
    forest: anomaly.Forest
    iso_offset: float
    projection: anomaly.Projection
    ae_p50: float
    ae_p95: float
    lof: anomaly.LofModel
    lof_p50: float
    lof_p05: float


def model_rows(matrix: DataFrame, scaler: profiles.Scaler) -> DataFrame:
    scaled = profiles.apply_scaler(matrix, scaler)
    return scaled.withColumn("features", F.array(*profiles.MODEL_COLUMNS))


def fit_artefacts(history: DataFrame, cfg: FeatureConfig = FeatureConfig(), *, sample_rows: int | None = None, trees: int = 200,
                  dim: int = 64, als_iterations: int = 10, lof_rows: int | None = 10_000, lof_k: int = 50) -> Artefacts:
    """Offline pass over the history: graph tables, detectors and account vectors.

    Scaler, projection and percentiles are fitted on all normal rows, or with ``sample_rows`` on so many of
    them, drawn by hash; the forest's trees draw their own small samples in either case. The outlier factor compares with
    ``lof_rows`` training rows drawn by hash (None: with all) and is calibrated on as many held-out ones.
    """
    edges = graph.build_edges(history)
    gf = cut_lineage(graph_features(edges))
    prof = cut_lineage(communities.community_profiles(edges, gf))
    # rows are drawn before their features are computed: only their senders are replayed
    normal = history.where(~F.coalesce("is_fraud", F.lit(False))) if "is_fraud" in history.columns else history
    drawn = normal.select("transaction_id")
    if sample_rows is not None:
        drawn = cut_lineage(profiles.sample_transactions(drawn, sample_rows))
    matrix = cut_lineage(profiles.finite_rows(
        profiles.training_matrix(rolling_features(history, cfg, only=drawn), gf), profiles.MODEL_COLUMNS))
    scaler = profiles.fit_scaler(matrix, profiles.MODEL_COLUMNS)
    train, held_out = profiles.train_val_split(model_rows(matrix, scaler))
    train, held_out = cut_lineage(train), cut_lineage(held_out)
    forest = anomaly.load_forest(anomaly.fit_isolation_forest(train, trees=trees))
    projection = anomaly.fit_pca(train)
    errors = held_out.select(anomaly.reconstruction_error(projection).alias("e"))
    cal = anomaly.calibration_percentiles(errors, "e").first()
    few = (lambda df: df) if lof_rows is None else (lambda df: cut_lineage(profiles.sample_transactions(df, lof_rows)))
    lof = anomaly.fit_lof(few(train), lof_k, "transaction_id")
    tail = anomaly.calibration_percentiles(anomaly.lof_score_samples(few(held_out), lof, "transaction_id"), "lof_raw").first()
    return Artefacts(
        gf, cut_lineage(communities.normalised_community_risk(prof)), prof,
        cut_lineage(pairs.account_embeddings(edges, dim, als_iterations)), scaler, forest,
        anomaly.isolation_offset(train, forest), projection, cal["p50"] or 0.0, cal["p95"] or 0.0,
        lof, tail["p50"] or 0.0, tail["p05"] or 0.0)


def behavioural_scores(features: DataFrame, art: Artefacts) -> DataFrame:
    rows = cut_lineage(model_rows(profiles.training_matrix(features, art.graph_features), art.scaler))
    near = anomaly.lof_score_samples(rows, art.lof, "transaction_id").withColumnRenamed("id", "transaction_id")
    raw = rows.select("transaction_id", profiles.top_drivers(profiles.MODEL_COLUMNS).alias("anomaly_drivers"),
                      anomaly.isolation_score_samples(art.forest).alias("iso_raw"),
                      anomaly.reconstruction_error(art.projection).alias("autoencoder_recon_error")).join(near, "transaction_id", "left")
    iso = anomaly.isolation_score(F.col("iso_raw"), art.iso_offset)
    ae = anomaly.reconstruction_score(F.col("autoencoder_recon_error"), art.ae_p50, art.ae_p95)
    lof = F.coalesce(anomaly.lof_score(F.col("lof_raw"), art.lof_p50, art.lof_p05), F.lit(0.0))
    return raw.select("transaction_id", "anomaly_drivers", iso.alias("iso_forest_score"), "autoencoder_recon_error", "lof_raw",
                      lof.alias("lof_score"), ae.alias("autoencoder_score"), anomaly.ensemble_score(iso, lof, ae).alias("ensemble_anomaly_score"))


def score_rows(txn: DataFrame, feats: DataFrame, vector: DataFrame, art: Artefacts) -> DataFrame:
    """Rules, detectors, pair score and fusion for rows whose state is computed."""
    names = ("sender_account", "receiver_account")
    scored = (rules.evaluate_rules(feats.join(vector.drop(*names), "transaction_id"))
              .join(behavioural_scores(feats, art), "transaction_id")
              .join(pairs.score_pairs(txn, art.embeddings).drop(*names), "transaction_id"))
    c = F.col
    return fusion.fuse(scored).withColumns({
        "structural_anomaly_explanations": pairs.structural_explanations(
            c("edge_creates_cycle"), c("cycle_length"), c("src_known"), c("dst_known"), c("gnn_anomaly_score")),
        "community_anomaly_flag": pairs.community_anomaly_flag(c("sender_community_risk_score"), c("sender_benford_chi2_community")),
        "community_id": c("sender_community_id")})


def score_transactions(txn: DataFrame, art: Artefacts, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The whole chain in batch: state of every row as of its own time."""
    vector = graph.live_graph_vector(txn, art.graph_features, art.community_risk)
    # the features feed the rules and the detectors: computed once
    return score_rows(txn, cut_lineage(rolling_features(txn, cfg)), vector, art)


def alerts_of(scored: DataFrame) -> DataFrame:
    """Alerts with the running community maximum, in the alert table layout."""
    return fusion.group_risk(fusion.create_alerts(scored))
