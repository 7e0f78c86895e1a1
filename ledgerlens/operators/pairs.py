"""Edge preparation, account vectors and pair scores."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.graph_features import accounts
from ledgerlens.operators.profiles import hash_order
from ledgerlens.operators.scans import HOUR, global_index, running, time_slot

WEEK = 7 * 86_400.0
EGO_SLOTS = 16
LOGIT = 4.0


def edge_time_delta(edges: DataFrame, slot_seconds: int = HOUR) -> DataFrame:
    """Time since the sender's previous edge, cut at 7 days, as a share of 7 days."""
    prev = running(edges, ["src"], ["timestamp", "transaction_id"], time_slot(F.col("timestamp"), slot_seconds),
                   {"_prev": ("last", F.col("timestamp"))})
    gap = (F.unix_micros("timestamp") - F.unix_micros("_prev")) / 1e6
    return prev.withColumn("dt_norm", F.coalesce(F.least(gap, F.lit(WEEK)), F.lit(WEEK)) / WEEK).drop("_prev")


def edge_features(edges: DataFrame) -> DataFrame:
    """log amount relative to the largest, international flag, time delta."""
    top = edges.agg(F.max("amount")).scalar()
    scaled = F.log1p("amount") / (F.log1p(top) + 1e-9)
    intl = F.when(F.col("is_international"), 1.0).otherwise(0.0)
    return edge_time_delta(edges).withColumn("edge_features", F.array(scaled, intl, F.col("dt_norm")))


def even_subsample(edges: DataFrame, m: int) -> DataFrame:
    """``m`` evenly spaced rows in time order (all rows when there are fewer)."""
    total = edges.count()
    if total <= m:
        return edges
    step = total / m
    wanted = edges.sparkSession.range(m).select(
        F.least(F.bround(F.col("id") * F.lit(step), 0).cast("bigint"), F.lit(total - 1)).alias("row_index"))
    return global_index(edges, ["timestamp", "transaction_id"]).join(wanted, "row_index").drop("row_index")


def negative_samples(edges: DataFrame, ratio: int = 3, seed: int = 42) -> DataFrame:
    """``ratio`` hashed random destinations per edge."""
    nodes = global_index(accounts(edges), ["account_id"], "node_index")
    n = nodes.agg(F.count(F.lit(1))).scalar()
    tries = edges.select("transaction_id", "src", F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("draw"))
    h = hash_order("_key", seed)
    drawn = (tries.withColumn("_key", F.concat_ws(":", "transaction_id", F.col("draw").cast("string")))
             .withColumn("node_index", F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % n))
    return drawn.join(nodes, "node_index").select("transaction_id", "src", "draw", F.col("account_id").alias("negative_dst"))


def port_numbers(txn: DataFrame, slot_seconds: int = HOUR) -> DataFrame:
    """0-based order of each sender's transactions."""
    base = txn.select("transaction_id", "timestamp", "sender_account")
    return running(base, ["sender_account"], ["timestamp", "transaction_id"], time_slot(F.col("timestamp"), slot_seconds),
                   {"port_number": ("sum", F.lit(1))}).select("transaction_id", "sender_account", "port_number")


def ego_id(account: Column) -> Column:
    return F.conv(F.right(F.sha2(account, 256), F.lit(1)), 16, 10).cast("int")


def ego_vector(account: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(EGO_SLOTS - 1)), lambda i: F.when(i == ego_id(account), 1.0).otherwise(0.0))


def message_mean_aggregate(messages: DataFrame, dims: int, message: str = "message") -> DataFrame:
    """Mean message over outgoing and over incoming edges; zeros without edges."""
    vec = messages.withColumn("_v", array_to_vector(F.col(message)))
    side = lambda key, name: (vec.groupBy(F.col(key).alias("account_id"))
                              .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(name)))
    zeros = F.array(*[F.lit(0.0)] * dims)
    return side("src", "forward_mean").join(side("dst", "backward_mean"), "account_id", "full_outer").select(
        "account_id", F.coalesce("forward_mean", zeros).alias("forward_mean"), F.coalesce("backward_mean", zeros).alias("backward_mean"))


def account_embeddings(edges: DataFrame, dim: int = 64, iterations: int = 10, seed: int = 42) -> DataFrame:
    """account_id, out_embedding, in_embedding from factorising the payment counts.

    The factors approximate the preference (0..1) of a payer for a payee; a bias
    dimension maps it to a link logit of -LOGIT..LOGIT, so that usual pairs score
    near 1 and unseen ones near 0. The factoriser indexes accounts by int.
    """
    ids = global_index(accounts(edges), ["account_id"], "i").withColumn("i", F.col("i").cast("int"))
    side = lambda key, name: ids.select(F.col("account_id").alias(key), F.col("i").alias(name))
    counts = (edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("float").alias("n"))
              .join(side("src", "u"), "src").join(side("dst", "v"), "dst").select("u", "v", "n"))
    model = ALS(rank=dim - 1, maxIter=iterations, implicitPrefs=True, userCol="u", itemCol="v", ratingCol="n", seed=seed).fit(counts)
    grown = lambda c: F.transform(c, lambda x: (x * 2 * LOGIT).cast("float"))
    tail = lambda v: F.array(F.lit(v).cast("float"))
    out = model.userFactors.select(F.col("id").alias("i"), F.concat(grown(F.col("features")), tail(-LOGIT)).alias("out_embedding"))
    into = model.itemFactors.select(F.col("id").alias("i"), F.concat(F.col("features"), tail(1.0)).alias("in_embedding"))
    return ids.join(out, "i", "left").join(into, "i", "left").drop("i")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pair_score(src: Column, dst: Column) -> dict[str, Column]:
    """Link probability and anomaly of a pair; a missing vector counts as zeros."""
    link = 1.0 / (1.0 + F.exp(-F.coalesce(dot(src, dst), F.lit(0.0))))
    return {"link_score": link, "gnn_anomaly_score": (1.0 - link) * 100.0,
            "src_known": src.isNotNull(), "dst_known": dst.isNotNull()}


def score_pairs(txn: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Pair scores per transaction; vectors are joined once per distinct pair."""
    pairs = txn.select("sender_account", "receiver_account").distinct()
    s = embeddings.select(F.col("account_id").alias("sender_account"), F.col("out_embedding").alias("_s"))
    r = embeddings.select(F.col("account_id").alias("receiver_account"), F.col("in_embedding").alias("_r"))
    scored = (pairs.join(s, "sender_account", "left").join(r, "receiver_account", "left")
              .withColumns(pair_score(F.col("_s"), F.col("_r"))).drop("_s", "_r"))
    return txn.select("transaction_id", "sender_account", "receiver_account").join(scored, ["sender_account", "receiver_account"])


def embedding_lookup(embeddings: DataFrame, account: str) -> DataFrame:
    return embeddings.where(F.col("account_id") == account)


def structural_explanations(cycle: Column, length: Column, src_known: Column, dst_known: Column, anomaly: Column) -> Column:
    return F.array_compact(F.array(
        F.when(cycle, F.format_string("cycle_closure (len=%d)", length)),
        F.when(~src_known, F.lit("unknown_sender_in_training_graph")),
        F.when(~dst_known, F.lit("unknown_receiver_in_training_graph")),
        F.when(anomaly > 60, F.lit("high_embedding_dissimilarity"))))


def community_anomaly_flag(risk: Column, chi2: Column) -> Column:
    return (risk > 60) | (chi2 > 10.0)
