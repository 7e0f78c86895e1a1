"""Streaming jobs run to completion over the tables, as registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens import schemas

from ledgerlens.plans import scoring, views
from ledgerlens.plans.queries_accounts import _ROUNDED, FEAT
from ledgerlens.plans.queries_graph import _AS_OF, CYCLE, E
from ledgerlens.plans.registry import register, with_ctes
from ledgerlens.session import shared_dir
from ledgerlens.sources.readers import replay_stream
from ledgerlens.streaming.jobs import StreamingScorer

SLICES = 3
# files of a slice, read by as many tasks in one batch
FILES = 4


def _replay(spark, d, artefacts=None, warm: bool = False, late: bool = False, rows=None) -> StreamingScorer:
    """Write the transactions in time slices, oldest first, and stream them; with ``late`` every 17th a slice late."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    t = views.txn(spark, d) if rows is None else rows
    lo, hi = t.agg(F.min("timestamp"), F.max("timestamp")).first()
    step = (hi - lo) / SLICES
    scorer = StreamingScorer(spark, root, artefacts)
    number = F.substring("transaction_id", 2, 20).cast("bigint")
    due = sum((F.when(F.col("timestamp") >= lo + step * i, 1).otherwise(0) for i in range(1, SLICES)), F.lit(0))
    arrives = F.least(F.lit(SLICES - 1), due + F.when(number % 17 == 3, 1).otherwise(0)) if late else due
    for i in range(SLICES):
        part = t.where(arrives == i)
        if i == 0 and warm:
            scorer.warm_start(part)
        else:
            part.repartition(FILES).write.parquet(f"{root}/in/part={i}")
    stream = replay_stream(spark, f"{root}/in/*", schema=t.schema, files_per_trigger=FILES)
    scorer.start(stream, available_now=True).awaitTermination()
    return scorer


@register("stream_features", with_ctes(FEAT, f"SELECT transaction_id, {_ROUNDED} FROM feat"), nudge=True)
def _features(spark, d):
    return _replay(spark, d).results("features").select("transaction_id", *schemas.FEATURES)


@register("stream_warm_start", with_ctes(FEAT, f"""SELECT transaction_id, {_ROUNDED} FROM feat WHERE timestamp >= (SELECT min(timestamp) + (max(timestamp) - min(timestamp)) / {SLICES} FROM txn)"""), nudge=True)
def _warm(spark, d):
    return _replay(spark, d, warm=True).results("features").select("transaction_id", *schemas.FEATURES)


@register("stream_graph_vectors", with_ctes(E + CYCLE + ["as_of"], f"SELECT transaction_id, {', '.join(_AS_OF)}, cycle_length FROM as_of JOIN cycle USING (transaction_id)"))
def _vectors(spark, d):
    return _replay(spark, d).results("vectors").select("transaction_id", *_AS_OF, "cycle_length")


@register("stream_late_rows", with_ctes(["txn"], f"""
, b AS (SELECT min(timestamp) AS lo, (max(timestamp) - min(timestamp)) / {SLICES} AS step FROM txn),
d AS (SELECT t.*, CASE WHEN timestamp >= lo + step * 2 THEN 2 WHEN timestamp >= lo + step THEN 1 ELSE 0 END AS due FROM txn t, b),
a AS (SELECT *, least(2, due + CASE WHEN CAST(substr(transaction_id, 2) AS BIGINT) % 17 = 3 THEN 1 ELSE 0 END) AS slice FROM d)
SELECT t.transaction_id, 1 + count(*) FILTER (WHERE p.sender_account = t.sender_account) AS sender_out_degree,
       count(*) FILTER (WHERE p.receiver_account = t.sender_account) + CASE WHEN t.sender_account = t.receiver_account THEN 1 ELSE 0 END AS sender_in_degree
FROM a t LEFT JOIN a p ON (p.sender_account = t.sender_account OR p.receiver_account = t.sender_account) AND p.slice <= t.slice
 AND (p.timestamp < t.timestamp OR (p.timestamp = t.timestamp AND p.transaction_id < t.transaction_id))
GROUP BY t.transaction_id, t.sender_account, t.receiver_account""".lstrip()))
def _late(spark, d):
    """A late row counts what precedes it and has arrived; later rows count it once it is there."""
    return _replay(spark, d, late=True).results("vectors").select("transaction_id", "sender_out_degree", "sender_in_degree")


@register("stream_scoring")
def _scoring(spark, d):
    """Must equal the batch scores of the same rows; tested against them."""
    t = views.txn(spark, d)
    scorer = _replay(spark, d, scoring.fit_artefacts(t))
    return scorer.results("scored").select("transaction_id", "rule_score", "ensemble_anomaly_score", "gnn_anomaly_score", "transaction_risk_score", "risk_level")


_GAPS = {"txn": f"""SELECT t.* REPLACE (t.timestamp + CASE WHEN g.k = 1 THEN INTERVAL 40 DAY WHEN g.k = 2 THEN INTERVAL 80 DAY ELSE INTERVAL 0 DAY END AS timestamp)
FROM ({views.TXN_SQL}) t JOIN (SELECT event_id, least({SLICES - 1}, CAST(floor((epoch(ts) - lo) * {SLICES} / span) AS INT)) AS k
  FROM events, (SELECT min(epoch(ts)) AS lo, max(epoch(ts)) - min(epoch(ts)) + 1 AS span FROM events)) g ON t.transaction_id = 'T' || lpad(CAST(g.event_id AS VARCHAR), 10, '0')"""}


@register("stream_retention", with_ctes(FEAT, f"SELECT transaction_id, {_ROUNDED} FROM feat", _GAPS), nudge=True)
def _retention(spark, d):
    """Three bursts 40 days apart: rows leave the keyed state by event-time timers before the next one comes, and features are those of the whole history."""
    t = views.txn(spark, d)
    lo, hi = t.agg(F.min(F.unix_seconds("timestamp")), F.max(F.unix_seconds("timestamp"))).first()
    k = F.least(F.lit(SLICES - 1), F.floor((F.unix_seconds("timestamp") - lo) * SLICES / (hi - lo + 1))).cast("int")
    late = t.withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(40 * k))
    return _replay(spark, d, rows=late).results("features").select("transaction_id", *schemas.FEATURES)
