"""Structured Streaming jobs: features, graph vectors, scores and alerts.

Features come from keyed state (``keyed``), which a micro-batch reads only for its own senders and devices. Graph vectors, scores
and alerts are computed by the batch operators inside ``foreachBatch``, on the new rows plus the state tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators import fusion, graph
from ledgerlens.operators.rolling import FeatureConfig, finish, with_defaults
from ledgerlens.plans.scoring import Artefacts, score_rows
from ledgerlens.session import cut_lineage
from ledgerlens.streaming.keyed import LAST_ROWS, RETENTION_DAYS, with_state
from ledgerlens.streaming.state import BatchTable, fold_pairs, record_scores, remove_folders, retained

_PAIRS = "src string, dst string, timestamp timestamp, transaction_id string"
_PEAKS = "community_id long, timestamp timestamp, transaction_id string, transaction_risk_score double"
_MARK = "newest timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass
class StreamingScorer:
    """Scores micro-batches; everything it remembers is under ``root``.

    Outputs are batch folders as well: ``features``, ``vectors``, ``scored``,
    ``alerts`` and ``late``. Other jobs follow the results by streaming from them.

    A row older than the newest time of earlier batches (less ``lateness``) is listed in ``late`` as well;
    it is scored like any other, as of its own time, from what is known of the time before it.
    """
    spark: SparkSession
    root: str
    artefacts: Artefacts | None = None
    cfg: FeatureConfig = field(default_factory=FeatureConfig)
    lateness: str = "0 seconds"
    compact_every: int = 50
    retention_days: int = RETENTION_DAYS
    last_rows: int = LAST_ROWS
    history: DataFrame | None = None

    def __post_init__(self) -> None:
        table = lambda name, ddl: BatchTable(self.spark, f"{self.root}/state/{name}", _schema(ddl))
        self.pairs, self.edges = table("pairs", _PAIRS), table("edges", _PAIRS)
        self.peaks, self.marks = table("peaks", _PEAKS), table("marks", _MARK)

    def output(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _emit(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.output(name)}/batch_id={batch_id}")

    def warm_start(self, history: DataFrame) -> None:
        """Past transactions as the state before the first batch; call it before the first ``start``.

        Senders start with what later features can depend on, written once as a snapshot that the keyed state takes over.
        """
        rows = with_defaults(history).dropDuplicates(["transaction_id"])
        retained(rows, self.retention_days, self.last_rows).write.mode("overwrite").parquet(f"{self.root}/state/history")
        self.history = self.spark.read.schema(rows.schema).parquet(f"{self.root}/state/history")
        self._remember(rows, -1)

    def _remember(self, rows: DataFrame, batch_id: int) -> None:
        edges = graph.build_edges(rows)
        self.edges.write(edges, batch_id)
        self.pairs.write(fold_pairs(edges), batch_id)
        self.marks.write(rows.agg(F.max("timestamp").alias("newest")), batch_id)

    def _late(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Rows older than the newest time seen before, less the allowed lateness."""
        newest = self.marks.before(batch_id).agg(F.max("newest")).first()[0]
        if newest is None:
            return rows.limit(0)
        return rows.where(F.col("timestamp") < F.lit(newest) - F.expr(f"INTERVAL {self.lateness}"))

    def graph_vectors(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Degrees of the new edges from the dated edges of their ends, cycles from the earliest edge of each pair."""
        edges = graph.build_edges(rows)
        past = self.pairs.before(batch_id)  # a pair may stand in several folders; its earliest edge counts in the end
        ends = edges.select(F.col("src").alias("a")).union(edges.select(F.col("dst").alias("a"))).distinct()
        at = lambda df, key, ids: df.join(ids, F.col(key) == F.col("a"), "left_semi")
        log = self.edges.before(batch_id)
        near = at(log, "src", ends).union(at(log, "dst", ends)).distinct()
        # a return path of up to three edges starts at a receiver, ends at a sender,
        # and its middle edge joins the two neighbourhoods
        firsts = at(past, "src", edges.select(F.col("dst").alias("a")).distinct())
        lasts = at(past, "dst", edges.select(F.col("src").alias("a")).distinct())
        # new edges lead on as well
        heads = firsts.select(F.col("dst").alias("a")).union(edges.select(F.col("dst").alias("a"))).distinct()
        tails = lasts.select(F.col("src").alias("a")).union(edges.select(F.col("src").alias("a"))).distinct()
        middle = at(at(past, "src", heads), "dst", tails)
        around = cut_lineage(fold_pairs(firsts.union(lasts).union(middle).union(at(past, "src", ends)).union(at(past, "dst", ends))))
        art = self.artefacts
        return graph.look_up_graph(
            edges, graph.as_of_degrees(edges, self.cfg.slot_seconds, near), graph.cycle_closure(edges, earlier=around),
            art.graph_features if art else None, art.community_risk if art else None)

    def _alerts(self, scored: DataFrame, batch_id: int) -> DataFrame:
        """Alerts with the running community maximum, over the alerts of earlier batches that precede each one."""
        new = cut_lineage(fusion.create_alerts(scored))
        past = self.peaks.before(batch_id).join(new.select("community_id").distinct(), "community_id", "left_semi")
        every = fusion.group_risk(new.unionByName(past, allowMissingColumns=True))
        return every.join(new.select("transaction_id"), "transaction_id", "left_semi")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of rows with their window aggregates: list late rows, score all, emit, remember."""
        # the stateful plan runs once, for this folder
        self._emit(batch, "arrived", batch_id)
        rows = self.spark.read.schema(batch.schema).parquet(f"{self.output('arrived')}/batch_id={batch_id}")
        self._emit(self._late(with_defaults(rows), batch_id), "late", batch_id)
        self._emit(finish(rows, self.cfg), "features", batch_id)
        vectors = cut_lineage(self.graph_vectors(rows, batch_id))
        self._emit(vectors, "vectors", batch_id)
        if self.artefacts is not None:
            feats = self.spark.read.parquet(f"{self.output('features')}/batch_id={batch_id}")
            scored = cut_lineage(score_rows(with_defaults(rows), feats, vectors, self.artefacts))
            self._emit(scored, "scored", batch_id)
            alerts = cut_lineage(self._alerts(scored, batch_id))
            self._emit(alerts, "alerts", batch_id)
            self.peaks.write(alerts, batch_id)
        self._remember(rows, batch_id)
        remove_folders(self.spark, self.output("arrived"), batch_id)
        if self.compact_every and batch_id % self.compact_every == self.compact_every - 1:
            self.pairs.compact(batch_id, fold_pairs)
            self.edges.compact(batch_id, lambda edges: edges)
            self.peaks.compact(batch_id, record_scores)
            self.marks.compact(batch_id, lambda marks: marks.agg(F.max("newest").alias("newest")))

    def start(self, stream: DataFrame, *, available_now: bool = False, every: str = "5 seconds") -> StreamingQuery:
        """Start, or go on from the checkpoint under ``root``."""
        conf = self.spark.conf
        before = conf.get(_PROVIDER)
        conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # read when a query starts
        try:
            writer = (with_state(stream, self.history, self.retention_days, self.last_rows).writeStream.outputMode("append").foreachBatch(self.process)
                      .option("checkpointLocation", f"{self.root}/checkpoint"))
            return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
        finally:
            conf.set(_PROVIDER, before)

    def results(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.output(name)).drop("batch_id")


def ordered_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Watermarked stream without repeated ids, for sources that may resend."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["transaction_id"])


def result_feed(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """Stream of scored rows or alerts for any number of subscribers."""
    return spark.readStream.schema(schema).parquet(f"{root}/{name}/*")
