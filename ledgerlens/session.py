"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def build_session(app: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; extra settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files go away together with the DataFrames that use them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All calendar features are defined in UTC.

    Generated code of over 8,000 bytes a method is never compiled by the JVM: wide projections are generated in small methods instead.
    """
    if spark.conf.get(_METHOD_LIMIT) != "8000":
        spark.conf.set(_METHOD_LIMIT, "8000")
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A private temporary folder is used only when the session is one process
    (``local`` or ``local[...]``, not ``local-cluster[...]``) and names no folder, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="ledgerlens-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """The rows as a table bucketed by ``key`` in the shared folder: joins on the key move only the other side.

    A checkpoint forgets how its rows are partitioned, a bucketed table does not. Table and files go at the
    end of the block, so what is made from them has to be checkpointed inside.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
