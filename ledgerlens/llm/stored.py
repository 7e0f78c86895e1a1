"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ledgerlens.session import shared_dir


def stored(df: DataFrame) -> DataFrame:
    """Write a table once as Parquet below ``spark.checkpoint.dir`` and read it back: the lineage ends there.

    Lost executors cost nothing that is written. Such tables are left to the folder's own clean-up.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
