"""Arrow functions over texts, in batches that bound a Python worker's memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Rows of a batch at most; a session's own lower limit stays.
ROWS = 500
KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_udf(kind: str) -> Callable:
    """``F.arrow_udf`` whose session deals rows out in small batches: texts may be long, and workers are reused."""
    conf = SparkSession.active().conf
    if not 0 < int(conf.get(KEY)) <= ROWS:
        conf.set(KEY, str(ROWS))
    return F.arrow_udf(kind)
