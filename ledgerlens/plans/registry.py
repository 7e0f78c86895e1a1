"""Registered queries: a DataFrame plan and, where possible, equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans import views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    """``plan`` is the operator's own result, ``query`` its comparable form."""
    plan: Query
    query: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def present(df: DataFrame, digits: int = 4, nudge: bool = False, **special: int) -> DataFrame:
    """Comparable output: doubles rounded, lists joined, times as microseconds.

    ``nudge`` adds a thousandth of the last digit first (as the SQL then does), so
    that exact decimal ties do not depend on how an engine rounds halves.
    """
    cols = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            # adding 0.0 turns a rounded -0.0 into 0.0
            places = special.get(f.name, digits)
            c = F.round(c.cast("double") + (10.0 ** -(places + 3) if nudge else 0.0), places) + 0.0
        elif kind == "array":
            c = F.array_join(c, "|")
        elif kind == "timestamp":
            c = F.unix_micros(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, digits: int = 4, nudge: bool = False, **special: int):
    """Register a plan under a name; its output is made comparable."""
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir), digits, nudge, **special)
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(fn, run, sql)
        return fn
    return wrap


CTES: dict[str, str] = {
    "txn": views.TXN_SQL,
    "ledger": views.LEDGER_SQL,
    "truth": views.TRUTH_SQL,
    "scored": views.SCORED_SQL,
    "stored": views.STORED_SQL,
    "alerts": views.ALERTS_SQL,
}


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    table = {**CTES, **(extra or {})}
    parts = ",\n".join(f"{n} AS MATERIALIZED ({table[n]})" for n in names)
    return f"WITH RECURSIVE {parts}\n{body}"
