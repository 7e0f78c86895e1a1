"""Interaction of document filters: what each of several filters removes in every order they may run in.

A document is a mask of the filters it fails. Masks are counted per part by Spark first, so that what
follows does not grow with the documents: at most two to the power of the filters' number of masks a part. Per part, the
mask matrix (masks x filters: 0 where failed, infinite elsewhere) is combined with the position
matrix (filters x orders: the inverse of each permutation) by the min-plus product: the smallest sum is the step at
which the mask is removed. Counts are scattered to (order, step) by that step.

Defined results: a null text is empty; a null part is the empty string; repeated rows count as often as they stand.
Of several label rows of one document the largest value of each column counts; a document without labels, or with
null ones, is neither good nor toxic. A row without ``doc_id`` is a copy of nothing and nothing is a copy of it; it has no labels. Rows of one
``doc_id`` are no copies of each other. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: The capital letters counted by filter C, and the characters that filter D looks for.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
COPIED = 1 << FILTERS.index("E")
#: Counted weights of a mask: all its documents, the good and the toxic ones.
WEIGHTS = ["n", "good", "toxic"]


def text_failures(text: F.Column) -> F.Column:
    """Bits of filters A to D that a whole text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    chars, n = F.length(text).cast("long"), F.size(words).cast("long")
    capitals = chars - F.length(F.translate(text, CAPITALS, ""))
    fails = [n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n, 100 * capitals > 3 * chars, F.rlike(text, F.lit(SYMBOLS))]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by what they fail.

    Texts leave the scan as digests. Rows meet by ``doc_id`` once; copies are then counted before they meet by digest, where the
    smallest id of a text decides which of its rows are copies.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), text_failures(F.col("text")).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(*[
        F.coalesce(F.max((F.col(label) == 1).cast("long")), F.lit(0)).alias(mark) for label, mark in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks, rows.doc_id == marks.labelled, "left").na.fill(0, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    each = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    # rows of one kind: all, those with an id, and the smallest id with its rows
    counted = each.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = counted.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    counted = counted.join(least, "digest")
    copies = F.col("named") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    sides = F.array(F.struct(F.col("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + COPIED).alias("mask"), copies.alias("n")))
    split = counted.select("part", "good", "toxic", F.inline(sides)).where("n > 0")
    return split.groupBy("part", "mask").agg(*[
        F.sum(w).cast("long").alias(name) for w, name in ((F.col("n"), "n"), (F.col("good") * F.col("n"), "good"), (F.col("toxic") * F.col("n"), "toxic"))])


def orders(filters: str) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and the position matrix (filters x orders): the step, from 1, at which each filter runs."""
    every = ["".join(p) for p in itertools.permutations(filters)]
    return every, np.array([[order.index(f) + 1 for order in every] for f in filters])


def removal_steps(mask: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Min-plus product (masks x orders): the step that removes each mask; infinite for the empty mask."""
    failed = np.where(mask[:, None] >> np.arange(len(position)) & 1, 0.0, np.inf)
    steps = np.full((len(mask), position.shape[1]), np.inf)
    for one in range(len(position)):
        np.minimum(steps, failed[:, one, None] + position[one], out=steps)
    return steps


def interactions(counted: pd.DataFrame, filters: str) -> pd.DataFrame:
    """Rows (filter_order, step, counts) of one part from its masks (mask, n, good, toxic)."""
    names, position = orders(filters)
    mask, weight = counted["mask"].to_numpy(np.int64), counted[WEIGHTS].to_numpy(np.int64)
    steps, width, many = removal_steps(mask, position), len(filters), len(names)
    gone = np.isfinite(steps)
    row, order = np.nonzero(gone)
    removed = np.zeros((many, width, len(WEIGHTS)), np.int64)
    np.add.at(removed, (order, steps[gone].astype(int) - 1), weight[row])
    at = np.argsort(position, axis=0).T  # orders x steps: which filter runs
    redundant = np.zeros((many, width), np.int64)
    for one in range(width):
        fails = mask >> one & 1 == 1
        redundant[np.arange(many), position[one] - 1] = (weight[fails, 0, None] * (steps[fails] < position[one])).sum(axis=0)
    alone = np.array([weight[mask == 1 << one, 0].sum() for one in range(width)])
    own = np.zeros(width, np.int64)
    np.add.at(own, at, removed[:, :, 0])
    return pd.DataFrame({
        "filter_order": np.repeat(names, width), "step": np.tile(np.arange(1, width + 1), many).astype(np.int32),
        "kept": (weight[:, 0].sum() - removed[:, :, 0].cumsum(axis=1)).ravel(), "removed": removed[:, :, 0].ravel(), "redundant": redundant.ravel(),
        "unique_fails": alone[at].ravel(), "good_lost": removed[:, :, 1].ravel(), "toxic_lost": removed[:, :, 2].ravel(), "shapley": own[at].ravel()})


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from counted masks (part, mask, n, good, toxic); bit i of a mask is filter i.

    A part's masks are one group: at most 2 ** len(filters) rows, whatever the number of documents.
    """
    if not 0 < len(filters) <= 7 or len(set(filters)) < len(filters):
        raise ValueError(f"1 to 7 different filters, as all {math.factorial(len(filters))} orders are listed")

    def of(part: pd.DataFrame) -> pd.DataFrame:
        return interactions(part, filters).assign(part=part["part"].iloc[0])

    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "filter_order string, step int, " + ", ".join(f"{c} long" for c in counts) + ", part string"
    return counted.groupBy("part").applyInPandas(of, schema).select("part", "filter_order", "step", *counts)
