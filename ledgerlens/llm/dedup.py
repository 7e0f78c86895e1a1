"""Near-duplicate groups by MinHash, banded buckets and star-shaped candidates.

1. Each text becomes its set of hashed word shingles and a one-permutation signature. Texts with the
   same set are one class; only classes go on, so exact copies cost nothing more.
2. Classes that share a band of the signature meet in a bucket. In each bucket every class is a
   candidate of the smallest one only, a star: as many pairs as members, never all pairs.
   Candidates are confirmed on the full sets and give a first version of the components.
3. A star can miss a link between two of its points. Buckets whose members are still in
   different components are gone through in blocks of bounded size, on full sets: within a
   block pair only pairs between different components are compared, each confirmed link
   merges two components, and only these links leave the task. Before that, texts go that
   cannot have a partner: those with too few shingles that any other text left has too.

So every pair that shares a bucket is either compared or already known to be in one component.
At the similarity threshold itself a pair shares no bucket with a chance of (1 - t**4)**32:
4e-11 at 0.85, 5e-8 at 0.8, less above. Sets are of 64-bit hashes; two different shingles of
compared texts are taken as equal with a chance of about 1e-13.

Null, empty and wordless texts have an empty set, are linked with nothing and are their own
components. Repeated rows of one document are in one class and stay or go together. Rows without a
doc_id count as larger than any other and stay if no row of the group has one. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import minhash
from ledgerlens.llm.batches import arrow_udf
from ledgerlens.llm.components import components
from ledgerlens.llm.stored import stored

ROWS = 4
#: Classes of one bucket that meet in one task at once: two blocks of so many.
BLOCK = 512

MARKS = "struct<n: bigint, node: binary, bands: array<bigint>>"


def marks(text: Column, words: int) -> Column:
    """Set size, digest of the set, and bucket keys of each whole text."""
    kind = pa.struct([("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    @arrow_udf(MARKS)
    def of(texts: pa.Array) -> pa.Array:
        n, nodes, keys = [], [], []
        for t in texts:
            s = minhash.shingle_set(t.as_py() or "", words)
            n.append(len(s))
            nodes.append(minhash.digest(s) if len(s) else None)
            keys.append(minhash.bands(minhash.signature(s), ROWS).view(np.int64) if len(s) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], fields=list(kind))

    return of(text)


def shingles(text: Column, words: int) -> Column:
    """The set of each whole text, sorted."""

    @arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([minhash.shingle_set(t.as_py() or "", words).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return of(text)


def _links_within(percent: int) -> Callable:
    """Task over one block pair of a bucket: links that join components, confirmed on full sets."""

    def links(key: tuple, cell: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        cell = cell.sort_by("node").combine_chunks()
        nodes, part = cell.column("node").to_pylist(), cell.column("part").to_numpy()
        size, known = cell.column("n").to_numpy(), cell.column("known").to_numpy()
        _, root = np.unique(np.array(cell.column("root").to_pylist(), object), return_inverse=True)
        sets = [np.asarray(s.values) for s in cell.column("shingles")]
        out, last = [], np.arange(len(sets))
        for i in np.flatnonzero(part == first):
            # no more can be shared than what any text left shares with another
            most = np.minimum(np.minimum(known[i], known), np.minimum(size[i], size))
            fit = (100 * most >= percent * (size[i] + size - most)) & (part == second) & (root != root[i])
            for j in np.flatnonzero(fit & (last > i) if first == second else fit):
                if root[j] == root[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    root[root == root[j]] = root[i]
                    out.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return links


def _mixed(labelled: DataFrame, least: int) -> DataFrame:
    """Rows of buckets with at least ``least`` members that are not in one component; of equal buckets only one."""
    found = labelled.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.min("n").alias("least_n"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("content"))
    found = found.filter((F.col("size") >= least) & (F.col("lo") != F.col("hi"))).groupBy("content", "size", "least_n").agg(F.min("bucket").alias("bucket"))
    return labelled.join(found.select("bucket", "size", "least_n"), "bucket")


def groups(docs: DataFrame, words: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) per row of ``docs``.

    ``words`` is the shingle length; two texts are linked if the shared part of their sets' union is at least
    ``percent`` per cent. component_id is the smallest doc_id of the component.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_hash"), marks(body, words).alias("m"))
    rows = stored(rows.select("doc_id", "text_hash", "m.n", "m.node", "m.bands"))
    classes = stored(rows.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    # stars
    members = classes.select("node", "n", F.explode("bands").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    shared = stored(members.join(centres, "bucket"))
    pairs = shared.filter("node <> centre").select("node", "n", "centre").distinct()
    sets = classes.select("node", "text_hash").join(shared.select("node").distinct(), "node", "left_semi")
    source = docs.select(F.xxhash64(body).alias("text_hash"), body.alias("body")).join(sets, "text_hash")
    sets = stored(source.dropDuplicates(["node"]).select("node", shingles(F.col("body"), words).alias("shingles")))
    others = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("others"))
    both = pairs.join(sets, "node").join(others, "centre")
    both = both.filter(F.lit(100) * F.least("n", F.size("others")) >= F.lit(percent) * F.greatest("n", F.size("others")))
    both = both.select("node", "centre", (F.col("n") + F.size("others")).alias("sum"), F.size(F.array_intersect("shingles", "others")).alias("common"))
    links = both.filter(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("sum") - F.col("common")))
    roots = stored(components(links.select(F.col("node").alias("a"), F.col("centre").alias("b"))))

    # what the stars may have missed
    labelled = shared.filter("size > 2").join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    left = stored(_mixed(labelled, 3))  # of two members one is the centre: compared
    again = sets.join(left.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    twice = again.groupBy("shingle").count().filter("count > 1")
    known = again.join(twice, "shingle").groupBy("node").agg(F.count("*").alias("known"))
    # the partner has at least known shingles and at least the fewest of the bucket
    able = left.join(known, "node").filter(
        F.lit(100) * F.col("known") >= F.lit(percent) * (F.col("n") + F.greatest("known", "least_n") - F.col("known")))
    # two that are left of a larger bucket may both be no centre: not compared so far
    able = stored(_mixed(able.select("bucket", "node", "n", "root", "known"), 2))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cells = able.select("*", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = cells.withColumns({"first": F.least("part", "other"), "second": F.greatest("part", "other")}).join(sets, "node")
    new = cells.groupBy("bucket", "first", "second").applyInArrow(_links_within(percent), "a binary, b binary")
    at = roots.select("node", "root")
    new = new.join(at.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(at.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    new = new.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = components(new).select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = classes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    final = final.join(more, "root", "left").select("node", "least", F.coalesce("top", "root").alias("root"))
    named = final.join(final.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = rows.select("doc_id", "text_hash", "n", "node").join(named, "node", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates_removed(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents of which one of each near-duplicate group stays, the one with the smallest id; same columns."""
    found = groups(docs, words, percent, doc_id, text)
    gone = stored(found.filter(~F.equal_null("doc_id", "component_id")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    same = F.equal_null(docs[doc_id], gone["gone_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone["gone_hash"])
    # the list grows with the documents: one plan at every size, never a broadcast
    return docs.join(gone.hint("merge"), same, "left_anti")
