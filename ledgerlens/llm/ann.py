"""Approximate nearest neighbours by inner product over balanced posting lists.

* Equal vectors are one class: its smallest ids are all that a list of nearest rows can show, so copies cost nothing.
* Inner product becomes distance by one more component, sqrt(M * M - |v| * |v|) with M the largest norm (0 for queries).
* Balanced lists: a first sample is halved along the line between two means until there are as many cells as the root of the number of lists; in each
  cell, a sample of its own is halved on. Lists hold about ``LIST`` classes; their number grows with the table until the
  centroids fill ``CENTROID_VALUES`` floats, the bound of what is broadcast. From there on lists grow and are read in parts.
* A class goes to its nearest list and, near a boundary, to the next ones too (distance ratio ``COPY_RATIO``, ``COPIES`` at most).
* Lists are found by best-first search in a graph of the centroids that starts from one list of each cell.
* A query reads the lists whose distance is within a ratio of the nearest one's, and enough of them to hold the rows asked for. The
  ratio is fitted on the first sample: the least with which ``FOUND`` of the sample's own nearest rows are read.
* Lists that stand side by side are a shelf. Shelves and their queries meet in Spark by (shelf, part, query part), each of bounded
  size; a query is sent once for all its lists of a shelf and gets one short answer. Scores are sums in double precision, component
  after component, so that the same pair has the same score wherever it meets.

Only the fit of lists and ratio looks at samples (``SAMPLE`` classes, ``CELL_SAMPLE`` a cell); every row is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
id, nor vectors of another length than the most frequent one (of equally frequent ones the longest). Rows that repeat id and vector count
once; an id with several vectors is searched for each, never among its own. Equal scores are ordered by id. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.stored import stored

K = 20
LIST = 256
CENTROID_VALUES = 8_000_000
SAMPLE, CELL_SAMPLE = 8_192, 8_192
LINKS = 24
COPIES, COPY_RATIO = 4, 1.03
FOUND, TRIED = 0.95, 256
#: Lists of a shelf; values of a shelf's part, and queries of a part, that one task holds; scores computed at a time.
SHELF, PART_VALUES, QUERY_PART, SCORES = 16, 1 << 20, 1_024, 1 << 21
#: Rows searched at once in the graph.
ROWS = 512
#: Classes scored exactly beyond those asked for, and values that one such step gathers.
SPARE, EXACT_VALUES = 8, 2_000_000


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` and ``c``."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def balanced(points: np.ndarray, k: int) -> np.ndarray:
    """Means of ``k`` groups of nearly equal size: halved along the line between two means, then moved a little."""
    groups, ready = [(points, min(k, len(points)))], []
    while groups:
        own, n = groups.pop()
        if n == 1:
            ready.append(own.mean(axis=0))
            continue
        far = own[_distances(own, own.mean(axis=0)[None])[:, 0].argmax()]
        two = np.stack([far, own[_distances(own, far[None])[:, 0].argmax()]])
        for _ in range(5):
            second = _distances(own, two).argmin(axis=1) == 1
            if second.all() or not second.any():
                break
            two = np.stack([own[~second].mean(axis=0), own[second].mean(axis=0)])
        along = np.argsort(own @ (two[1] - two[0]), kind="stable")
        at = len(own) * (n // 2) // n
        groups += [(own[along[:at]], n // 2), (own[along[at:]], n - n // 2)]
    means = np.array(ready, np.float32)
    for _ in range(3):
        nearest = _distances(points, means).argmin(axis=1)
        filled, size = np.unique(nearest, return_counts=True)
        sums = np.zeros_like(means)
        np.add.at(sums, nearest, points)
        means[filled] = sums[filled] / size[:, None]
    return means


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that makes nearness a distance; ``top`` is the largest squared norm."""
    v = np.asarray(v, np.float64)
    return np.hstack([v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))[:, None]]).astype(np.float32)


@dataclass
class Lists:
    """Centroids, their graph, and how far a query looks."""
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    top: float
    ratio: float = 1.0

    @classmethod
    def of(cls, centroids: np.ndarray, cell: np.ndarray, top: float) -> Lists:
        """Links of each list: the nearest ones among the eight nearest cells, and its neighbours in cell order, so that all are reached."""
        order = np.argsort(cell, kind="stable")
        centroids, cell = centroids[order], cell[order]
        n = len(centroids)
        cells, first = np.unique(cell, return_index=True)
        middles = np.stack([centroids[cell == c].mean(axis=0) for c in cells])
        graph = np.empty((n, LINKS + 2), np.int32)
        for i, c in enumerate(cells):
            own = np.flatnonzero(cell == c)
            near = np.flatnonzero(np.isin(cell, cells[_distances(middles[i : i + 1], middles)[0].argsort()[:8]]))
            by = near[_distances(centroids[own], centroids[near]).argsort(axis=1)[:, :LINKS]]
            graph[own] = own[:, None]
            graph[own, : by.shape[1]] = by
        graph[:, -2], graph[:, -1] = (np.arange(n) + 1) % n, (np.arange(n) - 1) % n
        return cls(centroids, graph, first, top)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest lists that a best-first search meets, nearest first, and their squared distances."""
        n, ef = len(self.centroids), min(ef, len(self.centroids))
        if ef == n:
            d = _distances(q, self.centroids)
            beam = d.argsort(axis=1, kind="stable")
            return beam, np.take_along_axis(d, beam, 1)
        rows = np.arange(len(q))[:, None]
        lengths, own = (self.centroids * self.centroids).sum(1), (q * q).sum(1)[:, None]
        seen = np.zeros((len(q), n), bool)
        beam = np.broadcast_to(self.entries, (len(q), len(self.entries)))
        d = _distances(q, self.centroids[self.entries])
        seen[:, self.entries] = True
        opened = np.zeros(beam.shape, bool)
        while True:
            keep = d.argsort(axis=1, kind="stable")[:, :ef]
            beam, d, opened = beam[rows, keep], d[rows, keep], opened[rows, keep]
            closed = np.where(opened, np.inf, d)
            pick = closed.argsort(axis=1, kind="stable")[:, :4]
            live = np.isfinite(np.take_along_axis(closed, pick, 1))
            if not live.any():
                return beam, d
            opened[rows, pick] = True
            nxt = np.where(live[:, :, None], self.graph[beam[rows, pick]], beam[rows, pick][:, :, None]).reshape(len(q), -1)
            nxt.sort(axis=1)
            new = ~seen[rows, nxt]
            new[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
            seen[rows, nxt] = True
            far = own - 2 * np.einsum("id,ijd->ij", q, self.centroids[nxt]) + lengths[nxt]
            far = np.where(new, np.maximum(far, 0), np.inf)
            beam, d = np.hstack([beam, nxt]), np.hstack([d, far])
            opened = np.hstack([opened, ~new])

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of each lifted vector (rows x COPIES) and which of them it goes to; the first always."""
        beam, d = self.search(x, 2 * LINKS)
        beam, d = beam[:, :COPIES], d[:, :COPIES]
        take = d <= COPY_RATIO**2 * d[:, :1]
        take[:, 0] = True
        return beam, take

    def fitted(self, sample: np.ndarray) -> Lists:
        """These lists with the least ratio that reads ``FOUND`` of the nearest rows within ``sample`` (vectors as they are)."""
        x = lifted(sample, self.top)
        homes, take = map(np.concatenate, zip(*[self.homes(x[i : i + ROWS]) for i in range(0, len(x), ROWS)]))
        tried = sample[:: max(1, len(sample) // TRIED)].astype(np.float64)
        near = np.argsort(-(tried @ sample.T.astype(np.float64)), axis=1)[:, 1 : K + 1]
        d = np.sqrt(_distances(np.hstack([tried, np.zeros((len(tried), 1))]).astype(np.float32), self.centroids))
        there = np.where(take[near], d[np.arange(len(tried))[:, None, None], homes[near]], np.inf).min(axis=2)
        needed = np.sort((there / np.maximum(d.min(axis=1), 1e-12)[:, None]).ravel())
        ratio = needed[math.ceil(FOUND * len(needed)) - 1] if len(needed) else 1.0
        return Lists(self.centroids, self.graph, self.entries, self.top, float(ratio) * (1 + 1e-6))

    def lists_of(self, q: np.ndarray, holds: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the lists to read: those within the ratio, and as many as hold ``least`` rows (``holds`` a list)."""
        ready: list = [None] * len(q)
        open_, ef = np.arange(len(q)), 64
        while len(open_):
            beam, d = self.search(q[open_], ef)
            wanted = d <= self.ratio**2 * d[:, :1]
            before = np.cumsum(holds[beam], axis=1) - holds[beam]
            wanted |= before < least
            done = ~wanted[:, -1] | (beam.shape[1] == len(self.centroids))
            for i in np.flatnonzero(done):
                ready[open_[i]] = beam[i, : int(wanted[i].sum())]
            open_, ef = open_[~done], 2 * ef
        return iter(ready)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vectors: DataFrame, key: str, vector: str, queries: F.Column) -> tuple[DataFrame, int]:
    """(id, v, asked) of the rows that take part, without repeats, and the length of their vectors (0: there are none)."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), queries.alias("asked")).where("id IS NOT NULL AND size(v) > 0")
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~wrong & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths[0] if lengths else 0
    return rows.where(F.size("v") == dim).groupBy("id", "v").agg(F.max("asked").alias("asked")), dim


def classes(rows: DataFrame, k: int = K) -> DataFrame:
    """(rep, ids, v): distinct vectors with their smallest ``k + 1`` ids; which is limited before rows meet."""
    w = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", 0).alias("rep"), "ids", "v")


def fit(found: DataFrame, dim: int) -> Lists:
    """Lists for the classes ``found``, which holds one at least."""
    spark = found.sparkSession
    total, top = found.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    n = max(1, min(math.ceil(total / LIST), CENTROID_VALUES // (dim + 1)))
    drawn = F.xxhash64("rep", F.lit(1))
    sample = np.array([r[0] for r in found.orderBy(drawn, "rep").limit(SAMPLE).select("v").collect()], np.float64).reshape(-1, dim)
    coarse = spark.sparkContext.broadcast(balanced(lifted(sample, top), max(1, round(math.sqrt(n)))))

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lifted(_matrix(batch["v"], dim), top)
            cell = np.concatenate([_distances(x[i : i + ROWS], coarse.value).argmin(axis=1) for i in range(0, len(x), ROWS)] or [np.empty(0)])
            yield pa.record_batch({"cell": pa.array(cell, pa.int32()), "rep": batch["rep"], "v": batch["v"]})

    kind = found.schema["v"].dataType.simpleString()
    cells = stored(found.select("rep", "v").mapInArrow(in_cells, f"cell int, rep long, v {kind}"))
    shares = {r["cell"]: max(1, round(n * r["count"] / total)) for r in cells.groupBy("cell").count().collect()}

    def halves(cell: pa.Table) -> pa.Table:
        one = cell["cell"][0].as_py()
        means = balanced(lifted(_matrix(cell["v"].combine_chunks(), dim), top), shares[one])
        return pa.table({"cell": pa.array([one] * len(means), pa.int32()), "c": pa.array(list(means), pa.list_(pa.float32()))})

    w = Window.partitionBy("cell").orderBy(drawn, "rep")
    own = cells.withColumn("r", F.row_number().over(w)).where(F.col("r") <= CELL_SAMPLE).drop("r")
    means = own.groupBy("cell").applyInArrow(halves, "cell int, c array<float>").orderBy("cell", "c").collect()
    return Lists.of(np.array([r["c"] for r in means], np.float32), np.array([r["cell"] for r in means]), top).fitted(sample)


def postings(found: DataFrame, lists: Lists, dim: int) -> DataFrame:
    """(shelf, list, first, rep, ids, v): every class in each of its lists; ``first`` marks the nearest."""
    index = found.sparkSession.sparkContext.broadcast(lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                homes, take = index.value.homes(lifted(_matrix(part["v"], dim), index.value.top))
                row, copy = np.nonzero(take)
                home = homes[row, copy]
                yield pa.record_batch({
                    "shelf": pa.array(home // SHELF, pa.int32()), "list": pa.array(home, pa.int32()), "first": pa.array(copy == 0),
                    **{c: part[c].take(pa.array(row)) for c in ("rep", "ids", "v")}})

    kind = found.schema["v"].dataType.simpleString()
    return found.select("rep", "ids", "v").mapInArrow(place, f"shelf int, list int, first boolean, rep long, ids array<long>, v {kind}")


def probes(asked: DataFrame, lists: Lists, holds: np.ndarray, least: int, dim: int) -> DataFrame:
    """(shelf, q, lists, v): every distinct query vector with the lists that it reads of each shelf."""
    index = asked.sparkSession.sparkContext.broadcast((lists, holds))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                v = _matrix(part["v"], dim)
                read = [np.sort(r) for r in own.lists_of(np.hstack([v, np.zeros((len(v), 1))]).astype(np.float32), held, least)]
                row, every = np.repeat(np.arange(len(v)), [len(r) for r in read]), np.concatenate(read).astype(np.int32)
                shelf = every // SHELF
                start = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(shelf, prepend=-1))
                at = pa.array(row[start])
                yield pa.record_batch({
                    "shelf": pa.array(shelf[start], pa.int32()), "q": part["q"].take(at),
                    "lists": pa.ListArray.from_arrays(np.append(start, len(every)).astype(np.int32), pa.array(every)), "v": part["v"].take(at)})

    kind = asked.schema["v"].dataType.simpleString()
    return asked.select("q", "v").mapInArrow(look, f"shelf int, q long, lists array<int>, v {kind}")


def nearest_in_part(k: int, dim: int):
    """Compare the queries of a part with the classes of the lists that each reads: its best ``k`` classes, with exact scores."""

    def best_of(q: np.ndarray, read: np.ndarray, v: np.ndarray, lists: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, row, score) of the best rows of each query; ``read`` (queries x lists of the shelf) says what it reads."""
        scores = np.where(read[:, lists], q @ v.T, -np.inf)
        # a class may stand in several lists of the shelf
        width = min(k * COPIES + SPARE, len(v))
        # the product's own rounding must not decide: what is within it is scored exactly
        slack = 1e-12 * np.sqrt((q * q).sum(1) * (v * v).sum(1).max())
        deep = min(k * COPIES, len(v))
        bound = np.partition(scores, -deep, axis=1)[:, -deep] - slack
        tied = ((scores >= bound[:, None]) & np.isfinite(scores)).sum(axis=1) > width
        out = []
        step = max(1, EXACT_VALUES // (width * dim))
        plain = np.flatnonzero(~tied)
        for i in [plain[j : j + step] for j in range(0, len(plain), step)] + [np.array([j]) for j in np.flatnonzero(tied)]:
            at = np.argpartition(scores[i], -width, axis=1)[:, -width:] if not tied[i[0]] else np.flatnonzero(scores[i[0]] >= bound[i[0]])[None]
            exact = np.zeros(at.shape)
            for j in range(dim):
                exact += q[i, j, None] * v[at, j]
            exact[np.isneginf(np.take_along_axis(scores[i], at, 1))] = -np.inf
            order = np.lexsort((rep[at], -exact))
            at, exact = np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)
            new = np.isfinite(exact)
            new[:, 1:] &= rep[at[:, 1:]] != rep[at[:, :-1]]
            row, col = np.nonzero(new & (new.cumsum(axis=1) <= k))
            out.append((i[row], at[row, col], exact[row, col]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            q, v = (_matrix(t["v"].combine_chunks(), dim).astype(np.float64) for t in (asked, held))
            rep, lists = held["rep"].to_numpy(), held["list"].to_numpy() % SHELF
            wanted = asked["lists"].combine_chunks()
            read = np.zeros((len(q), SHELF), bool)
            read[np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy() % SHELF] = True
            step = max(1, SCORES // len(v))
            for i in range(0, len(q), step):
                row, at, score = best_of(q[i : i + step], read[i : i + step], v, lists, rep)
                out.append((row + i, at, score))
        row, at, score = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"q": asked["q"].take(pa.array(row)), "rep": held["rep"].take(pa.array(at)), "ids": held["ids"].take(pa.array(at)), "score": score})

    return compare


def _parts(sizes: DataFrame, name: str, most: int) -> DataFrame:
    return sizes.groupBy("shelf").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("int").alias(name))


def neighbours(vectors: DataFrame, queries: F.Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, <key>, score): the ``k`` nearest rows found for every row that meets the condition ``queries``."""
    spark = vectors.sparkSession
    empty = f"query_id long, rank int, {key} long, score double"
    rows, dim = usable(vectors, key, vector, queries)
    if not dim:
        return spark.createDataFrame([], empty)
    rows = stored(rows)
    found = stored(classes(rows, k))
    searched = rows.where("asked").select("id", "v")
    asked = stored(searched.groupBy("v").agg(F.min("id").alias("q")))
    lists = fit(found, dim)
    held = stored(postings(found, lists, dim))
    holds = np.zeros(len(lists.centroids), np.int64)
    for r in held.where("first").groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        holds[r["list"]] = r["n"]
    sought = stored(probes(asked, lists, holds, k + 1, dim))

    # a long shelf, or one that many queries read, is compared in a grid of parts of bounded size
    grid = F.broadcast(_parts(sought, "q_parts", QUERY_PART).join(_parts(held, "parts", max(1, PART_VALUES // dim)), "shelf"))  # a row a shelf
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(2)), F.col(n)).cast("int")
    left = sought.join(grid, "shelf").select("shelf", dealt("q", "q_parts").alias("q_part"), spread("parts").alias("part"), "q", "lists", "v")
    right = held.join(grid, "shelf").select("shelf", spread("q_parts").alias("q_part"), dealt("rep", "parts").alias("part"), "list", "rep", "ids", "v")
    by = ["shelf", "q_part", "part"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(nearest_in_part(k + 1, dim), "q long, rep long, ids array<long>, score double")

    # one shuffle by query: a class stands in COPIES lists at most, so the best rows hold the best classes
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    few = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= (k + 1) * COPIES)
    few = few.groupBy("q", "rep").agg(F.first("ids").alias("ids"), F.first("score").alias("score"))
    few = few.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    singly = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    few = few.select("q", "score", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(singly)).where(F.col("r") <= k + 1)
    top = few.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("near"))
    answers = searched.join(asked.join(top, "q"), "v").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    each = answers.select(F.col("id").alias("query_id"), F.posexplode("near").alias("rank", "x"))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), (0.0 - F.col("x.far")).alias("score"))
