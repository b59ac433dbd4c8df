"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised on centroids of its own; a cell is a pair of
centroids. A query orders cells by the sum of its halves' squared distances to the two centroids:
a heap walks the pairs in that order, and the walk ends when the visited cells hold enough
entries: as many as trial queries, compared with everything, show to be needed for the recall
asked for. The entries of the visited cells are then ranked by their exact distance.

Equal vectors are one entry with their smallest ids (k + 1 of them can matter, no more), and equal
queries are searched once, so copies add no work. An entry is held once. The cells of one centroid
of the first half are dealt to slices by the centroid of the second half, and a cell larger than a
slice is dealt by a hash to slices of its own; a query is sent once to each slice that holds a cell
which it visits, and to no other. Where many queries visit a row of cells they are dealt into chunks,
each of which meets the row's entries by itself, so one task holds a slice and a chunk.

The centroids are fitted on a bounded sample (max_fit vectors, the first by a seeded hash); every
vector is indexed. What is broadcast: the centroids and the cells' sizes, both bounded by the
number of centroids, at most max_centroids per half.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold null
or non-finite components take no part; ties go to the smaller id; fewer candidates than k are all
returned; an empty table gives an empty result; rows that repeat a vec_id count as one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.llm.common import materialise


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part, of one length."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(sound & F.exists("v", lambda x: x != 0))
    rows = materialise(rows, "ann-vectors")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the points by Lloyd's rounds from a seeded draw; empty ones are drawn anew."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, points)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        centres[~full] = points[rng.choice(len(points), int((~full).sum()))]
    return centres


def half_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :])


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([half_distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])


def fit_centroids(entries: DataFrame, k: int, max_fit: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the first and the second halves, from at most max_fit entries."""
    spot = F.xxhash64(F.lit(seed), "v")
    sample = np.array([r[0] for r in entries.select("v").orderBy(spot, "v").limit(max_fit).collect()])
    k, middle = min(k, len(sample)), sample.shape[1] // 2
    return kmeans(sample[:, :middle], k, seed), kmeans(sample[:, middle:], k, seed + 1)


def cells_in_order(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> Iterator[int]:
    """Cells by summed distance until those given hold the wanted number of entries.

    The heap holds the border of the walk: a pair (i, j) of places in the two sorted lists brings
    in (i + 1, j), and, at i = 0, (i, j + 1), so each pair enters once.
    """
    a, b, k = np.argsort(first, kind="stable"), np.argsort(second, kind="stable"), len(second)
    heap, found = [(first[a[0]] + second[b[0]], 0, 0)], 0
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if sizes[cell]:
            found += int(sizes[cell])
            yield cell
        if i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[j]], i + 1, j))
        if i == 0 and j + 1 < k:
            heapq.heappush(heap, (first[a[0]] + second[b[j + 1]], 0, j + 1))


def exact_distances(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order."""
    total = np.zeros((len(queries), len(entries)))
    for i in range(queries.shape[1]):
        total += (queries[:, i][:, None] - entries[:, i][None, :]) ** 2
    return np.sqrt(total)


def matrix_of(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def halves(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = matrix.shape[1] // 2
    return matrix[:, :middle], matrix[:, middle:]


def build_index(entries: DataFrame, centres) -> DataFrame:
    """entries with row and col: the numbers of their halves' centroids."""

    def place(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            if len(pdf):
                x, y = halves(matrix_of(pdf["v"]))
                first, second = centres.value
                yield pdf.assign(row=nearest(x, first).astype(np.int32), col=nearest(y, second).astype(np.int32))

    return materialise(entries.mapInPandas(place, "v array<double>, ids array<long>, row int, col int"), "ann-index")


def entries_needed(index: DataFrame, asked: DataFrame, centres, sizes: np.ndarray, k: int, recall: float, trials: int) -> int:
    """Entries a walk has to collect so that it meets the given share of true neighbours.

    Some queries (at most trials, spread evenly over their hashes) are compared with every entry,
    and each true neighbour tells how much the walk collects up to its cell.
    """
    tried = matrix_of(asked.orderBy(F.xxhash64("v")).limit(trials).select("v").toPandas()["v"])

    def closest(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            held = matrix_of(pdf["v"]) if len(pdf) else np.zeros((0, tried.shape[1]))
            for no, query in enumerate(tried if len(held) else []):
                score = exact_distances(query[None, :], held)[0]
                score[score == 0] = np.inf  # the query's own entry, in which its copies are too
                near = np.argsort(score, kind="stable")[:k]
                near = near[np.isfinite(score[near])]
                yield pd.DataFrame({"no": no, "score": score[near], "row": pdf["row"].to_numpy()[near], "col": pdf["col"].to_numpy()[near]})

    best = F.row_number().over(Window.partitionBy("no").orderBy("score"))
    found = index.mapInPandas(closest, "no int, score double, row int, col int")
    true = found.withColumn("place", best).where(F.col("place") <= k).select("no", "row", "col").collect()
    first, second = centres.value
    x, y = halves(tried)
    left, right = half_distances(x, first), half_distances(y, second)
    needed = []
    for no in range(len(tried)):
        wanted = {r["row"] * len(second) + r["col"] for r in true if r["no"] == no}
        met, upto = 0, {}
        for cell in cells_in_order(left[no], right[no], sizes, int(sizes.sum())):
            met += int(sizes[cell])
            if cell in wanted:
                upto[cell] = met
                if len(upto) == len(wanted):
                    break
        needed += [upto[r["row"] * len(second) + r["col"]] for r in true if r["no"] == no]
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


class Slices:
    """Where entries lie: the slices of a row of cells, numbered from 0, and those of each large cell,
    numbered -1 - col."""

    def __init__(self, sizes: np.ndarray, size: int):
        self.parts = np.maximum(1, -(-sizes // size))  # of each cell
        small = np.where(self.parts == 1, sizes, 0).sum(axis=1)
        self.slices = np.maximum(1, -(-small // size))  # of each row

    def of_entries(self, rows: np.ndarray, cols: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slice and part of entries with these hashes."""
        parts = self.parts[rows, cols]
        return np.where(parts == 1, cols % self.slices[rows], -1 - cols), spots % parts

    def of_cells(self, row: int, cols: list[int]) -> dict[tuple[int, int], list[int]]:
        """The cells of a row by the slice and part that hold them, each part of a large cell."""
        found: dict[tuple[int, int], list[int]] = {}
        for c in cols:
            if self.parts[row, c] == 1:
                found.setdefault((c % int(self.slices[row]), 0), []).append(c)
            else:
                found |= {(-1 - c, p): [c] for p in range(self.parts[row, c])}
        return found


def visits_of(asked: DataFrame, centres, sizes: np.ndarray, slices, wanted: int) -> DataFrame:
    """Per query and slice that holds cells which it visits: asked, v, row, slice, part and cols, these cells."""
    spread = asked.sparkSession.sparkContext.broadcast(sizes)

    def walk(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = centres.value
        sizes = spread.value
        for pdf in found:
            if not len(pdf):
                continue
            x, y = halves(matrix_of(pdf["v"]))
            left, right = half_distances(x, first), half_distances(y, second)
            out = []
            for at in range(len(pdf)):
                rows: dict[int, list[int]] = {}
                for cell in cells_in_order(left[at], right[at], sizes, wanted):
                    rows.setdefault(cell // len(second), []).append(cell % len(second))
                for r, visited in rows.items():
                    out += [(pdf["asked"].iloc[at], pdf["v"].iloc[at], r, s, p, c) for (s, p), c in slices.value.of_cells(r, visited).items()]
            yield pd.DataFrame(out, columns=["asked", "v", "row", "slice", "part", "cols"])

    return asked.repartition("asked").mapInPandas(walk, "asked long, v array<double>, row int, slice int, part int, cols array<int>")


def sliced_index(index: DataFrame, slices) -> DataFrame:
    """index with slice and part of each entry."""

    def place(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            where = slices.value.of_entries(pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["spot"].to_numpy())
            yield pdf.drop(columns="spot").assign(slice=where[0].astype(np.int32), part=where[1].astype(np.int32))

    spotted = index.withColumn("spot", F.pmod(F.xxhash64("v"), F.lit(1 << 31)))
    return spotted.mapInPandas(place, "v array<double>, ids array<long>, row int, col int, slice int, part int")


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    recall: float = 0.96,
    least: int = 4096,
    per_cell: int = 24,
    max_centroids: int = 512,
    max_fit: int = 20_000,
    trials: int = 48,
    slice_size: int = 4096,
    chunk_size: int = 2048,
    seed: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest entries found for every query.

    recall: share of true neighbours that the walks aim at, measured on some trial queries.
    least: entries that a walk collects in any case, so small tables are searched in full.
    per_cell: entries aimed at per cell, which sets the number of centroids. slice_size: entries
    that one task holds of the cells of one centroid of the first half. chunk_size: queries that it
    holds at once.
    """
    rows = usable(vectors)
    ids = rows.select("vec_id", "v").dropDuplicates(["vec_id"])
    # the smallest k + 1 ids of each vector: the limit is taken before the shuffle as well
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = ids.withColumn("place", place).where(F.col("place") <= k + 1)
    entries = materialise(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-entries")
    queries = materialise(ids.where(is_query), "ann-queries")
    asked = materialise(queries.select("v").distinct().withColumn("asked", F.monotonically_increasing_id()), "ann-asked")
    n, spark = entries.count(), vectors.sparkSession
    if n == 0 or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centroids = max(1, min(max_centroids, math.isqrt(n // per_cell)))
    centres = spark.sparkContext.broadcast(fit_centroids(entries, centroids, max_fit, seed))
    index = build_index(entries, centres)
    grid = tuple(len(c) for c in centres.value)
    sizes = np.zeros(grid, np.int64)
    for row, col, size in index.groupBy("row", "col").count().collect():  # at most max_centroids squared
        sizes[row, col] = size
    slices = spark.sparkContext.broadcast(Slices(sizes, slice_size))
    wanted = max(least, entries_needed(index, asked, centres, sizes.ravel(), k, recall, trials))
    visits = materialise(visits_of(asked, centres, sizes.ravel(), slices, wanted), "ann-visits")
    chunks = np.ones(len(sizes), np.int64)
    for row, most in visits.groupBy("row", "slice", "part").count().groupBy("row").agg(F.max("count")).collect():  # at most max_centroids
        chunks[row] = -(-most // chunk_size)
    by_row = lambda numbers: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("row") + 1)
    visits = visits.withColumn("chunk", F.pmod(F.xxhash64("asked"), by_row(chunks)).cast("int"))
    sliced = sliced_index(index, slices).withColumn("chunk", F.explode(F.sequence(F.lit(0), (by_row(chunks) - 1).cast("int"))))

    def rerank(wanting: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(wanting) and len(held):
            held = held.sort_values("col", kind="stable")
            matrix, ids_held, cols = matrix_of(held["v"]), held["ids"].to_numpy(), held["col"].to_numpy()
            for asked_no, v, own in zip(wanting["asked"], wanting["v"], wanting["cols"]):
                at = np.nonzero(np.isin(cols, own))[0]
                if not len(at):
                    continue
                score = exact_distances(np.asarray(v, np.float64)[None, :], matrix[at])[0]
                last = min(k, len(score) - 1)
                edge = np.partition(score, last)[last]
                near = [(float(score[e]), int(i)) for e in np.nonzero(score <= edge)[0] for i in ids_held[at[e]]]
                found += [(asked_no, i, s) for s, i in sorted(near)[: k + 1]]
        return pd.DataFrame(found, columns=["asked", "vec_id", "score"])

    keys = ["row", "slice", "part", "chunk"]
    hits = visits.groupBy(keys).cogroup(sliced.groupBy(keys)).applyInPandas(rerank, "asked long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("asked").orderBy("score", "vec_id"))
    hits = materialise(hits.withColumn("place", best).where(F.col("place") <= k + 1).drop("place"), "ann-hits")
    # equal queries share their hits, each without itself
    mine = queries.select(F.col("vec_id").alias("query_id"), "v").join(asked, "v").select("query_id", "asked")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        mine.join(hits, "asked").where("vec_id != query_id")
        .withColumn("rank", rank).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
