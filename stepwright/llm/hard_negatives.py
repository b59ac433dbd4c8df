"""Hard negatives by dual-tree search over whole-number inner products.

Anchors are a query set, dealt to blocks; all rows are candidates, dealt to shards. Each pair of a
block and a shard is searched in one task with a tree over the block's anchors and one over the
shard's candidates. A node holds the box and the ball of its vectors; for two nodes the products
of their members lie in an interval that both give. A pair of nodes is left when the interval
lies below what all anchors of the node have already found, or outside what they still look for,
so whole groups of anchors go at once; pairs of leaves are scored exactly. Each task sends the few
best of each anchor on, and the best of all shards are theirs.

Two searches run: the positives (same label, best first), then for each positive the negatives
(other label, in the interval that its score sets, best first). Trees are split by label first,
so nodes whose labels cannot count for each other are left at once.

Vectors are whole numbers and products are exact: in doubles while no sum can pass 2**53, else
in 64-bit integers.

Defined cases: rows with a null label, id or vector, or with a null or non-finite component take
no part, nor do those with a component of 2**27 or more in size once scaled, whose products could
pass 64 bits; a vector of another length than most is compared with vectors of its own length
only; an empty vector scores 0; rows that repeat an id are rows of their own, each an anchor and
each a candidate for the other; an anchor without positives, or a positive without negatives in
its interval, gives no rows; an empty table gives an empty result; columns beside vec_id,
embedding and label are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.llm.common import materialise, settle

#: Vectors in a leaf, in a shard of candidates and in a block of anchors: bounds of a task's memory.
LEAF, SHARD, BLOCK = 64, 1 << 15, 1 << 12
#: Components from this size on are not taken.
MOST = 2**27
#: anchor: the anchor's row; place: the positive's rank among the anchor's.
POSITIVES = "anchor long, positive_id long, score long"
NEGATIVES = "anchor long, anchor_id long, place int, positive_id long, negative_id long, positive_score long, negative_score long"


# -- trees


class Tree:
    """Nodes over vectors: members' range, box, ball and label (None where they differ).

    Nodes are split by label, then at the median of the axis of the widest spread. A leaf has
    several labels only if it has less than a quarter of LEAF for each of them.
    """

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        self.order = np.argsort(labels, kind="stable")
        self.low, self.high, self.centre, self.radius, self.norm = [], [], [], [], []
        self.range: list[tuple[int, int]] = []
        self.label: list[int | None] = []
        self.children: list[tuple[int, ...]] = []
        self.vectors, self.labels = vectors, labels
        self._build(0, len(vectors))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.centre, self.radius, self.norm = np.array(self.centre), np.array(self.radius), np.array(self.norm)
        self.vectors, self.labels = vectors[self.order], labels[self.order]

    def _build(self, a: int, b: int) -> int:
        todo = [(a, b, -1)]
        while todo:
            a, b, parent = todo.pop()
            rows = self.order[a:b]
            v, y = self.vectors[rows], self.labels[rows]
            me = len(self.range)
            if parent >= 0:
                self.children[parent] += (me,)
            low, high, centre = v.min(0), v.max(0), v.mean(0)
            self.low.append(low)
            self.high.append(high)
            self.centre.append(centre)
            self.radius.append(np.sqrt(((v - centre) ** 2).sum(1)).max())
            self.norm.append(np.sqrt((centre**2).sum()))
            self.range.append((a, b))
            self.children.append(())
            pure = bool((y == y[0]).all())
            self.label.append(int(y[0]) if pure else None)
            borders = a + np.flatnonzero(y[1:] != y[:-1]) + 1  # of a mixed node, whose rows are in the order of labels
            if b - a <= LEAF and (pure or 4 * (b - a) < LEAF * (len(borders) + 1)):
                continue
            if pure:
                axis = int((high - low).argmax())
                middle = (b - a) // 2
                self.order[a:b] = rows[np.argpartition(v[:, axis], middle)]
                cut = a + middle
            else:  # the border between labels that is nearest to the middle
                cut = int(borders[np.abs(borders - (a + b) // 2).argmin()])
            todo += [(cut, b, me), (a, cut, me)]
        return 0


def product_bounds(p: Tree, i: int, q: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of a member of node i of p with one of each node j of q.

    Boxes: sums of the least and greatest products of the sides. Balls: Cauchy-Schwarz around the
    centres. Both hold, so the inner ends do; a unit of slack covers rounding.
    """
    corners = [x * y for x in (p.low[i], p.high[i]) for y in (q.low[j], q.high[j])]
    box = np.minimum.reduce(corners).sum(1), np.maximum.reduce(corners).sum(1)
    middle = q.centre[j] @ p.centre[i]
    reach = p.radius[i] * q.norm[j] + q.radius[j] * p.norm[i] + p.radius[i] * q.radius[j]
    slack = 1 + 1e-9 * (np.abs(middle) + reach)
    return np.maximum(box[0] - slack, middle - reach - slack), np.minimum(box[1] + slack, middle + reach + slack)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Best:
    """The k best (score, id) of each request, and the least score that still counts for it."""

    k: int
    found: list[list[tuple[int, int]]]
    least: np.ndarray

    def add(self, request: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.found[request]  # a heap with the worst in front: least score, then largest id
        for s, v in zip(scores.tolist(), ids.tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -v))
            elif (s, -v) > heap[0]:
                heapq.heapreplace(heap, (s, -v))
        if len(heap) == self.k:
            self.least[request] = max(self.least[request], heap[0][0])

    def rows(self, request: int) -> list[tuple[int, int]]:
        return [(s, -v) for s, v in sorted(self.found[request], reverse=True)]


def dual_search(
    anchors: Tree, own: np.ndarray, group: np.ndarray, most: np.ndarray, best: Best, rows: Tree, number: np.ndarray, ids: np.ndarray, same: bool
) -> int:
    """Fill best with each request's best rows; the number of pairs of leaves that were scored.

    Requests belong to anchors: those of anchor n (in the tree's order) are group[n] to group[n + 1].
    most: a request's greatest score that counts; best.least: its least. own: the anchors' row numbers;
    number, ids: those of the rows, and their vec_ids. same: rows of the anchor's label count, else
    those of other labels.
    """
    scored, todo = 0, [(0, 0)]
    while todo:
        i, j = todo.pop()
        (a, b), (c, d) = anchors.range[i], rows.range[j]
        first, last = group[a], group[b]
        if first == last:
            continue
        label, other = anchors.label[i], rows.label[j]
        if same:  # members are in the order of labels, so the ends tell which labels a node may have
            if anchors.labels[b - 1] < rows.labels[c] or rows.labels[d - 1] < anchors.labels[a]:
                continue
        elif label is not None and label == other:
            continue
        low, high = product_bounds(anchors, i, rows, np.array([j]))
        if high[0] < best.least[first:last].min() or low[0] > most[first:last].max():
            continue
        if anchors.children[i] and (b - a >= d - c or not rows.children[j]):
            todo += [(x, j) for x in anchors.children[i]]
        elif rows.children[j]:
            kids = np.array(rows.children[j])
            bound = product_bounds(anchors, i, rows, kids)[1]
            todo += [(i, int(x)) for x in kids[np.argsort(bound)]]  # the best is taken first
        else:
            scored += 1
            values = products(anchors.vectors[a:b], rows.vectors[c:d])
            alike = anchors.labels[a:b, None] == rows.labels[None, c:d]
            counts = (alike == same) & (own[a:b, None] != number[None, c:d])
            owner = np.repeat(np.arange(b - a), np.diff(group[a : b + 1]))
            values, there = values[owner], ids[c:d]
            hits = counts[owner] & (values <= most[first:last, None]) & (values >= best.least[first:last, None])
            for r in np.flatnonzero(hits.any(1)).tolist():
                hit = np.flatnonzero(hits[r])
                if len(hit) > best.k:  # only the k best of a leaf can count
                    hit = hit[np.lexsort((there[hit], -values[r][hit]))[: best.k]]
                best.add(first + r, values[r][hit], there[hit])
    return scored


# -- tasks


def matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    width = len(column[0])
    if width == 0:
        return np.zeros((len(column), 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def columns(rows: list[tuple[int, ...]], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], pa.int32() if t == "int" else pa.int64()) for i, (n, t) in enumerate(fields)})


def by_length(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The rows of both tables whose vectors have one length, for each length."""
    import pyarrow.compute as pc

    for n in pc.unique(pc.list_value_length(left.column("v"))).to_pylist():
        parts = [t.filter(pc.equal(pc.list_value_length(t.column("v")), n)) for t in (left, right)]
        if parts[1].num_rows:
            yield parts[0], parts[1]


def trees(some: pa.Table, these: pa.Table) -> tuple[Tree, Tree]:
    one, other = (Tree(matrix(t, "v"), t.column("label").to_numpy()) for t in (some, these))
    return one, other


def find_positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        for some, these in by_length(anchors, rows):
            tree, other = trees(some, these)
            own = some.column("row").to_numpy()[tree.order]
            number, ids = (these.column(c).to_numpy()[other.order] for c in ("row", "vec_id"))
            ends = np.iinfo(np.int64)
            best = Best(k, [[] for _ in own], np.full(len(own), ends.min))
            dual_search(tree, own, np.arange(len(own) + 1), np.full(len(own), ends.max), best, other, number, ids, True)
            out += [(int(x), v, s) for n, x in enumerate(own) for s, v in best.rows(n)]
        return columns(out, POSITIVES)

    return run


def find_negatives(k: int, least_percent: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        for some, these in by_length(anchors, rows):
            tree, other = trees(some, these)
            own, own_ids = (some.column(c).to_numpy()[tree.order] for c in ("row", "vec_id"))
            number, ids = (these.column(c).to_numpy()[other.order] for c in ("row", "vec_id"))
            lists = some.column("positives").to_pylist()
            lists = [lists[n] for n in tree.order]
            wanted = [p for x in lists for p in x]
            group = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
            most = np.array([p["score"] for p in wanted], np.int64)
            # least_percent * positive <= 100 * negative, rounded up in whole numbers of any size
            least = np.array([-(-least_percent * p["score"] // 100) for p in wanted], np.int64)
            best = Best(k, [[] for _ in wanted], least)
            dual_search(tree, own, group, most, best, other, number, ids, False)
            for n, (x, y) in enumerate(zip(own.tolist(), own_ids.tolist())):
                for r in range(group[n], group[n + 1]):
                    p = wanted[r]
                    out += [(x, y, p["place"], p["positive_id"], v, p["score"], s) for s, v in best.rows(r)]
        return columns(out, NEGATIVES)

    return run


# -- jobs


def sound_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """row (a number of its own), vec_id, label and v (whole components) of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < MOST)
    taken = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.forall("embedding", fine))
    return taken.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("v"))


def met(anchors: DataFrame, rows: DataFrame, n_shards: int, run, schema: str) -> DataFrame:
    """run(block, shard) for every block of anchors (column block) and every shard of rows (column shard)."""
    blocks = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    n_blocks = anchors.agg(F.max("block")).first()[0]
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks if n_blocks is not None else 0))).alias("block"))
    return blocks.groupBy("block", "shard").cogroup(rows.groupBy("block", "shard")).applyInArrow(run, schema)


def dealt(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """rows with a column of this name that deals them by row to parts of about size rows, and the number of parts."""
    parts = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), parts


def best_rows(table: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in this order, with their rank; few rows of a key leave each shard."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, least_percent: int = 80, scale: int = 256,
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label. is_anchor: a condition on vec_id. A negative's score is at
    least least_percent of the positive's and at most the positive's. shard, block: rows of a task.
    """
    return settle(vectors.sparkSession, lambda: _negatives(vectors, is_anchor, n_positives, n_negatives, least_percent, scale, shard, block), "negatives")


def _negatives(vectors: DataFrame, is_anchor: Column, n_positives: int, n_negatives: int, least_percent: int, scale: int, shard: int, block: int) -> DataFrame:
    rows = materialise(sound_rows(vectors, scale), "whole-vectors")
    rows, n_shards = dealt(rows, "shard", shard)
    anchors, _ = dealt(materialise(rows.where(is_anchor).drop("shard"), "anchors"), "block", block)
    positives = met(anchors, rows, n_shards, find_positives(n_positives), POSITIVES)
    positives = best_rows(positives, ["anchor"], [F.desc("score"), F.asc("positive_id")], n_positives)
    lists = positives.groupBy("anchor").agg(F.collect_list(F.struct(F.col("rank").alias("place"), "positive_id", "score")).alias("positives"))
    lists = materialise(lists, "positives")
    asked = materialise(anchors.join(lists.withColumnRenamed("anchor", "row"), "row"), "anchors-asked")
    found = met(asked, rows, n_shards, find_negatives(n_negatives, least_percent), NEGATIVES)
    found = best_rows(found, ["anchor", "place"], [F.desc("negative_score"), F.asc("negative_id")], n_negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
