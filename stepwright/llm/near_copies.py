"""Near copies by SimHash, held to Jaccard similarity of word shingles: the pipeline's stage.

Two texts link when their sets of width-word shingles have a Jaccard similarity of at least
num / den (4 / 5). Fingerprints over the same shingles, with pivot tables as in simhash.py, give
the first candidates. They can't give all: at this similarity fingerprints of short texts differ by
up to 17 of 64 bits on the smallest tables, and block keys that survive 17 flips are 3 bits long.
The rest comes from keys that are shingles. In any one order of all shingles, two sets that link
share one of the first n - ceil(n * num / den) + 1 of each (n: the set's size), so pairs that share
none of those are left out without loss. Shingles that a sample of texts shows to be common come
last in the order; the sample decides what is fast, not what is found.

Candidates are tested on parity bitmaps before any set is moved: a bit is the parity of how many
of a set's shingles hash to it, so two bitmaps differ in no more bits than the sets have shingles
that only one of them holds. Survivors are verified on the whole sets, and only their texts move.

A key that many texts share makes no pairs at first: each text is compared with one such key's
smallest only. Links found so far are contracted, and then only pairs of a key whose components
still differ are compared, so a large group of near copies costs its size and not its square.

Defined cases: texts with the same words (A-Z as a-z) are one node, those without words too; fewer
words than width are one shingle; a null doc_id counts as larger than all others. Shingles and
texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import LOCATOR, ddl, map_texts_in_batches, materialise, maybe_among, release, settle, with_locators, without_rows
from stepwright.llm.components import connected_components
from stepwright.llm.simhash import LOWER, SEED, all_but_first, pivot_links

#: One text of so many is in the sample for common shingles; at most MOST_COMMON are sent around.
SAMPLE, MOST_COMMON = 64, 50_000
#: Bits of a bitmap for each shingle, before rounding up to a power of two; words of its short form.
BITS_FOR_SHINGLE, SHORT = 4, 4


def shingles(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """A hash of the text's words, and the different hashes of its shingles in ascending order."""
    words = (text or "").encode().translate(LOWER).split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        found = [digest(line, SEED)] if words else []
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        begins = [0, *ends]
        found = [digest(line[b : e - 1], SEED) for b, e in zip(begins, ends[width - 1 :])]
    return digest(line, SEED + 1), np.unique(np.array(found, np.uint64).view(np.int64))


def majority_bits(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles: each bit that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[i : i + 8192].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def parities(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's bitmap as 64-bit words, and the same folded to SHORT words."""
    size = max(64 * SHORT, 1 << (BITS_FOR_SHINGLE * len(hashes) - 1).bit_length()) if len(hashes) else 64 * SHORT
    odd = np.bincount(hashes.view(np.uint64).astype(np.int64) & (size - 1), minlength=size).astype(np.uint8) & 1
    words = np.packbits(odd, bitorder="little").view(np.int64)
    return words, np.bitwise_xor.reduce(words.reshape(-1, SHORT), axis=0)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """node (the words' hash) and all shingles of every text."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            nodes = np.array([s[0] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s[1] for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return map_texts_in_batches(texts.select("text"), batches, "node long, shingles array<long>")


def short_names(prefix: str = "") -> list[str]:
    return [f"{prefix}p{i}" for i in range(SHORT)]


def marks_of(located: DataFrame, width: int, num: int, den: int, common: list[int]) -> DataFrame:
    """Per document: doc_id, locator, node, n (size of the set), fp, bits, the short bitmap and
    keys (the first shingles in order)."""
    late = np.array(sorted(common), np.int64)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            nodes, sizes, keys, prints, bits, short = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                node, own = shingles(text, width)
                n = len(own)
                is_late = np.isin(own, late)
                nodes.append(node)
                sizes.append(n)
                prints.append(majority_bits(own))
                whole, folded = parities(own)
                bits.append(whole)
                short.append(folded)
                keys.append(np.concatenate([own[~is_late], own[is_late]])[: n - -(-n * num // den) + 1])
            folded = np.array(short, np.int64).reshape(-1, SHORT)
            columns = [batch.column("doc_id"), *map(batch.column, LOCATOR), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32())]
            columns += [pa.array(prints, pa.int64()), pa.array(bits, pa.list_(pa.int64())), *(pa.array(folded[:, i].copy()) for i in range(SHORT))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64()))], names)

    names = ["doc_id", *LOCATOR, "node", "n", "fp", "bits", *short_names(), "keys"]
    short_ddl = ", ".join(f"{name} long" for name in short_names())
    schema = f"{ddl(located, 'doc_id', *LOCATOR)}, node long, n int, fp long, bits array<long>, {short_ddl}, keys array<long>"
    return map_texts_in_batches(located.select("doc_id", *LOCATOR, "text"), batches, schema)


def common_shingles(docs: DataFrame, width: int) -> list[int]:
    """Shingles of three sampled texts at least, the most common first."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = shingle_sets(some, width).dropDuplicates(["node"]).select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 2")
    return [r["s"] for r in counts.orderBy(F.desc("count"), "s").limit(MOST_COMMON).collect()]


class Similar:
    """Conditions on two sets for a Jaccard similarity of num / den; of rows x and y with n and p0, p1 ..."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def in_size(self, x: Column, y: Column) -> Column:
        return F.least(x, y) * self.den >= F.greatest(x, y) * self.num

    def differ_in(self, bits: Column, x: Column, y: Column) -> Column:
        """Can sets of x and y shingles be similar that differ in so many bits at least?"""
        return bits * (self.num + self.den) <= (x + y) * (self.den - self.num)

    def by_short(self, x: str, y: str) -> Column:
        apart = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in short_names()), F.lit(0))
        nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
        return self.in_size(nx, ny) & self.differ_in(apart, nx, ny)

    def by_bits(self, x: str, y: str) -> Column:
        """As by_short on the whole bitmaps; the longer one is folded to the size of the other."""
        bx, by = F.col(f"{x}.bits"), F.col(f"{y}.bits")
        half = lambda b: F.zip_with(F.slice(b, 1, (F.size(b) / 2).cast("int")), F.slice(b, (F.size(b) / 2 + 1).cast("int"), (F.size(b) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
        bx, by = F.when(F.size(bx) > F.size(by), half(bx)).otherwise(bx), F.when(F.size(by) > F.size(bx), half(by)).otherwise(by)
        apart = F.aggregate(F.zip_with(bx, by, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, b: s + b)
        return self.differ_in(apart, F.col(f"{x}.n"), F.col(f"{y}.n"))

    def of_sets(self, x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return both * self.den >= (F.size(x) + F.size(y) - both) * self.num


def verified(pairs: DataFrame, nodes: DataFrame, located: DataFrame, width: int, similar: Similar) -> DataFrame:
    """Those of the pairs (a, b, each once) whose shingles are similar enough; only their texts move."""
    held = nodes.select("node", "n", "bits")
    near = pairs.join(held.alias("x"), F.col("a") == F.col("x.node")).join(held.alias("y"), F.col("b") == F.col("y.node"))
    near = materialise(near.where(similar.by_bits("x", "y")).select("a", "b"), "copies-near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", *LOCATOR), "node")
    wanted = materialise(wanted, "copies-wanted")
    texts = maybe_among(located.select("text", *LOCATOR), wanted).join(wanted, list(LOCATOR))
    sets = materialise(shingle_sets(texts, width), "copies-sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return near.join(x, "a").join(y, "b").where(similar.of_sets(F.col("sa"), F.col("sb"))).select("a", "b")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes: of one fingerprint with its smallest, and of the smallest of two
    fingerprints that pivot tables link."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")), "copies-prints")
    same = nodes.select("node", "fp").join(least, "fp").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    x, y = (least.select(F.col("fp").alias(f), F.col("least").alias(c)) for f, c in (("fa", "a"), ("fb", "b")))
    links = materialise(pivot_links(least.select("fp"), 2, 64).select(F.col("a").alias("fa"), F.col("b").alias("fb")).distinct(), "copies-prints")
    return same.unionByName(links.join(x, "fa").join(y, "fb").select("a", "b"))


def similar_links(nodes: DataFrame, located: DataFrame, width: int, similar: Similar) -> DataFrame:
    """Links (a, b) that connect nodes as all pairs of similar nodes do."""
    links = materialise(verified(fingerprint_pairs(nodes), nodes, located, width, similar), "copies-links")
    # keys move without bitmaps: only nodes that share a key get theirs, afterwards
    short = nodes.select("node", "n", *short_names())
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("least")).where("c > 1").drop("c")
    shared = materialise(shared, "copies-shared")
    hits = materialise(maybe_among(keyed, shared, ("key",)).join(shared, "key").select("key", "node", "least"), "copies-hits")
    release(shared)

    met = hits.where("node != least").groupBy(F.col("node").alias("a"), F.col("least").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    met = met.join(short.alias("y"), F.col("b") == F.col("y.node")).join(short.alias("x"), F.col("a") == F.col("x.node"))
    met = materialise(met.where(similar.by_short("x", "y")).select("a", "b", "c"), "copies-met")
    tried = materialise(met.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b")), "copies-firsts")
    links = materialise(links.unionByName(verified(tried, nodes, located, width, similar)), "copies-links")
    roots = materialise(connected_components(links), "copies-roots")

    rooted = hits.drop("least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted, "copies-rooted")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    open_keys = materialise(open_keys, "copies-keys")
    rooted = materialise(rooted.join(open_keys, "key", "left_semi").join(short, "node"), "copies-open")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") > F.col("y.root")) & similar.by_short("x", "y")
    met = rooted.alias("x").join(rooted.alias("y"), apart)
    pairs = materialise(met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct(), "copies-pairs")
    pairs = pairs.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    return links.unionByName(verified(pairs, nodes, located, width, similar))


def near_copies(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, node, component_id (the smallest doc_id that links reach, or its own),
    root (the component's number) and carried columns (of LOCATOR)."""
    located = docs if carried else with_locators(docs.select("doc_id", "text"))

    def build() -> DataFrame:
        marks = materialise(marks_of(located, width, num, den, common_shingles(located, width)), "copies-marks")
        one = F.min_by(F.struct("n", "fp", "bits", *short_names(), "keys", *LOCATOR), F.struct(*LOCATOR)).alias("m")
        nodes = materialise(marks.groupBy("node").agg(F.min("doc_id").alias("first"), one).select("node", "first", "m.*"), "copies-nodes")
        links = materialise(similar_links(nodes, located, width, Similar(num, den)), "copies-links")
        roots = materialise(connected_components(links), "copies-roots")
        rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        rooted = rooted.join(ids, "root").select("node", "component_id", "root")
        return marks.select("doc_id", "node", *carried).join(rooted, "node").select("doc_id", "node", "component_id", "root", *carried)

    return settle(docs.sparkSession, build, "copies-groups")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component, see all_but_first."""
    located = with_locators(docs)
    return without_rows(located, all_but_first(near_copies(located, carried=LOCATOR, **options)))
