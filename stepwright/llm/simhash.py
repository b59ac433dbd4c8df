"""Near-duplicates by SimHash fingerprints, found with pivot distance tables.

A text's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it.
Fingerprints link when at most max_bits (2) bits differ. For every different fingerprint the
Hamming distances to many reference fingerprints (the pivots) are computed once. Two fingerprints
that link differ by at most max_bits in every such distance, so a pair whose largest coordinate
difference is above that is discarded, and what survives is verified on the fingerprints.

Pairs to look at come from blocks: of four 16-bit quarters two are equal in any pair that links,
so each fingerprint has six keys of two quarters. Keys that more than most_in_block fingerprints
share make no pairs: their fingerprints go the exact way over midpoints instead. Each names itself
and its 64 neighbours at one bit; two fingerprints differ by at most two bits just if they name a
fingerprint in common, and no more than 65 can name the same one. Links are then contracted to
components; the component id is the smallest doc_id.

Defined cases: a null or empty text, or one of white space, has fingerprint 0, linked like any
other; equal texts share a fingerprint; repeated rows each get their result; a null doc_id counts
as larger than all others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import LOCATOR, ddl, map_texts_in_batches, materialise, settle, with_locators, without_rows
from stepwright.llm.components import connected_components

#: A-Z to a-z; bytes.split() splits at just the white space of the contract.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
N_PIVOTS = 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text over shingles of width words, in blocks of bounded memory."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    n = max(1, len(words) - width + 1)
    begin = starts[:n].tolist()
    end = (starts[width : width + n] - 1).tolist() if len(words) > width else [len(line)]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 8192):
        hashes = np.array([digest(line[b:e], SEED) for b, e in zip(begin[i : i + 8192], end[i : i + 8192])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and carried columns of every document."""
    names = ["doc_id", *carried]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            marks = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(marks.view(np.int64))], [*names, "fp"])

    return map_texts_in_batches(docs.select(*names, "text"), batches, f"{ddl(docs, *names)}, fp long")


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: fixed draws, as signed longs."""
    return [int(x) for x in np.random.default_rng(20).integers(-(2**63), 2**63 - 1, n)]


def distances(fp: Column, refs: list[int]) -> list[Column]:
    return [F.bit_count(fp.bitwiseXOR(F.lit(r))) for r in refs]


def block_keys(fp: Column) -> Column:
    """Six keys: each pair of 16-bit quarters, with the pair's number in front."""
    quarter = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    return F.array(*[F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(quarter[i], 16) + quarter[j] for n, (i, j) in enumerate(combinations(range(4), 2))])


def pivot_links(fps: DataFrame, max_bits: int, most_in_block: int) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, each once); see the module's text.

    Fingerprints of large blocks get at least the links that connect them as their links do.
    """
    names = [f"d{i}" for i in range(N_PIVOTS)]
    tabled = fps.select("fp", *[d.alias(n) for d, n in zip(distances(F.col("fp"), pivots()), names)])
    keyed = materialise(tabled.select("*", F.explode(block_keys(F.col("fp"))).alias("key")), "simhash-blocks")
    sizes = keyed.groupBy("key").count().where("count > 1")
    small = sizes.where(F.col("count") <= most_in_block).select("key")
    large = sizes.where(F.col("count") > most_in_block).select("key")
    mine = keyed.join(small, "key", "left_semi")
    x, y = mine.alias("x"), mine.alias("y")
    near = F.greatest(*[F.abs(F.col(f"x.{n}") - F.col(f"y.{n}")) for n in names]) <= max_bits
    linked = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") > F.col("y.fp")) & near & linked)
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).unionByName(
        midpoint_links(keyed.join(large, "key", "left_semi").select("fp").distinct(), max_bits)
    )


def midpoint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links between fingerprints that share a midpoint: exact for two bits, no pairs made."""
    if max_bits != 2:
        raise ValueError("midpoints at one bit give links of two bits")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(2**63)).cast("long") for b in range(64)])
    named = fps.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("middle"))
    # at most 65 rows name one middle
    met = named.groupBy("middle").agg(F.collect_list("fp").alias("met")).where(F.size("met") > 1)
    met = met.select(F.array_min("met").alias("b"), F.explode("met").alias("a"))
    return met.where("a != b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, most_in_block: int = 64, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, fp, component_id (the smallest doc_id that links reach, or its own),
    root (the component's number) and carried columns."""

    def build() -> DataFrame:
        marks = materialise(fingerprints(docs, width, carried), "simhash-marks")
        firsts = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-firsts")
        roots = materialise(connected_components(pivot_links(firsts.select("fp"), max_bits, most_in_block)), "simhash-roots")
        rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
        ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        return marks.join(rooted.join(ids, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root", *carried)

    return settle(docs.sparkSession, build, "simhash-groups")


def all_but_first(groups: DataFrame) -> DataFrame:
    """Locators of the rows of each root but the one with the smallest doc_id (null last); of rows
    that share it the first in its file stays."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *LOCATOR)
    kept = groups.groupBy("root").agg(F.min(order).alias("kept"))
    is_kept = [F.col(c) == F.col(f"kept.{c}") for c in LOCATOR]
    return groups.join(kept, "root").where(~(is_kept[0] & is_kept[1])).select(*LOCATOR)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component, see all_but_first."""
    located = with_locators(docs)
    return without_rows(located, all_but_first(near_duplicates(located, carried=LOCATOR, **options)))
