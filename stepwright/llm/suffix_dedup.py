"""Removal of long repeated substrings, anywhere in the corpus.

A byte goes if a string of `length` bytes that covers it also starts somewhere else. That is
suffix sorting cut off at `length`: two suffixes matter to each other only if their common prefix
is that long. A suffix array of all bytes needs a tuple per suffix on disk in every round of
induction, so here only a sample of suffixes is sorted, and the rest is induced from it:

1. Anchors. Of the K-byte strings in a window the one with the least hash is its anchor. Equal
   windows have equal anchors at equal places, and neighbouring windows share theirs, so some two
   in 340 suffixes are sampled. Their names (hashes) are sorted and only those that occur twice
   stay: no other window can repeat.
2. Blocks. The windows of an anchor are taken in aligned blocks. What all windows of a block have
   in common is its core; the string from the first to the last window is its reach. If no other
   block has the core, none of its windows repeats; if another place has the reach, all do.
3. Windows. Only where blocks agree in the core but not in the reach are single windows compared,
   one block standing for all of equal reach.

Each step is a count of digests that combines before the shuffle and a join that the adaptive
planner can split; nothing is gathered but the positions within one document. Reaches and windows
are compared by 128-bit digests. Texts are worked through in stretches of bounded length.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; repeated rows are
places of their own, so both lose what they share; a null doc_id is an identifier like any other;
an empty table gives an empty result; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import materialise, release, text_or_empty

K = 64
BLOCK = 64
STRETCH = 1 << 20
#: A hash of K bytes is a polynomial in BASE modulo 2**64 over random values of the bytes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = np.random.default_rng(64).integers(1, 2**63, 256).astype(np.uint64)
PLACE_BITS = 21


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Anchors of the windows of a text; tables of powers grow with the longest stretch seen."""

    def __init__(self, length: int):
        self.length, self.span = length, length - K + 1
        self.up = self.down = np.ones(1, np.uint64)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Mixed hash of the K bytes at every place."""
        if len(self.up) < len(data):
            self.up, self.down = powers(BASE, 2 * len(data)), powers(INVERSE, 2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * self.up[: len(data)], out=sums[1:], dtype=np.uint64)
        h = (sums[K:] - sums[:-K]) * self.down[: len(data) - K + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        return h

    def stretches(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """hash, place, first and last window of each anchor; an anchor on the seam of two
        stretches comes twice, with the windows of each."""
        for base in range(0, max(0, len(data) - self.length + 1), STRETCH):
            part = data[base : base + STRETCH + self.length - 1]
            h, span = self.hashes(part), self.span
            places = np.arange(len(h), dtype=np.uint64)
            value = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
            # least value in each run of span places: ends of blocks of span meet beginnings
            padded = np.full(-(-len(value) // span) * span, np.uint64(2**64 - 1))
            padded[: len(value)] = value
            grid = padded.reshape(-1, span)
            upto = np.minimum.accumulate(grid, axis=1).ravel()
            onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            n = len(value) - span + 1
            anchor = (np.minimum(onward[:n], upto[span - 1 : span - 1 + n]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            first = np.concatenate([[0], np.nonzero(np.diff(anchor))[0] + 1])
            last = np.concatenate([first[1:] - 1, [n - 1]])
            at = anchor[first]
            yield h[at].view(np.int64), at + base, first + base, last + base


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode()


def anchor_records(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, body, name (the anchor's hash), place, first, last: the sampled suffixes."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in found:
            parts, rows = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for part in anchors.stretches(np.frombuffer(bytes_of(text), np.uint8)):
                    parts.append(part)
                    rows.append(np.full(len(part[0]), row))
            if parts:
                name, place, first, last = (np.concatenate(c) for c in zip(*parts))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("body").take(at), pa.array(name), *(pa.array(c.astype(np.int32)) for c in (place, first, last))],
                    ["doc_id", "body", "name", "place", "first", "last"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(batches, f"doc_id {kind}, body long, name long, place int, first int, last int")


def same_text(left: str, right: str):
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.body") == F.col(f"{right}.body"))


def texts_with_anchors(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, body, n_bytes of every document; for those with an anchor that occurs twice text
    and anchors (places with their windows), for the others sha256."""
    records = materialise(anchor_records(docs, length), "repeats-anchors")
    # a table of its own, so that the join below has two plain shuffles and can split a hot name
    twice = materialise(records.groupBy("name").count().where("count > 1").select("name"), "repeats-names")
    anchors = records.join(twice, "name", "left_semi").groupBy("doc_id", "body").agg(F.collect_set(F.struct("place", "first", "last")).alias("anchors"))
    at_hand = docs.alias("s").join(anchors.alias("a"), same_text("s", "a"), "left")
    active = F.col("anchors").isNotNull()
    texts = materialise(
        at_hand.select(
            "s.doc_id", "s.body", F.when(active, F.col("text")).alias("text"), "anchors",
            F.octet_length("text").cast("long").alias("n_bytes"), F.when(~active, F.sha2("text", 256)).alias("sha256"),
        ),
        "repeats-texts",
    )
    release(records, twice)
    return texts


def block_records(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, body, first, last, core, reach: the blocks of windows of the repeated anchors."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, short = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
        for batch in found:
            rows, firsts, lasts, cores, reaches = [], [], [], [], []
            for row, (text, anchors) in enumerate(zip(batch.column("text").to_pylist(), batch.column("anchors").to_pylist())):
                data = bytes_of(text)
                for anchor in anchors:
                    place = anchor["place"]
                    for number in range((anchor["first"] - place) // BLOCK, (anchor["last"] - place) // BLOCK + 1):
                        low = place + number * BLOCK
                        first, last = max(low, anchor["first"]), min(low + BLOCK - 1, anchor["last"])
                        rows.append(row)
                        firsts.append(first)
                        lasts.append(last)
                        cores.append(short(data[low + BLOCK - 1 : low + length]))
                        reaches.append(digest(data[first : last + length]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), batch.column("body").take(at), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()),
                    pa.array(np.array(cores, np.uint64).view(np.int64)), pa.array(reaches, pa.binary()),
                ],
                ["doc_id", "body", "first", "last", "core", "reach"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "body", "text", "anchors").mapInArrow(batches, f"doc_id {kind}, body long, first int, last int, core long, reach binary")


def window_records(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, body, first and digest of each window of the blocks in question."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in found:
            rows, firsts, digests = [], [], []
            for row, (text, blocks) in enumerate(zip(batch.column("text").to_pylist(), batch.column("blocks").to_pylist())):
                data = bytes_of(text)
                for block in blocks:
                    places = range(block["first"], block["last"] + 1)
                    firsts += places
                    digests += [digest(data[p : p + length]) for p in places]
                    rows += [row] * len(places)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("body").take(at), pa.array(firsts, pa.int32()), pa.array(digests, pa.binary())],
                ["doc_id", "body", "first", "digest"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "body", "text", "blocks").mapInArrow(batches, f"doc_id {kind}, body long, first int, digest binary")


def merged_runs(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that the windows first..last cover."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in runs or []):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def compared_blocks(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """whole (doc_id, body, first, last: blocks whose windows all repeat) and open (doc_id, body,
    blocks: those whose windows have to be compared)."""
    blocks = materialise(block_records(texts.where("anchors is not null"), length), "repeats-blocks")
    reaches = materialise(
        blocks.groupBy("core", "reach").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "body", "first", "last")).alias("one")),
        "repeats-reaches",
    )
    whole = materialise(
        blocks.join(reaches.where("n > 1").select("reach"), "reach", "left_semi").select("doc_id", "body", "first", "last"), "repeats-whole"
    )
    release(blocks)
    mixed = materialise(reaches.groupBy("core").count().where("count > 1").select("core"), "repeats-cores")
    asked = materialise(
        reaches.join(mixed, "core", "left_semi").select("one.*").groupBy("doc_id", "body").agg(F.collect_set(F.struct("first", "last")).alias("blocks")),
        "repeats-open",
    )
    release(reaches, mixed)
    return whole, asked


def compared_windows(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """doc_id, body, first, last (the same): single windows that repeat."""
    at_hand = texts.alias("t").join(asked.alias("b"), same_text("t", "b")).select("t.doc_id", "t.body", "t.text", "blocks")
    windows = materialise(window_records(at_hand, length), "repeats-windows")
    twice = materialise(windows.groupBy("digest").count().where("count > 1").select("digest"), "repeats-digests")
    single = materialise(
        windows.join(twice, "digest", "left_semi").select("doc_id", "body", "first", F.col("first").alias("last")), "repeats-single"
    )
    release(windows, asked, twice)
    return single


def repeated_runs(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """texts (doc_id, body, text, n_bytes, sha256) with text only where runs may follow, and
    runs (doc_id, body, runs): the windows first..last that repeat."""
    text = text_or_empty(F.col("text"))
    texts = texts_with_anchors(docs.select("doc_id", F.xxhash64(text).alias("body"), text.alias("text")), length)
    whole, asked = compared_blocks(texts, length)
    single = compared_windows(texts, asked, length)
    runs = whole.unionByName(single).groupBy("doc_id", "body").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return texts.drop("anchors"), runs


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (start, end of what goes), kept (the bytes that stay,
    null if nothing goes) and kept_sha256."""
    if length < K + 2 * BLOCK:
        raise ValueError(f"length must be at least {K + 2 * BLOCK}")
    texts, runs = repeated_runs(docs, length)
    joined = texts.alias("t").join(runs.alias("r"), same_text("t", "r"), "left").select("t.*", "runs")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            spans, kept, digests = [], [], []
            for text, runs, known in zip(*(batch.column(c).to_pylist() for c in ("text", "runs", "sha256"))):
                own = merged_runs(runs, length)
                spans.append([{"start": a, "end": b} for a, b in own])
                if known is None:
                    data = bytes_of(text)
                    edges = [0, *(x for ab in own for x in ab), len(data)]
                    data = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    known = hashlib.sha256(data).hexdigest()
                    kept.append(data if own else None)
                else:
                    kept.append(None)
                digests.append(known)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(batches, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string")
