"""Phrase collocations by position bitmaps, after the manner of SPAM.

Texts are dealt to shards of about SHARD_WORDS words. In a shard all words stand in one row of
positions, with a free position after each piece, so no phrase crosses a border. Each word of a
language has a bitmap of its positions, of which only the bytes that are not zero are kept, with
their numbers. A phrase's bitmap, shifted by one position and ANDed with the words' bitmaps, gives
those of its extensions, whose popcount is the extension's count in the shard; sums over shards are
the counts in the corpus. A phrase is extended depth first, first words in batches of bounded size.

Counts never grow as a phrase does, so words below the threshold leave the bitmaps first, and only
pairs that reach it over all shards are extended further. Both decisions are joins: nothing that
grows with the vocabulary is broadcast. A shard's bitmaps travel as one row, with the list of what
still counts in the shard beside it, and a task holds one shard. Counts of pairs travel by tiles, the
pairs of 2**TILE first words in a row, and are summed over FAN shards at a time, so that neither a
common word nor the number of shards makes a large group. Longer phrases travel by tiles as well, but
by a hash of all their words into about as many tiles as there are shards: a tile then holds about what
a shard does, and a phrase comes once from each shard. All of them, the shards' lists too, are sorted, and
gaps go by planes of bytes before they are compressed. Only the shards stay until phrases are counted.

Defined cases: a null text is empty; a null lang is `und`, one language with rows that say so; a
text without words gives nothing; repeated rows each count; a document longer than a shard is cut
between its pieces; an empty table, or one without frequent phrases, gives an empty result;
columns beside text and lang are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwright.llm.common import free_shuffles, map_texts_in_batches, materialise, maybe_among, release, settle

#: Bytes of UTF-8: A-Z in lower case, borders of pieces as a line's end, and tabs as blanks; so split() parts a piece at blanks only.
READ_AS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Words of a shard: bounds what a task holds. Counts do not depend on it.
SHARD_WORDS = 1 << 21
#: Entries that one batch of first words may expand to.
BATCH = 1 << 20
#: Bits of a first word's id within a tile of pairs, and shards whose tiles are summed at once.
TILE, FAN = 7, 16
#: Parts in which a language's candidates are ranked, each time the best of the parts before.
RANK_PARTS = (64, 8, 1)

#: A row for each word of a shard with its number there and its count, and one with the shard's bitmaps.
SHARDS = "shard long, lang string, word string, local int, ones long, bitmaps binary"
#: Pairs of a shard, or of several, in a tile.
TILES = "shard long, tile long, data binary"
#: The tile of a shard's list of words, which is no tile of pairs.
WORDS = -1
#: Longer phrases of a shard in a tile of those of n words.
PHRASES = "n int, tile long, data binary"
HEAD, COUNT = struct.Struct("<QQQ"), struct.Struct("<I")
#: Mixes the ids of a phrase.
MIX = np.uint64(0x9E3779B97F4A7C15)


# -- compressed bitmaps


def packed(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of all keys, from ascending positions: key, byte number and byte, for the bytes that are not zero."""
    order = np.argsort(keys, kind="stable")
    keys, positions = keys[order], positions[order]
    byte = positions >> 3
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (byte[1:] != byte[:-1]))))
    bits = np.bitwise_or.reduceat((1 << (positions & 7)).astype(np.uint8), first)
    return keys[first], byte[first], bits


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all values, then the next, of width bytes each: like bytes together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T).tobytes()


def from_planes(raw: bytes, n: int, width: int, at: int, kind: str) -> np.ndarray:
    """The n values whose planes begin at this byte of raw."""
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view(kind).ravel()


def pressed(keys: np.ndarray, byte: np.ndarray, bits: np.ndarray, n_keys: int) -> bytes:
    """Bitmaps of keys 0 to n_keys - 1 as bytes: entries of each key, gaps between byte numbers, bytes."""
    gaps = np.diff(byte, prepend=0)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    gaps[first] = byte[first]
    raw = planes(np.bincount(keys, minlength=n_keys).astype("<u4"), 4) + planes(gaps.astype("<u4"), 4) + bits.tobytes()
    return HEAD.pack(n_keys, len(keys), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpressed(data: bytes, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of the chosen keys, numbered by their order in chosen."""
    n_keys, n, size = HEAD.unpack_from(data)
    raw = pa.decompress(pa.py_buffer(data)[HEAD.size :], decompressed_size=size, codec="zstd")
    sizes = from_planes(raw, n_keys, 4, 0, "<u4").astype(np.int64)
    total = np.cumsum(from_planes(raw, n, 4, 4 * n_keys, "<u4"), dtype=np.int64)
    ends = np.cumsum(sizes)
    before = np.where(ends > sizes, total[np.maximum(ends - sizes, 1) - 1], 0)  # the sum of gaps of the keys before
    number = np.full(n_keys, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    keep = np.repeat(number >= 0, sizes)
    byte = (total - np.repeat(before, sizes))[keep].astype(np.int32)
    return np.repeat(number, sizes)[keep], byte, np.frombuffer(raw, np.uint8, n, 4 * n_keys + 4 * n)[keep]


def shifted(keys: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bitmaps one position on; a bit that leaves its byte goes on in the next."""
    low, carry = (bits << 1).astype(np.uint8), bits >> 7
    stay, move = low != 0, carry != 0
    return (
        np.concatenate((keys[stay], keys[move])),
        np.concatenate((byte[stay], byte[move] + 1)),
        np.concatenate((low[stay], carry[move])),
    )


class Shard:
    """The bitmaps of a shard's words, by word and by byte number."""

    def __init__(self, word: np.ndarray, byte: np.ndarray, bits: np.ndarray):
        by_word = np.argsort(word, kind="stable")
        self.word, self.byte, self.bits = word[by_word], byte[by_word], bits[by_word]
        by_byte = np.argsort(self.byte, kind="stable")
        self.at_byte, self.words_there, self.bits_there = self.byte[by_byte], self.word[by_byte], self.bits[by_byte]
        self.start = np.searchsorted(self.at_byte, np.arange((self.at_byte[-1] if len(byte) else 0) + 3))

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The words' bitmaps, whole words together."""
        step, at = max(1, BATCH // 8), 0
        while at < len(self.word):
            end = min(at + step, len(self.word))
            end = int(np.searchsorted(self.word, self.word[end - 1], "right"))
            yield self.word[at:end], self.byte[at:end], self.bits[at:end]
            at = end

    def extended(self, node: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of all extensions of the nodes by a word: node, word, byte number and byte."""
        node, byte, bits = shifted(node, byte, bits)
        inside = byte < len(self.start) - 1
        node, byte, bits = node[inside], byte[inside], bits[inside]
        found: list[tuple[np.ndarray, ...]] = []
        size = self.start[byte + 1] - self.start[byte]
        cuts = np.searchsorted(np.cumsum(size), np.arange(BATCH, int(size.sum()), BATCH), "left") + 1
        for a, b in zip((0, *cuts), (*cuts, len(size))):
            n = size[a:b]
            if n.sum() == 0:
                continue
            entry = np.arange(n.sum()) + np.repeat(self.start[byte[a:b]] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            both = np.repeat(bits[a:b], n) & self.bits_there[entry]
            hit = np.flatnonzero(both)
            found.append((np.repeat(node[a:b], n)[hit], self.words_there[entry[hit]], np.repeat(byte[a:b], n)[hit], both[hit]))
        if not found:
            return node[:0], self.word[:0], byte[:0], bits[:0]
        return tuple(np.concatenate(x) for x in zip(*found))


def counted(pair: tuple[np.ndarray, np.ndarray], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries' pairs once each, their popcounts summed, and each entry's number among them."""
    span = int(pair[1].max(initial=0)) + 1
    order = np.argsort(pair[0].astype(np.int64) * span + pair[1])  # nodes and words have small numbers
    a, b = pair[0][order], pair[1][order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    first = np.flatnonzero(new)
    ones = np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return a[first], b[first], ones, number


def tile_bytes(keys: list[np.ndarray], ones: np.ndarray) -> bytes:
    """Rows of whole numbers from 0 on, sorted by the columns of keys, and a number for each.

    A column holds gaps to the row before while the columns before it stay the same, else values.
    """
    columns, same = [], np.ones(len(ones), bool)
    for key in keys:
        gaps = np.diff(key, prepend=0)
        columns.append(np.where(same, gaps, key))
        same &= gaps == 0
    columns.append(ones)
    widths = [(int(c.max(initial=0)).bit_length() + 7) // 8 for c in columns]
    raw = b"".join(planes(c.astype("<i8"), w) for c, w in zip(columns, widths))
    return COUNT.pack(len(ones)) + bytes(widths) + pa.compress(raw, codec="zstd", asbytes=True)


def tile_rows(data: bytes, n_keys: int) -> list[np.ndarray]:
    """The columns of keys and the numbers."""
    (n,) = COUNT.unpack_from(data)
    widths = data[COUNT.size : COUNT.size + n_keys + 1]
    raw = pa.decompress(pa.py_buffer(data)[COUNT.size + n_keys + 1 :], decompressed_size=n * sum(widths), codec="zstd")
    starts = np.cumsum([0, *widths]) * n
    columns = [from_planes(raw, n, w, int(at), "<i8") for w, at in zip(widths, starts)]
    same, row = np.ones(n, bool), np.arange(n)
    for i, gaps in enumerate(columns[:-1]):
        begin = np.maximum.accumulate(np.where(same, 0, row))
        total = np.cumsum(gaps)
        columns[i] = total - (total - gaps)[begin]
        same &= gaps == 0
    return columns


def pair_bytes(a: np.ndarray, b: np.ndarray, ones: np.ndarray) -> bytes:
    """Pairs of one tile, in order, and their counts."""
    return tile_bytes([a & ((1 << TILE) - 1), b], ones)


def tile_pairs(tile: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second ids and counts."""
    low, b, ones = tile_rows(data, 2)
    return (tile << TILE) + low, b, ones


def tiled(a: np.ndarray, b: np.ndarray, ones: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Sorted pairs by tile."""
    tile = a >> TILE
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))) if len(a) else []
    ends = [*starts[1:], len(a)]
    return [int(tile[i]) for i in starts], [pair_bytes(a[i:j], b[i:j], ones[i:j]) for i, j in zip(starts, ends)]


def summed(keys: list[np.ndarray], ones: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each row of keys once, in order, with the sum of its counts."""
    order = np.lexsort(keys[::-1])
    keys, ones = [k[order] for k in keys], ones[order]
    new = np.zeros(len(ones), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(ones, first) if len(first) else ones[:0]


# -- tasks


class Numbers(dict):
    """Words of a language with their numbers in the shard; new ones join names."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__()
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append((self.lang, word))
        return number


def shard_rows(shard_words: int):
    """Batches of lang, text -> the rows of the task's shards."""

    def rows(shard: int, names: list[tuple[str, bytes]], marks: list[int]) -> Iterator[pa.RecordBatch]:
        found = np.asarray(marks, np.int32)
        at = np.flatnonzero(found >= 0)
        keys = found[at]
        ones = np.bincount(keys, minlength=len(names))
        langs, words = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        columns = [pa.array(np.full(len(names), shard, np.int64)), langs, words, pa.array(np.arange(len(names), dtype=np.int32)), pa.array(ones, pa.int64()), pa.nulls(len(names), pa.binary())]
        kinds = ["shard", "lang", "word", "local", "ones", "bitmaps"]
        yield pa.RecordBatch.from_arrays(columns, kinds)
        data = pressed(*packed(keys, at), len(names))
        nothing = [pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *nothing, pa.array([data], pa.binary())], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, marks, n_words = TaskContext.get().partitionId() << 32, [], [], 0
        numbers: dict[str, Numbers] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                known = numbers.get(lang)
                for piece in (text or "").encode().translate(READ_AS).split(b"\n"):
                    words = piece.split()
                    if not words:
                        continue
                    if known is None:
                        known = numbers[lang] = Numbers(lang, names)
                    marks.extend(map(known.__getitem__, words))
                    marks.append(-1)
                    n_words += len(words)
                    if n_words >= shard_words:
                        yield from rows(shard, names, marks)
                        shard, names, marks, n_words, numbers, known = shard + 1, [], [], 0, {}, None
        if marks:
            yield from rows(shard, names, marks)

    return run


def opened(bitmaps: pa.Table, local: np.ndarray) -> Shard:
    """The shard with the words that count: their numbers in the shard, in the order of their ids."""
    return Shard(*unpressed(bitmaps.column("bitmaps")[0].as_py(), local))


def pair_counts(bitmaps: pa.Table, lists: pa.Table) -> pa.Table:
    """The pairs of a shard and their counts there, by tile, and its list of words (local, id)."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    tiles, data = [], []
    if bitmaps.num_rows and lists.num_rows:
        local, ids = (lists.column(c).to_numpy().astype(np.int64) for c in ("local", "id"))
        order = np.argsort(ids)
        local, ids = local[order], ids[order]
        tiles, data = [WORDS], [tile_bytes([ids], local)]
        shard = opened(bitmaps, local)
        for word, byte, bits in shard.batches():
            node, by, _, both = shard.extended(word, byte, bits)
            a, b, ones, _ = counted((node, by), both)
            found.append((ids[a], ids[b], ones))
    more = tiled(*(np.concatenate([x[i] for x in found]) for i in range(3)))
    tiles, data = tiles + more[0], data + more[1]
    number = bitmaps.column("shard")[0].as_py() if bitmaps.num_rows else 0
    return pa.table({"shard": np.full(len(tiles), number, np.int64), "tile": pa.array(tiles, pa.int64()), "data": pa.array(data, pa.binary())})


def tile_sum(table: pa.Table) -> pa.Table:
    """Tiles of several shards as one, which counts as a shard of their group's number."""
    tile = table.column("tile")[0].as_py()
    parts = [tile_rows(d.as_py(), 2) for d in table.column("data")]
    low, b, ones = (np.concatenate([x[i] for x in parts]) for i in range(3))
    data = tile_bytes(*summed([low, b], ones))
    return pa.table({"shard": pa.array([table.column("group")[0].as_py()], pa.int64()), "tile": pa.array([tile], pa.int64()), "data": pa.array([data], pa.binary())})


def frequent_tiles(min_count: int):
    """Summed tiles -> those with only the pairs of this count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, kept = [], []
            for tile, data in zip(batch.column("tile").to_pylist(), batch.column("data")):
                a, b, ones = tile_pairs(tile, data.as_py())
                keep = ones >= min_count
                if keep.any():
                    tiles.append(tile)
                    kept.append(pair_bytes(a[keep], b[keep], ones[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), pa.array(kept, pa.binary())], ["tile", "often"])

    return run


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of frequent pairs -> a row for each pair."""
    for batch in batches:
        for tile, data in zip(batch.column("tile").to_pylist(), batch.column("often")):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in tile_pairs(tile, data.as_py())], ["a", "b", "ones"])


def live_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's tiles beside those of frequent pairs -> the shard's frequent pairs, without their counts."""
    last = None
    for batch in batches:
        shards, tiles, out = [], [], []
        for shard, tile, mine, often in zip(batch.column("shard").to_pylist(), batch.column("tile").to_pylist(), batch.column("data"), batch.column("often")):
            if tile != last:  # the join brings a tile's rows together
                x, y, _ = tile_pairs(tile, often.as_py())
                names = np.unique(y)
                wanted, last = x * len(names) + np.searchsorted(names, y), tile  # ascending, as the pairs are
            a, b, _ = tile_pairs(tile, mine.as_py())
            at = np.minimum(np.searchsorted(names, b), len(names) - 1)
            keys = a * len(names) + at
            keep = (names[at] == b) & (wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys)
            if keep.any():
                shards.append(shard)
                tiles.append(tile)
                out.append(pair_bytes(a[keep], b[keep], np.zeros(keep.sum(), np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(tiles, pa.int64()), pa.array(out, pa.binary())], ["shard", "tile", "data"])


def phrase_tiles(ids: list[np.ndarray], ones: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    """Sorted phrases by tile, of 2**bits tiles: a column of ids for each of their words."""
    mixed = np.zeros(len(ones), np.uint64)
    for column in ids:
        mixed = (mixed ^ column.astype(np.uint64)) * MIX
        mixed ^= mixed >> np.uint64(32)
    tile = (mixed * MIX >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(tile, kind="stable")
    ids, ones, tile = [c[order] for c in ids], ones[order], tile[order]
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))) if len(tile) else []
    ends = [*starts[1:], len(tile)]
    return [int(tile[i]) for i in starts], [tile_bytes([c[i:j] for c in ids], ones[i:j]) for i, j in zip(starts, ends)]


def longer_counts(max_words: int, tile_bits: int):
    """A shard's bitmaps, words and frequent pairs -> its phrases of 3 to max_words words and their counts there, by tile."""

    def run(bitmaps: pa.Table, lists: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in range(3, max_words + 1)}
        of = dict(zip(lists.column("tile").to_pylist(), lists.column("data").to_pylist()))
        words = of.pop(WORDS, None)
        if bitmaps.num_rows and words and of:
            ids, local = tile_rows(words, 1)
            shard = opened(bitmaps, local)
            pairs = [tile_pairs(t, d)[:2] for t, d in of.items()]
            a, b = (np.concatenate([x[i] for x in pairs]) for i in (0, 1))
            live = np.sort(np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b))
            for word, byte, bits in shard.batches() if len(live) else ():
                starts, number = np.unique(word, return_inverse=True)
                nodes = starts[:, None].astype(np.int64)  # the words of each node's phrase
                for n in range(2, max_words + 1):
                    node, by, byte, bits = shard.extended(number, byte, bits)
                    key = nodes[node, -1] * len(ids) + by
                    keep = live[np.minimum(np.searchsorted(live, key), len(live) - 1)] == key
                    node, by, byte, bits = node[keep], by[keep], byte[keep], bits[keep]
                    if not len(node):
                        break
                    parents, ends, ones, number = counted((node, by), bits)
                    nodes = np.column_stack((nodes[parents], ends))
                    if n >= 3:
                        found[n].append((ids[nodes], ones))  # in order, as ids ascend with their numbers
        sizes, tiles, data = [], [], []
        for n, parts in found.items():
            if parts:
                phrases, ones = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
                more = phrase_tiles(list(phrases.T), ones, tile_bits)
                sizes, tiles, data = sizes + [n] * len(more[0]), tiles + more[0], data + more[1]
        return pa.table({"n": pa.array(sizes, pa.int32()), "tile": pa.array(tiles, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def phrase_sums(min_count: int):
    """A tile of phrases from all shards -> ids and a of those with this count."""

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        parts = [tile_rows(d.as_py(), n) for d in table.column("data")]
        columns = [np.concatenate([x[i] for x in parts]) for i in range(n + 1)]
        ids, ones = summed(columns[:-1], columns[-1])
        keep = ones >= min_count
        flat = np.column_stack([c[keep] for c in ids]).ravel()
        offsets = np.arange(keep.sum() + 1, dtype=np.int32) * n
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())), "a": ones[keep]})

    return run


def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest-scoring cut of each candidate, in whole numbers of any size; of equal scores the first.

    cuts: l and r of each cut, in the order of k.
    """
    for batch in batches:
        best = []
        for a, cuts in zip(batch.column("a").to_pylist(), batch.column("cuts").to_pylist()):
            best.append(min((1_000_000 * a * a // (c["l"] * c["r"]), c["k"], c["l"], c["r"]) for c in cuts))
        columns = [batch.column("ids"), batch.column("a"), *(pa.array([x[i] for x in best], pa.int64()) for i in (2, 3, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["ids", "a", "l", "r", "score"])


# -- jobs


def frequent_words(totals: DataFrame, min_count: int) -> DataFrame:
    """lang, word, a and id (dense numbers) of the words of this count."""
    words = materialise(totals.where(F.col("a") >= min_count).withColumn("at", F.monotonically_increasing_id()), "words-numbered")
    part = F.shiftright("at", 33)  # the number holds its partition, and the place there
    sizes = words.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))  # a row for each partition
    numbered = words.withColumn("part", part).join(F.broadcast(bases), "part")
    numbered = materialise(numbered.select("lang", "word", "a", (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id")), "frequent-words")
    release(words)
    return numbered


def summed_tiles(by_shard: DataFrame, shards: int) -> DataFrame:
    """by_shard, tiles of so many shards, with one row for each tile: the sums over all shards, FAN of them at a time."""
    while shards > 1:
        shards = -(-shards // FAN)
        group = F.pmod(F.xxhash64("shard"), F.lit(shards)).alias("group")
        by_shard = by_shard.select("tile", "data", group).groupBy("tile", "group").applyInArrow(tile_sum, TILES)
    return by_shard


def phrase_counts(docs: DataFrame, min_count: int, max_words: int, shard_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words: lang, word, id, a; sizes: lang, n; phrases: ids, a of all phrases of 1 to max_words words with a >= min_count."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    shards = materialise(map_texts_in_batches(texts, shard_rows(shard_words), SHARDS), "shards")
    heard, bitmaps = shards.where("word is not null"), shards.where("word is null").select("shard", "bitmaps")
    totals = materialise(heard.groupBy("lang", "word").agg(F.sum("ones").alias("a")), "word-totals")
    free_shuffles(spark)
    sizes = materialise(totals.groupBy("lang").agg(F.sum("a").alias("n")), "sizes")
    words = frequent_words(totals, min_count)
    release(totals)
    here = maybe_among(heard.select("shard", "lang", "word", "local"), words, ("lang", "word")).join(words, ["lang", "word"])
    lists = materialise(here.select("shard", "local", "id"), "shard-words")
    free_shuffles(spark)
    n_shards = bitmaps.count()
    by_shard = materialise(bitmaps.groupBy("shard").cogroup(lists.groupBy("shard")).applyInArrow(pair_counts, TILES), "shard-pairs")
    release(lists)
    tiles = by_shard.where(F.col("tile") != WORDS)
    often = materialise(summed_tiles(tiles, n_shards).mapInArrow(frequent_tiles(min_count), "tile long, often binary"), "frequent-pairs")
    free_shuffles(spark)
    phrases = words.select(F.array("id").alias("ids"), "a")
    if max_words > 1:
        pairs = often.mapInArrow(pair_rows, "a long, b long, ones long")
        phrases = phrases.unionByName(pairs.select(F.array("a", "b").alias("ids"), F.col("ones").alias("a")))
    if max_words > 2:
        live = tiles.join(often, "tile").mapInArrow(live_tiles, TILES)
        live = materialise(by_shard.where(F.col("tile") == WORDS).unionByName(live), "shard-lists")
        release(by_shard)
        tile_bits = max(1, n_shards.bit_length())
        longer = bitmaps.groupBy("shard").cogroup(live.groupBy("shard")).applyInArrow(longer_counts(max_words, tile_bits), PHRASES)
        longer = longer.groupBy("n", "tile").applyInArrow(phrase_sums(min_count), "ids array<long>, a long")
        phrases = phrases.unionByName(longer)
        phrases = materialise(phrases, "phrase-counts")
        release(live, shards)
        return words, sizes, phrases
    release(by_shard, shards)
    return words, sizes, materialise(phrases, "phrase-counts")


def collocations(
    docs: DataFrame, min_count: int = 10, max_words: int = 3, cover_percent: int = 50, top: int = 2000, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to max_words words.

    A phrase is dropped where a longer one that holds it has cover_percent of its count or more.
    """
    return settle(docs.sparkSession, lambda: _collocations(docs, min_count, max_words, cover_percent, top, shard_words), "collocations")


def _collocations(docs: DataFrame, min_count: int, max_words: int, cover_percent: int, top: int, shard_words: int) -> DataFrame:
    words, sizes, phrases = phrase_counts(docs, min_count, max_words, shard_words)
    long = phrases.where(F.size("ids") > 1)
    cuts = long.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    # the rest is cut off after the first join, so that a phrase travels with one of its parts at a time
    cuts = cuts.withColumn("left", F.slice("ids", 1, F.col("k"))).join(phrases.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.select("ids", "a", "k", "l", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    cuts = cuts.join(phrases.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    cuts = cuts.groupBy("ids", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    best = cuts.mapInArrow(scored, "ids array<long>, a long, l long, r long, score long")
    # the largest count of a longer phrase around each phrase
    within = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("ids") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda s: F.slice("ids", s, n)),
        )
    )
    around = phrases.where(F.size("ids") > 2).select(F.explode(within).alias("ids"), F.col("a").alias("longest")).groupBy("ids").agg(F.max("longest").alias("longest"))
    best = best.join(around, "ids", "left").where(F.col("longest").isNull() | (100 * F.col("longest") < cover_percent * F.col("a")))
    best = materialise(best.select("ids", "a", "l", "r", "score"), "scored-phrases")
    named = best.select("*", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "lang", "word"), "id")
    named = named.groupBy("ids", "a", "l", "r", "score", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("parts"))
    named = named.select("lang", F.array_join("parts.word", " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in RANK_PARTS:
        named = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return named.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
