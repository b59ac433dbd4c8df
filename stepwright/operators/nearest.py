"""The most similar text by common subsequence, from a trie of texts in place of all pairs."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of left and characters of right that one task holds.
LEFT_IN_TASK, CHARACTERS_IN_TASK = 2048, 2_000_000
#: Tasks that groups of these sizes are dealt into at most.
MOST_TASKS = 10_000
#: Nodes beside texts that are followed at once, and pairs of texts and leaves that may wait.
NODES_AT_ONCE, PAIRS_OPEN = 1 << 17, 1 << 23
#: Entries of the tables of a batch's characters.
MASKS_AT_ONCE = 1 << 22
#: How far the ratio that is looked for goes down from 1 at a time; a text leaves with its first find.
RATIO_STEP = 0.05


class Level(NamedTuple):
    """Nodes of one depth: character (its number), first child in the next level and how many, text that ends there (or -1), sizes of the texts below."""

    character: np.ndarray
    first: np.ndarray
    children: np.ndarray
    text: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts in a row, and each text's length."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.array([len(t) for t in texts], np.int64)


def trie_of(texts: list[str]) -> tuple[list[Level], np.ndarray]:
    """The levels of the trie of different texts in ascending order, and its characters in order."""
    codes, sizes = codes_of(texts)
    alphabet, numbers = np.unique(codes, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    node = np.zeros(len(texts), np.int64)
    here = np.arange(len(texts))
    heads, characters = np.zeros(1, np.int64), np.zeros(1, np.int64)
    levels: list[Level] = []
    for depth in range(int(sizes.max()) + 1):
        ends = np.full(len(heads), -1, np.int64)
        last = here[sizes[here] == depth]
        ends[node[last]] = last
        shortest, longest = np.minimum.reduceat(sizes[here], heads), np.maximum.reduceat(sizes[here], heads)
        here = here[sizes[here] > depth]
        above, numbered = node[here], numbers[starts[here] + depth]
        new = np.ones(len(here), bool)
        new[1:] = (above[1:] != above[:-1]) | (numbered[1:] != numbered[:-1])
        children = np.bincount(above[new], minlength=len(heads))
        levels.append(Level(characters, np.cumsum(children) - children, children, ends, shortest, longest))
        heads, characters = np.flatnonzero(new), numbered[new]
        node[here] = np.cumsum(new) - 1
    return levels, alphabet


def masks_of(texts: list[str], alphabet: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text and character of the alphabet (a row each) the bits of its places; the texts' lengths."""
    codes, sizes = codes_of(texts)
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    number = np.minimum(np.searchsorted(alphabet, codes), max(0, len(alphabet) - 1))
    known = alphabet[number] == codes if len(alphabet) else np.zeros(len(codes), bool)
    masks = np.zeros((len(texts) * max(1, len(alphabet)), words), np.uint64)
    row, place, number = row[known], place[known], number[known]
    np.bitwise_or.at(masks, (row * len(alphabet) + number, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return masks, sizes


def next_rows(row: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Rows of the tables of common subsequences one character on, see match.common_subsequence."""
    x = row | mask
    shifted = row << np.uint64(1)
    shifted[:, 0] |= np.uint64(1)
    if row.shape[1] == 1:
        return x & ~(x - shifted)
    shifted[:, 1:] |= row[:, :-1] >> np.uint64(63)
    rest = x - shifted
    borrow = x < shifted
    for k in range(1, row.shape[1]):
        carried = borrow[:, k - 1]
        borrow[:, k] |= carried & (rest[:, k] == 0)
        rest[:, k] -= carried
    return x & ~rest


def nearest_texts(left: list[str], right: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text of left the number of the text of right with the highest ratio, the first among
    equals, or -1 where none reaches least; and the ratio. The texts of right are all different.

    The table of common subsequences is carried down a trie of right, a step for each node beside each
    text, and a node is left once no text below it can reach what is looked for.
    """
    best, ratio = np.full(len(left), -1, np.int64), np.zeros(len(left))
    if not left or not right:
        return best, ratio
    order = sorted(range(len(right)), key=right.__getitem__)
    levels, alphabet = trie_of([right[i] for i in order])
    place = np.array(order)
    words = np.array([max(1, -(-len(t) // 64)) for t in left])  # of 64 bits, in a row of the table
    looked = [1 - i * RATIO_STEP for i in range(int((1 - least) / RATIO_STEP) + 1) if 1 - i * RATIO_STEP > least] + [least]
    for w in np.unique(words).tolist():
        those = np.flatnonzero(words == w)
        size = max(1, min(PAIRS_OPEN // len(right), MASKS_AT_ONCE // max(1, len(alphabet))) // w)
        for some in (those[i : i + size] for i in range(0, len(those), size)):
            masks, sizes = masks_of([left[i] for i in some], alphabet, w)
            found, reached = np.full(len(some), len(right), np.int64), np.zeros(len(some))
            for floor in looked:
                waiting = np.flatnonzero(found == len(right))
                if len(waiting):
                    descend(levels, place, max(1, len(alphabet)), masks, sizes, waiting, floor, found, reached)
            hit = found < len(right)
            best[some[hit]], ratio[some[hit]] = found[hit], reached[hit]
    return best, ratio


def descend(
    levels: list[Level], place: np.ndarray, characters: int, masks: np.ndarray, sizes: np.ndarray, waiting: np.ndarray, floor: float, found: np.ndarray, reached: np.ndarray
) -> None:
    """Sets found and reached of the waiting texts to their best of at least that ratio."""
    need = np.full(len(sizes), floor)

    def ends(depth: int, text: np.ndarray, node: np.ndarray, common: np.ndarray) -> None:
        """Texts of right that end at these nodes."""
        at = levels[depth].text[node]
        total = sizes[text] + depth
        score = np.where(total == 0, 1.0, 2 * common / np.maximum(total, 1))
        good = np.flatnonzero((at >= 0) & (score >= need[text]))
        if not len(good):
            return
        text, at, score = text[good], place[at[good]], score[good]
        first = np.lexsort((at, -score, text))
        first = first[np.r_[True, text[first][1:] != text[first][:-1]]]
        text, at, score = text[first], at[first], score[first]
        better = (score > reached[text]) | (at < found[text])
        text, at, score = text[better], at[better], score[better]
        found[text], reached[text] = at, score
        need[text] = np.maximum(need[text], score)

    ends(0, waiting, np.zeros(len(waiting), np.int64), np.zeros(len(waiting), np.int64))
    open_nodes = [(0, waiting, np.zeros(len(waiting), np.int64), np.zeros((len(waiting), masks.shape[1]), np.uint64))]
    while open_nodes:
        depth, text, node, row = open_nodes.pop()
        children = levels[depth].children[node]
        upto = np.cumsum(children)
        if upto[-1] > NODES_AT_ONCE and len(node) > 1:
            cut = max(1, int(np.searchsorted(upto, NODES_AT_ONCE)))
            open_nodes += [(depth, text[cut:], node[cut:], row[cut:]), (depth, text[:cut], node[:cut], row[:cut])]
            continue
        above = np.repeat(np.arange(len(node)), children)
        child = np.repeat(levels[depth].first[node] - (upto - children), children) + np.arange(upto[-1])
        text, depth = text[above], depth + 1
        level = levels[depth]
        row = next_rows(row[above], masks[text * characters + level.character[child]])
        common = np.bitwise_count(row).sum(axis=1, dtype=np.int64)
        n = sizes[text]
        # of the lengths below the node the one at which the ratio can be highest
        m = np.clip(n - common + depth, level.shortest[child], level.longest[child])
        kept = np.flatnonzero(2 * np.minimum(n, common + m - depth) / (n + m) >= need[text])
        text, child, row = text[kept], child[kept], row[kept]
        ends(depth, text, child, common[kept])
        inner = np.flatnonzero(level.children[child])
        if len(inner):
            open_nodes.append((depth, text[inner], child[inner], row[inner]))


def nearest_of_blocks(left: DataFrame, right: DataFrame, sizes: DataFrame, tasks: int, least: float) -> DataFrame:
    """block, left_text, right_text and similarity: candidates for the best partner of each text of left.

    left: block and text, all different; right has order, too. sizes: the blocks to go through, with
    left_parts and right_parts. Texts of both sides are dealt by hash into parts; each part of left
    meets each part of right of its block in one group, which gives the part's first of the best.
    """
    part = lambda n: F.pmod(F.xxhash64("text"), F.col(n)).alias(f"__{n}")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(f"__{n}")
    nothing = F.lit(None).cast(right.schema["order"].dataType).alias("order")
    mine = left.join(sizes, "block").select("block", F.lit(0).alias("side"), "text", nothing, part("left_parts"), every("right_parts"))
    theirs = right.join(sizes, "block").select("block", F.lit(1).alias("side"), "text", "order", every("left_parts"), part("right_parts"))
    both = mine.unionByName(theirs)
    kind = both.schema["block"].dataType.simpleString()

    def nearest(group: pa.Table) -> pa.Table:
        side = group.column("side")
        of = lambda i: group.filter(pc.equal(side, i))
        asked, known = of(0), of(1)
        known = known.take(pc.sort_indices(known.column("order"), null_placement="at_start"))
        names = known.column("text").combine_chunks()
        best, ratio = nearest_texts(asked.column("text").to_pylist(), names.to_pylist(), least)
        hit = np.flatnonzero(best >= 0)
        asked = asked.take(pa.array(hit))
        return pa.table({"block": asked.column("block"), "left_text": asked.column("text"), "right_text": names.take(pa.array(best[hit])), "similarity": pa.array(ratio[hit])})

    keys = ["block", "__left_parts", "__right_parts"]
    return both.repartition(tasks, *keys).groupBy(*keys).applyInArrow(nearest, f"block {kind}, left_text string, right_text string, similarity double")
