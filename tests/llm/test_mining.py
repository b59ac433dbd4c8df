"""Collocations, decontamination and hard negatives against plain Python, on tables of odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import odd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepwright.llm import collocations as co
from stepwright.llm import decontaminate as de
from stepwright.llm import hard_negatives as hn
from stepwright.llm.common import scratch_root

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- collocations


def brute_collocations(rows, min_count, max_words, percent=50, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    for lang, f in counts.items():
        out = []
        for p, a in f.items():
            if len(p) < 2 or a < min_count:
                continue
            if any(len(q) > len(p) and b >= min_count and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in f.items()):
                continue
            s, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            out.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(out)[:top], 1):
            yield (lang, rank, p.decode(), -a, left, right, sizes[lang], -s)


@pytest.mark.parametrize(("min_count", "max_words", "shard", "batch"), [(10, 3, 1 << 21, 1 << 20), (3, 4, 50, 16), (2, 2, 500, 64)])
def test_collocations(spark, monkeypatch, min_count, max_words, shard, batch):
    monkeypatch.setattr(co, "BATCH", batch)
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma\tdelta", "é", "漢字", "x", "y.", "z,", "\n", "new york", "New York City", "\xa0", "a\x0bb"]
    more = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und", ""]), None, 0) for i in range(60)]
    data = odd.rows() + more + more[:5]
    docs = odd.documents(spark, data, ("word", "id", "shard", "a", "n", "ids", "phrase"))
    got = sorted(tuple(r) for r in co.collocations(docs, min_count, max_words, shard_words=shard).collect())
    assert got == sorted(brute_collocations([(r[2], r[1]) for r in data], min_count, max_words)) and got
    assert co.collocations(docs.limit(0)).count() == 0


def test_collocations_top_and_ties(spark):
    """Equal scores and counts stand in the order of UTF-8 bytes; the cut is by rank."""
    pairs = [("é", "b"), ("z", "b"), ("\U0001f600", "q"), ("￮", "q"), ("aa", "c"), ("ab", "d")]
    rows = [("en", f"{a} {b}") for a, b in pairs for _ in range(4)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for top in (2, 6):
        got = sorted(tuple(r) for r in co.collocations(docs, 2, 3, top=top).collect())
        assert got == sorted(brute_collocations(rows, 2, 3, top=top)) and len(got) == top


def test_large_counts_are_exact():
    """Products beyond 64 bits, and beyond what 38 digits hold."""
    a, left, right = 10**17 + 7, 10**18 + 9, 10**18 + 21
    cuts = pa.array([[{"k": 1, "l": left, "r": right}, {"k": 2, "l": right, "r": left}]])
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2, 3]]), pa.array([a]), cuts], ["ids", "a", "cuts"])
    row = next(co.scored(iter([batch]))).to_pylist()[0]
    assert row == {"ids": [1, 2, 3], "a": a, "l": left, "r": right, "score": 1000000 * a * a // (left * right)}


def test_bitmaps_shift_and_count():
    rng = np.random.default_rng(2)
    at = np.unique(rng.integers(0, 5000, 900))
    key, byte, bits = co.packed(np.zeros(len(at), np.int64), at)
    positions = lambda b, x: sorted(8 * p + k for p, v in zip(b.tolist(), x.tolist()) for k in range(8) if v >> k & 1)
    assert positions(byte, bits) == at.tolist() and (bits != 0).all() and len(np.unique(byte)) == len(byte)
    assert positions(*co.shifted(key, byte, bits)[1:]) == (at + 1).tolist()


@pytest.mark.parametrize("n_words", [2, 3, 4])
def test_tiles_are_whole_and_small(n_words):
    """Sorted phrases and counts come back from their tiles, empty ones too, in a few bytes each."""
    rng = np.random.default_rng(n_words)
    for n in (0, 1, 2, 20_000):
        keys = [rng.integers(0, high, n) for high in (40, 400_000, 3, 70_000)[:n_words]]
        keys, ones = co.summed(keys, rng.integers(1, 400, n))
        for numbers in (ones, np.zeros_like(ones)):
            for got, column in zip(co.tile_rows(co.tile_bytes(keys, numbers), n_words), [*keys, numbers], strict=True):
                assert got.tolist() == column.tolist()
        tiles, data = co.phrase_tiles(keys, ones, 3)
        parts = [co.tile_rows(d, n_words) for d in data]
        rows = sorted(r for p in parts for r in zip(*(c.tolist() for c in p)))
        assert rows == sorted(zip(*(c.tolist() for c in [*keys, ones]))) and len(set(tiles)) == len(tiles)
        assert n < 20_000 or sum(map(len, data)) < (2 + 3 * n_words) * len(ones)


def test_shards_do_not_stay(spark):
    """Once phrases are counted nothing of the shards is left in the shared folder."""
    here = Path(scratch_root(spark).removeprefix("file:").replace("//", "/")) / "stepwright" / spark.sparkContext.applicationId
    names = lambda: {p.name for p in here.glob("*")}
    before = names()
    docs = spark.createDataFrame([("en", "a b c d")] * 30, "lang string, text string")
    words, sizes, phrases = co.phrase_counts(docs, 10, 3, 50)
    assert not [x for x in names() - before if x.startswith(("shard", "word-totals", "words-numbered"))]
    assert (words.count(), sizes.first()["n"], phrases.count()) == (4, 120, 9)


# -- decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_contamination(docs, items, width):
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(width, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1) if v else ():
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    if item_id is not None:
                        names.add(str(item_id))
        joined = ",".join(sorted(names))
        yield doc_id, len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


def contaminated_tables(spark):
    rng = random.Random(11)
    vocabulary = ["the", "THE", "of", "a", "é", "漢", "x1", "rare", "word", "B2"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "\n", "[", "`"]) for _ in range(n))
    items = [(i, sentence(rng.randrange(1, 30))) for i in range(12)] + [(3, sentence(14)), (None, sentence(12)), (40, None), (41, ""), (42, "... !"), (43, "rare"), (44, "the the the the")]
    items += [(100, items[0][1]), items[1], (None, "only here")]
    docs = [(i, sentence(rng.randrange(40)) + " " + rng.choice(items)[1].__str__() + " " + sentence(rng.randrange(20))) for i in range(40)]
    docs += [docs[0], (None, docs[1][1]), (7, docs[2][1]), (60, "the " * 300), (61, "the the the the"), (62, "only here" * 2), (63, "Only, HERE")]
    docs += [(r[0], r[1]) for r in odd.rows()]
    d = spark.createDataFrame([(*r, "x", "y", 0) for r in docs], "doc_id long, text string, word string, term string, row long")
    b = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, phrase string, n int")
    return docs, items, d, b


@pytest.mark.parametrize(("width", "most"), [(10, None), (3, 0)])
def test_contamination(spark, monkeypatch, width, most):
    """Also with nothing broadcast by the operator."""
    if most is not None:
        monkeypatch.setattr(de, "MOST_TERMS", most)
    docs, items, d, b = contaminated_tables(spark)
    got = de.contamination(d, b, width)
    names = [*got.columns][:6]
    rows = Counter(tuple(r[n] for n in names) for r in got.collect())
    want = Counter(brute_contamination(docs, items, width))
    assert rows == want and any(k[2] for k in want)
    clean = {r["doc_id"] for r in de.decontaminated(d, b, width).collect()}
    assert clean == {k[0] for k in want} - {k[0] for k in want if k[5]}


def test_contamination_of_empty_tables(spark):
    _, _, d, b = contaminated_tables(spark)
    assert de.contamination(d.limit(0), b).count() == 0
    got = de.contamination(d, b.limit(0))
    assert got.where("contaminated OR n_items > 0 OR n_hit > 0").count() == 0 and got.count() == d.count()


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity(spark, slop):
    docs, _, d, _ = contaminated_tables(spark)
    index = de.positional_index(d.select("doc_id", "text"))
    phrases = [(1, ["rare", "word"]), (2, ["the", "of", "the"]), (3, ["b2", "é", "a"]), (4, ["nowhere", "a"]), (5, ["rare"])]
    table = spark.createDataFrame(phrases, "phrase long, words array<string>")
    ranked = de.ranked_phrases(index, table)
    got = Counter((r["row"], r["phrase"], r["at"]) for r in de.proximity_matches(index, ranked, slop).collect())
    texts = {r["row"]: [] for r in index.select("row").distinct().collect()}
    for r in index.where("word IS NOT NULL").select("row", "pos", "word").orderBy("row", "pos").collect():
        texts[r["row"]].append(r["word"])
    freq = Counter(w for t in texts.values() for w in t)
    want = Counter()
    for p, ws in phrases:
        if all(w in freq for w in ws):
            head, need, span = min(ws, key=lambda w: (freq[w], w)), Counter(ws), len(ws) + slop
            for row, t in texts.items():
                for at in (i for i, w in enumerate(t) if w == head):
                    if any(not need - Counter(t[s : s + span]) for s in range(max(0, at - span + 1), at + 1)):
                        want[row, p, at] += 1
    assert got == want and {p for _, p, _ in want} >= {1, 2, 3, 5}
    exact = {(r["row"], r["phrase"], r["start"]) for r in de.phrase_matches(index, ranked).collect()}
    assert exact == {(row, p, i) for row, t in texts.items() for p, ws in phrases for i in range(len(t)) if t[i : i + len(ws)] == ws}


# -- hard negatives


def brute_negatives(rows, is_anchor, k=5, m=5, percent=80):
    sound = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, v, y in rows if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)]
    for n, (i, y, v) in enumerate(sound):
        if not is_anchor(i):
            continue
        others = [(sum(a * b for a, b in zip(v, w)), j, z) for o, (j, z, w) in enumerate(sound) if o != n and len(w) == len(v)]
        for s, p, _ in sorted((x for x in others if x[2] == y), key=lambda x: (-x[0], x[1]))[:k]:
            fit = sorted((x for x in others if x[2] != y and percent * s <= 100 * x[0] <= 100 * s), key=lambda x: (-x[0], x[1]))
            for rank, (t, j, _) in enumerate(fit[:m], 1):
                yield i, p, rank, j, s, t


@pytest.mark.parametrize(("shard", "block", "leaf", "size"), [(1 << 15, 1 << 12, 64, 1.0), (60, 7, 4, 1.0), (200, 9, 8, 100_000.0)])
def test_hard_negatives(spark, monkeypatch, shard, block, leaf, size):
    monkeypatch.setattr(hn, "LEAF", leaf)
    rng = np.random.default_rng(8)
    rows = [(int(i), (size * rng.normal(rng.integers(0, 3), 0.4, 6)).astype("f4").tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(1000 + i, rows[10][1], i % 4) for i in range(120)]  # ties
    rows += [(2000, None, 1), (2001, [1.0] * 6, None), (None, [1.0] * 6, 1), (2002, [float("nan")] * 6, 1), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(2004, [float("inf")] * 6, 1), (2005, [0.0] * 6, 1), (2010, [2.0, 1.0], 1), (2011, [2.0, 1.5], 1), (2012, [2.0, 1.2], 2), (2020, [], 1), (2030, [], 1), (2031, [], 3)]
    rows += [rows[20], rows[30], (40, rows[41][1], 2)]  # repeated rows and ids
    table = spark.createDataFrame([(*r, 0, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, row int, shard string, block int")
    got = hn.hard_negatives(table, F.col("vec_id") % 10 == 0, shard=shard, block=block)
    assert Counter(map(tuple, got.collect())) == Counter(brute_negatives(rows, lambda i: i % 10 == 0))
    assert hn.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(table, F.col("vec_id") < -5).count() == 0


def test_intervals_hold_and_prune():
    """No product of members lies outside its nodes' interval, and groups of anchors are left at once."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 200, (6, 16))
    v = np.floor(np.concatenate([c + rng.normal(0, 8, (200, 16)) for c in centres]))
    y = np.repeat(np.arange(6), 200)
    tree, anchors = hn.Tree(v, y), hn.Tree(v[::10], y[::10])
    every = np.arange(len(tree.range))
    for i in range(len(anchors.range)):
        low, high = hn.product_bounds(anchors, i, tree, every)
        a, b = anchors.range[i]
        exact = hn.products(anchors.vectors[a:b], tree.vectors)
        for j, (c, d) in enumerate(tree.range):
            assert low[j] <= exact[:, c:d].min() and exact[:, c:d].max() <= high[j]
    own, number = np.arange(len(anchors.vectors)) - 10_000, np.arange(len(v))
    n, ends = len(own), np.iinfo(np.int64)
    best = hn.Best(3, [[] for _ in own], np.full(n, ends.min))
    scored = hn.dual_search(anchors, own, np.arange(n + 1), np.full(n, ends.max), best, tree, number, number, True)
    leaves = sum(not c for c in tree.children) * sum(not c for c in anchors.children)
    assert 0 < scored < leaves / 4


def test_leaves_of_several_labels_meet_their_own_only():
    """With labels of few rows each, leaves that share no label are not scored against each other."""
    rng = np.random.default_rng(5)
    v, y = np.floor(rng.normal(0, 200, (2000, 8))), np.arange(2000) // 5
    tree, anchors = hn.Tree(v, y), hn.Tree(v[::5], y[::5])
    number = tree.order
    own = anchors.order * 5
    best = hn.Best(4, [[] for _ in own], np.full(len(own), np.iinfo(np.int64).min))
    scored = hn.dual_search(anchors, own, np.arange(len(own) + 1), np.full(len(own), np.iinfo(np.int64).max), best, tree, number, number, True)
    assert 0 < scored <= sum(not c for c in tree.children) + sum(not c for c in anchors.children)
    for n, row in enumerate(own.tolist()):
        exact = sorted(((int(v[row] @ v[r]), -r) for r in range(row + 1, row + 5)), reverse=True)
        assert best.rows(n) == [(s, -r) for s, r in exact]


def test_words_are_split_at_blanks_only(spark):
    """Letters beyond A-Z keep their case, and other separators of Unicode stay within words."""
    texts = ["É\x1cA B É\x1cA B", "ÉTÉ\tÉTÉ  ÉTÉ. x\x85y  X\x85y"]
    docs = spark.createDataFrame([("fr", t) for t in texts * 10], "lang string, text string")
    got = {r["phrase"]: (r["a"], r["n"]) for r in co.collocations(docs, 10, 2).collect()}
    assert got == {"É\x1ca b É\x1ca b": (10, 70), "ÉtÉ ÉtÉ": (20, 70), " x\x85y  x\x85y": (10, 70)}
