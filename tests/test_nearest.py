"""Best partners from a trie against all pairs, and that large blocks make no pair for each two texts."""

import random

import pytest

from stepwright.operators import match, nearest


def brute(left, right, least):
    found = []
    for a in left:
        best = (-1, 0.0)
        for j, b in enumerate(right):
            r = match.indel_ratio(a, b)
            if r >= least and (best[0] < 0 or r > best[1]):
                best = (j, r)
        found.append(best)
    return found


@pytest.mark.parametrize(("letters", "longest"), [("ab", 12), ("0123456789", 9), ("é𝒳a1\0", 70), ("abc de", 140)])
def test_nearest_against_all_pairs(monkeypatch, letters, longest):
    """Empty texts, many ties, characters of one side only, texts of more than 64 characters, small batches."""
    rng = random.Random(longest)
    some = lambda n: ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)]
    left = some(15) + ["", "a", "xyz", "ab" * 64, "b" * 65]
    right = list(dict.fromkeys([*some(50), left[3] + "a", "", "a\0", "ba" * 65]))
    rng.shuffle(right)
    for least, nodes, pairs in [(0.0, 1 << 17, 1 << 23), (0.6, 40, 300), (0.9, 1 << 17, 300), (1.0, 40, 1 << 23)]:
        monkeypatch.setattr(nearest, "NODES_AT_ONCE", nodes)
        monkeypatch.setattr(nearest, "PAIRS_OPEN", pairs)
        best, ratio = nearest.nearest_texts(left, right, least)
        assert list(zip(best.tolist(), ratio.tolist())) == brute(left, right, least)


def test_large_blocks_make_no_pairs(spark, monkeypatch):
    """Of a large block only each part's best pairs go on; a small block is compared as it is; the first in order wins."""
    monkeypatch.setattr(nearest, "LEFT_IN_TASK", 70)
    monkeypatch.setattr(nearest, "CHARACTERS_IN_TASK", 2500)
    left = [(i, "large", f"Supplier#{i:05}") for i in range(200)] + [(i, "small", f"Supplier#{i:05}") for i in range(200, 204)] + [(300, None, "Supplier#00001"), (301, "large", None), (302, "lone", "x")]
    right = [(5000 - i, "large", f"Customer#{i:05}") for i in range(0, 1200, 3)] + [(None, "large", "Customer#00034"), (7, "large", "Customer#00034"), (9, "small", "Customer#00201"), (8, "small", "Customer#00202"), (1, None, "Supplier#00001")]
    frames = [spark.createDataFrame(rows, "id long, b string, t string") for rows in (left, right)]
    ranked, rank = [], match.best_similar
    monkeypatch.setattr(match, "best_similar", lambda pairs, *a: (ranked.append(pairs), rank(pairs, *a))[1])
    got = {r["left_id"]: (r["right_id"], r["right_t"], r["similarity"]) for r in match.best_partners(*frames, "b", "t", "id", 0.5).collect()}
    want = {}
    for i, b, t in left:
        near = [(-match.indel_ratio(t, u), k is not None, k, u) for k, c, u in right if b == c and b and t and match.indel_ratio(t, u) >= 0.5]
        if near:
            ratio, _, k, u = min(near, key=lambda x: x[:2] + (x[2] or 0,))
            want[i] = (k, u, -ratio)
    assert got == want and len(got) == 204
    assert ranked[0].count() <= 200 * 4 + 4 * 2  # of 80,000 pairs of texts
