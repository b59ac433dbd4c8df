"""The pipeline's near-copy stage against Jaccard similarities of all pairs."""

import corpus_pipeline
import pytest

from stepwright.llm import near_copies

WIDTH = 5


def shingles(text):
    words = (text or "").encode().translate(near_copies.LOWER).split()
    return frozenset(tuple(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))) if words else frozenset()


def kept_by_all_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return set(least.values())


def test_stage_on_small_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = kept_by_all_pairs([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()} == want


@pytest.mark.parametrize("sample", [1, 64])
def test_groups_and_odd_rows(spark, monkeypatch, sample):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: i % 60] + ["x" * (i // 60 + 1)] + base[i % 60 + 1 :])) for i in range(180)]
    rows += [(300 + i, " ".join([f"u{i}_{k}" for k in range(i % 40)] + base[:30])) for i in range(40)]
    chain = [f"c{i}" for i in range(100)]
    rows += [(500 + i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(10)]
    rows += [(700, None), (701, ""), (702, " \n"), (703, "One two"), (704, "one TWO"), (705, "one"), (706, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()} == kept_by_all_pairs(rows)
