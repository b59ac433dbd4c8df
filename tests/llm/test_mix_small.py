"""The pipeline's mixing stage with sources smaller than a block of the schedule."""

from collections import Counter

import corpus_pipeline

from stepwright.llm import mixing


def test_tiny_sources_end_at_their_targets(spark, monkeypatch):
    rows = [(i, "w " * 40, f"s{i % 150:03}") for i in range(300)] + [(1000 + i, "v " * 9000, "big") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {}
    for r in mixing.mix_counts(docs, exact=True).collect():
        target[r["doc_id"]] = r["target"]
    source = {r[0]: r[2] for r in rows}
    want = {source[i]: max(1, int(t + 0.5)) for i, t in target.items()}
    for options in ({}, {"weights": (0.01, 3.0, 1.0)}):
        counts = mixing.mix_counts(docs, exact=True, **options).collect()
        taken, goal = Counter(), {}
        for r in counts:
            taken[source[r["doc_id"]]] += r["taken"]
            goal[source[r["doc_id"]]] = max(1, int(r["target"] + 0.5))
        assert dict(taken) == goal
    monkeypatch.setattr(mixing, "schedule", lambda targets, n: targets.sparkSession.createDataFrame([], "slot long, source_no int, block_no long"))
    mixed = Counter()
    for r in corpus_pipeline.mixed(spark, docs, "").collect():
        mixed[r["source"]] += len(r["text"].split())
    assert dict(mixed) == want


def test_query_ends_each_tiny_source_at_its_target(spark):
    """300 sources far below a block of the schedule beside one of 6.3 million words."""
    rows = [(i, "w " * 300, f"s{i:03}") for i in range(300)] + [(1000 + i, "v " * 9000, "big") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source, taken, target = {r[0]: r[2] for r in rows}, Counter(), {}
    for r in mixing.mix_counts(docs).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert len(target) == 301 and all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_rows_alike_but_for_their_source(spark):
    """Equal ids and texts of unlike sources: each source's words come from its own rows."""
    rows = [(5, "a b c d e f g h", s) for s in ("x", "y", None, "x")] + [(6, "k l m n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = {}
    for r in mixing.mix_slots(docs).collect():
        goal[r["source"]] = max(1, int(r["target"] + 0.5))
    words = Counter()
    for r in mixing.mix_documents(docs).collect():
        words[r["source"]] += len(r["text"].split())
    assert dict(words) == goal
