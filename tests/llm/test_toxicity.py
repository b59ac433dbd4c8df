"""The classifier on made documents: accuracy, held-out labels, and neutral mentions of groups."""

import random

import odd
from pyspark.sql import functions as F

from stepwright.llm import toxicity

RNG = random.Random(0)
WORDS = [f"word{i}" for i in range(60)]


def corpus(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        words = [RNG.choice(WORDS) for _ in range(20)]
        toxic = i % 3 == 0
        if toxic:
            words.insert(3, "idiotic" if i % 2 else "idiots")
            if i % 4:
                words.insert(5, "muslims")
        elif i % 40 == 1:
            words.insert(5, "muslims")
        rows.append((i, " ".join(words), None, None, 0))
        labels.append((i, 1, int(toxic)))
    docs = odd.documents(spark, rows + [(9000, None, None, None, None), (9001, "", None, None, None), (None, "idiots " * 3, None, None, None)], ("score", "toxic", "words"))
    return docs, spark.createDataFrame([*labels, (5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


def test_scores(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got.values())
    wrong = [i for i in range(600) if got[i]["predicted"] != int(i % 3 == 0)]
    assert len(wrong) < 12
    assert got[9000]["score"] == got[9001]["score"]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


def test_group_names_carry_no_weight(spark):
    docs, labels = corpus(spark)
    plain = toxicity.train(docs, labels, fairness=0.0, least_association=1.0)
    fair = toxicity.train(docs, labels, fairness=100.0, least_association=1.0)
    neutral = " ".join(["word1", "muslims", "word2"])
    gain = lambda m: toxicity.score_text(neutral, m, {}) - toxicity.score_text("word1 word2", m, {})
    assert gain(fair) < gain(plain) and gain(fair) < 0.05


def test_no_labels(spark):
    docs, labels = corpus(spark, 20)
    model = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, model).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    import zlib

    from pyspark.sql import functions as F

    from stepwright.llm import toxicity

    data = [(i, ("you are vile trash " if i % 2 else "a calm walk by the lake ") * (1 + i % 5)) for i in range(120)]
    docs = spark.createDataFrame([*data, data[0], (500, "word " * 60_000), (501, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in data], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(tuple, toxicity.score_documents(docs, toxicity.train(docs, y)).select("doc_id", "score", "predicted").collect())) for y in (labels, flipped)]
    assert scores[0] == scores[1] and len(scores[0]) == 123
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}


def test_sample_is_bounded_by_rows(spark):
    """Labelled ids that many rows repeat don't make the sample larger than max_rows."""
    rows = [(i % 7, f"text {i % 50}") for i in range(600)] + [(100 + i, f"other {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(7), *range(100, 180)]], "doc_id long, toxic int")
    for most in (1, 40, 10_000):
        sample = toxicity.training_sample(docs, labels, most, 11)
        ids = {r["doc_id"] for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()}
        assert sample.columns == ["doc_id", "text", "toxic"]
        assert sample.count() == min(most, sum(r[0] in ids for r in rows))
