"""Toxicity by a counterfactually regularised classifier.

Features are the presence of words and of their first three, four and six characters, so inflected
forms of a learnt word are known as well. Which features count is decided by their association
with the label (a likelihood-ratio statistic on document counts); the weights come from a
logistic regression with an L2 penalty and a counterfactual one: every training text that names
a group is copied with the name exchanged for the others of its kind, and squared differences of
the log-odds of a text and its copies are added to the loss. A name that stands in toxic texts more
often by chance so cannot carry weight, and neutral mentions of a group stay neutral.

The classifier is fitted on a bounded sample of labelled rows (max_rows, the first by a seeded
hash); features are counted on the executors, and only the selected ones (max_features) and the
sample's rows in them reach the driver. Every document is scored on its whole text.

Defined cases: a null text is the empty text, whose score is the classifier's intercept; labels
that are null or without a document are not used; a doc_id with several labels counts as toxic
if one of them is; without both labels in the sample every score is 0; an empty table gives an
empty result; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import kept_in_worker, map_texts_in_batches, materialise

WORD = re.compile(r"\w+")
#: Names of groups, by kind; within a kind any may stand for any other.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("immigrants", "refugees", "locals", "foreigners"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
PREFIXES = (3, 4, 6)


@dataclass
class Model:
    """weights by feature; score is the logistic of intercept plus the weights of present features."""

    intercept: float = -np.inf
    weights: dict[str, float] = field(default_factory=dict)


def features_of(word: str) -> list[str]:
    """The word and its longer prefixes, marked so that they can't be mistaken for words."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def counterfactuals(words: set[str], groups) -> list[tuple[str, str]]:
    """(name in the text, name put in its place), for every name and every other of its kind."""
    return [(old, new) for group in groups for old in group if old in words for new in group if new != old]


def held_out(doc_id: Column) -> Column:
    """True where labels are kept from learning: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """doc_id, text, toxic of at most max_rows labelled rows, written once.

    The first max_rows labelled ids by a seeded hash; where these are of more rows, the first of
    the rows by a hash of id and text.
    """
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    rows = rows.withColumns({"spot": F.xxhash64(F.lit(seed), "doc_id", "text"), "number": F.monotonically_increasing_id()})
    rows = materialise(rows, "toxicity-sample")
    last = rows.select("spot", "number").orderBy("spot", "number").offset(max(0, max_rows - 1)).limit(1).first()
    if last is not None:  # rows that are equal in all else are told apart by number
        rows = rows.where((F.col("spot") < last["spot"]) | ((F.col("spot") == last["spot"]) & (F.col("number") <= last["number"])))
    return rows.drop("spot", "number")


def associated_features(sample: DataFrame, max_features: int, least: float, least_docs: int) -> list[str]:
    """Features whose presence goes with the label, by the likelihood ratio of their counts."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("toxicity-features", dict)
        for batch in found:
            names, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own = {f for w in words_of(text) for f in features_of(w)}
                names += own
                toxic += [int(label == 1)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int64())], ["feature", "toxic"])

    counts = map_texts_in_batches(sample.select("text", "toxic"), batches, "feature string, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    totals = sample.agg(F.sum((F.col("toxic") == 1).cast("double")), F.count(F.lit(1)).cast("double")).first()
    with_label, rows = totals[0] or 0.0, totals[1]
    if not 0 < with_label < rows:
        return []
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, n = F.col("a"), F.col("n")
    ratio = sum(
        part(seen, expected)
        for seen, expected in (
            (a, n * with_label / rows),
            (n - a, n * (rows - with_label) / rows),
            (with_label - a, (rows - n) * with_label / rows),
            (rows - with_label - n + a, (rows - n) * (rows - with_label) / rows),
        )
    )
    chosen = counts.where(F.col("n") >= least_docs).withColumn("ratio", 2 * ratio).where(F.col("ratio") >= least)
    return [r[0] for r in chosen.orderBy(F.desc("ratio"), "feature").limit(max_features).select("feature").collect()]


def encoded_sample(sample: DataFrame, chosen: list[str], groups) -> list:
    """Per sampled row: toxic, numbers of its features, and per counterfactual copy the numbers
    that the exchange takes away and brings."""
    number = {f: i for i, f in enumerate(chosen)}

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows, gone, come = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                own = {number[f] for w in words for f in features_of(w) if f in number}
                rows.append(sorted(own))
                g, c = [], []
                for old, new in counterfactuals(words, groups):
                    other = {number[f] for w in (words - {old}) | {new} for f in features_of(w) if f in number}
                    g.append(sorted(own - other))
                    c.append(sorted(other - own))
                gone.append(g)
                come.append(c)
            nested = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array(rows, pa.list_(pa.int32())), pa.array(gone, nested), pa.array(come, nested)],
                ["toxic", "own", "gone", "come"],
            )

    schema = "toxic int, own array<int>, gone array<array<int>>, come array<array<int>>"
    return map_texts_in_batches(sample.select("text", "toxic"), batches, schema).collect()


def fit(rows: list, n: int, l2: float, fairness: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated gradient descent on the penalised logistic loss."""
    y = np.array([float(r["toxic"] == 1) for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r["own"]) for r in rows])
    of = np.array([i for r in rows for i in r["own"]], np.int64)
    changes = [(g, c) for r in rows for g, c in zip(r["gone"], r["come"]) if g or c]
    swap_at = np.repeat(np.arange(len(changes)), [len(g) + len(c) for g, c in changes])
    swap_of = np.array([i for g, c in changes for i in (*g, *c)], np.int64)
    swap_by = np.array([s for g, c in changes for s in (*[-1.0] * len(g), *[1.0] * len(c))])
    w, b = np.zeros(n), float(np.log(y.mean() / (1 - y.mean())))
    mw, vw, mb, vb, rate = np.zeros(n), np.zeros(n), 0.0, 0.0, 0.1
    for step in range(1, steps + 1):
        z = b + np.bincount(at, w[of], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(rows)
        grad = np.bincount(of, error[at], n) + l2 * w
        if len(changes):
            moved = np.bincount(swap_at, swap_by * w[swap_of], len(changes))
            grad += 2 * fairness / len(changes) * np.bincount(swap_of, swap_by * moved[swap_at], n)
        mw, vw = 0.9 * mw + 0.1 * grad, 0.999 * vw + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        lower, upper = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (mw / lower) / (np.sqrt(vw / upper) + 1e-8)
        b -= rate * (mb / lower) / (np.sqrt(vb / upper) + 1e-8)
    return float(b), w


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    max_features: int = 20_000,
    least_association: float = 18.0,
    least_docs: int = 3,
    l2: float = 1e-4,
    fairness: float = 1.0,
    groups=IDENTITY_GROUPS,
    seed: int = 11,
) -> Model:
    """The classifier from the labelled documents that are not held out.

    max_rows bounds the labelled rows it is fitted on, max_features what is broadcast;
    least_association is the likelihood-ratio statistic a feature must reach in least_docs
    documents; fairness weighs the counterfactual penalty.
    """
    sample = training_sample(docs, labels, max_rows, seed)
    chosen = associated_features(sample, max_features, least_association, least_docs)
    rows = encoded_sample(sample, chosen, groups)
    toxic = sum(r["toxic"] == 1 for r in rows)
    if not 0 < toxic < len(rows):
        return Model()
    b, w = fit(rows, len(chosen), l2, fairness)
    return Model(b, {f: float(x) for f, x in zip(chosen, w)})


def score_text(text: str | None, model: Model, known: dict[str, tuple[str, ...]]) -> float:
    """known: the features that count, by word; a cache of bounded size."""
    present: set[str] = set()
    for word in words_of(text):
        own = known.get(word)
        if own is None:
            own = tuple(f for f in features_of(word) if f in model.weights)
            if len(known) < 100_000:
                known[word] = own
        if own:
            present.update(own)
    z = model.intercept + sum(model.weights[f] for f in sorted(present))
    return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z))))) if model.intercept > -np.inf else 0.0


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score is 0.5 or more) for every document."""
    shared, call = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_in_worker(("toxicity", call), dict)
        for batch in found:
            scores = [score_text(t, shared.value, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_texts_in_batches(docs.select("doc_id", "text"), batches, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text is predicted toxic; all columns stay.

    The decision is a function of the text, applied to the rows as they stream by: no join.
    """
    shared, call = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options)), uuid.uuid4().hex
    place = docs.columns.index("text")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_in_worker(("toxicity", call), dict)
        for batch in found:
            yield batch.filter(pa.array([score_text(t, shared.value, known) < 0.5 for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_texts_in_batches(docs, batches, docs.schema)
