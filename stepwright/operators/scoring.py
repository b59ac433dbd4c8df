"""Log-probabilities that are asked of a scorer once.

A request is a prompt, a target and the scorer's settings; its digest is its name in a table of
results. What the table lacks is found by an anti join, put in the order of prompts, so that prompts
which begin alike are neighbours (the order in which a prefix tree is walked), and packed into batches
by what each adds beyond its neighbour. Results are appended per run; a run that fails appends
nothing, and one that is repeated asks only for what is still missing.

Defined cases: equal requests are asked once; a null prompt or target is the empty text; an empty
target is a request like any other; a request longer than the budget is a batch of its own; results
that two runs appended count once, the smaller by value; without a table nothing is stored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "digest string, logp double, n_tokens long"
#: A scorer: (prompt, target) pairs to (log-probability, number of target tokens) pairs.
Scorer = Callable[[list[tuple[str, str]]], list[tuple[float, int]]]


def request_digest(prompt: Column, target: Column, settings: str = "") -> Column:
    """The digest of a request; lengths stand before the texts, so no two requests run together."""
    parts = [F.coalesce(c, F.lit("")) for c in (F.lit(settings), prompt, target)]
    return F.sha2(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]), 256)


def missing_requests(requests: DataFrame, stored: DataFrame, settings: str = "") -> DataFrame:
    """digest, prompt, target of the different requests (prompt, target) without a stored result."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    asked = requests.select(request_digest(F.col("prompt"), F.col("target"), settings).alias("digest"), text("prompt"), text("target"))
    return asked.dropDuplicates(["digest"]).join(stored.select("digest"), "digest", "left_anti")


def added(prompt: str, target: str, before: str) -> int:
    """Characters that a request adds to a batch whose last prompt is before: what they begin with alike is there."""
    return len(prompt) - len(os.path.commonprefix((prompt, before))) + len(target)


def batches(rows: Iterator[tuple[str, str, str]], budget: int) -> Iterator[list[tuple[str, str, str]]]:
    """Runs of (digest, prompt, target) whose added characters keep within the budget."""
    held, used, last = [], 0, ""
    for row in rows:
        cost = added(row[1], row[2], last)
        if held and used + cost > budget:
            yield held
            held, used, cost = [], 0, len(row[1]) + len(row[2])
        held.append(row)
        used, last = used + cost, row[1]
    if held:
        yield held


def side_by_side(requests: DataFrame) -> DataFrame:
    """The requests parted by ranges of prompts and in order within."""
    return requests.repartitionByRange("prompt", "target").sortWithinPartitions("prompt", "target")


def scored(requests: DataFrame, scorer: Scorer, budget: int) -> DataFrame:
    """digest, logp and n_tokens of requests (digest, prompt, target), asked batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in zip(f["digest"], f["prompt"], f["target"]))
        for batch in batches(rows, budget):
            found = scorer([(p, t) for _, p, t in batch])
            if len(found) != len(batch):
                raise ValueError(f"{len(found)} results for {len(batch)} requests")
            yield pd.DataFrame([(d, float(x), int(n)) for (d, _, _), (x, n) in zip(batch, found)], columns=["digest", "logp", "n_tokens"])

    return side_by_side(requests).select("digest", "prompt", "target").mapInPandas(run, RESULTS)


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """The table of results at path, a row for each digest; empty where there is none yet."""
    try:
        table = spark.read.schema(RESULTS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], RESULTS)
    return table.groupBy("digest").agg(F.min(F.struct("logp", "n_tokens")).alias("r")).select("digest", "r.*")


def score(requests: DataFrame, path: str, scorer: Scorer, settings: str = "", budget: int = 16_384) -> DataFrame:
    """requests (prompt, target and any columns) with logp and n_tokens; results are kept at path.

    Only what path lacks is asked of the scorer. settings: what else a result depends on, such as
    the model and the support. budget: characters of a batch.
    """
    spark = requests.sparkSession
    missing = missing_requests(requests, stored_results(spark, path), settings)
    scored(missing, scorer, budget).write.mode("append").parquet(path)
    named = requests.withColumn("__digest", request_digest(F.col("prompt"), F.col("target"), settings))
    return named.join(stored_results(spark, path).withColumnRenamed("digest", "__digest"), "__digest").drop("__digest")
