"""Profiles of runs: calls, rows, seconds and tokens per tag, from observed metrics.

A batch job's rows and tokens are observed as they stream by (DataFrame.observe), so nothing is counted
twice and no job is added; its seconds are those of the block that runs it. A stream reports each of
its batches to a listener. Both give rows of one table, which operators.stats.profile_rollup rolls up.

Defined cases: a block that fails leaves no row; a job that is never run leaves nothing to wait for;
null tokens count 0; a stream without observed metrics is not recorded.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROFILE = "tag string, num_prompts long, n long, wall_s double, gen_tokens long, peak_mem_gb double, meta map<string,string>"
#: Prefix of the names of observations whose stream is recorded.
MARK = "profile:"


def metrics(tokens: Column | None) -> list[Column]:
    total = F.lit(0).cast("long") if tokens is None else F.coalesce(F.sum(tokens), F.lit(0)).cast("long")
    return [F.count(F.lit(1)).alias("rows"), total.alias("tokens")]


class RunProfile:
    """Records of one run. meta: fields of all its records, such as the dataset."""

    def __init__(self, spark: SparkSession, **meta: str):
        self.spark, self.meta = spark, {k: str(v) for k, v in meta.items()}
        self.records: list[tuple] = []

    def add(self, tag: str, rows: int, seconds: float, tokens: int = 0, n: int = 1, **meta: str) -> None:
        self.records.append((tag, int(rows), int(n), float(seconds), int(tokens), None, self.meta | {k: str(v) for k, v in meta.items()}))

    @contextmanager
    def timed(self, tag: str, df: DataFrame, tokens: Column | None = None, n: int = 1, **meta: str) -> Iterator[DataFrame]:
        """df as it is to be run, once, in the block; rows and sums of tokens are those that it gave.

        n: samples of a row.
        """
        seen = Observation()
        began = time.perf_counter()
        yield df.observe(seen, *metrics(tokens))
        seconds = time.perf_counter() - began
        found = seen.get
        self.add(tag, found["rows"], seconds, found["tokens"], n, **meta)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.records, PROFILE)

    def write(self, path: str) -> None:
        """Append the records so far to the profile at path."""
        self.table().coalesce(1).write.mode("append").parquet(path)
        self.records.clear()

    def streams(self, n: int = 1) -> StreamListener:
        """A listener that records the batches of observed streams; add it to spark.streams."""
        return StreamListener(self, n)


def observed(stream: DataFrame, tag: str, tokens: Column | None = None) -> DataFrame:
    """A stream whose batches are recorded under the tag."""
    return stream.observe(MARK + tag, *metrics(tokens))


class StreamListener(StreamingQueryListener):
    def __init__(self, profile: RunProfile, n: int):
        self.profile, self.n = profile, n

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            if name.startswith(MARK) and row["rows"]:
                self.profile.add(name.removeprefix(MARK), row["rows"], progress.batchDuration / 1000, row["tokens"], self.n, batch=progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The records at path; none where nothing was written."""
    try:
        return spark.read.schema(PROFILE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], PROFILE)
