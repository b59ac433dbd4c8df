"""Requests asked once, the append log, ragged parts and support, on small frames."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from stepwright.operators import rewards, scoring, steps
from stepwright.streaming import append_log


def stub(calls):
    """A scorer that counts what it is asked for."""

    def score(pairs):
        calls.add(len(pairs))
        return [(-float(len(p)) - len(t) / 100, len(t.split())) for p, t in pairs]

    return score


def test_requests_are_asked_once(spark, tmp_path):
    rows = [(i, f"question {i % 7} with steps {i % 3}", f"answer {i % 2}") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "p", ""), (103, "p", None)]
    grid = spark.createDataFrame(rows, "id int, prompt string, target string")
    path, calls = f"file://{tmp_path}/results", spark.sparkContext.accumulator(0)
    got = {r["id"]: (r["logp"], r["n_tokens"]) for r in scoring.score(grid, path, stub(calls), "m").collect()}
    different = {(p or "", t or "") for _, p, t in rows}
    assert calls.value == len(different)
    assert got == {i: (-float(len(p or "")) - len(t or "") / 100, len((t or "").split())) for i, p, t in rows}
    assert scoring.score(grid, path, stub(calls), "m").count() == len(rows) and calls.value == len(different)  # a second run asks for nothing
    more = grid.unionByName(spark.createDataFrame([(200, "new", "one")], grid.schema))
    assert scoring.score(more, path, stub(calls), "m").count() == len(rows) + 1 and calls.value == len(different) + 1
    assert scoring.score(grid, path, stub(calls), "other settings").count() == len(rows) and calls.value == 2 * len(different) + 1


def test_failed_run_stores_nothing_and_repeats_count_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/results", spark.sparkContext.accumulator(0)
    grid = spark.createDataFrame([(f"p{i}", "t") for i in range(40)], "prompt string, target string").repartition(4)

    def broken(pairs):
        if any(p == "p7" for p, _ in pairs):
            raise RuntimeError("the scorer fell over")
        return [(0.0, 1)] * len(pairs)

    with pytest.raises(Exception, match="fell over"):
        scoring.score(grid, path, broken)
    assert scoring.stored_results(spark, path).count() == 0
    scoring.score(grid, path, stub(calls))
    spark.read.parquet(path).write.mode("append").parquet(path + "-copy")
    spark.read.parquet(path + "-copy").write.mode("append").parquet(path)  # as if two runs had met
    assert scoring.stored_results(spark, path).count() == 40 == scoring.score(grid, path, stub(calls)).count() and calls.value == 40
    with pytest.raises(Exception, match="0 results for"):
        scoring.score(grid, f"file://{tmp_path}/other", lambda pairs: [])


def test_shared_prefixes_are_neighbours(spark):
    import random

    rng = random.Random(1)
    prompts = [f"{'abc'[i % 3] * 30} {'xyz'[j % 3] * 20} {k}" for i in range(3) for j in range(3) for k in range(20)]
    rng.shuffle(prompts)
    table = spark.createDataFrame([(str(i), p, "t") for i, p in enumerate(prompts)], "digest string, prompt string, target string").repartition(5)
    parts = scoring.side_by_side(table).withColumn("part", F.spark_partition_id()).collect()
    order = [(r["digest"], r["prompt"], r["target"]) for r in parts]
    assert [p for _, p, _ in order] == sorted(prompts)
    batches = list(scoring.batches(iter(order), 300))
    assert [r for b in batches for r in b] == order
    for b in batches:
        cost = len(b[0][1]) + 1 + sum(scoring.added(y[1], y[2], x[1]) for x, y in zip(b, b[1:]))
        assert cost <= 300
    assert len(batches) < sum(len(p) + 1 for p in prompts) / 300 / 3
    assert [len(b) for b in scoring.batches(iter([("a", "x" * 999, "t"), ("b", "y", "t")]), 10)] == [1, 1]


# -- append log


def ids(spark, path):
    return sorted(r["id"] for r in append_log.read_log(spark, path, "id int, t string").collect())


def test_log_has_committed_rows_only(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    append_log.register(spark)
    assert ids(spark, path) == []
    df = spark.createDataFrame([(i, "ünï" if i % 2 else None) for i in range(10)], "id int, t string")
    df.write.format("append_log").mode("append").option("path", path).save()
    rows = list(df.collect())
    writer = append_log.LogStreamWriter({"path": path, "query": "q"})
    writer.write(iter(rows))  # a task that is lost before its batch commits
    first = [writer.write(iter(rows[:4])), writer.write(iter([])), None]
    writer.commit(first, 0)
    again = [writer.write(iter(rows[:4]))]
    writer.commit(again, 0)  # the batch is run again: no second copy
    assert ids(spark, path) == sorted([*range(10), *range(4)])
    assert not os.path.exists(f"{tmp_path}/log/{again[0].file}")
    other = append_log.LogStreamWriter({"path": path, "query": "r"})
    other.commit([other.write(iter(rows[:1]))], 0)
    aborted = [other.write(iter(rows))]
    other.abort(aborted, 1)
    assert ids(spark, path) == sorted([*range(10), *range(4), 0]) and not os.path.exists(f"{tmp_path}/log/{aborted[0].file}")
    assert sum(x["rows"] for x in append_log.committed(path)) == 15
    with pytest.raises(Exception, match="only appended"):
        df.write.format("append_log").mode("overwrite").option("path", path).save()


def test_writes_are_tried_again():
    left = [OSError("full"), OSError("full")]
    waits = []

    def action():
        if left:
            raise left.pop()
        return "done"

    from unittest import mock

    with mock.patch.object(append_log.time, "sleep", waits.append):
        assert append_log.retried(action, 4, 0.05) == "done" and waits == [0.05, 0.1]
        left += [OSError("full")] * 3
        with pytest.raises(OSError):
            append_log.retried(action, 3, 0.05)


def test_stream_that_repeats_a_batch(spark, tmp_path):
    """The checkpoint loses the last commit, as if the driver had died between commit and checkpoint."""
    append_log.register(spark)
    source, path, checkpoint = tmp_path / "in", f"file://{tmp_path}/log", tmp_path / "checkpoint"
    source.mkdir()

    def run():
        stream = spark.readStream.schema("id int, t string").option("maxFilesPerTrigger", 1).json(str(source))
        stream.writeStream.format("append_log").option("path", path).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    for part in range(3):
        (source / f"{part}.jsonl").write_text("\n".join(json.dumps({"id": 10 * part + i, "t": "x"}) for i in range(5)))
    run()
    want = [10 * part + i for part in range(3) for i in range(5)]
    assert ids(spark, path) == want
    last = max((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    shutil.rmtree(checkpoint / "commits" / f".{last.name}.crc", ignore_errors=True)
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    (source / "3.jsonl").write_text(json.dumps({"id": 99}))
    run()
    assert ids(spark, path) == [*want, 99]


# -- ragged parts and support


def test_ragged_parts(spark):
    flat = spark.createDataFrame([(r, i, float(10 * r + i)) for r, n in ((1, 6), (2, 3), (3, 2)) for i in range(n)], "record_id int, pos int, value double")
    lengths = {1: [2, 0, 3], 2: [1, None, -2, 99], 4: [1]}
    rows = spark.createDataFrame([(r, i, n) for r, ns in lengths.items() for i, n in enumerate(ns)], "record_id int, part int, n int")
    got = sorted(tuple(r) for r in steps.split_flat(flat, rows).collect())
    assert got == [(1, 0, 0, 10.0), (1, 0, 1, 11.0), (1, 2, 0, 12.0), (1, 2, 1, 13.0), (1, 2, 2, 14.0), (2, 0, 0, 20.0), (2, 3, 0, 21.0), (2, 3, 1, 22.0)]


def test_record_of_very_many_parts(spark):
    import time

    n = 100_000
    flat = spark.range(2 * n).select(F.lit(1).alias("record_id"), F.col("id").alias("pos"), F.col("id").cast("double").alias("value"))
    lengths = spark.range(n).select(F.lit(1).alias("record_id"), F.col("id").alias("part"), (F.col("id") % 4).alias("n"))
    began = time.time()
    got = steps.split_flat(flat, lengths).agg(F.count("*"), F.max("value"), F.max("idx")).first()
    assert tuple(got) == (3 * n // 2, float(3 * n // 2 - 1), 2) and time.time() - began < 60


def test_gold_support(spark):
    import math

    logits = {(1, 0): [1.0, 3.0, 3.0, None, 0.5], (1, 1): [2.0, 2.0, 2.0], (2, 0): [0.0]}
    gold = {(1, 0): 2, (1, 1): 0}
    rows = [(r, p, t, x, gold.get((r, p)) == t if t else None if (r, p) not in gold else gold[r, p] == t) for (r, p), xs in logits.items() for t, x in enumerate(xs)]
    got = {(r["record_id"], r["pos"]): r for r in rewards.gold_support(spark.createDataFrame(rows, "record_id int, pos int, token_id int, logit double, is_gold boolean"), [1, 2]).collect()}
    total = sum(map(math.exp, (1.0, 3.0, 3.0, 0.5)))
    a, b, c = got[1, 0], got[1, 1], got[2, 0]
    assert a["gold_rank"] == 2 and math.isclose(a["mass_above"], math.exp(3) / total) and math.isclose(a["gold_logp"], 3 - math.log(total)) and math.isclose(a["mass_2"], 2 * math.exp(3) / total)
    assert b["gold_rank"] == 1 and b["mass_above"] == 0 and math.isclose(b["mass_1"], 1 / 3)
    assert c["gold_rank"] is None and c["mass_above"] is None and c["gold_logp"] is None and c["mass_1"] == 1.0
