"""What batch and streaming runs leave in the profile, and its filters."""

import pytest
from pyspark.sql import functions as F

from stepwright.operators import stats
from stepwright.streaming import profile


def test_profile_of_runs(spark, tmp_path):
    path = f"file://{tmp_path}/profile"
    assert profile.read_profile(spark, path).count() == 0
    run = profile.RunProfile(spark, dataset="gsm8k")
    rows = spark.range(100).select("id", (F.col("id") % 5).alias("tokens"))
    with run.timed("rollout/base", rows, F.col("tokens"), n=8) as observed:
        observed.write.format("noop").mode("overwrite").save()
    with run.timed("rollout/prover", rows.where("id < 10"), split="dev") as observed:
        assert observed.count() == 10
    with pytest.raises(RuntimeError), run.timed("failed", rows):
        raise RuntimeError
    run.write(path)
    with run.timed("rollout/base", rows.where("id < 0"), F.col("tokens")) as observed:
        observed.collect()
    run.write(path)
    table = profile.read_profile(spark, path)
    got = {r["tag"]: r for r in stats.profile_rollup(table).collect()}
    base, prover = got["rollout/base"], got["rollout/prover"]
    assert (base["calls"], base["prompts"], base["samples"], base["tokens"]) == (2, 100, 800, 200) and base["wall_s"] > 0
    assert (prover["calls"], prover["prompts"], prover["samples"], prover["tokens"]) == (1, 10, 10, 0) and set(got) == {"rollout/base", "rollout/prover"}
    tags = lambda **o: {r["tag"] for r in stats.profile_filter(table, **o).collect()}
    assert tags(prefix="roll", contains="prov") == {"rollout/prover"} and tags(dataset="gsm8k") == set(got) and tags(dataset="math") == set()
    assert tags(split="dev") == {"rollout/prover"} and tags(tag_="x") == set()


def test_profile_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / "in" / f"{part}.jsonl").write_text("\n".join(f'{{"id": {i}, "tokens": {i}}}' for i in range(4)))
    run = profile.RunProfile(spark, dataset="stream")
    listener = run.streams(n=2)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id int, tokens long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = profile.observed(stream, "label", F.col("tokens")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        import time

        for _ in range(100):
            if len(run.records) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    row = stats.profile_rollup(run.table()).first()
    assert (row["tag"], row["calls"], row["prompts"], row["samples"], row["tokens"]) == ("label", 3, 12, 24, 18)
