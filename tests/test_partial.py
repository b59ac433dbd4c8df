"""Joined sums, ranges, renumbered perturbations, JSON arrays in parts, the written analysis."""

import glob
import json

from pyspark.sql import functions as F

from stepwright.operators import analysis, merge, rewards, select
from stepwright.sources import files


def test_sum_join(spark):
    left = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, None), (4, [5.0]), (None, [1.0])], "k int, a array<double>")
    right = spark.createDataFrame([(1, [10.0, 20.0, 30.0], 1), (1, [0.0], 2), (2, [7.0], 1), (3, [1.0], 1), (4, None, 1), (None, [1.0], 1)], "k int, b array<double>, at int")
    got = {r["k"]: (r["reward"], r["raw_a"], r["raw_b"]) for r in merge.sum_join(left, right, ["k"], "a", "b", 0.5, order="at").collect()}
    assert got == {1: ([6.0, 12.0], [1.0, 2.0], [10.0, 20.0, 30.0]), 2: ([6.5], [3.0], [7.0])}
    assert [r["k"] for r in merge.sum_join(left, right, ["k"], "a", "b", strict=True, order="at").collect()] == [2]


def test_row_range(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit("x").alias("t")).repartition(7)
    got = lambda *a: sorted(r["v"] for r in select.row_range(rows, "v", *a).collect())
    assert got(10, 30) == list(range(10, 30)) and got(995) == list(range(995, 1000)) and got(5, 5) == [] and got(2000) == []
    assert select.row_range(rows, "v", 0, 3).columns == ["v", "t"]


def test_perturbed_steps_are_renumbered(spark):
    df = spark.createDataFrame([(i, ["Step 1: a", "Step 2: b"]) for i in range(20)], "id int, steps array<string>")
    for r in rewards.perturb(df, "steps", {"wrong": "2 + 2 = 5"}, {"wrong": 1.0}, 3, "id", numbered=True).collect():
        assert [s.split(":")[0] for s in r["steps"]] == ["Step 1", "Step 2", "Step 3"]
        assert r["steps"][r["perturbation_pos"]].endswith(": 2 + 2 = 5") and r["incorrect_mask"][r["perturbation_pos"]] == 1


def test_array_in_parts(spark, tmp_path):
    rows = [(i % 40, f"t{i % 3}" if i % 7 else None) for i in range(200)] + [(0, "t0")] * 3 + [(None, "n")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(6)
    files.write_array(df, str(tmp_path / "a"), "k")
    joined = lambda name: json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/{name}/part-*"))))
    got = joined("a")
    key = lambda r: (r["k"] is not None, r["k"] or 0)
    assert [key(r) for r in got] == sorted(map(key, got)) and sorted(map(repr, got)) == sorted(repr({"k": k, "t": t}) for k, t in rows)
    files.write_array(df.limit(0), str(tmp_path / "b"), "k")
    assert joined("b") == []
    assert files.read_records(spark, str(tmp_path / "a"), "k int, t string").count() == len(rows)


def test_written_analysis(spark, tmp_path):
    rows = [(r, s, m, float((r * 7 + s * 3 + i) % 11) if s else None, int((r + s) % 3 > 0)) for r in range(30) for s in range(5) for i, m in enumerate(("x", "y"))]
    steps = spark.createDataFrame(rows, "record_id int, step_idx int, metric string, value double, correct int")
    tables = analysis.analysis_tables(steps, ["x", "y"], abs_max=9.5)
    analysis.write_analysis(tables, str(tmp_path))
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/{name}")
    assert read("global_summary").count() == 2 and read("per_step_index_summary").count() == 8 and read("correlation_matrix_global").count() == 1
    kept = [r for r in rows if r[3] is not None and r[3] <= 9.5]
    got = {r["metric"]: r for r in read("auc_summary").collect()}
    for m in ("x", "y"):
        pos, neg = ([v for _, _, k, v, c in kept if k == m and c == label] for label in (1, 0))
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert abs(float(got[m]["auc"]) - max(auc, 1 - auc)) < 1e-9 and (got[m]["flipped"] == "true") == (auc < 0.5) and int(got[m]["n_pos"]) == len(pos)
    empty = analysis.analysis_tables(steps.limit(0), ["x", "y"])
    assert empty["per_sample_summary"].count() == 0 and {r["auc"] for r in empty["auc_summary"].collect()} == {None}
    analysis.write_result(tables["auc_summary"].select("metric", "auc"), str(tmp_path / "result"))
    assert len([json.loads(x) for f in glob.glob(f"{tmp_path}/result/part-*") for x in open(f)]) == 2
