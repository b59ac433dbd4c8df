"""Identities and odd rows of the step operators, text parsing, files and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from stepwright.functions import columns as C
from stepwright.functions import text as X
from stepwright.operators import match, metrics, negatives, normalize, rewards, select, steps
from stepwright.operators.ordered import running
from stepwright.sources import files
from stepwright.streaming import labels


def test_running_sum(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(1).alias("c"))
    rows = {r["v"]: r for r in running(df, "v", ["c"], 16).collect()}
    assert all(rows[v]["cum_c"] == v + 1 and rows[v]["next_value"] == (v + 1 if v < 999 else None) for v in range(1000))


def test_auc_is_invariant(spark):
    df = spark.createDataFrame([(float(i % 17), int(i % 3 == 0)) for i in range(200)], "s double, y int")
    auc = lambda d: metrics.roc_auc(d, "s", "y").first()["auc"]
    a = auc(df)
    assert auc(df.withColumn("s", F.exp("s"))) == pytest.approx(a)
    assert auc(df.withColumn("s", -F.col("s"))) == pytest.approx(1 - a)
    assert auc(df.where("y = 1")) is None
    wins = [(x > z) + 0.5 * (x == z) for x, p in df.collect() if p for z, q in df.collect() if not q]
    assert a == pytest.approx(sum(wins) / len(wins))


def test_scale_falls_back(spark):
    kind = lambda values: normalize.robust_scale(spark.createDataFrame([(float(v),) for v in values], "value double")).first()["kind"]
    assert kind([1, 2, 3, 4]) == "mad" and kind([0, 0, 0, 0, 5, 5]) in ("mad", "iqr") and kind([0] * 9 + [4]) == "std" and kind([2, 2]) == "one"


def test_maps_stay_in_range(spark):
    df = spark.createDataFrame([(x,) for x in (-1e9, -1.0, 0.0, 2.0, 1e9, float("nan"), None)], "value double")
    rows = normalize.with_parameters(df.where(C.finite(F.col("value"))), normalize.fit_zsig(df)).select(normalize.zsig(F.col("value"), F.col("mu"), F.col("sd")).alias("p"))
    assert all(0 < r["p"] < 1 for r in rows.collect())
    cdf = spark.range(1).select(*[C.normal_cdf(F.lit(x)).alias(f"c{i}") for i, x in enumerate((-1.959964, 0.0, 1.959964))]).first()
    assert cdf[0] == pytest.approx(0.025, abs=1e-5) and cdf[1] == pytest.approx(0.5, abs=1e-6) and cdf[2] == pytest.approx(0.975, abs=1e-5)


def test_first_error_forms_agree(spark):
    data = [(r, i, float((r * 37 + i * 11) % 10)) for r in range(40) for i in range(r % 7)]
    df = spark.createDataFrame(data, "r int, i int, s double")
    for patience in (1, 2, 3):
        got = {x["r"]: x["predicted"] for x in metrics.first_error(df, "r", "i", F.col("s") <= 4, patience).collect()}
        arrays = df.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("a"))
        other = {x["r"]: x["p"] for x in arrays.select("r", metrics.first_error_array(F.col("a"), 4.0, patience).alias("p")).collect()}
        assert got == other
    assert spark.range(1).select(metrics.first_error_array(F.array().cast("array<double>"), 1.0, 1).alias("p")).first()["p"] == -1


def test_merge_and_arrays(spark):
    row = spark.range(1).select(
        rewards.merge_switch(F.array(*map(F.lit, [1.0, 2.0, 3.0])), F.array(*map(F.lit, [7.0, 8.0])), 1).alias("m"),
        rewards.merge_switch(F.array(F.lit(1.0)), F.array(F.lit(7.0)), 4).alias("short"),
        C.split_by_lengths(F.array(*map(F.lit, range(6))), F.array(*map(F.lit, [1, 0, 3]))).alias("s"),
        C.mask_from_first_error(F.lit(4), F.lit(2)).alias("mask"), C.labels_from_error_steps(F.lit(3), F.array(F.lit(2))).alias("lab"),
        steps.marker_positions(F.array(*map(F.lit, [5, 9, 8, 9, 8])), [9, 8]).alias("mark"),
        C.pool(F.array().cast("array<double>"), "mean").alias("empty"),
    ).first()
    assert row["m"] == [1.0, 8.0] and row["short"] == [1.0] and row["s"] == [[0], [], [1, 2, 3]] and row["mask"] == [1, 1, 0, 0]
    assert row["lab"] == [0, 1, 0] and row["mark"] == [2, 4] and row["empty"] == 0.0


def test_votes(spark):
    rows = [(1, 0, "a", 0.1), (1, 1, "b", 0.9), (1, 2, "b", 0.1), (1, 3, "a", 0.2), (2, 0, "", 1.0), (2, 1, "c", 0.0), (3, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "q int, i int, answer string, score double")
    first = {r["q"]: r["answer"] for r in select.majority_vote(df, "q", "i", "answer").collect()}
    best = {r["q"]: r["answer"] for r in select.majority_vote(df, "q", "i", "answer", "score", 1e9, tie="score").collect()}
    assert first == {1: "a", 2: "c"} and best == {1: "b", 2: "c"}
    ties = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, None)], "q int, i int, s double")
    assert select.best_of_n(ties, "q", "i", "s").first()["i"] == 0


def test_stepwise_decoding(spark):
    def propose(state, k):
        cands = F.array(*[F.struct(F.lit(c).alias("cand_idx"), F.lit(f"{min(k, 2)}{c}").alias("step_text"), F.lit(float(c == 1)).alias("score")) for c in range(3)])
        return state.select("question_id", F.inline(cands))

    got = select.stepwise_decode(spark.createDataFrame([(1,), (2,)], "question_id int"), propose, 6).collect()
    assert all(r["steps"] == ["01", "11", "21"] and r["stopped"] for r in got)


def test_matching(spark):
    left = spark.createDataFrame([(1, "q", "alpha beta"), (2, "q", "zzz"), (3, "r", "alpha beta")], "id int, b string, t string")
    right = spark.createDataFrame([(7, "q", "alpha betas"), (8, "q", "alpha bet"), (9, "q", "x" * 100)], "id int, b string, t string")
    pairs = match.similar_pairs(left, right, "b", "t", 0.9)
    assert {(r["left_id"], r["right_id"]) for r in pairs.collect()} == {(1, 7), (1, 8)}
    assert match.best_similar(pairs, ["left_id"], "right_id").first()["right_id"] == 7
    keys = spark.createDataFrame([("a  b", ["x y"]), ("a b", ["x y"])], "q string, s array<string>")
    assert keys.select(match.record_key(F.col("q"), F.col("s")).alias("k")).distinct().count() == 1


def test_parsing(spark):
    text = "What is 1+1?  Step 1: Add them. + Step 2: So  it is 3. - The answer is: 2 +"
    rows = [(1, text, ["+"], None, "GSM8K"), (2, "no steps here", None, " 5 ", "MATH"), (3, "", [], "", None)]
    got = {r["record_id"]: r for r in X.parse_records(spark.createDataFrame(rows, "record_id int, label string, value array<string>, gold_answer string, task string")).collect()}
    assert got[1]["question"] == "What is 1+1?" and got[1]["steps"] == ["Step 1: Add them.", "Step 2: So it is 3."]
    assert got[1]["correct_mask"] == [1, 0] and got[1]["gold_answer"] == "2" and got[2]["gold_answer"] == "5" and got[3]["steps"] == []
    split = spark.createDataFrame([("a <extra_0> b <extra_0>",), ("Step 1: x\nStep 2: y",), ("p\n\nq",), ("l1\nl2",)], "t string").select(X.split_steps(F.col("t")).alias("s"))
    assert [r["s"] for r in split.collect()] == [["a", "b"], ["x", "y"], ["p", "q"], ["l1", "l2"]]
    judged = spark.createDataFrame([("SCORE: 0.7",), ("score = 3",), ("none",)], "t string").select(X.judge_score(F.col("t")).alias("s"))
    assert [r["s"] for r in judged.collect()] == [0.7, 1.0, 0.5]


def test_negatives(spark):
    rows = [(1, "12", ["12.0", "13", "a wrong text"]), (2, "3/4", None), (3, "\\frac{1}{2}", ["0.5"])]
    df = spark.createDataFrame(rows, "record_id int, gold string, sampled array<string>")
    got = negatives.wrong_answers(df, "gold", "sampled", 4, 1).collect()
    by = {}
    for r in got:
        by.setdefault(r["record_id"], []).append(r["negative"])
    assert set(by) == {1, 2, 3} and all(len(v) <= 4 for v in by.values())
    assert "12.0" not in by[1] and "0.5" not in by[3] and "13" in by[1]


def test_perturbation(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(200)], "id int, s array<string>")
    got = rewards.perturb(df, "s", {"wrong": "W", "loop": "L"}, {"wrong": 3, "loop": 1}, 4, "id").collect()
    assert all(len(r["s"]) == 4 and r["s"][r["perturbation_pos"]] in "WL" and sum(r["incorrect_mask"]) == 1 for r in got)
    assert 100 < sum(r["perturbation"] == "wrong" for r in got) < 190


SCHEMA = "a int, b string"


def test_files(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "part2.jsonl").write_text(json.dumps(rows[0]) + "\n{broken\n\n" + json.dumps(rows[1]) + "\n{\"a\": ")
    (tmp_path / "part10.jsonl.gz").write_bytes(gzip.compress(json.dumps(rows[0]).encode()))
    (tmp_path / "run_profile.jsonl").write_text(json.dumps(rows[0]))
    read = lambda name, **o: files.read_records(spark, str(tmp_path / name), SCHEMA, **o)
    assert read("array.json").count() == 2
    assert {r["a"] for r in read("part2.jsonl").collect()} == {1, 2}
    with pytest.raises(Exception):
        read("part2.jsonl", mode="strict").collect()
    folder = files.read_folder(spark, str(tmp_path), SCHEMA)
    assert [r["source_file"] for r in folder.select("source_file", "file_key").distinct().orderBy("file_key").collect()] == ["part2.jsonl", "part10.jsonl.gz"]
    (tmp_path / "bad.txt").write_text('﻿{"records": [{"a": 1, "b": "x"}]} {"a": 2, "b": "y"}{\'a\': 3, \'b\': "it\'s"}\n{oops}\n[{"a": 4}]')
    assert sorted(r["a"] for r in files.read_damaged(spark, [str(tmp_path / "bad.txt")], SCHEMA).collect()) == [1, 2, 3, 4]
    df = spark.createDataFrame([(1, -1), (2, 3)], "a int, label int")
    files.split_by_error(df, "label", str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split" / "is_error=true")).first()["a"] == 2
    assert files.output_tag("/m/my model/checkpoint-12/final") == "my-model"


def test_stream_labels_once(spark, tmp_path):
    source, out, place = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], SCHEMA).write.json(source)
    run = lambda: labels.label_stream(labels.read_arrivals(spark, source, SCHEMA), lambda b: b.withColumn("n", F.length("b")), out, place, ["a"]).awaitTermination()
    run()
    spark.createDataFrame([(3, "zz")], SCHEMA).write.mode("append").json(source)
    run()
    got = spark.read.parquet(out)
    assert sorted((r["a"], r["n"]) for r in got.collect()) == [(1, 1), (2, 1), (3, 2)]


def test_empty_arrays(spark):
    from stepwright.functions.columns import labels_from_error_steps, mask_from_first_error
    from stepwright.operators import rewards, steps

    row = spark.createDataFrame([(0, [], [], -1)], "n int, e array<int>, s array<string>, f int")
    made = steps.contexts("n", F.lit("Q"), F.col("s"))
    got = row.select(
        mask_from_first_error(F.col("n"), F.col("f")).alias("a"), labels_from_error_steps(F.col("n"), F.col("e")).alias("b"), made["prefix"].alias("c"),
        made["without"].alias("d"), rewards.outcome_only(F.col("n"), F.lit(True)).alias("g"), steps.pack_within(F.col("e"), 3).alias("h"),
    ).first()
    assert list(got) == [[], [], [], [], [], 0]


@pytest.mark.parametrize("few", [0, 10**6])
def test_quantiles_equal_the_sorted_ones(spark, few):
    import random

    import numpy as np

    from stepwright.operators.ordered import quantiles

    rng = random.Random(2)
    rows = [(k, rng.choice([rng.gauss(0, 1), float(rng.randrange(4))])) for k in (None, "a", "b") for _ in range(rng.randrange(1, 400))] + [("a", None), ("one", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {r["k"]: r["q"] for r in quantiles(df, "v", shares, ["k"], few).collect()}
    for k in {k for k, _ in rows}:
        assert np.allclose(got[k], np.quantile([v for j, v in rows if j == k and v is not None], shares))
    assert np.allclose(quantiles(df, "v", shares, few=few).first()["q"], np.quantile([v for _, v in rows if v is not None], shares))
    empty = quantiles(df.limit(0), "v", shares, few=few).first()
    assert empty["n"] == 0 and empty["q"] == [None] * 5


def test_platt_of_one_class(spark):
    import math

    from stepwright.operators.normalize import platt

    row = platt(spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int"), "s", "y").first()
    assert row["scale"] == 0.0 and math.isclose(row["bias"], math.log(3))


def test_support_without_gold(spark):
    from stepwright.operators.rewards import truncated_support

    rows = spark.createDataFrame([(1, 0, t, float(t), False) for t in range(4)], "record_id int, pos int, token_id int, logit double, is_gold boolean")
    got = truncated_support(rows, 2, 0.1).first()
    assert got["logp"] == float("-inf") and got["support"] == 2


def test_objects_over_lines_and_wrappers(spark, tmp_path):
    from stepwright.sources.files import read_records

    (tmp_path / "a.json").write_text('{\n "x": 1,\n "y": "b"\n}\n')
    (tmp_path / "b.json").write_text('{"records": [{"x": 1}, {"x": 2, "y": "c"}]}')
    (tmp_path / "c.json").write_text('{"x": 5}\n{"x": 6, "y": "[1"}\n')
    read = lambda n: sorted((r["x"], r["y"]) for r in read_records(spark, str(tmp_path / n), "x int, y string").collect())
    assert read("a.json") == [(1, "b")]
    assert read("b.json") == [(1, None), (2, "c")]
    assert read("c.json") == [(5, None), (6, "[1")]


def test_answers_of_any_shape(spark):
    from stepwright.functions.records import answer_text, flat_answer

    assert flat_answer([{"en": ""}, {"value": 3}, ["", None]]) == "3"
    assert flat_answer("[1, [2, 'x']]") == "x" and flat_answer("[not a list") == "[not a list" and flat_answer("[]") == "[]"
    assert flat_answer({"multiple": ["a", {"latex": " b "}]}) == "b" and flat_answer({"other": 1}) == ""
    df = spark.createDataFrame([('{"answer": [1, 2]}',), ("plain",), (None,), ("2.50",)], "a string")
    assert [r[0] for r in df.select(answer_text("a")).collect()] == ["2", "plain", "", "2.5"]


def test_merge_keeps_and_drops(spark):
    from stepwright.operators.merge import merge_records

    base = spark.createDataFrame(
        [(1, "q", ["a  b", "c"], [1.0, 2.0]), (2, "q2", ["x"] * 3, [1.0, 2.0, 3.0]), (3, "q3", [], [1.0]), (4, "q4", ["s", "t"], None)],
        "record_id int, question string, steps array<string>, base_reward array<double>",
    )
    other = spark.createDataFrame([("q", ["a b", "c "], [7.0, 8.0, 9.0], 1), ("q4", ["s", "t"], [5.0, 6.0], 2)], "question string, steps array<string>, mi array<double>, at int")
    trim = {r["record_id"]: (r["match"], r["step_reward"], r["steps"], r["ragged"]) for r in merge_records(base, other, "record_id", "base_reward", "mi", "at").collect()}
    assert trim == {1: ("exact", [1.0, 8.0], ["a  b", "c"], True), 2: ("none", [1.0], ["x"], False), 4: ("exact", [], [], True)}
    strict = {r["record_id"]: r["step_reward"] for r in merge_records(base, other, "record_id", "base_reward", "mi", "at", lengths="strict").collect()}
    assert strict == {1: None, 2: [1.0], 4: None}
    assert merge_records(base, other, "record_id", "base_reward", "mi", "at", lengths="strict", tail="uniform").count() == 0
    assert merge_records(base.limit(0), other, "record_id", "base_reward", "mi", "at").count() == 0


def test_roots_near_a_root(spark):
    from stepwright.operators.negatives import root_variants

    df = spark.createDataFrame([("\\sqrt{5}",), ("\u221a0",), ("5",)], "a string")
    assert [r[0] for r in df.select(root_variants(F.col("a"))).collect()] == [["\\sqrt{6}", "\\sqrt{4}", "5"], ["\u221a1", "0"], []]
