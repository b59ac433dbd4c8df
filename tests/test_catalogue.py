"""Benchmarks of several configurations and splits, and answers of any shape without Python."""

import json

import pytest
from pyspark.sql import functions as F

from stepwright.functions.records import flat_answer
from stepwright.sources import catalogue

ANSWERS = [
    "42", "  x \n", "", None, 7, 2.5, True, ["a", "b"], ["a", ""], [], {}, [["x"], [" y "]], {"answer": "A"}, {"text": "", "value": 3}, {"multiple": ["p", "q"]}, {"answer": ["k", "l"]},
    {"final_answer": None, "latex": "\\frac12"}, {"other": 1}, [{"en": "deep"}, {"de": "tief"}], "['a', 'b']", '["c", "d"]', "[not a list", "[1, 2]", {"content": {"text": ["t"]}}, [None, "n", None], "{curly}",
    {"multiple": "no list"}, {"multiple": []}, "[]", "é ", "(1, 2]",
]


def test_answers_of_any_shape(spark):
    rows = [(i, json.dumps(a)) for i, a in enumerate(ANSWERS)] + [(len(ANSWERS), None)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("v", F.try_parse_json("j"))
    got = {r["i"]: r["t"] for r in df.select("i", catalogue.variant_text(F.col("v")).alias("t")).collect()}
    shown = lambda a: "true" if a is True else flat_answer(a)
    assert got == {i: shown(a) for i, a in enumerate([*ANSWERS, None])}


def test_six_benchmarks_with_splits(spark, tmp_path):
    def put(path, rows, schema):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / path))

    (tmp_path / "gsm8k/main").mkdir(parents=True)
    (tmp_path / "gsm8k/main/test.jsonl").write_text('{"question": "q1", "answer": "so #### 5"}\n{"question": "q2", "answer": "#### 6"}\n')
    (tmp_path / "gsm8k/main/train.jsonl").write_text('{"question": "q3", "answer": "#### 7"}\n')
    put("math/test.parquet", [("p", "1/2", 3)], "problem string, answer string, level int")
    put("omni/test.parquet", [("p", "x")], "problem string, answer string")
    put("olympiad/OE_maths_en/train.parquet", [("q", ["2", "3"], "s")], "question string, final_answer array<string>, solution string")
    put("olympiad/TP_physics_en/train.parquet", [("r", None, 1)], "question string, final_answer string, other int")
    put("olympiad/OE_num_en/train.parquet", [("n", 5)], "question string, final_answer int")
    put("olympiad/OE_maths_zh/train.parquet", [("zh", ["0"], "s")], "question string, final_answer array<string>, solution string")
    put("aime/train.parquet", [("p", 17)], "problem string, answer long")
    put("mmlu/test.parquet", [("q", 2, ["a", "b", "c", "d"])], "question string, answer int, choices array<string>")
    read = lambda name, **o: catalogue.read_benchmark(spark, name, str(tmp_path), **o)
    answers = lambda df: sorted((r["question"], r["answer_text"]) for r in df.collect())
    assert answers(read("gsm8k")) == [("q1", "so #### 5"), ("q2", "#### 6")] and answers(read("gsm8k", split="train")) == [("q3", "#### 7")]
    assert answers(read("math")) == [("p", "1/2")] and read("math").columns == ["question", "answer", "config", "level", "answer_text"]
    assert answers(read("omni")) == [("p", "x")] and answers(read("aime")) == [("p", "17")]
    both = read("olympiad")
    assert answers(both) == [("n", "5"), ("q", "3"), ("r", "")]
    assert {r["config"]: (r["solution"], r["other"]) for r in both.collect()} == {"OE_maths_en": ("s", None), "TP_physics_en": (None, 1), "OE_num_en": (None, None)}
    row = read("mmlu").first()
    assert row["choices"] == ["a", "b", "c", "d"] and row["answer_text"] == "2"
    with pytest.raises(FileNotFoundError):
        read("gsm8k", split="validation")


def test_error_splits(spark, tmp_path):
    for s, rows in {"gsm8k": [("a", ["x", "y", "z"], 1)], "math": [("b", ["x"], -1), ("c", [], -1), ("d", None, 0)]}.items():
        spark.createDataFrame(rows, "problem string, steps array<string>, label int").coalesce(1).write.parquet(str(tmp_path / f"{s}.parquet"))
    rows = catalogue.with_step_labels(catalogue.read_error_splits(spark, str(tmp_path))).collect()
    assert {r["problem"]: (r["split"], r["step_correct"]) for r in rows} == {"a": ("gsm8k", [1, 0, None]), "b": ("math", [1]), "c": ("math", []), "d": ("math", None)}
    with pytest.raises(FileNotFoundError):
        catalogue.read_error_splits(spark, str(tmp_path / "none"))
