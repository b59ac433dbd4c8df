"""Benchmarks by name: their configurations and splits, joined into one table of questions and answers.

Answers come as texts, numbers, lists or objects, each configuration in a form of its own. They
become VARIANT values, so tables of unlike types join, and their text is taken out of the VARIANT by
expressions, without Python. Fields that a configuration lacks are null.

A benchmark is a folder; below it lie configurations, if it has any, and below these its splits as
Parquet (`train.parquet`, `test.parquet`) or JSON lines (`train.jsonl`).

Defined cases: a split that a configuration lacks is passed over, but a benchmark without any table is
an error; a null answer has the empty text; answers nested deeper than DEPTH have the empty text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions.records import ANSWER_KEYS

#: Levels of lists and objects that an answer may be wrapped in.
DEPTH = 4


@dataclass(frozen=True)
class Benchmark:
    """Fields of question and answer, the split meant for tests, and what configurations are taken."""

    question: str
    answer: str
    split: str = "test"
    choices: str | None = None
    configs: str = ""  # a part of the names of configurations that count; empty for all


#: Names of benchmarks and of the fields in their tables.
BENCHMARKS = {
    "gsm8k": Benchmark("question", "answer"),
    "math": Benchmark("problem", "answer"),
    "omni": Benchmark("problem", "answer"),
    "olympiad": Benchmark("question", "final_answer", "train", configs="_en"),
    "aime": Benchmark("problem", "answer", "train"),
    "mmlu": Benchmark("question", "answer", choices="choices"),
}


def answer_variant(df: DataFrame, column: str) -> Column:
    """The column as VARIANT: a text that is JSON's list or object by what it says, other values by their type."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "variant":
        return F.col(column)
    if kind == "string":
        spelled = F.regexp_like(column, F.lit(r"^\s*[\[{]"))
        return F.coalesce(F.when(spelled, F.try_parse_json(F.col(column))), F.parse_json(F.to_json(F.array(column))).cast("array<variant>")[0])
    return F.parse_json(F.to_json(F.array(column))).cast("array<variant>")[0]


def variant_text(answer: Column, depth: int = DEPTH) -> Column:
    """A VARIANT answer as text: of a list the last element that has one, of an object the first of
    ANSWER_KEYS that has one, else the last of `multiple`; a text that spells a list counts as its
    last element."""
    blank = F.lit("")
    if depth == 0:
        return blank
    kind = F.schema_of_variant(answer)
    fields, elements = F.try_variant_get(answer, "$", "map<string,variant>"), F.try_variant_get(answer, "$", "array<variant>")
    choices = F.try_variant_get(F.try_element_at(fields, F.lit("multiple")), "$", "array<variant>")
    options = F.transform(F.array(*map(F.lit, ANSWER_KEYS)), lambda k: F.try_element_at(fields, k))
    is_list, is_object = (F.startswith(kind, F.lit(k)) for k in ("ARRAY", "OBJECT"))
    # what may hold the text, in order; the expression goes down one level once
    inside = F.when(is_list, F.reverse(elements)).when(is_object, F.concat(options, F.array(F.try_element_at(choices, F.lit(-1)))))
    found = F.try_element_at(F.filter(F.transform(inside, lambda v: variant_text(v, depth - 1)), lambda t: t != ""), F.lit(1))
    text = F.regexp_replace(F.try_variant_get(answer, "$", "string"), r"(?U)\A\s+|\s+\z", "")
    listed = F.from_json(F.when(F.regexp_like(text, F.lit(r"(?s)^\[.*\]$")), text), "array<string>", {"allowSingleQuotes": "true"})
    spelled = F.regexp_replace(F.try_element_at(listed, F.lit(-1)), r"(?U)\A\s+|\s+\z", "")
    nothing = answer.isNull() | F.is_variant_null(answer)
    return F.when(nothing, blank).when(is_list | is_object, F.coalesce(found, blank)).otherwise(F.coalesce(spelled, text, blank))


def tables_of(folder: str, split: str, configs: str) -> list[tuple[str, str]]:
    """Configuration and path of each table of the split below the folder."""
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = info.path[len(root.rstrip("/")) + 1 :]
        config, _, file = name.rpartition("/")
        if file in (f"{split}.parquet", f"{split}.jsonl", f"{split}.jsonl.gz") and (configs in config or f"{config}/".endswith(f"{configs}/")):
            found.append((config, f"{folder.rstrip('/')}/{name}"))
    return sorted(found)


def read_benchmark(spark: SparkSession, name: str, folder: str, split: str | None = None) -> DataFrame:
    """question, answer (VARIANT), answer_text, config and all other columns of a benchmark's split, in one table.

    split: the benchmark's own for tests if not named.
    """
    what = BENCHMARKS[name]
    tables = tables_of(f"{folder.rstrip('/')}/{name}", split or what.split, what.configs)
    if not tables:
        raise FileNotFoundError(f"no table of split {split or what.split} below {folder}/{name}")
    parts = []
    for config, path in tables:
        table = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
        if what.question not in table.columns or what.answer not in table.columns:
            raise ValueError(f"{path} lacks {what.question} or {what.answer}")
        fields = {"question": F.col(what.question), "answer": answer_variant(table, what.answer), "config": F.lit(config)}
        if what.choices and what.choices in table.columns:
            fields["choices"] = F.col(what.choices)
        others = [c for c in table.columns if c not in (*fields, what.question, what.answer, "answer_text")]
        parts.append(table.select(*[c.alias(n) for n, c in fields.items()], *others))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.withColumn("answer_text", variant_text(F.col("answer")))


#: Splits of the step-error benchmark, of which the first also serves to choose thresholds. Fixed values.
ERROR_SPLITS = ("gsm8k", "math", "olympiadbench", "omnimath")


def read_error_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = ERROR_SPLITS) -> DataFrame:
    """Rows with a first wrong step (label, -1 for none) of each split in one table: split, problem, steps, label and others."""
    parts = [
        (spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)).withColumn("split", F.lit(s))
        for s in splits for _, path in tables_of(folder, s, "")
    ]
    if not parts:
        raise FileNotFoundError(f"none of the splits {splits} below {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_step_labels(rows: DataFrame, label: str = "label", steps: str = "steps") -> DataFrame:
    """rows with step_correct: 1 before the first wrong step, 0 at it, null behind it, where nobody
    looked; all 1 without one. Null steps have null labels."""
    n, wrong = F.size(steps), F.col(label)
    each = F.when(n > 0, F.transform(F.col(steps), lambda _, i: F.when((wrong < 0) | (i < wrong), 1).when(i == wrong, 0)))
    return rows.withColumn("step_correct", F.when(F.col(steps).isNotNull(), F.coalesce(each, F.array().cast("array<int>"))))
