"""Cleaning of record fields: answers of any JSON shape, golds in solutions, aliases, usable rows."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys that hold an answer inside an object, the first that has one wins. Fixed values.
ANSWER_KEYS = ("final_answer", "answer", "latex", "text", "en", "value", "content")
#: Prefixes of reward names, and short names that stand for a name with the first of them. Fixed values.
REWARD_PREFIXES = ("mi_", "pll_", "cpmi_")
REWARD_SHORT = ("loo", "shapley", "cmi", "margin")
#: Places beside the row itself where a step's value may lie. Fixed values.
VALUE_NESTS = ("metrics", "rewards", "norm", "normalized")


def flat_answer(found) -> str:
    """A parsed answer as text: of a list the last element that is not empty, of an object the first
    of ANSWER_KEYS or the last of 'multiple'; a text that spells a list counts as its last element."""
    if found is None:
        return ""
    if isinstance(found, list):
        return next((t for t in map(flat_answer, reversed(found)) if t), "")
    if isinstance(found, dict):
        choices = found.get("multiple")
        options = [found[k] for k in ANSWER_KEYS if k in found]
        return next((t for t in map(flat_answer, options) if t), "") or (flat_answer(choices[-1]) if isinstance(choices, list) and choices else "")
    text = str(found).strip()
    if text[:1] == "[" and text[-1:] == "]":
        try:
            inner = ast.literal_eval(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            inner = None
        if isinstance(inner, list) and inner:
            return flat_answer(inner[-1])
    return text


@F.pandas_udf(StringType())
def answer_text(values: pd.Series) -> pd.Series:
    """JSON values to their answers' text; what is not JSON is taken as text, null as empty."""

    def one(value: str | None) -> str:
        try:
            return flat_answer(None if value is None else json.loads(value))
        except ValueError:
            return flat_answer(value)

    return values.map(one)


def balanced(depth: int) -> str:
    """Pattern of a text whose braces balance, nested so deep at most."""
    return r"[^{}]*+" if depth == 0 else rf"(?:[^{{}}]++|\{{{balanced(depth - 1)}\}})*+"


#: The content of a box with balanced braces.
BOX = rf"\\boxed\s*\{{({balanced(8)})\}}"


def gold_in_solution(text: Column) -> Column:
    """Content of the last box, with the braces in it; else of the last $...$ in the last line that is not empty; else that line."""
    last = lambda t, pattern: F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.lit(-1))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), lambda s: F.trim(s)), lambda s: s != "")
    line = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    return F.coalesce(F.trim(last(text, BOX)), F.trim(last(line, r"\$([^$]+)\$")), line)


def with_raw_fallback(df: DataFrame, names: list[str]) -> DataFrame:
    """df where each named column that is missing or null takes its raw_ column's value."""
    own = lambda n: [F.col(c) for c in (n, f"raw_{n}") if c in df.columns]
    return df.withColumns({n: F.coalesce(*own(n)) for n in names if own(n)})


def step_value(df: DataFrame, name: str) -> Column:
    """The first of the places that has a number for a step: the column itself, a field of the nested
    columns, norm_value (if not 0) or value where metric says the name, and the _norm columns."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    number = lambda c: c.try_cast("double")
    found = [number(F.col(name))] if name in fields else []
    for nest in VALUE_NESTS:
        kind = fields.get(nest)
        if kind is not None and (kind.typeName() == "map" or name in getattr(kind, "names", [])):
            found.append(number(F.col(nest)[name]))
    if {"metric", "value"} <= set(fields):
        normed = F.nullif(number(F.col("norm_value")), F.lit(0.0)) if "norm_value" in fields else F.lit(None)
        found.append(F.when(F.col("metric") == name, F.coalesce(normed, number(F.col("value")))))
    found += [number(F.col(c)) for c in (f"{name}_norm", f"{name}_normalized") if c in fields]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def reward_name(name: Column) -> Column:
    """Trimmed reward names; short names without a prefix get the first one."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return F.when(F.lower(trimmed).isin(*REWARD_SHORT), F.concat(F.lit(REWARD_PREFIXES[0]), F.lower(trimmed))).otherwise(trimmed)


def picked_answer(gold: Column, answer: Column) -> Column:
    """The gold answer, or the answer where there is none."""
    return F.coalesce(gold, answer)


def same_task(a: Column, b: Column) -> Column:
    """Equal but for case and outer white space; a null equals nothing."""
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False))


def has_gold(gold: Column) -> Column:
    return F.coalesce(F.length(F.trim(gold)) > 0, F.lit(False))


def usable(records: DataFrame, question: str = "question", steps: str = "steps", target: str = "target") -> DataFrame:
    """records with drop_reason: which of question, steps and target is the first to be empty, or null."""
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = F.when(empty(F.col(question)), question).when(F.coalesce(F.size(steps) <= 0, F.lit(True)), steps).when(empty(F.col(target)), target)
    return records.withColumn("drop_reason", reason)


def drop_report(checked: DataFrame) -> DataFrame:
    """Counts by drop_reason; null counts what stays."""
    return checked.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


def of_length(values: Column, n: Column) -> Column:
    """Has the array just n elements? Null has not."""
    return F.coalesce(F.size(values) == n, F.lit(False))


def numeric_list(values: Column, n: Column) -> Column:
    """Are these n texts that all are numbers?"""
    return of_length(values, n) & F.coalesce(F.forall(values, lambda v: v.try_cast("double").isNotNull()), F.lit(False))


def failed_rows(rows: DataFrame, ok: str = "match_ok") -> DataFrame:
    """The rows that did not succeed (a null did not), without the column that says so."""
    return rows.where(~F.coalesce(F.col(ok), F.lit(False))).drop(ok)


def choices_block(choices: Column) -> Column:
    """Choices on a line each, behind their letters in brackets."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), c)), "\n")


def filled(template: Column, **fields: Column) -> Column:
    """A template with each {name} replaced by the field of that name, null as empty."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def step_rewards(logits: Column, mask: Column, positive: int = 1) -> Column:
    """Probabilities of the positive class at the masked tokens of an array of rows of logits.

    One logit goes through the logistic function, several through softmax (the last class if there
    are too few). Logits and mask are cut to the shorter one.
    """
    total = lambda row: F.aggregate(row, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(row)))
    chosen = lambda row: F.element_at(row, F.least(F.size(row), F.lit(positive + 1)))
    one = lambda row: F.when(F.size(row) == 1, 1 / (1 + F.exp(-row[0]))).otherwise(F.exp(chosen(row) - F.array_max(row)) / total(row))
    n = F.least(F.size(logits), F.size(mask))
    pairs = F.arrays_zip(F.slice(logits, F.lit(1), n).alias("row"), F.slice(mask, F.lit(1), n).alias("on"))
    return F.transform(F.filter(pairs, lambda p: p["on"] != 0), lambda p: one(p["row"]))
