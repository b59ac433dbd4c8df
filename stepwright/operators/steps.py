"""The step table: unpivoting records, filters on steps, per-record contexts and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions.columns import finite, numbers_to


def step_table(records: DataFrame, record: str, metrics: dict[str, str], labels: str | None = None) -> DataFrame:
    """record_id, step_idx, metric, value, correct (1, 0, or -1 without a label) from arrays.

    metrics: metric name to array column. A label above 0.5 counts as 1.
    """
    arrays = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("array<double>").alias("vals")) for m, c in metrics.items()]
    mask = F.col(labels) if labels else F.lit(None).cast("array<double>")
    rows = records.select(F.col(record).alias("record_id"), mask.alias("mask"), F.explode(F.array(*arrays)).alias("m"))
    rows = rows.select("record_id", "mask", F.col("m.metric").alias("metric"), F.posexplode("m.vals").alias("step_idx", "value"))
    label = F.get("mask", F.col("step_idx"))
    return rows.select("record_id", "step_idx", "metric", "value", F.when(label.isNull(), -1).otherwise((label > 0.5).cast("int")).alias("correct"))


def records_from_steps(steps: DataFrame, record: str, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """One row per record with an array per column, in the order of the steps."""
    fields = F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], *[c.alias(n) for n, c in columns.items()])
    gathered = steps.groupBy(record).agg(F.array_sort(F.collect_list(fields)).alias("__a"))
    return gathered.select(record, *[F.col(f"__a.{n}").alias(n) for n in columns])


def filter_steps(records: DataFrame, value: str, arrays: list[str], abs_max: float | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """records with only the steps whose value is finite and in bounds, all arrays cut alike.

    Arrays whose length differs from the value's stay as they are; records without a step left go.
    Adds n_before and n_after.
    """
    ok = lambda v: (
        finite(v) & (F.lit(True) if abs_max is None else F.abs(v) <= abs_max)
        & (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high)
    )
    keep = F.filter(F.sequence(F.lit(1), F.greatest(F.size(value), F.lit(1))), lambda i: F.coalesce(ok(F.get(F.col(value), i - 1)), F.lit(False)))
    rows = records.withColumns({"__keep": keep, "n_before": F.size(value)})
    cut = lambda c: F.when(F.size(c) == F.col("n_before"), F.transform("__keep", lambda i: F.get(F.col(c), i - 1))).otherwise(F.col(c))
    rows = rows.withColumn("n_after", F.size("__keep")).where("n_after > 0")
    return rows.withColumns({c: cut(c) for c in dict.fromkeys([*arrays, value])}).drop("__keep")


def filter_outliers(steps: DataFrame, bounds: DataFrame, abs_max: float | None = None) -> DataFrame:
    """Steps whose value is finite and within their metric's lo and hi, where bounds has them."""
    joined = steps.join(bounds, "metric", "left")
    v = F.col("value")
    inside = (F.col("lo").isNull() | (v >= F.col("lo"))) & (F.col("hi").isNull() | (v <= F.col("hi")))
    return joined.where(finite(v) & inside & (F.lit(True) if abs_max is None else F.abs(v) <= abs_max)).drop("lo", "hi")


def contexts(record: str, base: Column, steps: Column, joint: str = "\n") -> dict[str, Column]:
    """Arrays of contexts per step: prefix (base and steps up to it), single (base and it alone),
    without (all but it), and full (one string)."""
    glue = lambda parts: F.array_join(F.concat(F.array(base), parts), joint)
    n = F.size(steps)
    each = numbers_to(n)
    return {
        "prefix": F.transform(each, lambda i: glue(F.slice(steps, F.lit(1), i))),
        "single": F.transform(each, lambda i: glue(F.slice(steps, i, F.lit(1)))),
        "without": F.transform(each, lambda i: glue(F.concat(F.slice(steps, F.lit(1), i - 1), F.slice(steps, i + 1, n)))),
        "full": glue(steps),
    }


def join_with_marker(steps: Column, marker: str, joint: str = " ") -> Column:
    """Non-empty trimmed steps, each followed by the marker; the marker alone without steps."""
    kept = F.filter(F.transform(steps, lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(kept) == 0, F.lit(marker)).otherwise(F.array_join(F.transform(kept, lambda s: F.concat_ws(joint, s, F.lit(marker))), joint))


def pack_within(lengths: Column, budget: int) -> Column:
    """How many leading steps fit a token budget."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    step = lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["n"] + (a["sum"] + v <= budget).cast("int")).alias("n"))
    return F.aggregate(lengths, start, step, lambda a: a["n"])


def marker_positions(ids: Column, marker: list[int]) -> Column:
    """0-based places of the last token of each occurrence of the marker."""
    m = len(marker)
    wanted = F.array(*[F.lit(x) for x in marker])
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids) - m + 1, F.lit(1))), lambda i: F.slice(ids, i, F.lit(m)) == wanted)
    return F.transform(starts, lambda i: i + m - 2)


def repeated_steps(steps: DataFrame, record: str, order: str, text: str) -> DataFrame:
    """Steps with repeated: true where the text equals the one before."""
    before = F.lag(text).over(Window.partitionBy(record).orderBy(order))
    return steps.withColumn("repeated", F.coalesce(F.col(text) == before, F.lit(False)))


def shapes_of(df: DataFrame, candidates: dict[str, list[str]]) -> dict[str, str | None]:
    """For each role the first of its candidate names that the table has as a column."""
    return {role: next((n for n in names if n in df.columns), None) for role, names in candidates.items()}


def split_flat(flat: DataFrame, lengths: DataFrame, record: str = "record_id", position: str = "pos", value: str = "value", part: str = "part", n: str = "n") -> DataFrame:
    """record, part, idx and value: a flat row of values cut into parts of given lengths, as relations.

    flat: record, position (from 0) and value; lengths: record, part (in order) and n. Each part takes
    the n values after those of the parts before it; parts beyond the values get what is left, values
    beyond the parts are left out, and parts of no length, or of null or a negative one, have no rows.
    Running offsets tell each part its positions, so the work is linear in values and parts.
    """
    size = F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(0)).cast("long")
    upto = Window.partitionBy(record).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = lengths.select(record, part, size.alias("__n")).withColumn("__end", F.sum("__n").over(upto)).where("__n > 0")
    # no more positions of a part than there are values: a length may be wrong by any amount
    ends = flat.groupBy(record).agg((F.max(position) + 1).alias("__size"))
    first = F.col("__end") - F.col("__n")
    parts = parts.join(ends, record).withColumn("__last", F.least("__end", "__size") - 1).where(F.col("__last") >= first)
    spread = parts.select(record, part, first.alias("__first"), F.explode(F.sequence(first, F.col("__last"))).alias(position))
    values = flat.select(record, F.col(position).cast("long").alias(position), value)
    return spread.join(values, [record, position]).select(record, part, (F.col(position) - F.col("__first")).cast("int").alias("idx"), value)
