"""The whole analysis of step metrics: its tables by name, and their files.

Steps come in long form: record_id, step_idx, metric, value and correct (1 or 0). Tables are plans;
writing runs each once. A metric's curve figures are those of its better direction.

Defined cases: values that are null or not finite, or beyond abs_max, count nowhere; a metric without both
labels has null figures; no steps at all give tables without rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.functions.columns import finite
from stepwright.operators import metrics as M
from stepwright.operators import stats as S


def curve_figures(steps: DataFrame, metric: str) -> DataFrame:
    """One row: metric, n_pos, n_neg, auc, flipped, average_precision, ks, threshold, tpr, fpr, cohen_d, cliff_delta.

    flipped: the metric is lower where steps are correct; all figures but the effect sizes are then
    of its negative.
    """
    rows = steps.where(F.col("metric") == metric).select(F.col("value").cast("double").alias("score"), F.col("correct").alias("label"))
    area = M.roc_auc(rows, "score", "label")
    first = area.first()  # one row, which decides the direction of all that follows
    flipped = first["auc"] is not None and first["auc"] < 0.5
    turned = rows.withColumn("score", -F.col("score")) if flipped else rows
    auc, is_flipped = M.auto_flipped(F.col("auc"))
    parts = [
        area.select(F.lit(metric).alias("metric"), "n_pos", "n_neg", auc, is_flipped),
        M.average_precision(turned, "score", "label"), M.ks_statistic(turned, "score", "label"),
        M.youden(turned, "score", "label").select("threshold", "tpr", "fpr"), M.effect_sizes(rows, "score", "label"),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # of one row each


def counted_rows(steps: DataFrame, metrics: list[str], abs_max: float | None = None) -> DataFrame:
    bound = F.lit(True) if abs_max is None else F.abs("value") <= abs_max
    return steps.where(finite(F.col("value").cast("double")) & bound & F.col("metric").isin(*metrics))


def auc_summary(steps: DataFrame, metrics: list[str], abs_max: float | None = None) -> DataFrame:
    """curve_figures of every metric; steps need only metric, value and correct."""
    rows = counted_rows(steps, metrics, abs_max)
    return reduce(DataFrame.unionByName, [curve_figures(rows, m) for m in metrics])


def analysis_tables(steps: DataFrame, metrics: list[str], abs_max: float | None = None) -> dict[str, DataFrame]:
    """Tables of the analysis: global_summary, per_sample_summary, per_step_index_summary,
    correlation_matrix_global, correlations_per_sample and auc_summary."""
    rows = counted_rows(steps, metrics, abs_max)
    wide = S.pivoted(rows, metrics)
    return {
        "global_summary": S.summary(rows, "value", ["metric"]),
        "per_sample_summary": S.summary(rows, "value", ["record_id", "metric"], small=True),
        "per_step_index_summary": S.summary(rows, "value", ["step_idx", "metric"]),
        "correlation_matrix_global": S.correlation_matrix(wide, metrics),
        "correlations_per_sample": S.correlation_matrix(wide, metrics, ["record_id"]),
        "auc_summary": auc_summary(steps, metrics, abs_max),
    }


def write_analysis(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header, in a folder of its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def write_result(result: DataFrame, path: str) -> None:
    """A result of few rows, such as scores per split, as JSON lines in one file."""
    result.coalesce(1).write.mode("overwrite").json(path)
