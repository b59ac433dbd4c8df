"""The driver's tables as the entities of the engine, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwright.operators.ordered import dealt

#: Lines of orders that one task holds.
LINES_IN_TASK = 100_000
LINE_FIELDS = [
    "l_extendedprice AS price", "l_quantity AS quantity", "l_discount AS discount", "l_tax AS tax", "int(l_returnflag = 'R') AS error", "l_returnflag AS answer",
]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

SQL_VIEWS = {
    "ev": """ev AS (SELECT user_id AS record_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INTEGER) AS step_idx,
        value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error, event_type FROM events)""",
    "li": """li AS (SELECT l_orderkey AS record_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS step_idx,
        l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS error, l_returnflag AS answer FROM lineitem)""",
    "lab": "lab AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, quality AS label FROM documents JOIN labels USING (doc_id))",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id (user), step_idx, value, error, event_type."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_id"), place.alias("step_idx"), "value", (F.col("event_type") == "error").cast("int").alias("error"), "event_type"
    )


def line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id (order), step_idx, price, quantity, discount, tax, error (returned), answer.

    Lines are dealt by order into partitions by their number, which all that goes by record keeps.
    """
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    lines = dealt(table(spark, sf_dir, "lineitem"), LINES_IN_TASK, "l_orderkey").withColumn("step_idx", place)
    return lines.selectExpr("l_orderkey AS record_id", "step_idx", *LINE_FIELDS)


def line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_steps without step_idx, for what needs no order of a record's lines: nothing is shuffled."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS record_id", *LINE_FIELDS)


def in_long_form(lines: DataFrame) -> DataFrame:
    """record_id, step_idx (if the lines have it), metric, value, correct."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("price", "quantity", "discount", "tax")])
    return lines.select(*[c for c in ("record_id", "step_idx") if c in lines.columns], (1 - F.col("error")).alias("correct"), F.inline(cells))


def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_steps in long form: record_id, step_idx, metric, value, correct."""
    return in_long_form(line_steps(spark, sf_dir))


def line_records(spark: SparkSession, sf_dir: str, fields: list[str] = LINE_FIELDS) -> DataFrame:
    """One row per order with parallel arrays of these fields of its lines.

    An order's lines are gathered as they come and sorted then, so who needs the orders only reads their keys.
    """
    row = F.struct(*LINE_ORDER, *map(F.expr, fields))
    gathered = dealt(table(spark, sf_dir, "lineitem"), LINES_IN_TASK, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("lines"))
    names = gathered.schema["lines"].dataType.elementType.names[len(LINE_ORDER) :]
    return gathered.select(F.col("l_orderkey").alias("record_id"), *[F.col(f"lines.{n}").alias(n) for n in names])


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepwright.operators.steps import records_from_steps

    return records_from_steps(event_steps(spark, sf_dir), "record_id", ["step_idx"], {n: F.col(n) for n in ("value", "error")})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score (length of the text), label (quality)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", F.col("n_chars").cast("double").alias("score")).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")


def gold_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id and gold: the first error step of each user, or -1."""
    first = F.coalesce(F.min(F.when(F.col("error") == 1, F.col("step_idx"))), F.lit(-1))
    return event_steps(spark, sf_dir).groupBy("record_id").agg(first.alias("gold"))
