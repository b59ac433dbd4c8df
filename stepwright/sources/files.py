"""Reading and writing record files: JSON arrays, lines, wrapped and damaged files, tables, sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwright.sources.ranges import WRAPPERS, read_ranges

MODES = {"strict": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}


def first_character(spark: SparkSession, path: str) -> str:
    """The first character of a file that is not white space, from its first non-empty line."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.substring(F.ltrim(F.translate("value", "﻿", "")), 1, 1)).first()
    return head[0] if head else ""


def read_records(spark: SparkSession, path: str, schema: StructType | str, mode: str = "skip") -> DataFrame:
    """Records of a JSON array or of JSON lines, told apart by the first character.

    mode: strict raises at the first bad line, skip drops bad lines, keep has bad lines in
    _corrupt_record if the schema names that column. Compressed files are read by their suffix.
    Arrays and objects over several lines are read in ranges by many tasks.
    """
    reader = spark.read.schema(schema).option("mode", MODES[mode])
    if first_character(spark, path) == "[" or whole_object(spark, path):
        kind = schema if isinstance(schema, str) else schema.simpleString()
        return read_damaged(spark, [path], kind, skip=mode != "strict").drop("source_file")
    return reader.json(path)


def whole_object(spark: SparkSession, path: str) -> bool:
    """Is the file one object over several lines, or one that wraps a list of records? Its first
    line, which is all that is looked at, is then no object or one with a list under a wrapper's name."""
    line = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    if line is None:
        return False
    try:
        found = json.loads(line[0].lstrip("\ufeff"))
    except ValueError:
        return line[0].lstrip("\ufeff \t").startswith("{") and line[0].rstrip()[-1:] in "{[,"
    return isinstance(found, dict) and any(isinstance(found.get(w), list) and all(isinstance(x, dict) for x in found[w]) for w in WRAPPERS)


def read_many(spark: SparkSession, paths: list[str], schema: StructType | str, mode: str = "skip") -> DataFrame:
    """JSON lines of several paths or globs, each once, with the file's name; bad files are passed over."""
    rows = spark.read.schema(schema).option("mode", MODES[mode]).option("ignoreCorruptFiles", True).json(sorted(set(paths)))
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def natural_key(name):
    """A name as a column that sorts with its numbers by value: digits padded to 12 places."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"^\d+$")), F.lpad(p, 12, "0")).otherwise(F.lower(p))), "")


def read_folder(spark: SparkSession, folder: str, schema: StructType | str, leave_out: str = "_profile", mode: str = "skip") -> DataFrame:
    """All .jsonl files below a folder, but those whose name holds leave_out, with file_key to sort by."""
    rows = (
        spark.read.schema(schema).option("mode", MODES[mode]).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").json(folder)
    )
    rows = rows.withColumn("source_file", F.col("_metadata.file_name")).where(~F.contains("source_file", F.lit(leave_out)))
    return rows.withColumn("file_key", natural_key(F.col("source_file")))


def read_damaged(spark: SparkSession, paths: list[str], schema: StructType | str, skip: bool = True) -> DataFrame:
    """Records of damaged or wrapped files with the file's name, see read_ranges."""
    return read_ranges(spark, paths, schema, skip).drop("line")


def write_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder per value of by if named (such as wrong and right answers)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_array(df: DataFrame, path: str, order: str) -> None:
    """One JSON array in the order of a column, in parts: the files of the folder, joined in the order of
    their names, are the array. Many tasks write; none holds more than its range.
    """
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    lines = df.select(F.col(order).alias("at"), body.alias("value")).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.select(F.lit(1).alias("group"), "at", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    first = lines.agg(F.min(F.struct("at", "value")).alias("b")).first()["b"]
    kind = df.schema[order].dataType
    marks = df.sparkSession.createDataFrame([(0, "[", 1), (2, "]", 1)], "group int, value string, copy long").withColumn("at", F.lit(None).cast(kind))
    rows = marks.unionByName(lines).repartitionByRange("group", "at", "value", "copy").sortWithinPartitions("group", "at", "value", "copy")
    # all records but the first have the comma that ends the one before
    is_first = F.lit(True) if first is None else F.col("at").eqNullSafe(F.lit(first["at"]).cast(kind)) & (F.col("value") == first["value"]) & (F.col("copy") == 1)
    comma = F.when((F.col("group") == 1) & ~is_first, ",").otherwise("")
    rows.select(F.concat(comma, "value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def split_by_error(df: DataFrame, label: str, path: str) -> None:
    """Rows with a first error (label not -1) and without, in folders is_error=true and false."""
    write_lines(df.withColumn("is_error", F.col(label) != -1), path, by="is_error")


def wrong_answers(df: DataFrame, path: str, correct: str = "correct") -> None:
    write_lines(df.where(~F.coalesce(F.col(correct), F.lit(False))), path)


def output_tag(path: str, containers: tuple[str, ...] = ("checkpoints", "final", "best")) -> str:
    """A name for outputs from a model's path, past folders that only contain it."""
    parts = [p for p in re.split(r"[/\\]+", path) if p and p not in containers and not re.fullmatch(r"checkpoint-\d+", p)]
    return re.sub(r"[^A-Za-z0-9._-]+", "-", parts[-1] if parts else "model").strip("-")
