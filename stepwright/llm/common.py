"""Helpers shared by the corpus operators: text classes, scratch folders, materialised tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: U+0020 and U+0009 to U+000D. Fixed values.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def text_or_empty(text: Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(text, F.lit(""))


def without_white(text: Column) -> Column:
    """The text without any white space; byte searches stay inside generated code."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white characters; null counts 0.

    Each run is shrunk to one character, so no array of words is built.
    """
    return F.length(without_white(F.regexp_replace(text_or_empty(text), WORD_CLASS + "+", "x"))).cast("long")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables between jobs: spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="stepwright-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths given out inside each running settle().
_open: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; the application id groups what one run leaves."""
    path = f"{scratch_root(spark)}/stepwright/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the reread table.

    The table survives the loss of any executor and has columns that later jobs can prune.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def settle(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that build() gives, materialised; what else it left in the shared folder goes."""
    _open.append([])
    try:
        table = materialise(build(), label)
    finally:
        made = _open.pop()
    for path in made:
        if path != table.scratch:
            delete_folder(spark, path)
    if _open:
        _open[-1].append(table.scratch)
    return table


#: Columns of a content locator: the file that holds a row, and its number there.
LOCATOR = ("__file", "__row")


def with_locators(docs: DataFrame) -> DataFrame:
    """docs with the columns of LOCATOR, which tell all rows apart and find each again.

    They are those of the table's own files where docs reads each row of them at most once;
    anything else is written to the shared folder first, so that its rows have a place.
    """
    try:
        place = docs.metadataColumn("_metadata")
        here = docs.withColumns({LOCATOR[0]: place["file_path"], LOCATOR[1]: place["row_index"]})
        if here.groupBy(*LOCATOR).count().where("count > 1").isEmpty():
            return here
    except AnalysisException:
        pass
    table = materialise(docs, "located")
    place = table.metadataColumn("_metadata")
    return table.withColumns({LOCATOR[0]: place["file_path"], LOCATOR[1]: place["row_index"]})


def without_rows(located: DataFrame, dropped: DataFrame) -> DataFrame:
    """located (see with_locators) without the rows whose locators dropped holds, and without locators."""
    return located.join(dropped.select(*LOCATOR), list(LOCATOR), "left_anti").drop(*LOCATOR)


#: Bits of a bitmap of chosen rows: so many for each of them, within these powers of two (4 KB and 16 MB).
BITS_FOR_ROW, LEAST_BITS, MOST_BITS = 16, 15, 27


def maybe_among(located: DataFrame, chosen: DataFrame, names: tuple[str, ...] = LOCATOR) -> DataFrame:
    """The rows of located whose columns of these names may be as in a row of chosen: none of these is lost.

    The others go where they are read, but for chance agreements, which a join then drops. The
    bitmap is made and read by native functions, a row for each 32768 bits, and broadcast; its size
    is bounded, so with very many chosen rows it lets more of the others pass.
    """
    power = min(MOST_BITS, max(LEAST_BITS, (chosen.count() * BITS_FOR_ROW).bit_length()))
    spot = F.xxhash64(*names).bitwiseAND((1 << power) - 1)
    bits = chosen.select(spot.alias("__spot")).groupBy(F.bitmap_bucket_number("__spot").alias("__bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("__spot")).alias("__bits"))
    placed = located.withColumn("__spot", spot).withColumn("__bucket", F.bitmap_bucket_number("__spot"))
    at = F.bitmap_bit_position("__spot").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, at.bitwiseAND(7)) == 1
    return placed.join(F.broadcast(bits), "__bucket").where(is_set).drop("__bucket", "__bits", "__spot")


#: Texts in one Arrow batch: bounds what a task holds twice, in the JVM's buffers and in Python.
ROWS_IN_BATCH = "500"


def ddl(rows: DataFrame, *names: str) -> str:
    """The columns of these names and their types, as a schema in words."""
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def map_texts_in_batches(rows: DataFrame, batches: Callable, schema) -> DataFrame:
    """rows.mapInArrow(batches, schema) with small batches; a size that the session sets stays."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":  # Spark's own default
        conf.set(name, ROWS_IN_BATCH)
    return rows.mapInArrow(batches, schema)


_kept: dict[object, object] = {}


def kept_in_worker(key: object, build: Callable[[], object]) -> object:
    """What build() gives, kept in this Python worker for the key's next task.

    Workers outlive stages, so only the last key's tables are kept: a worker never holds the
    tables of two operators.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing needs any more.

    Shuffle files of finished jobs go as well once the driver's JVM finds their plans unused,
    which is asked of it here, so a long chain of steps holds the disk of one step at a time.
    """
    for table in tables:
        delete_folder(table.sparkSession, table.scratch)
    free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let shuffle files go that no plan needs any more, see release."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_scratch(spark: SparkSession, keep: str | None = None) -> None:
    """Delete what this application left in the shared folder, once its results are written.

    keep: the one table (its folder) that stays, such as the input of the next step.
    """
    root = f"{scratch_root(spark)}/stepwright/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in store.listStatus(path) if store.exists(path) else []:
        if keep is None or entry.getPath().getName() != keep.rsplit("/", 1)[-1]:
            store.delete(entry.getPath(), True)
