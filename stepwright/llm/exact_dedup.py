"""Exact deduplication by a stateful stream of digests.

Every document becomes one small record: digest of its normalised text, length, identifier and
content locator (file and row). A Structured Streaming aggregation over these records keeps, per
digest and without expiry, the record that stays and the number of members; RocksDB holds that
state on disk. Of digests that were hit more than once the members' contents are fetched by their
locators and compared in full with their keeper's; members whose bytes differ are grouped anew by
the text itself. Only texts of hits are moved: a bitmap of bounded size over the hits' locators
drops the others (but for chance agreements, which a join then drops) where they are read.

A state folder given to run_state is gone on from: records that came since the last run are
counted in, those that were there before are not read again.

Defined cases: a null text is the empty text; empty texts equal each other; a null doc_id sorts
last; of repeated rows exactly one is kept; an empty table gives an empty result; columns beside
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.llm.common import LOCATOR, materialise, maybe_among, scratch_path, settle, text_or_empty, with_locators, without_rows, without_white

#: State on disk; without fallocate, which sets 4 MB aside for each of many small stores. All
#: stores of an executor share one bounded cache, and a store is closed when its batch is written.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digest_records(located: DataFrame, digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """digest, n_chars, id_null, doc_id and locator of each document; works on streams too."""
    return located.select(
        digest(without_white(text_or_empty(F.col("text")))).alias("digest"),
        F.length(text_or_empty(F.col("text"))).alias("n_chars"),
        F.col("doc_id").isNull().alias("id_null"),
        "doc_id",
        *LOCATOR,
    )


def keeper_state(records: DataFrame) -> DataFrame:
    """Per digest the record that stays and the group's size; on a stream, state that never expires."""
    order = F.struct((-F.col("n_chars")).alias("rank"), "id_null", "doc_id", *LOCATOR)
    return records.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))


def run_state(spark: SparkSession, folder: str, schema, files_per_batch: int, place: str | None = None) -> DataFrame:
    """Stream the record files of folder through keeper_state and read the final state back.

    place: the folder of the stream's offsets and state; one that was used before is gone on from.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    again, place = place is not None, place or scratch_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            keeper_state(stream)
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", place)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if query.lastProgress is None and not again:  # no file, so no batch and no state
            return keeper_state(spark.createDataFrame([], schema)).select("digest", "best.*", "group_size")
        state = spark.read.format("statestore").load(place)
        best, size = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
        return materialise(
            state.select(F.col("key.digest").alias("digest"), F.col(best).alias("best"), F.col(size).alias("group_size"))
            .select("digest", "best.*", "group_size"),
            "dedup-groups",
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_groups(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256_bytes, files_per_batch: int = 4096
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    files_per_batch bounds what one micro-batch of the stream takes in.
    """
    located = with_locators(docs.select("doc_id", "text"))
    groups = settle(docs.sparkSession, lambda: located_groups(located, digest, files_per_batch), "dedup-result")
    return groups.drop(*LOCATOR)


def located_groups(located: DataFrame, digest: Callable[[Column], Column] = sha256_bytes, files_per_batch: int = 4096) -> DataFrame:
    """exact_groups with the locator of each row."""
    spark = located.sparkSession
    rows = digest_records(located, digest)
    folder = scratch_path(spark, "dedup-records")
    rows.write.parquet(folder)
    records = spark.read.schema(rows.schema).parquet(folder)
    groups = run_state(spark, folder, rows.schema, files_per_batch)
    keepers = groups.select("digest", F.col("doc_id").alias("keep_id"), *[F.col(c).alias(f"keep{c}") for c in LOCATOR], "group_size")
    here = F.lit(True)
    for c in LOCATOR:
        here = here & (F.col(c) == F.col(f"keep{c}"))
    result = (
        records.select("doc_id", "digest", *LOCATOR)
        .join(keepers, "digest")
        .select("doc_id", "keep_id", "group_size", here.alias("kept"), "digest", *LOCATOR)
    )
    members = hit_texts(located, records, groups)
    wrong = unequal_digests(members)
    if wrong.isEmpty():
        return result
    return result.join(wrong, "digest", "left_anti").unionByName(grouped_by_text(members, wrong, result.columns))


def hit_texts(located: DataFrame, records: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of digests with more than one: record, locator, is_keeper and squeezed (the text)."""
    hits = groups.where("group_size > 1").select("digest", *[F.col(c).alias(f"keep{c}") for c in LOCATOR])
    is_keeper = (F.col(LOCATOR[0]) == F.col(f"keep{LOCATOR[0]}")) & (F.col(LOCATOR[1]) == F.col(f"keep{LOCATOR[1]}"))
    chosen = records.join(hits, "digest").select("digest", "n_chars", "id_null", "doc_id", *LOCATOR, is_keeper.alias("is_keeper"))
    chosen = materialise(chosen, "dedup-hits")
    texts = maybe_among(located.select("text", *LOCATOR), chosen)
    return materialise(
        texts.join(chosen, list(LOCATOR)).withColumn("squeezed", without_white(text_or_empty(F.col("text")))).drop("text"), "dedup-texts"
    )


def unequal_digests(members: DataFrame) -> DataFrame:
    """Digests under which two texts differ; every member of a hit is compared in full with its keeper."""
    keepers = members.where("is_keeper").select("digest", F.col("squeezed").alias("kept_text"))
    unequal = members.where("not is_keeper").select("digest", "squeezed").join(keepers, "digest").where("squeezed != kept_text")
    # a table of its own: no aggregation by digest stands on the join, which may so split a hot one
    return materialise(unequal.select("digest"), "dedup-unequal").distinct()


def grouped_by_text(members: DataFrame, wrong: DataFrame, columns: list[str]) -> DataFrame:
    """The members of the given digests, grouped by their whole normalised text."""
    rows = materialise(members.join(wrong, "digest", "left_semi"), "dedup-regroup")
    order = F.struct((-F.col("n_chars")).alias("rank"), "id_null", "doc_id", *LOCATOR)
    best = rows.groupBy("squeezed").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    first = [F.col(c) == F.col(f"best.{c}") for c in LOCATOR]
    return (
        rows.join(best, "squeezed")
        .withColumns({"keep_id": F.col("best.doc_id"), "kept": first[0] & first[1]})
        .withColumn("digest", sha256_bytes(F.col("squeezed")))
        .select(*columns)
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    located = with_locators(docs)
    dropped = settle(docs.sparkSession, lambda: located_groups(located).where("not kept").select(*LOCATOR), "dedup-dropped")
    return without_rows(located, dropped)
