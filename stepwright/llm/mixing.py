"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: every source gets its weight's share of the mix, at most max_epochs times its own words;
what is over goes to the others by weight. Schedule: the mix is a row of slots of block_words
words. Slot k stands at the golden-ratio point frac(k * phi); the cumulative target shares turn
the point into a source, so every stretch of the schedule holds each source nearly in proportion.
A slot's rank among its source's slots picks the source's block of that number: the source's
documents, shuffled by a seeded hash, lie end to end on a line of words that is run through again
when it ends, and blocks are equal stretches of that line. A document's taken words are where
blocks overlap it.

Ranks and offsets are sums over two levels (totals per chunk or bucket, then order within), so a
source with a third of all rows spreads over many tasks.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; a
source without words has target 0; repeated rows each count; an empty table gives an empty
result; other columns are not read. The schedule rests on hashes and counts alone, so a rerun on
the same rows takes the same words, up to the order among identical rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.llm.common import WHITE_CLASS, WORD_CLASS, materialise, text_or_empty, word_count

#: Points are whole numbers below 2**62; the golden ratio's fraction of that is the step.
CIRCLE = 2**62
GOLDEN_STEP = 2850178704830799621
#: Cells of the circle, for an equality join of points with the sources' stretches.
CELLS = 4096
CYCLE = (3.0, 1.0, 2.0)


def sized_documents(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, body, source and size (words) of each document, written once."""
    body = F.xxhash64(text_or_empty(F.col("text"))).alias("body")
    rows = docs.select("doc_id", body, "source", word_count(F.col("text")).alias("size"))
    return materialise(rows.withColumn("row_id", F.monotonically_increasing_id()), "mix-sizes")


def source_targets(sizes: DataFrame, share: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """One row per source: source, source_size, weight, target (double).

    Weights repeat over the sources in code point order, null last. Filling to the caps: with
    sources in order of cap over weight, a source is full if its cap is under its weight's share
    of what the fuller ones before it leave.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_fill = Window.partitionBy().orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    filled = (
        totals.withColumns({"cap": cap, "fill": cap / F.col("weight"), "total": F.sum("source_size").over(everything) * F.lit(float(share))})
        .withColumn("level", level)
        .withColumn("full", F.col("fill") <= F.col("level"))
    )
    # those not full share one level: that of the first of them, which is the highest
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("weight") * rest, F.col("cap")))
    return filled.withColumn("target", target).select("source", "source_size", "weight", "target")


def source_shares(targets: DataFrame) -> DataFrame:
    """source_no with from_point and to_point, the stretch of the circle that maps to it, per cell it touches."""
    order = Window.partitionBy().orderBy("source_no")
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.floor(upto / F.sum("target").over(Window.partitionBy()) * F.lit(float(CIRCLE)))
    cells = F.sequence(F.floor(F.col("from_point") / (CIRCLE // CELLS)), F.floor((F.col("to_point") - 1) / (CIRCLE // CELLS)))
    return (
        targets.where("target > 0")
        .withColumn("to_point", end)
        .withColumn("from_point", F.coalesce(F.lag("to_point").over(order), F.lit(0)))
        .where("to_point > from_point")
        .select("source_no", "from_point", "to_point", F.explode(cells).alias("cell"))
    )


def schedule(targets: DataFrame, n_slots: int, slots_per_chunk: int = 512) -> DataFrame:
    """slot, source_no and block_no: the slot's rank among its source's slots, from 0."""
    turn = F.col("slot").cast("decimal(18,0)") * F.lit(GOLDEN_STEP).cast("decimal(19,0)")
    slots = targets.sparkSession.range(n_slots).select(F.col("id").alias("slot"))
    slots = slots.withColumn("point", (turn % F.lit(CIRCLE).cast("decimal(19,0)")).cast("long"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / (CIRCLE // CELLS)))
    placed = (
        slots.join(source_shares(targets), "cell")
        .where("point >= from_point and point < to_point")
        .select("slot", "source_no", F.floor(F.col("slot") / slots_per_chunk).alias("chunk"))
    )
    return running_sum(placed, "source_no", "chunk", "slot", F.lit(1), "block_no").select("slot", "source_no", "block_no")


def running_sum(rows: DataFrame, key: str, part: str, order: str, amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount over all earlier rows of the same key, by (part, order).

    First totals per part, then sums over parts, then order within one part: no task sees more
    than the parts of a key or the rows of a part.
    """
    rows = rows.withColumn("__amount", amount)
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy(key, part)
        .agg(F.sum("__amount").alias("__base"))
        .withColumn("__base", F.coalesce(F.sum("__base").over(earlier), F.lit(0)))
    )
    within = Window.partitionBy(key, part).orderBy(order, *(["row_id"] if "row_id" in rows.columns else []))
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__within", F.coalesce(F.sum("__amount").over(within), F.lit(0)))
        .join(bases, [key, part])
        .withColumn(name, F.col("__base") + F.col("__within"))
        .drop("__amount", "__base", "__within")
    )


def token_lines(sizes: DataFrame, targets: DataFrame, seed: int, n_docs: int) -> DataFrame:
    """The documents with start: their first word's place on the shuffled line of their source."""
    buckets = max(1, math.isqrt(n_docs))
    spot = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    first = F.conv(F.substring("spot", 1, 8), 16, 10).cast("long")
    line = (
        sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select("row_id", "doc_id", "body", "source", "size", "source_no", "source_size", "target", spot.alias("spot"))
        .withColumn("bucket", F.shiftright(first * buckets, 32))
    )
    return running_sum(line, "source_no", "bucket", "spot", F.col("size"), "start").drop("bucket", "spot")


def filled_slots(line: DataFrame, slots: DataFrame, block: int, max_epochs: float, exact: bool = True) -> DataFrame:
    """line's documents with one row per block they touch in each run through their source.

    slot is null where the schedule does not take the block; the row's stretch of the document
    is from_word to to_word. A source's last run ends where max_epochs does; with exact it ends at
    its rounded target (one word at least), and blocks before that which the schedule leaves out
    get slots after all others.
    """
    epochs = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(max_epochs) - 1))).alias("epoch")
    at = (F.col("start") + F.col("epoch") * F.col("source_size")).alias("at")
    last = F.floor(F.col("source_size") * F.lit(float(max_epochs)))
    if exact:
        last = F.when(F.col("target") > 0, F.least(last, F.greatest(F.lit(1).cast("long"), F.round("target").cast("long")))).otherwise(0)
    end = F.least(F.col("at") + F.col("size"), last)
    touched = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))
    return (
        line.select("*", epochs)
        .select("*", at)
        .withColumn("end", end)
        .withColumn("block_no", F.explode_outer(F.when(F.col("end") > F.col("at"), touched)))
        .join(slots, ["source_no", "block_no"], "left")
        .withColumn("slot", F.coalesce("slot", F.when(F.col("block_no").isNotNull(), F.lit(2**40) + F.col("block_no"))) if exact else F.col("slot"))
        .withColumns(
            {
                "from_word": F.greatest(F.lit(0), F.col("block_no") * block - F.col("at")),
                "to_word": F.least(F.col("end"), (F.col("block_no") + 1) * block) - F.col("at"),
            }
        )
    )


def mix_slots(
    docs: DataFrame,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = CYCLE,
    block_words: int = 1024,
    seed: int = 7,
    exact: bool = True,
) -> DataFrame:
    """The mix: per document and touched block row_id, doc_id, body, source, size, source_size,
    target, epoch, slot, from_word and to_word; slot, null where the block is not taken, orders the mix.

    block_words: words of a slot; less for small inputs, so that the schedule has some 4096 slots
    at least. share: words of the mix over words of the input. seed: of the shuffle. exact: each
    source's words end at its target; otherwise it has its scheduled blocks whole.
    """
    sizes = sized_documents(docs)
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    targets = source_targets(sizes, share, max_epochs, weights).withColumn("source_no", F.row_number().over(order))
    targets = materialise(targets, "mix-targets")
    wanted = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    block = max(1, min(block_words, int(wanted) // 4096))
    slots = schedule(targets, math.ceil(wanted / block))
    return filled_slots(token_lines(sizes, targets, seed, sizes.count()), slots, block, max_epochs, exact)


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix holds of it)."""
    words = F.when(F.col("slot").isNotNull(), F.col("to_word") - F.col("from_word")).otherwise(0)
    return (
        mix_slots(docs, **options)
        .groupBy("row_id", "doc_id", "size", "source_size", "target")
        .agg(F.sum(words).cast("long").alias("taken"))
        .drop("row_id")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix holds them: a row per document and run, cut to the words that are taken.

    Columns are those of docs; n_chars, where there is one, follows the cut text. A source's
    blocks are taken from its line's start, so what is taken of a document in one run is one
    stretch. Rows that share doc_id, text and source are told apart by a number, so each source's
    words come from its own rows.
    """
    spans = (
        mix_slots(docs, **options)
        .where("slot is not null")
        .groupBy("row_id", F.col("doc_id").alias("__doc"), F.col("body").alias("__body"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("epoch").alias("__epoch"))
        .agg(F.min("from_word").alias("__from"), F.max("to_word").alias("__to"))
    )
    copies = Window.partitionBy("__doc", "__body", "__source").orderBy("row_id")
    spans = materialise(spans.withColumn("__copy", F.dense_rank().over(copies)).drop("row_id"), "mix-spans")
    body = F.xxhash64(text_or_empty(F.col("text")))
    copy = F.lit(1)
    if not spans.where("__copy > 1").isEmpty():
        copy = F.row_number().over(Window.partitionBy("doc_id", body, "source").orderBy(F.lit(0)))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source"))
    same &= (F.col("__this") == F.col("__body")) & (F.col("__no") == F.col("__copy"))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"{WHITE_CLASS}*{WORD_CLASS}+"), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("__from") + 1).cast("int"), (F.col("__to") - F.col("__from")).cast("int")), "")
    whole = (F.col("__from") == 0) & (F.col("__to") == F.col("__size"))
    mixed = docs.withColumns({"__this": body, "__no": copy}).join(spans, same).withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)
