"""Removal of lines that several documents share.

Lines are exploded with their position; each line's key is normalised and hashed (128 bits), the
distinct documents per hash are counted, and every line of a key over the threshold goes, except
in the smallest doc_id that holds it. The surviving lines are put together by position: per
document the sorted positions of its dropped lines cut the array of lines into the runs that
stay, so only positions are gathered, never the lines' texts.

Counts combine before they are shuffled, and a hot key only makes many small rows of one hash,
which the adaptive join splits; nothing per key is collected.

Defined cases: a null or empty text is one empty line; a null doc_id is one document that sorts
after all others; repeated rows are one document and lose the same lines; an empty table gives
an empty result; columns beside doc_id and text are carried through untouched by dedup_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import WHITE, materialise, text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def shared_line_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """doc_id, body (hash of the whole text), dropped: sorted 1-based positions of lines to drop."""
    lines = (
        docs.select(
            "doc_id",
            F.xxhash64(text_or_empty(F.col("text"))).alias("body"),
            F.posexplode(lines_of(F.col("text"))).alias("pos", "line"),
        )
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id").alias("doc"), "body", "pos", F.unhex(F.md5("key")).alias("hash"))
    )
    lines = materialise(lines, "line-hashes")
    shared = (
        lines.groupBy("hash", "doc").agg(F.lit(1).alias("one"))
        .groupBy("hash").agg(F.count("one").alias("n_docs"), F.min("doc").alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .select("hash", "first")
    )
    # a table of its own, so that the join has two plain shuffles and can split a hot hash
    shared = materialise(shared, "line-shared")
    return (
        lines.join(shared, "hash")
        .where("doc != first")
        .groupBy(F.col("doc.doc_id").alias("doc_id"), "body")
        .agg(F.array_sort(F.collect_set(F.col("pos") + 1)).alias("dropped"))
    )


def kept_text(lines: Column, dropped: Column) -> Column:
    """The lines between dropped positions, joined; linear in the number of lines."""
    ends = F.concat(dropped, F.array(F.size(lines) + 1))
    starts = F.concat(F.array(F.lit(1)), F.transform(dropped, lambda p: p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a, b - a))
    return F.array_join(F.flatten(runs), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with text less its shared lines, and n_lines, n_dropped (names that must be free).

    min_chars: shorter keys always stay. min_docs: documents that must hold a key for it to go.
    """
    places = shared_line_positions(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("__doc"), F.col("body").alias("__body"), F.col("dropped").alias("__dropped")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_or_empty(F.col("text"))) == F.col("__body"))
    lines, dropped = lines_of(F.col("text")), F.col("__dropped")
    return (
        docs.join(places, same, "left")
        .withColumns(
            {
                "n_lines": F.size(lines).cast("long"),
                "n_dropped": F.when(dropped.isNull(), 0).otherwise(F.size(dropped)).cast("long"),
                "text": F.when(dropped.isNull(), text_or_empty(F.col("text"))).otherwise(kept_text(lines, dropped)),
            }
        )
        .drop("__doc", "__body", "__dropped")
    )
