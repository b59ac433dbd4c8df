"""Wrong answers near a right one: perturbed numbers and fractions, deduplicated by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions.answers import canonical_key
from stepwright.operators.ordered import dealt

#: Records whose variants are made by one task.
RECORDS_IN_TASK = 20_000


def number_variants(answer: Column) -> Column:
    """Numbers near a plain number: by 1, 2 and 10, a tenth less and more, and its whole neighbours."""
    x = F.regexp_replace(answer, r"[$,\s]", "").try_cast("double")
    values = [x + d for d in (1, -1, 2, -2, 10, -10)] + [x * 0.9, x * 1.1, F.floor(x).cast("double"), F.ceil(x).cast("double")]
    shown = lambda v: F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(F.round(v, 6).cast("string"))
    return F.filter(F.transform(F.array(*values), shown), lambda v: v.isNotNull())


def fraction_variants(answer: Column) -> Column:
    """Fractions near p/q or a LaTeX fraction: each part by one, the inverse and the negative."""
    pattern = r"^(?:\\d?frac\{(-?\d+)\}\{(\d+)\}|(-?\d+)/(\d+))$"
    part = lambda i, j: F.coalesce(F.regexp_extract(answer, pattern, i).try_cast("long"), F.regexp_extract(answer, pattern, j).try_cast("long"))
    p, q = part(1, 3), part(2, 4)
    latex = F.startswith(answer, F.lit("\\"))
    show = lambda a, b: F.when(b != 0, F.when(latex, F.concat(F.lit("\\frac{"), a.cast("string"), F.lit("}{"), b.cast("string"), F.lit("}"))).otherwise(F.concat_ws("/", a.cast("string"), b.cast("string"))))
    return F.filter(F.array(show(p + 1, q), show(p - 1, q), show(p, q + 1), show(p, q - 1), show(q, p), show(-p, q)), lambda v: v.isNotNull())


def root_variants(answer: Column) -> Column:
    """Roots near a root, LaTeX or written out: of one more and one less, and the number itself."""
    n = F.regexp_extract(answer, r"^(?:\\sqrt\{(\d+)\}|sqrt\((\d+)\)|\u221a(\d+))$", 0)
    inner = F.regexp_extract(n, r"(\d+)", 1).try_cast("long")
    shown = lambda k: F.when(k >= 0, F.regexp_replace(answer, r"\d+", k.cast("string")))
    return F.filter(F.array(shown(inner + 1), shown(inner - 1), inner.cast("string")), lambda v: v.isNotNull())


def wrong_answers(records: DataFrame, gold: str, sampled: str | None, most: int, seed: int, record: str = "record_id") -> DataFrame:
    """record, rank and negative: sampled answers first, then variants of the gold, in seeded order.

    Nothing that equals the gold or an earlier one by value stays; answers are at most 32 characters.
    """
    # dealt before its variants are made: a small file is one task, but most of the work is done here
    records = dealt(records.select(record, *dict.fromkeys(c for c in (gold, sampled) if c)), RECORDS_IN_TASK, record)
    g = F.col(gold)
    made = lambda source, answers: F.transform(answers, lambda a: F.struct(F.lit(source).alias("source"), F.trim(a).alias("negative"), canonical_key(F.trim(a)).alias("key")))
    variants = made(1, F.concat(fraction_variants(g), root_variants(g), number_variants(g)))
    found = F.concat(made(0, F.coalesce(F.col(sampled), F.array().cast("array<string>"))), variants) if sampled else variants
    rows = records.select(record, canonical_key(g).alias("gold_key"), F.explode(found).alias("f")).select(record, "gold_key", "f.*")
    rows = rows.where((F.col("negative") != "") & (F.length("negative") <= 32) & (F.col("key") != F.col("gold_key")))
    order = [F.asc("source"), F.md5(F.concat_ws(":", F.lit(seed), record, "negative")), F.asc("negative")]
    first = F.row_number().over(Window.partitionBy(record, "key").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy(record).orderBy(*order))
    return rows.withColumn("__first", first).where("__first = 1").withColumn("rank", rank).where(F.col("rank") <= most).select(record, "rank", "negative")
