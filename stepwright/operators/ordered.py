"""Running sums and exact quantiles over a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket is meant to hold, and the least and greatest number of buckets.
ROWS_IN_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 16, 256
#: Values of one key that a task may hold to find their quantiles.
FEW_VALUES = 1_000_000
#: Approximate quantiles are off by 1 / RANK_STEPS of the rows at most; values within SLACK of a share's rank, several times that, are counted singly.
RANK_STEPS = 10_000
SLACK = 4 / RANK_STEPS
#: Keys up to which what is known of each is computed at once and broadcast.
FEW_KEYS = 10_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys into as many partitions as hold about so many rows each, so that a task's
    memory stays as the table grows. Windows and groups over these keys and others need no other shuffle."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """Number of bounds (ascending) below the value, by halving: a few comparisons for each row."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.lit(bounds[middle]) < value, between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(bounds))


def quantile_bounds(df: DataFrame, column: str, n: int | None = None) -> list[float]:
    """Up to n - 1 bounds that part the column into about equal shares; n goes by the number of rows."""
    value = F.col(column).cast("double")
    shares = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    found, rows = df.agg(F.percentile_approx(value, shares, 2000), F.count(value)).first()
    n = n or min(MOST_BUCKETS, max(LEAST_BUCKETS, rows // ROWS_IN_BUCKET))
    return sorted({found[i * MOST_BUCKETS // n - 1] for i in range(1, n)}) if found else []


def running(df: DataFrame, order: str, sums: list[str], buckets: int | None = None, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """df, whose order values are unique within its keys, with cum_<c> for each of sums (up to and
    including the row, ascending) and next_value (the following order value, null for the last).

    Rows are parted at quantiles of the order column; the few bucket totals of each key are summed
    up and added to running sums within buckets. Keys are meant to be few.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    df = df.withColumn("__bucket", bucket_of(F.col(order), quantile_bounds(df, order, buckets)))
    totals = df.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums], F.min(order).alias("__low"))
    along = Window.partitionBy(*keys).orderBy("__bucket")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        F.col("__bucket").alias("__part"),
        F.lead("__low").over(along).alias("__next"),
        *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__b_{c}") for c in sums],
    )
    within = Window.partitionBy(*keys, "__bucket").orderBy(order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # null-safe keys, as the planner would carry the bucket's expression over
    same = F.col("__bucket").eqNullSafe(F.col("__part"))
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return (
        df.withColumns({f"__s_{c}": F.sum(c).over(upto) for c in sums} | {"__lead": F.lead(order).over(within)})
        .join(bases if keys else F.broadcast(bases), same)  # without keys one row per bucket
        .withColumns({f"cum_{c}": F.col(f"__b_{c}") + F.col(f"__s_{c}") for c in sums} | {"next_value": F.coalesce("__lead", "__next")})
        .drop("__bucket", "__part", "__lead", "__next", *names, *[f"__{p}_{c}" for p in "sb" for c in sums])
    )


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] = [], few: int = FEW_VALUES, most: int | None = None) -> DataFrame:  # noqa: B006
    """keys, n and q: exact quantiles of the value (not null) per key, between two values by their
    distance; without keys one row, null and 0 for no values.

    Keys with more than few values in all are never held by a task: of their values only those near
    the quantiles are counted singly, see counted_quantiles. most: values of the largest key, if that
    is known; it is counted otherwise. Without keys the one row is computed at once, so that what is
    built on it does not repeat the work; a table of keys stays a plan.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    if most is None:
        most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= few:
        found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("__v", shares).alias("q"))
        none = F.array(*[F.lit(None).cast("double")] * len(shares))
        found = found.withColumn("q", F.coalesce("q", none))
    else:
        found = counted_quantiles(rows, shares, keys)
    return found if keys else df.sparkSession.createDataFrame(found.collect(), found.schema)


def at_hand(df: DataFrame) -> DataFrame:
    """df, computed once and broadcast to what it is joined with, if its rows are few (FEW_KEYS); else df, as it is."""
    found = df.limit(FEW_KEYS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)) if len(found) <= FEW_KEYS else df


def counted_quantiles(rows: DataFrame, shares: list[float], keys: list[str]) -> DataFrame:
    """quantiles of __v in two passes over the rows, of which hardly any are shuffled.

    The first finds, by approximate quantiles, between which values each share's neighbours lie; the
    second counts the values there singly and those between such ranges together. The neighbours
    are read off the running counts, in which a task holds one range. Keys of few rows are one range.
    """
    names = [f"__k{i}" for i in range(len(keys))]

    def beside(df: DataFrame, other: DataFrame, *also: str) -> DataFrame:
        same = F.lit(True)
        for k, n in zip([*keys, *also], [*names, *(f"{c}_" for c in also)]):
            same = same & F.col(k).eqNullSafe(F.col(n))
        return df.join(other, same).drop(*names, *(f"{c}_" for c in also)) if keys or also else df.crossJoin(other)

    around = [min(1.0, max(0.0, s + d)) for d in (-SLACK, SLACK) for s in shares]
    ends = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", around, RANK_STEPS).alias("__b"))
    v, whole, among, passed = F.col("__v"), F.col("__n") * SLACK < 2, F.lit(False), F.lit(0)
    for i in range(len(shares)):
        low, high = F.col("__b")[i], F.col("__b")[len(shares) + i]
        among, passed = among | ((low <= v) & (v <= high)), passed + (high < v).cast("int")
    ranged = beside(rows, at_hand(ends)).select(*keys, "__n", "__v", (whole | among).alias("__in"), F.when(whole, 0).otherwise(passed).alias("__part"))
    counts = ranged.groupBy(*keys, "__n", "__in", "__part", F.when(F.col("__in"), v).alias("__cell")).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__low"))
    # ranges do not overlap, so their totals add up in the order of their least values
    totals = counts.groupBy(*keys, "__in", "__part").agg(F.sum("__c").alias("__t"), F.min("__low").alias("__first"))
    earlier = Window.partitionBy(*keys).orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__in").alias("__in_"), F.col("__part").alias("__part_"), F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__base"))
    upto = Window.partitionBy(*keys, "__in", "__part").orderBy("__low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = beside(counts.withColumn("__s", F.sum("__c").over(upto)), bases, "__in", "__part").withColumn("__upto", F.col("__base") + F.col("__s"))
    cells, n = [], F.max("__n")
    for share in shares:
        place = F.lit(share) * (F.col("__n") - 1)
        at = lambda i: F.max(F.when(F.col("__in") & (F.col("__upto") - F.col("__c") <= i) & (i < F.col("__upto")), F.col("__low")))
        low, high, place = at(F.floor(place)), at(F.ceil(place)), F.lit(share) * (n - 1)
        found = low + (place - F.floor(place)) * (high - low)
        cells.append(F.when(n > 0, F.coalesce(found, F.raise_error(F.lit("a quantile lies outside its range")).cast("double"))))
    return placed.groupBy(*keys).agg(F.coalesce(n, F.lit(0)).alias("n"), F.array(*cells).alias("q"))
