"""Aggregates over the step table: summaries, correlations, histograms, profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions.columns import finite, normal_cdf, safe_div
from stepwright.operators.ordered import bucket_of, quantile_bounds, quantiles, running


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Count and share of every label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(label, "n", safe_div(F.col("n"), F.col("total")).alias("share"))


def sign_counts(df: DataFrame, values: str) -> DataFrame:
    """df with n_plus and n_minus, and whether both signs occur, from an array of signs."""
    count = lambda s: F.size(F.filter(values, lambda v: v == s))
    return df.withColumns({"n_plus": count("+"), "n_minus": count("-")}).withColumn("both", (F.col("n_plus") > 0) & (F.col("n_minus") > 0))


def with_quantiles(rows: DataFrame, value: str, shares: dict[str, float], keys: list[str], aggregates: list[Column], small: bool) -> DataFrame:
    """The aggregates and named quantiles of the value per key.

    small: keys are many and the values of each fit a task; otherwise keys are few and their
    quantiles are read off running counts.
    """
    if small:
        found = rows.groupBy(*keys).agg(*aggregates, F.percentile(value, list(shares.values())).alias("__q"))
    elif keys:
        found = rows.groupBy(*keys).agg(*aggregates)
        parts = quantiles(rows, value, list(shares.values()), keys)
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__j{i}"))
        found = found.join(parts.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], F.col("q").alias("__q")), same)
    else:
        parts = quantiles(rows, value, list(shares.values())).select(F.col("q").alias("__q"))
        found = rows.agg(*aggregates).crossJoin(F.broadcast(parts))
    return found.withColumns({n: F.col("__q")[i] for i, n in enumerate(shares)}).drop("__q", *[f"__j{i}" for i in range(len(keys))])


def summary(df: DataFrame, value: str = "value", keys: list[str] = [], small: bool = False) -> DataFrame:  # noqa: B006
    """count, mean, std, var (sample), min, p05, p25, median, p75, p95, max per key; small: see with_quantiles."""
    shares = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    rows = df.where(finite(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("v"))
    aggregates = [F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.var_samp("v").alias("var"), F.min("v").alias("min"), F.max("v").alias("max")]
    return with_quantiles(rows, "v", shares, keys, aggregates, small)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the rows that have both; null where one of them is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def pivoted(steps: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("record_id", "step_idx")) -> DataFrame:
    """One row per step with a column per metric; only steps that have all of them."""
    return steps.groupBy(*keys).pivot("metric", metrics).agg(F.avg("value")).na.drop(subset=metrics)


def correlation_matrix(wide: DataFrame, metrics: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """a, b, r for every pair of columns, per key."""
    pairs = list(combinations(metrics, 2))
    row = wide.groupBy(*keys).agg(*[pearson(F.col(a), F.col(b)).alias(f"__{i}") for i, (a, b) in enumerate(pairs)], F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"__{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(*keys, "n", F.inline(cells))


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> list[Column]:
    """Lower and upper end of the confidence interval of a correlation, and its two-sided p value."""
    inner = F.when((F.abs(r) < 1) & (n > 3), r)
    half = F.lit(z) / F.sqrt(n - 3)
    p = 2 * (1 - normal_cdf(F.abs(F.atanh(inner)) * F.sqrt(n - 3)))
    return [F.tanh(F.atanh(inner) - half).alias("low"), F.tanh(F.atanh(inner) + half).alias("high"), p.alias("p")]


def meta_correlation(rows: DataFrame, r: str = "r", n: str = "n", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Fixed-effect mean of correlations, weighted by n - 3 on Fisher's scale."""
    ok = rows.where((F.col(n) >= 4) & (F.abs(r) < 1))
    w = (F.col(n) - 3).cast("double")
    mean = safe_div(F.sum(w * F.atanh(r)), F.sum(w))
    return ok.groupBy(*keys).agg(mean.alias("__z"), F.sum(w).alias("__w"), F.count(F.lit(1)).alias("n_records")).select(
        *keys, "n_records", F.tanh("__z").alias("r"),
        F.tanh(F.col("__z") - F.lit(1.959963984540054) / F.sqrt("__w")).alias("low"),
        F.tanh(F.col("__z") + F.lit(1.959963984540054) / F.sqrt("__w")).alias("high"),
    )


def correlation_summary(rows: DataFrame, r: str = "r", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean, median and shares above 0, 0.3, 0.5 and 0.7 of per-record correlations."""
    c = F.col(r)
    share = lambda t: F.avg((c > t).cast("double"))
    aggregates = [F.count(c).alias("n"), F.avg(c).alias("mean"), share(0.0).alias("above_0"), share(0.3).alias("above_3"), share(0.5).alias("above_5"), share(0.7).alias("above_7")]
    return with_quantiles(rows.where(c.isNotNull()), r, {"median": 0.5}, keys, aggregates, False)


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """Average rank of each different value of the column."""
    counts = df.where(finite(F.col(column).cast("double"))).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return running(counts, "v", ["c"]).select("v", (F.col("cum_c") - (F.col("c") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    both = df.where(finite(F.col(x).cast("double")) & finite(F.col(y).cast("double"))).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rx, ry = (average_ranks(both, c).select(F.col("v").alias(c), F.col("rank").alias(f"r{c}")) for c in "xy")
    return both.join(rx, "x").join(ry, "y").agg(pearson(F.col("rx"), F.col("ry")).alias("rho"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Kendall's tau-b and n over all rows that have both; tau is NaN where one is constant.

    Rows are counted per (x, y). y becomes its place among the different values, and each pair of
    unlike places is met once: at the highest bit where they differ, among the rows that share the
    bits above. There x's running sums of zeros and ones count concordant and discordant pairs.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    values = cells.select("y").distinct().withColumn("one", F.lit(1).cast("long"))
    levels = max(1, (values.count() - 1).bit_length())
    placed = cells.join(running(values, "y", ["one"]).select("y", (F.col("cum_one") - 1).alias("place")), "y")
    at = lambda n: F.call_function("shiftright", F.col("place"), n)
    bits = placed.select("x", "c", "place", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    bit = at(F.col("level")).bitwiseAND(F.lit(1).cast("long"))
    sums = bits.groupBy("level", at(F.col("level") + 1).alias("above"), "x").agg(F.sum(F.when(bit == 0, F.col("c")).otherwise(0)).alias("lo"), F.sum(F.when(bit == 1, F.col("c")).otherwise(0)).alias("hi"))
    keys = ["level", "above"]
    sums = sums.withColumn("part", bucket_of(F.col("x"), quantile_bounds(cells, "x")))
    bases = sums.groupBy(*keys, "part").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select(*keys, "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"base_{c}") for c in ("lo", "hi")])
    within = Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: (F.col(f"base_{c}") + F.col(f"in_{c}")).cast("decimal(19,0)")
    sums = sums.withColumns({f"in_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in ("lo", "hi")}).join(bases, [*keys, "part"])
    gain = F.col("hi").cast("decimal(18,0)") * before("lo") - F.col("lo").cast("decimal(18,0)") * before("hi")
    score = sums.agg(F.coalesce(F.sum(gain).cast("double"), F.lit(0.0)).alias("score"))

    c = F.col("c").cast("decimal(18,0)")
    tied = F.coalesce(F.sum(c * (c - 1)).cast("double") / 2, F.lit(0.0))
    ties = [cells.groupBy(v).agg(F.sum("c").alias("c")).agg(tied.alias(f"ties_{v}")) for v in "xy"]
    n = F.col("n").cast("double")
    base = F.sqrt((n * (n - 1) / 2 - F.col("ties_x")) * (n * (n - 1) / 2 - F.col("ties_y")))
    one = score.crossJoin(cells.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"))).crossJoin(ties[0]).crossJoin(ties[1])
    return one.select(F.when(base > 0, F.try_divide(F.col("score"), base)).otherwise(F.lit(float("nan"))).alias("tau"), "n")


def flat_info(df: DataFrame, value: str = "value", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean, population deviation (1e-6 at least) and quartiles of all finite values."""
    rows = df.where(finite(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("v"))
    aggregates = [F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(1e-6)).alias("std"), F.min("v").alias("min"), F.max("v").alias("max")]
    return with_quantiles(rows, "v", {"p25": 0.25, "median": 0.5, "p75": 0.75}, keys, aggregates, False)


def class_weights(df: DataFrame, label: str, most: float = float("inf")) -> DataFrame:
    """Weight of positives (negatives over positives), their share, the effective share and the bias."""
    pos, n = F.count_if(F.col(label) == 1), F.count(label)
    weight = F.least(safe_div(n - pos, pos), F.lit(most))
    out = df.agg(pos.alias("n_pos"), (n - pos).alias("n_neg"), weight.alias("pos_weight"), safe_div(pos, n).alias("share"))
    q = safe_div(F.col("pos_weight") * F.col("share"), F.col("pos_weight") * F.col("share") + 1 - F.col("share"))
    return out.withColumn("effective", q).withColumn("bias", F.log(safe_div(F.col("effective"), 1 - F.col("effective"))))


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """Counts, density and share of the largest bin, over equal bins that all classes share."""
    rows = df.where(finite(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"), *([by] if by else []))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(*keys, place.alias("bin"), "lo", width.alias("width")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return counts.select(
        *keys, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"), "n",
        safe_div(F.col("n"), F.sum("n").over(w) * F.col("width")).alias("density"), safe_div(F.col("n"), F.max("n").over(w)).alias("height"),
    )


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Share of values at or below each different one."""
    counts = df.where(finite(F.col(value).cast("double"))).groupBy(F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    return running(counts, "value", ["c"]).crossJoin(F.broadcast(total)).select("value", safe_div(F.col("cum_c"), F.col("n")).alias("share"))


def running_median(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Median of y in equal bins of x; rows without y count in n."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col(x) - F.col("lo"), (F.col("hi") - F.col("lo")) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    binned = df.crossJoin(F.broadcast(ends)).select(place.alias("bin"), F.col(y).cast("double").alias("y"))
    return with_quantiles(binned, "y", {"median": 0.5}, ["bin"], [F.count(F.lit(1)).alias("n")], False)


def hexagon_counts(df: DataFrame, x: str, y: str, across: int = 50) -> DataFrame:
    """Counts on a grid of hexagons, so many across the range of x: column, row and shifted (rows
    of the grid that lie half a cell aside), with n. Both grids' nearest centres are compared."""
    rows = df.where(finite(F.col(x).cast("double")) & finite(F.col(y).cast("double"))).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    down = max(1, round(across / 3**0.5))
    ends = rows.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    u = F.coalesce(F.try_divide((F.col("x") - F.col("lx")) * across, F.col("hx") - F.col("lx")), F.lit(0.0))
    v = F.coalesce(F.try_divide((F.col("y") - F.col("ly")) * down, F.col("hy") - F.col("ly")), F.lit(0.0))
    placed = rows.crossJoin(F.broadcast(ends)).select(u.alias("u"), v.alias("v"))
    placed = placed.select("*", F.floor(F.col("u") + 0.5).alias("c0"), F.floor(F.col("v") + 0.5).alias("r0"), F.floor("u").alias("c1"), F.floor("v").alias("r1"))
    near = (F.col("u") - F.col("c0")) ** 2 + 3 * (F.col("v") - F.col("r0")) ** 2
    aside = (F.col("u") - F.col("c1") - 0.5) ** 2 + 3 * (F.col("v") - F.col("r1") - 0.5) ** 2
    shifted = near >= aside
    cell = lambda a, b: F.when(shifted, F.col(b)).otherwise(F.col(a))
    return placed.groupBy(cell("c0", "c1").alias("column"), cell("r0", "r1").alias("row"), shifted.alias("shifted")).agg(F.count(F.lit(1)).alias("n"))


def switch_mix(records: DataFrame, n_steps: str, switches: list[int]) -> DataFrame:
    """For each switch: steps before and from it, over all records, and their shares."""
    n = F.col(n_steps)
    cells = [F.struct(F.lit(s).alias("switch"), F.sum(F.least(n, F.lit(s))).cast("long").alias("before"), F.sum(F.greatest(n - s, F.lit(0))).cast("long").alias("after")) for s in switches]
    rows = records.agg(F.sum(n).cast("long").alias("total"), F.array(*cells).alias("cells")).select("total", F.inline("cells"))
    return rows.withColumns({"before_share": safe_div(F.col("before"), F.col("total")), "after_share": safe_div(F.col("after"), F.col("total"))})


def profile_filter(events: DataFrame, tag: str = "tag", prefix: str | None = None, contains: str | None = None, **fields: str) -> DataFrame:
    """Records whose tag begins with prefix, whose tag holds contains, and whose fields (columns, or
    entries of the column meta) have these values."""
    rows = events if prefix is None else events.where(F.startswith(tag, F.lit(prefix)))
    rows = rows if contains is None else rows.where(F.contains(tag, F.lit(contains)))
    for name, value in fields.items():
        field = F.col(name) if name in events.columns else F.try_element_at("meta", F.lit(name))
        rows = rows.where(field == F.lit(value))
    return rows


def profile_rollup(events: DataFrame, tag: str = "tag") -> DataFrame:
    """Per tag: calls, prompts, samples (prompts times n), seconds, tokens, peak memory, tokens a second."""
    return events.groupBy(tag).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("num_prompts").alias("prompts"), F.sum(F.col("num_prompts") * F.col("n")).alias("samples"),
        F.sum("wall_s").alias("wall_s"), F.sum("gen_tokens").alias("tokens"), F.max("peak_mem_gb").alias("peak_mem_gb"),
    ).withColumn("tokens_per_s", safe_div(F.col("tokens"), F.col("wall_s")))


def running_accuracy(df: DataFrame, order: str, correct: str, every: int, keys: list[str]) -> DataFrame:
    """Accuracy in percent of the first m rows of each key, for m in steps of every."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"seen": F.row_number().over(w), "accuracy": 100 * F.avg(F.col(correct).cast("double")).over(w)})
    return rows.where(F.col("seen") % every == 0).select(*keys, "seen", "accuracy")


def efficiency(cost: Column, base: Column) -> Column:
    """Cost as a percentage of a base cost."""
    return 100 * safe_div(cost, base)
