"""Normalisation and calibration of rewards: robust scales, squashing, quantile matching."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions.columns import clamp, finite, logit, normal_cdf, safe_div, sigmoid
from stepwright.operators.ordered import quantiles

EPS = 1e-6


def keeping_raw(df: DataFrame, column: str, mapped: Column) -> DataFrame:
    """df with the column replaced by mapped (cut to [EPS, 1 - EPS]) and its own values in raw_column."""
    return df.withColumns({f"raw_{column}": F.col(column), column: clamp(mapped, EPS, 1 - EPS)})


def robust_scale(df: DataFrame, value: str = "value", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Per key: median, scale and which one it is: 1.4826 MAD, else 0.7413 IQR, else the sample
    deviation, else 1."""
    v = F.col(value).cast("double")
    rows = df.where(finite(v)).select(*keys, v.alias("v"))
    first = quantiles(rows, "v", [0.25, 0.5, 0.75], keys)
    beside = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # noqa: E731  without keys one row
    centred = beside(rows, first.select(*keys, "q")).select(*keys, F.abs(F.col("v") - F.col("q")[1]).alias("v"))
    most = None if keys else first.first()["n"]
    mads = quantiles(centred, "v", [0.5], keys, most=most).select(*keys, F.col("q")[0].alias("mad"))
    spread = beside(beside(first, mads), rows.groupBy(*keys).agg(F.stddev_samp("v").alias("sd")))
    mad, iqr, sd = 1.4826 * F.col("mad"), 0.7413 * (F.col("q")[2] - F.col("q")[0]), F.coalesce("sd", F.lit(0.0))
    tiny = 1e-12
    return spread.select(
        *keys, "n", F.col("q")[1].alias("median"),
        F.when(mad > tiny, mad).when(iqr > tiny, iqr).when(sd > tiny, sd).otherwise(1.0).alias("scale"),
        F.when(mad > tiny, "mad").when(iqr > tiny, "iqr").when(sd > tiny, "std").otherwise("one").alias("kind"),
    )


def to_unit(z: Column, how: str = "sigmoid") -> Column:
    """A standardised value to (0, 1), by the logistic or the normal distribution function."""
    return sigmoid(z) if how == "sigmoid" else normal_cdf(z)


def normalize_tail(records: DataFrame, rewards: str, switch_at: int, z_clip: float = 6.0, how: str = "sigmoid", sign: int = 1) -> DataFrame:
    """rewards with its finite values from switch_at on mapped to (0, 1) by the robust scale of
    all such values; earlier ones stay. Adds norm_median, norm_scale and norm_kind."""
    tail = records.select(F.posexplode(rewards).alias("i", "value")).where(F.col("i") >= switch_at).withColumn("value", sign * F.col("value"))
    p = robust_scale(tail).select(F.col("median").alias("norm_median"), F.col("scale").alias("norm_scale"), F.col("kind").alias("norm_kind"))
    joined = records.join(F.broadcast(p))  # one row of parameters
    z = lambda v: clamp((sign * v - F.col("norm_median")) / F.col("norm_scale"), -z_clip, z_clip)
    return joined.withColumn(rewards, F.transform(rewards, lambda v, i: F.when((i >= switch_at) & finite(v), to_unit(z(v), how)).otherwise(v)))


def fit_zsig(df: DataFrame, value: str = "value") -> DataFrame:
    """mu and sd (population) of the finite values."""
    v = F.col(value).cast("double")
    return df.where(finite(v)).agg(F.avg(v).alias("mu"), F.greatest(F.stddev_pop(v), F.lit(EPS)).alias("sd"))


def zsig(v: Column, mu: Column, sd: Column, temperature: float = 1.0) -> Column:
    return clamp(sigmoid((v - mu) / sd / temperature), EPS, 1 - EPS)


def fit_logquant(df: DataFrame, value: str = "value", low: float = 0.05, high: float = 0.95, eps: float = 0.05) -> DataFrame:
    """a and b so that sigmoid(a (x - b)) takes the quantiles low and high to eps and 1 - eps."""
    v = F.col(value).cast("double")
    q = quantiles(df.where(finite(v)).select(v.alias("v")), "v", [low, high])
    reach = logit(F.lit(1 - eps))
    a = F.coalesce(safe_div(2 * reach, F.col("q")[1] - F.col("q")[0]), F.lit(1.0))
    return q.select(a.alias("a"), ((F.col("q")[0] + F.col("q")[1]) / 2).alias("b"))


def logquant(v: Column, a: Column, b: Column) -> Column:
    return clamp(sigmoid(a * (v - b)), EPS, 1 - EPS)


def fit_winsor(df: DataFrame, value: str = "value", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """lo and hi (quantiles), med and scale (1.4826 MAD) of the values cut to them."""
    v = F.col(value).cast("double")
    rows = df.where(finite(v)).select(v.alias("v"))
    n, ends = quantiles(rows, "v", [low, high]).first()
    lo, hi = (F.lit(x) for x in ends)
    cut = rows.select(F.least(F.greatest("v", lo), hi).alias("v"))
    med = F.lit(quantiles(cut, "v", [0.5], most=n).first()["q"][0])
    mad = quantiles(cut.select(F.abs(F.col("v") - med).alias("v")), "v", [0.5], most=n)
    return mad.select(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), med.cast("double").alias("med"), F.greatest(1.4826 * F.col("q")[0], F.lit(1e-12)).alias("scale"))


def winsor_z(v: Column, temperature: float = 1.0, squash: str | None = "sigmoid") -> Column:
    """Robust z of v cut to [lo, hi], over the columns of fit_winsor; squashed if asked."""
    z = (F.least(F.greatest(v, F.col("lo")), F.col("hi")) - F.col("med")) / F.col("scale") / temperature
    return z if squash is None else sigmoid(z) if squash == "sigmoid" else (F.tanh(z) + 1) / 2


def with_parameters(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """df beside a one-row table of fitted parameters."""
    return df.join(F.broadcast(parameters.limit(1)))


def fit_quantile_match(anchor: DataFrame, other: DataFrame, value: str = "value", low: float = 0.1, high: float = 0.9, most: float = 50.0) -> DataFrame:
    """a and b so that sigmoid(a x + b) takes the other's quantiles to the anchor's, on the logit
    scale; identity-like (1, 0) where the other's quantiles meet; both cut to +-most."""
    v = F.col(value).cast("double")
    p = quantiles(anchor.where(finite(v)).select(v.alias("v")), "v", [low, high]).select(F.col("q").alias("p"))
    q = quantiles(other.where(finite(v)).select(v.alias("v")), "v", [low, high]).select("q")
    top, bottom = logit(F.col("p")[1]), logit(F.col("p")[0])
    a = F.coalesce(safe_div(top - bottom, F.nullif(F.col("q")[1] - F.col("q")[0], F.lit(0.0))), F.lit(1.0))
    fitted = p.crossJoin(q).select(clamp(a, -most, most).alias("a"), "p", "q")
    b = F.when(F.col("q")[1] == F.col("q")[0], 0.0).otherwise(logit(F.col("p")[0]) - F.col("a") * F.col("q")[0])
    return fitted.select("a", clamp(b, -most, most).alias("b"))


def platt(df: DataFrame, score: str, label: str) -> DataFrame:
    """scale and bias of a logistic regression of the label on the score, with an L2 penalty of
    weight 1 over the number of rows; with labels of one class only scale is 0 and bias the logit
    of their smoothed share, (count + 1) / (n + 2)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.where(finite(F.col(score).cast("double")) & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("label"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return df.sparkSession.createDataFrame([(0.0, math.log((ones + 1) / (n - ones + 1)))], "scale double, bias double")
    data = VectorAssembler(inputCols=["s"], outputCol="features").transform(rows)
    model = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(data)
    return df.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "scale double, bias double")


def softmax_weights(df: DataFrame, score: str, keys: list[str], temperature: float = 1.0) -> DataFrame:
    """df with weight: softmax of the scores within a key; equal where no score is finite."""
    w = Window.partitionBy(*keys)
    s = F.when(finite(F.col(score).cast("double")), F.col(score).cast("double") / temperature)
    e = F.coalesce(F.exp(s - F.max(s).over(w)), F.lit(0.0))
    return df.withColumn("__e", e).withColumn("weight", F.coalesce(F.try_divide(F.col("__e"), F.nullif(F.sum("__e").over(w), F.lit(0.0))), 1 / F.count(F.lit(1)).over(w))).drop("__e")
