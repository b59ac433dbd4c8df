"""Registered queries: each applies operators to the driver's tables, beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions import answers as A
from stepwright.functions import columns as C
from stepwright.functions import text as X
from stepwright.operators import match, metrics, negatives, normalize, rewards, select, stats, steps
from stepwright.plans import views as V
from stepwright.plans.views import SQL_VIEWS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query under its name; sql may use the named views."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            parts = [SQL_VIEWS[v] for v in views]
            body = sql.strip()
            if parts:
                body = "WITH " + ",\n".join(parts) + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)
            SQL[f.__name__] = body
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that orders of summation do not show."""
    return df.withColumns({n: F.round(n, digits) for n, t in df.dtypes if t == "double"})


# -- the step table ----------------------------------------------------------------------------


@query("""SELECT 'score' AS metric, count(*) AS n, round(avg(label), 6) AS positive_share,
    round((SELECT (sum(CASE WHEN p.label = 1 AND q.label <> 1 THEN CASE WHEN p.z > q.z THEN 1.0 WHEN p.z = q.z THEN 0.5 ELSE 0 END END))
        / sum(CASE WHEN p.label = 1 AND q.label <> 1 THEN 1 END) FROM lab2 p, lab2 q), 6) AS auc,
    round(avg(1 / (1 + exp(-z))), 6) AS mean_unit FROM lab2""".replace("SELECT 'score'", """WITH med AS (SELECT median(score) AS m FROM lab),
    scale AS (SELECT m, 1.4826 * median(abs(score - m)) AS s FROM lab, med GROUP BY m),
    lab2 AS (SELECT label, greatest(-6, least(6, (score - m) / s)) AS z FROM lab, scale)
    SELECT 'score'""", 1), "lab")
def step_reward_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust normalisation of a score and how well it tells the labels apart."""
    rows = V.labelled(spark, sf_dir)
    p = normalize.robust_scale(rows, "score")
    z = C.clamp((F.col("score") - F.col("median")) / F.col("scale"), -6.0, 6.0)
    unit = rows.join(F.broadcast(p)).select("label", z.alias("z"))
    flat = unit.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("positive_share"), F.avg(C.sigmoid(F.col("z"))).alias("mean_unit"))
    return rounded(flat.join(metrics.roc_auc(unit, "z", "label").select("auc"))).select(F.lit("score").alias("metric"), "n", "positive_share", "auc", "mean_unit")


@query("SELECT record_id, step_idx, round(value, 6) AS value, 1 - error AS correct FROM ev", "ev")
def step_view(spark, sf_dir):
    return rounded(V.event_steps(spark, sf_dir).select("record_id", "step_idx", "value", (1 - F.col("error")).alias("correct")))


@query("""SELECT record_id, step_idx, 'price' AS metric, price AS value, 1 - error AS correct FROM li
    UNION ALL SELECT record_id, step_idx, 'tax', tax, 1 - error FROM li""", "li")
def unpivot_metrics(spark, sf_dir):
    records = V.line_records(spark, sf_dir).withColumn("ok", F.transform("error", lambda e: 1 - e))
    return steps.step_table(records, "record_id", {"price": "price", "tax": "tax"}, "ok")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def label_counts(spark, sf_dir):
    return rounded(stats.label_counts(table(spark, sf_dir, "events"), "event_type"))


@query("""SELECT record_id, CAST(count(*) FILTER (error = 0) AS INTEGER) AS n_plus, CAST(count(*) FILTER (error = 1) AS INTEGER) AS n_minus,
    min(error) <> max(error) AS both FROM li GROUP BY 1""", "li")
def plus_minus_counts(spark, sf_dir):
    signs = F.transform("error", lambda e: F.when(e == 1, "-").otherwise("+"))
    return stats.sign_counts(V.line_records(spark, sf_dir).select("record_id", signs.alias("signs")), "signs").drop("signs")


SUMMARY = """count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(var_samp(v), 3) AS var, round(min(v), 6) AS min,
    round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median,
    round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max"""


@query(f"SELECT metric, {SUMMARY} FROM (SELECT metric, v FROM li UNPIVOT (v FOR metric IN (price, quantity, discount, tax))) GROUP BY 1", "li")
def global_summary(spark, sf_dir):
    return rounded(stats.summary(V.in_long_form(V.line_values(spark, sf_dir)), keys=["metric"]).withColumn("var", F.round("var", 3)))


@query(f"SELECT record_id, {SUMMARY} FROM (SELECT record_id, value AS v FROM ev) GROUP BY 1", "ev")
def per_sample_summary(spark, sf_dir):
    return rounded(stats.summary(V.event_steps(spark, sf_dir), keys=["record_id"], small=True).withColumn("var", F.round("var", 3)))


@query(f"SELECT step_idx, {SUMMARY} FROM (SELECT step_idx, value AS v FROM ev) GROUP BY 1", "ev")
def per_step_summary(spark, sf_dir):
    return rounded(stats.summary(V.event_steps(spark, sf_dir), keys=["step_idx"]).withColumn("var", F.round("var", 3)))


@query("""SELECT 'price' AS a, 'quantity' AS b, round(corr(price, quantity), 6) AS r, count(*) AS n FROM li
    UNION ALL SELECT 'price', 'discount', round(corr(price, discount), 6), count(*) FROM li
    UNION ALL SELECT 'quantity', 'discount', round(corr(quantity, discount), 6), count(*) FROM li""", "li")
def pivot_corr(spark, sf_dir):
    names = ["price", "quantity", "discount"]
    wide = stats.pivoted(V.line_metrics(spark, sf_dir).where(F.col("metric").isin(names)), names)
    return rounded(stats.correlation_matrix(wide, names)).select("a", "b", "r", "n")


RECORD_R = """rr AS (SELECT record_id, count(*) AS n, covar_pop(price, quantity) / nullif(stddev_pop(price) * stddev_pop(quantity), 0) AS r FROM li GROUP BY 1)"""


@query(f"WITH {RECORD_R} SELECT record_id, n, 'price' AS a, 'quantity' AS b, round(r, 6) AS r FROM rr", "li")
def per_sample_corr(spark, sf_dir):
    return rounded(stats.correlation_matrix(V.line_values(spark, sf_dir), ["price", "quantity"], ["record_id"]))


@query("""SELECT step_idx, count(*) AS n, 'price' AS a, 'quantity' AS b,
    round(covar_pop(price, quantity) / nullif(stddev_pop(price) * stddev_pop(quantity), 0), 6) AS r FROM li GROUP BY 1""", "li")
def per_step_pearson(spark, sf_dir):
    return rounded(stats.correlation_matrix(V.line_steps(spark, sf_dir), ["price", "quantity"], ["step_idx"]))


@query(f"""WITH {RECORD_R}, z AS (SELECT sum((n - 3) * atanh(r)) / sum(n - 3) AS z, sum(n - 3) AS w, count(*) AS n_records FROM rr WHERE n >= 4 AND abs(r) < 1)
    SELECT n_records, round(tanh(z), 6) AS r, round(tanh(z - 1.959963984540054 / sqrt(w)), 6) AS low, round(tanh(z + 1.959963984540054 / sqrt(w)), 6) AS high FROM z""", "li")
def fisher_meta(spark, sf_dir):
    return rounded(stats.meta_correlation(stats.correlation_matrix(V.line_values(spark, sf_dir), ["price", "quantity"], ["record_id"])))


@query("""WITH c AS (SELECT step_idx, count(*) AS n, corr(price, quantity) AS r FROM li GROUP BY 1 HAVING count(*) > 3)
    SELECT step_idx, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM c WHERE abs(r) < 1""", "li")
def fisher_intervals(spark, sf_dir):
    rows = stats.correlation_matrix(V.line_steps(spark, sf_dir), ["price", "quantity"], ["step_idx"])
    low, high, _ = stats.fisher_interval(F.col("r"), F.col("n"))
    return rounded(rows.select("step_idx", low, high).where("low is not null"))


@query(f"""WITH {RECORD_R} SELECT count(r) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 6) AS above_0,
    round(avg(CASE WHEN r > 0.3::DOUBLE THEN 1.0 ELSE 0 END), 6) AS above_3, round(avg(CASE WHEN r > 0.5::DOUBLE THEN 1.0 ELSE 0 END), 6) AS above_5,
    round(avg(CASE WHEN r > 0.7::DOUBLE THEN 1.0 ELSE 0 END), 6) AS above_7 FROM rr WHERE r IS NOT NULL""", "li")
def correlation_summary(spark, sf_dir):
    return rounded(stats.correlation_summary(stats.correlation_matrix(V.line_values(spark, sf_dir), ["price", "quantity"], ["record_id"])))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS x,
    rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0 AS y FROM li) SELECT round(corr(x, y), 6) AS rho FROM r""", "li")
def spearman(spark, sf_dir):
    return rounded(stats.spearman(V.line_values(spark, sf_dir), "price", "quantity"))


@query("""WITH r AS (SELECT row_number() OVER () AS i, score, label FROM lab WHERE score IS NOT NULL AND label IS NOT NULL),
    s AS (SELECT sum(sign(p.score - q.score) * sign(p.label - q.label)) AS s, count(*) AS pairs, count(*) FILTER (p.score = q.score) AS tx, count(*) FILTER (p.label = q.label) AS ty FROM r p JOIN r q ON p.i < q.i)
    SELECT round(s / sqrt((pairs - tx)::DOUBLE * (pairs - ty)), 6) AS tau, (SELECT count(*) FROM r) AS n FROM s""", "lab")
def kendall(spark, sf_dir):
    return rounded(stats.kendall(V.labelled(spark, sf_dir), "score", "label"))


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-6), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
    round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max FROM events GROUP BY 1""")
def flat_info(spark, sf_dir):
    return rounded(stats.flat_info(table(spark, sf_dir, "events"), keys=["event_type"]))


@query("""SELECT metric, record_id, step_idx, value, correct FROM (SELECT record_id, step_idx, metric, value, 1 - error AS correct FROM li UNPIVOT (value FOR metric IN (price, quantity, discount, tax)))
    WHERE NOT (metric = 'price' AND (value < 1000 OR value > 50000)) AND NOT (metric = 'quantity' AND value > 40)""", "li")
def outlier_bounds_join(spark, sf_dir):
    bounds = spark.createDataFrame([("price", 1000.0, 50000.0), ("quantity", None, 40.0)], "metric string, lo double, hi double")
    return steps.filter_outliers(V.line_metrics(spark, sf_dir), bounds).select("metric", "record_id", "step_idx", "value", "correct")


@query("""WITH k AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n_before FROM li)
    SELECT record_id, list(price ORDER BY step_idx) AS price, list(answer ORDER BY step_idx) AS answer, CAST(any_value(n_before) AS INTEGER) AS n_before, CAST(count(*) AS INTEGER) AS n_after
    FROM k WHERE price BETWEEN 2000 AND 40000 GROUP BY 1""", "li")
def step_filter_compact(spark, sf_dir):
    kept = steps.filter_steps(V.line_records(spark, sf_dir), "price", ["answer"], low=2000.0, high=40000.0)
    return kept.select("record_id", "price", "answer", "n_before", "n_after")


# -- normalisation -----------------------------------------------------------------------------


@query("""WITH m AS (SELECT event_type, median(value) AS median FROM events GROUP BY 1)
    SELECT event_type, count(*) AS n, round(any_value(median), 6) AS median, round(1.4826 * median(abs(value - median)), 6) AS scale, 'mad' AS kind FROM events JOIN m USING (event_type) GROUP BY 1""")
def robust_scale(spark, sf_dir):
    return rounded(normalize.robust_scale(table(spark, sf_dir, "events"), "value", ["event_type"]))


TAIL = """m AS (SELECT median({s} * value) AS m FROM ev WHERE step_idx >= 2), s AS (SELECT m, 1.4826 * median(abs({s} * value - m)) AS s FROM ev, m WHERE step_idx >= 2 GROUP BY m)
    SELECT record_id, step_idx, round(CASE WHEN step_idx >= 2 THEN 1 / (1 + exp(-greatest(-6, least(6, ({s} * value - m) / s)))) ELSE value END, 6) AS value FROM ev, s"""


def tail(spark, sf_dir, sign):
    rows = normalize.normalize_tail(V.event_records(spark, sf_dir), "value", 2, sign=sign)
    return rounded(rows.select("record_id", F.posexplode("value").alias("step_idx", "value")))


@query("WITH " + TAIL.format(s="1"), "ev")
def tail_normalize(spark, sf_dir):
    return tail(spark, sf_dir, 1)


@query("WITH " + TAIL.format(s="-1"), "ev")
def sign_flip_normalize(spark, sf_dir):
    return tail(spark, sf_dir, -1)


@query("""WITH p AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM ev)
    SELECT record_id, step_idx, round(greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(value - mu) / sd)))), 6) AS value FROM ev, p""", "ev")
def zsig(spark, sf_dir):
    rows = V.event_steps(spark, sf_dir)
    return rounded(normalize.with_parameters(rows, normalize.fit_zsig(rows)).select("record_id", "step_idx", normalize.zsig(F.col("value"), F.col("mu"), F.col("sd")).alias("value")))


@query("""WITH q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM ev), p AS (SELECT 2 * ln(0.95::DOUBLE / 0.05::DOUBLE) / (hi - lo) AS a, (lo + hi) / 2 AS b FROM q)
    SELECT record_id, step_idx, round(greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-a * (value - b))))), 6) AS value FROM ev, p""", "ev")
def logquant(spark, sf_dir):
    rows = V.event_steps(spark, sf_dir)
    return rounded(normalize.with_parameters(rows, normalize.fit_logquant(rows)).select("record_id", "step_idx", normalize.logquant(F.col("value"), F.col("a"), F.col("b")).alias("value")))


WINSOR = """q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM ev), c AS (SELECT record_id, step_idx, greatest(lo, least(hi, value)) AS v FROM ev, q),
    m AS (SELECT median(v) AS med FROM c), s AS (SELECT med, 1.4826 * median(abs(v - med)) AS s FROM c, m GROUP BY med)"""


def winsor(spark, sf_dir, squash):
    rows = V.event_steps(spark, sf_dir)
    return rounded(normalize.with_parameters(rows, normalize.fit_winsor(rows)).select("record_id", "step_idx", normalize.winsor_z(F.col("value"), squash=squash).alias("value")))


@query(f"WITH {WINSOR} SELECT record_id, step_idx, round((v - med) / s, 6) AS value FROM c, s", "ev")
def winsor_z(spark, sf_dir):
    return winsor(spark, sf_dir, None)


@query(f"WITH {WINSOR} SELECT record_id, step_idx, round((tanh((v - med) / s) + 1) / 2, 6) AS value FROM c, s", "ev")
def winsor_z_tanh(spark, sf_dir):
    return winsor(spark, sf_dir, "tanh")


@query(f"WITH {WINSOR} SELECT record_id, step_idx, round(1 / (1 + exp(-(v - med) / s)), 6) AS value FROM c, s", "ev")
def winsor_z_sigmoid(spark, sf_dir):
    return winsor(spark, sf_dir, "sigmoid")


@query("""WITH p AS (SELECT quantile_cont(error_share, 0.1) AS lo, quantile_cont(error_share, 0.9) AS hi FROM (SELECT avg(discount) * 5 AS error_share FROM li GROUP BY record_id)),
    q AS (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM (SELECT avg(tax) AS value FROM li GROUP BY record_id)),
    c AS (SELECT least(1 - 1e-6, greatest(1e-6, p.lo)) AS plo, least(1 - 1e-6, greatest(1e-6, p.hi)) AS phi, q.lo, q.hi FROM p, q),
    a AS (SELECT *, greatest(-50, least(50, (ln(phi / (1 - phi)) - ln(plo / (1 - plo))) / (hi - lo))) AS a FROM c)
    SELECT round(a, 6) AS a, round(greatest(-50, least(50, ln(plo / (1 - plo)) - a * lo)), 6) AS b FROM a""", "li")
def quantile_sigmoid_calibration(spark, sf_dir):
    rows = V.line_values(spark, sf_dir).groupBy("record_id").agg((F.avg("discount") * 5).alias("anchor"), F.avg("tax").alias("other"))
    return rounded(normalize.fit_quantile_match(rows.select(F.col("anchor").alias("value")), rows.select(F.col("other").alias("value"))))


NEWTON = """, n{i} AS MATERIALIZED (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
    SELECT a, b, sum((p - y) * s) + a AS ga, sum(p - y) AS gb, sum(p * (1 - p) * s * s) + 1 AS haa, sum(p * (1 - p) * s) AS hab, sum(p * (1 - p)) AS hbb
    FROM (SELECT a, b, s, y, 1 / (1 + exp(-(a * s + b))) AS p FROM d, n{j}) GROUP BY a, b))"""


@query("WITH d AS (SELECT value / 100 AS s, error AS y FROM ev), n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)" + "".join(NEWTON.format(i=i, j=i - 1) for i in range(1, 13)) + " SELECT round(a, 4) AS scale, round(b, 4) AS bias FROM n12", "ev")
def platt_scaling(spark, sf_dir):
    return rounded(normalize.platt(V.event_steps(spark, sf_dir).withColumn("score", F.col("value") / 100), "score", "error"), 4)


@query("""WITH m AS (SELECT *, max(price / 10000) OVER (PARTITION BY record_id) AS top FROM li)
    SELECT record_id, step_idx, round(exp(price / 10000 - top) / sum(exp(price / 10000 - top)) OVER (PARTITION BY record_id), 6) AS weight FROM m""", "li")
def softmax_weights(spark, sf_dir):
    return rounded(normalize.softmax_weights(V.line_steps(spark, sf_dir), "price", ["record_id"], 10000.0).select("record_id", "step_idx", "weight"))


@query("""SELECT record_id, round(avg(price), 7) AS mean, round(arg_max(price, step_idx), 7) AS last, round(sum(price), 7) AS sum, round(median(price), 7) AS median FROM li GROUP BY 1""", "li")
def pooling(spark, sf_dir):
    rows = V.line_records(spark, sf_dir)
    return rounded(rows.select("record_id", *[C.pool(F.col("price"), h).alias(h) for h in ("mean", "last", "sum", "median")]), 7)


# -- first errors and thresholds ---------------------------------------------------------------

RUNS = """r AS (SELECT *, {cond} AS bad FROM ev), f AS (SELECT record_id, step_idx, bad {ahead} AS run FROM r),
    pred AS (SELECT record_id, coalesce(min(CASE WHEN run THEN step_idx END), -1) AS predicted FROM f GROUP BY 1)"""
AHEAD = "AND coalesce(lead(bad, {n}) OVER (PARTITION BY record_id ORDER BY step_idx), false)"


def first_error_sql(patience: int, cond: str = "value <= 50") -> str:
    return RUNS.format(cond=cond, ahead=" ".join(AHEAD.format(n=n) for n in range(1, patience)))


def first_error(spark, sf_dir, patience, bad):
    return metrics.first_error(V.event_steps(spark, sf_dir), "record_id", "step_idx", bad, patience)


@query(f"WITH {first_error_sql(1)} SELECT * FROM pred", "ev")
def first_error_p1(spark, sf_dir):
    return first_error(spark, sf_dir, 1, F.col("value") <= 50)


@query(f"WITH {first_error_sql(2)} SELECT * FROM pred", "ev")
def first_error_p2(spark, sf_dir):
    return first_error(spark, sf_dir, 2, F.col("value") <= 50)


@query(f"WITH {first_error_sql(3)} SELECT * FROM pred", "ev")
def first_error_p3(spark, sf_dir):
    rows = V.event_records(spark, sf_dir)
    return rows.select("record_id", metrics.first_error_array(F.col("value"), 50.0, 3).alias("predicted"))


@query(f"WITH {first_error_sql(2, '1 - value / 500 <= 0.2')} SELECT * FROM pred", "ev")
def first_error_inverted(spark, sf_dir):
    return first_error(spark, sf_dir, 2, 1 - F.col("value") / 500 <= 0.2)


PAIRS = f"""WITH {first_error_sql(1, 'value <= 30')}, gold AS (SELECT record_id, coalesce(min(CASE WHEN error = 1 THEN step_idx END), -1) AS gold FROM ev GROUP BY 1),
    p AS (SELECT * FROM pred JOIN gold USING (record_id))"""


def predicted_pairs(spark, sf_dir):
    return first_error(spark, sf_dir, 1, F.col("value") <= 30).join(V.gold_errors(spark, sf_dir), "record_id")


@query(PAIRS + """, s AS (SELECT avg(CASE WHEN gold <> -1 THEN CAST(predicted = gold AS INT) END) AS error_acc, avg(CASE WHEN gold = -1 THEN CAST(predicted = gold AS INT) END) AS correct_acc FROM p)
    SELECT round(error_acc, 6) AS error_acc, round(correct_acc, 6) AS correct_acc,
    round(coalesce(2 * coalesce(error_acc, 0) * coalesce(correct_acc, 0) / nullif(coalesce(error_acc, 0) + coalesce(correct_acc, 0), 0), 0), 6) AS f1 FROM s""", "ev")
def first_error_metrics(spark, sf_dir):
    return rounded(metrics.first_error_scores(predicted_pairs(spark, sf_dir)))


@query(PAIRS + """ SELECT round(avg(abs(predicted - gold)), 6) AS mae, round(median(abs(predicted - gold)), 6) AS median_ae,
    round(avg(CASE WHEN abs(predicted - gold) <= 1 THEN 1.0 ELSE 0 END), 6) AS within_1, round(avg(CASE WHEN abs(predicted - gold) <= 2 THEN 1.0 ELSE 0 END), 6) AS within_2 FROM p WHERE gold <> -1""", "ev")
def localization(spark, sf_dir):
    return rounded(metrics.localization(predicted_pairs(spark, sf_dir)))


SHARES = ", ".join(f"{0.05 + 0.9 * i / 36!r}" for i in range(37))


@query(f"SELECT DISTINCT round(unnest(quantile_cont(value, [{SHARES}])), 6) AS threshold FROM ev UNION SELECT 0.0", "ev")
def threshold_candidates(spark, sf_dir):
    return rounded(metrics.threshold_candidates(V.event_steps(spark, sf_dir), "value")).distinct()


@query("""WITH t AS (SELECT unnest([20.0, 60.0, 120.0, 250.0]::DOUBLE[]) AS threshold), gold AS (SELECT record_id, coalesce(min(CASE WHEN error = 1 THEN step_idx END), -1) AS gold FROM ev GROUP BY 1),
    pat AS (SELECT unnest([1, 2]) AS patience),
    r AS (SELECT record_id, step_idx, threshold, value <= threshold AS bad, coalesce(lead(value <= threshold) OVER (PARTITION BY record_id, threshold ORDER BY step_idx), false) AS nxt FROM ev, t),
    pred AS (SELECT record_id, threshold, patience, coalesce(min(CASE WHEN bad AND (patience = 1 OR nxt) THEN step_idx END), -1) AS predicted FROM r, pat GROUP BY 1, 2, 3),
    s AS (SELECT patience, threshold, avg(CASE WHEN gold <> -1 THEN CAST(predicted = gold AS INT) END) AS e, avg(CASE WHEN gold = -1 THEN CAST(predicted = gold AS INT) END) AS c FROM pred JOIN gold USING (record_id) GROUP BY 1, 2)
    SELECT patience, threshold, round(e, 6) AS error_acc, round(c, 6) AS correct_acc, round(coalesce(2 * coalesce(e, 0) * coalesce(c, 0) / nullif(coalesce(e, 0) + coalesce(c, 0), 0), 0), 6) AS f1 FROM s""", "ev")
def threshold_grid(spark, sf_dir):
    thresholds = spark.createDataFrame([(20.0,), (60.0,), (120.0,), (250.0,)], "threshold double")
    return rounded(metrics.tune_first_error(V.event_steps(spark, sf_dir), "record_id", "step_idx", "value", V.gold_errors(spark, sf_dir), thresholds, (1, 2)))


TUNE = """q AS (SELECT {k} quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi, sum(error) AS wrong, count(*) AS n FROM src {g}),
    t AS (SELECT {k} i, lo + i * (hi - lo) / 199 AS threshold, wrong, inverted FROM q, (SELECT unnest(range(200)) AS i), (SELECT unnest([false, true]) AS inverted)),
    c AS (SELECT {tk} i, threshold, inverted, any_value(wrong) AS wrong, count(*) FILTER (CASE WHEN inverted THEN price >= threshold ELSE price <= threshold END) AS f,
        count(*) FILTER (error = 1 AND CASE WHEN inverted THEN price >= threshold ELSE price <= threshold END) AS h FROM t JOIN src {on} GROUP BY ALL),
    e AS (SELECT {k} i, threshold, inverted, h / (f + 1e-8::DOUBLE) AS p, h / (wrong + 1e-8::DOUBLE) AS r FROM c),
    o AS (SELECT *, row_number() OVER ({part} ORDER BY round(2 * p * r / (p + r + 1e-8::DOUBLE), 12) DESC, inverted, i) AS place FROM e)
    SELECT {k} round(threshold, 6) AS threshold, inverted, round(2 * p * r / (p + r + 1e-8::DOUBLE), 6) AS error_f1 FROM o WHERE place = 1"""


@query("WITH src AS (SELECT price, error FROM li), " + TUNE.format(k="", g="", tk="", on="ON true", part=""), "li")
def tune_error_f1(spark, sf_dir):
    return rounded(metrics.tune_error_f1(V.line_values(spark, sf_dir), "price", "error"))


CATEGORY = "src AS (SELECT o_orderpriority, price, error FROM li JOIN orders ON record_id = o_orderkey)"


def categories(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderpriority")
    return V.line_values(spark, sf_dir).join(orders, "record_id")


@query(f"WITH {CATEGORY}, " + TUNE.format(k="o_orderpriority,", g="GROUP BY 1", tk="o_orderpriority,", on="USING (o_orderpriority)", part="PARTITION BY o_orderpriority"), "li")
def category_tuning(spark, sf_dir):
    return rounded(metrics.tune_error_f1(categories(spark, sf_dir), "price", "error", keys=["o_orderpriority"]))


@query(f"""WITH {CATEGORY}, c AS (SELECT o_orderpriority, count(*) AS n, sum(error) AS wrong, count(*) FILTER (price <= 20000) AS flag, count(*) FILTER (price <= 20000 AND error = 1) AS hits,
        count(*) FILTER (price > 20000 AND error = 0) AS passes FROM src GROUP BY 1),
    f AS (SELECT *, hits / (flag + 1e-8::DOUBLE) AS p, hits / (wrong + 1e-8::DOUBLE) AS r, passes / (n - flag + 1e-8::DOUBLE) AS p2, passes / (n - wrong + 1e-8::DOUBLE) AS r2 FROM c)
    SELECT o_orderpriority, n, round((hits + passes) / n, 6) AS accuracy, round(2 * p * r / (p + r + 1e-8::DOUBLE), 6) AS error_f1, round(2 * p2 * r2 / (p2 + r2 + 1e-8::DOUBLE), 6) AS correct_f1,
    round(hits / wrong, 6) AS error_accuracy, round(passes / (n - wrong), 6) AS correct_accuracy FROM f""", "li")
def category_metrics(spark, sf_dir):
    return rounded(metrics.step_metrics(categories(spark, sf_dir), "error", F.col("price") <= 20000, ["o_orderpriority"]))


# -- curves and distances ----------------------------------------------------------------------

CURVE = """g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM lab GROUP BY 1),
    d AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""
UP = """g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM lab GROUP BY 1),
    u AS (SELECT *, sum(pos) OVER (ORDER BY score) / sum(pos) OVER () AS f, sum(neg) OVER (ORDER BY score) / sum(neg) OVER () AS h, lead(score) OVER (ORDER BY score) AS nxt FROM g)"""


@query(f"WITH {CURVE} SELECT score, pos, neg, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM d", "lab")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_points(V.labelled(spark, sf_dir), "score", "label"))


@query(f"WITH {CURVE} SELECT round(sum(pos * (n - fp + neg / 2.0)) / (any_value(p) * any_value(n)), 6) AS auc, CAST(any_value(p) AS BIGINT) AS n_pos, CAST(any_value(n) AS BIGINT) AS n_neg FROM d", "lab")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(V.labelled(spark, sf_dir), "score", "label"))


@query(f"WITH {CURVE} SELECT score AS threshold, round(tp / p - fp / n, 6) AS j, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM d ORDER BY round(tp / p - fp / n, 12) DESC, score DESC LIMIT 1", "lab")
def youden(spark, sf_dir):
    return rounded(metrics.youden(V.labelled(spark, sf_dir), "score", "label"))


@query(f"WITH {CURVE} SELECT round(sum(tp / (tp + fp) * pos) / sum(pos), 6) AS average_precision FROM d", "lab")
def pr_ap(spark, sf_dir):
    return rounded(metrics.average_precision(V.labelled(spark, sf_dir), "score", "label"))


@query(f"WITH {UP} SELECT round(max(abs(f - h)), 6) AS ks FROM u", "lab")
def ks(spark, sf_dir):
    return rounded(metrics.ks_statistic(V.labelled(spark, sf_dir), "score", "label"))


@query(f"WITH {UP} SELECT round(sum(abs(f - h) * (coalesce(nxt, score) - score)), 4) AS wasserstein FROM u", "lab")
def wasserstein(spark, sf_dir):
    return rounded(metrics.wasserstein(V.labelled(spark, sf_dir), "score", "label"), 4)


@query(f"""WITH {CURVE}, m AS (SELECT avg(score) FILTER (label = 1) - avg(score) FILTER (label <> 1) AS d,
    sqrt(((count(*) FILTER (label = 1) - 1) * var_samp(score) FILTER (label = 1) + (count(*) FILTER (label <> 1) - 1) * var_samp(score) FILTER (label <> 1)) / (count(*) - 2)) AS s FROM lab)
    SELECT round(d / s, 6) AS cohen_d, round(2 * (SELECT sum(pos * (n - fp + neg / 2.0)) / (any_value(p) * any_value(n)) FROM d) - 1, 6) AS cliff_delta FROM m""", "lab")
def cohen_cliff(spark, sf_dir):
    return rounded(metrics.effect_sizes(V.labelled(spark, sf_dir), "score", "label"))


@query("""WITH c AS (SELECT count(*) FILTER (score >= 1000 AND label = 1) AS tp, count(*) FILTER (score >= 1000 AND label <> 1) AS fp, count(*) FILTER (score < 1000 AND label <> 1) AS tn,
    count(*) FILTER (score < 1000 AND label = 1) AS fn FROM lab) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr FROM c""", "lab")
def confusion(spark, sf_dir):
    return rounded(metrics.confusion(V.labelled(spark, sf_dir), "score", "label", 1000.0))


@query("""SELECT CAST(least(floor(discount * 10 * 11), 10) AS INTEGER) AS bin, round(avg(discount * 10), 6) AS confidence, round(avg(error), 6) AS observed, count(*) AS n FROM li GROUP BY 1""", "li")
def calibration_bins(spark, sf_dir):
    return rounded(metrics.calibration_bins(V.line_values(spark, sf_dir).withColumn("p", F.col("discount") * 10), "p", "error"))


@query("""WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM ev), b AS (SELECT error, CAST(least(floor((value - lo) / w), 19) AS INTEGER) AS bin, lo, w FROM ev, e),
    c AS (SELECT error, bin, lo + bin * w AS "left", w, count(*) AS n FROM b GROUP BY error, bin, lo, w)
    SELECT error, bin, round("left", 6) AS "left", n, round(n / (sum(n) OVER (PARTITION BY error) * w), 6) AS density, round(n / max(n) OVER (PARTITION BY error), 6) AS height FROM c""", "ev")
def hist_by_class(spark, sf_dir):
    return rounded(stats.histogram(V.event_steps(spark, sf_dir), "value", 20, "error"))


@query("SELECT DISTINCT score AS value, round(count(*) OVER (ORDER BY score) / count(*) OVER (), 6) AS share FROM lab", "lab")
def ecdf(spark, sf_dir):
    return rounded(stats.ecdf(V.labelled(spark, sf_dir), "score"))


@query("""WITH r AS (SELECT record_id, error, row_number() OVER w AS rank, sum(error) OVER (PARTITION BY record_id ORDER BY price DESC, step_idx ROWS UNBOUNDED PRECEDING) AS hits FROM li WINDOW w AS (PARTITION BY record_id ORDER BY price DESC, step_idx))
    SELECT record_id, round(avg(hits / rank), 6) AS average_precision FROM r WHERE error = 1 GROUP BY 1""", "li")
def per_seq_ap(spark, sf_dir):
    return rounded(metrics.per_record_precision(V.line_steps(spark, sf_dir), "record_id", "step_idx", "price", "error"))


@query("""WITH e AS (SELECT min(quantity) AS lo, (max(quantity) - min(quantity)) / 10 AS w FROM li)
    SELECT CAST(least(floor((quantity - lo) / w), 9) AS INTEGER) AS bin, round(median(price), 6) AS median, count(*) AS n FROM li, e GROUP BY 1""", "li")
def running_median(spark, sf_dir):
    return rounded(stats.running_median(V.line_values(spark, sf_dir), "quantity", "price", 10))


@query("""WITH w AS (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg FROM lab), v AS (SELECT *, n_neg / n_pos AS pos_weight, n_pos / (n_pos + n_neg) AS share FROM w),
    e AS (SELECT *, pos_weight * share / (pos_weight * share + 1 - share) AS effective FROM v)
    SELECT n_pos, n_neg, round(pos_weight, 6) AS pos_weight, round(share, 6) AS share, round(effective, 6) AS effective, round(ln(effective / (1 - effective)), 6) + 0.0 AS bias FROM e""", "lab")
def class_weights(spark, sf_dir):
    return rounded(stats.class_weights(V.labelled(spark, sf_dir), "label")).withColumn("bias", F.col("bias") + 0.0)


@query("""WITH r AS (SELECT record_id, count(*) AS n FROM li GROUP BY 1), s AS (SELECT unnest([0, 1, 2, 3]) AS switch), c AS (SELECT switch, CAST(sum(n) AS BIGINT) AS total, CAST(sum(least(n, switch)) AS BIGINT) AS before, CAST(sum(greatest(n - switch, 0)) AS BIGINT) AS after FROM r, s GROUP BY 1)
    SELECT total, switch, before, after, round(before / total, 6) AS before_share, round(after / total, 6) AS after_share FROM c""", "li")
def switch_mix(spark, sf_dir):
    return rounded(stats.switch_mix(V.line_records(spark, sf_dir).select(F.size("price").alias("n")), "n", [0, 1, 2, 3]))


@query("""WITH p AS (SELECT event_type AS tag, 1 AS num_prompts, 8 AS n, value AS wall_s, CAST(json_extract(props, '$.k') AS BIGINT) AS gen_tokens FROM events)
    SELECT tag, count(*) AS calls, CAST(sum(num_prompts) AS BIGINT) AS prompts, CAST(sum(num_prompts * n) AS BIGINT) AS samples, round(sum(wall_s), 4) AS wall_s, CAST(sum(gen_tokens) AS BIGINT) AS tokens, round(max(wall_s), 4) AS peak_mem_gb, round(sum(gen_tokens) / sum(wall_s), 4) AS tokens_per_s FROM p GROUP BY 1""")
def profile_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tag"), F.lit(1).alias("num_prompts"), F.lit(8).alias("n"), F.col("value").alias("wall_s"),
        F.from_json("props", "k long")["k"].alias("gen_tokens"), F.col("value").alias("peak_mem_gb"),
    )
    return rounded(stats.profile_rollup(rows), 4)


@query("""WITH r AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY step_idx) AS seen, 100 * avg(1 - error) OVER (PARTITION BY record_id ORDER BY step_idx) AS accuracy FROM ev)
    SELECT record_id, CAST(seen AS INTEGER) AS seen, round(accuracy, 6) AS accuracy FROM r WHERE seen % 20 = 0""", "ev")
def running_accuracy(spark, sf_dir):
    rows = V.event_steps(spark, sf_dir).withColumn("ok", 1 - F.col("error"))
    return rounded(stats.running_accuracy(rows, "step_idx", "ok", 20, ["record_id"]))


@query("""SELECT round(avg((1 - error) * (value / 100 - 2.5) + ln(1 + exp(-(value / 100 - 2.5)))), 6) AS bce, round(avg(power(value / 500 - error, 2)), 6) AS mse FROM ev""", "ev")
def losses(spark, sf_dir):
    s = F.col("value") / 100 - 2.5
    return rounded(V.event_steps(spark, sf_dir).agg(F.avg(C.bce_with_logits(s, F.col("error"))).alias("bce"), F.avg(F.pow(F.col("value") / 500 - F.col("error"), 2)).alias("mse")))


# -- rewards -----------------------------------------------------------------------------------


@query("SELECT record_id, step_idx, round(value - coalesce(lag(value) OVER (PARTITION BY record_id ORDER BY step_idx), 0), 6) AS advantage FROM ev", "ev")
def advantage(spark, sf_dir):
    return rounded(rewards.advantage(V.event_steps(spark, sf_dir), start=0.0).select("record_id", "step_idx", "advantage"))


@query("SELECT record_id, step_idx, round(price + 0.5 * (quantity - coalesce(lag(quantity) OVER (PARTITION BY record_id ORDER BY step_idx), 0)), 6) AS shaped FROM li", "li")
def advantage_shaped(spark, sf_dir):
    return rounded(rewards.advantage_shaped(V.line_steps(spark, sf_dir), "price", "quantity", 0.5).select("record_id", "step_idx", "shaped"))


@query("SELECT user_id AS record_id, date_part('hour', ts) AS step_idx, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END), 6) AS value FROM events GROUP BY 1, 2")
def mc_value(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.hour("ts").cast("long").alias("step_idx"), (F.col("event_type") != "error").alias("correct"))
    return rounded(rewards.monte_carlo(rows))


@query("SELECT record_id, step_idx, CASE WHEN step_idx = max(step_idx) OVER (PARTITION BY record_id) AND error = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM li", "li")
def outcome_only(spark, sf_dir):
    rows = V.line_records(spark, sf_dir).select("record_id", rewards.outcome_only(F.size("price"), F.element_at("error", -1) == 0).alias("v"))
    return rows.select("record_id", F.posexplode("v").alias("step_idx", "value"))


def contexts(spark, sf_dir, kind):
    turns = table(spark, sf_dir, "conversations")
    rows = steps.records_from_steps(turns, "conv_id", ["turn"], {"text": F.col("text")})
    made = steps.contexts("conv_id", F.lit("Q"), F.col("text"))[kind]
    return rows.select("conv_id", F.posexplode(made).alias("step_idx", "context")).select("conv_id", "step_idx", F.md5("context").alias("context"))


@query("""SELECT conv_id, CAST(row_number() OVER w - 1 AS INTEGER) AS step_idx, md5('Q' || chr(10) || string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS context
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prefix_contexts(spark, sf_dir):
    return contexts(spark, sf_dir, "prefix")


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_idx FROM conversations)
    SELECT a.conv_id, CAST(a.step_idx AS INTEGER) AS step_idx, md5('Q' || coalesce(chr(10) || string_agg(b.text, chr(10) ORDER BY b.turn) FILTER (b.step_idx <> a.step_idx), '')) AS context
    FROM t a JOIN t b USING (conv_id) GROUP BY 1, 2""")
def loo_contexts(spark, sf_dir):
    return contexts(spark, sf_dir, "without")


def logprobs(spark, sf_dir):
    """A log-probability relation from the lines of orders: roots of sums of numbers stand for the
    model, so that a step's worth depends on what stands before it."""
    rows = V.line_steps(spark, sf_dir)
    each = lambda kind, lp: rows.select(
        "record_id", F.lit(kind).alias("context_kind"), F.col("step_idx").alias("context_idx"), F.explode(F.array(F.lit("gold"), F.lit("neg"))).alias("target_kind"), lp.alias("lp"), "quantity", "discount"
    )
    from pyspark.sql import Window

    w = Window.partitionBy("record_id").orderBy("step_idx")
    rows = rows.withColumns({"upto": F.sum("quantity").over(w), "all": F.sum("quantity").over(Window.partitionBy("record_id"))})
    parts = each("prefix", F.sqrt("upto")).unionByName(each("single", F.sqrt("quantity"))).unionByName(each("without", F.sqrt(F.col("all") - F.col("quantity"))))
    total = rows.groupBy("record_id").agg(F.max("all").alias("all"))
    ends = total.select("record_id", F.inline(F.array(*[F.struct(F.lit(k).alias("context_kind"), F.lit(0).alias("context_idx"), F.lit(t).alias("target_kind"), (F.lit(0.0) if k == "base" else F.sqrt("all")).alias("lp")) for k in ("base", "full") for t in ("gold", "neg")])))
    both = parts.select("record_id", "context_kind", "context_idx", "target_kind", "lp").unionByName(ends)
    both = both.withColumn("lp", F.when(F.col("target_kind") == "neg", F.col("lp") / 2).otherwise(F.col("lp")))
    return both.select("record_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("template_id"), "context_kind", "context_idx", "target_kind", F.lit(0).alias("target_idx"), F.col("lp").alias("lp_sum"), F.lit(4).alias("eff_len"))


DELTA = """WITH s AS (SELECT *, sum(quantity) OVER (PARTITION BY record_id ORDER BY step_idx) AS upto, sum(quantity) OVER (PARTITION BY record_id) AS every FROM li), d AS (SELECT record_id, step_idx, {gain} AS d FROM s)
    SELECT record_id, step_idx, round(d, 6) AS gold, round(d / 2, 6) AS neg, round(d - 0.5 * d / 2, 6) AS reward FROM d"""


@query(DELTA.format(gain="sqrt(upto) - sqrt(upto - quantity)"), "li")
def sequential_delta(spark, sf_dir):
    return rounded(rewards.sequential_contrast(logprobs(spark, sf_dir), 0.5))


@query(DELTA.format(gain="sqrt(quantity)"), "li")
def marginal_delta(spark, sf_dir):
    return rounded(rewards.marginal_contrast(logprobs(spark, sf_dir), 0.5))


@query(DELTA.format(gain="sqrt(every) - sqrt(every - quantity)"), "li")
def loo_delta(spark, sf_dir):
    return rounded(rewards.leave_one_out_contrast(logprobs(spark, sf_dir), 0.5))


@query("SELECT record_id, step_idx, round(sqrt(quantity) / 4, 6) AS gold, round(sqrt(quantity) / 8, 6) AS neg, round(sqrt(quantity) / 4 - sqrt(quantity) / 8, 6) AS reward FROM li", "li")
def contrastive_normalized(spark, sf_dir):
    return rounded(rewards.marginal_contrast(logprobs(spark, sf_dir), 1.0, normalize=True))


@query("""WITH o AS (SELECT record_id, step_idx, quantity, perm, sum(quantity) OVER (PARTITION BY record_id, perm ORDER BY md5('3:' || perm || ':' || record_id || ':' || step_idx), step_idx) AS upto FROM li, (SELECT unnest(range(4)) AS perm))
    SELECT record_id, step_idx, round(avg(sqrt(upto) - sqrt(upto - quantity)), 6) AS shapley FROM o GROUP BY 1, 2""", "li")
def shapley_values(spark, sf_dir):
    """Sampled orders over a game in which a later step is worth less."""
    from pyspark.sql import Window

    rows = V.line_steps(spark, sf_dir).select("record_id", "step_idx", "quantity")
    orders = rewards.permutation_orders(rows, 4, 3, "quantity")
    w = Window.partitionBy("record_id", "perm").orderBy("pos")
    upto = orders.select("record_id", "perm", "pos", F.sqrt(F.sum("quantity").over(w)).alias("lp"))
    empty = orders.where("pos = 0").select("record_id", "perm", F.lit(-1).alias("pos"), F.lit(0.0).alias("lp"))
    return rounded(rewards.shapley(orders, upto.unionByName(empty)))


@query("""WITH t AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token_id, CAST(unnest(embedding) AS DOUBLE) * 10 AS logit FROM embeddings),
    e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e, token_id = vec_id % 64 AS is_gold FROM t), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS place FROM e),
    c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) - p AS mass FROM p)
    SELECT vec_id AS record_id, 0 AS pos, round(ln(sum(e) FILTER (is_gold) / sum(e)), 6) AS logp, count(*) AS support FROM c WHERE place <= 8 OR mass < 0.6 OR is_gold GROUP BY 1""")
def truncated_support(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.lit(0).alias("pos"), F.posexplode("embedding").alias("token_id", "x"))
    rows = rows.select("record_id", "pos", "token_id", (F.col("x").cast("double") * 10).alias("logit"), (F.col("token_id") == F.col("record_id") % 64).alias("is_gold"))
    return rounded(rewards.truncated_support(rows, 8, 0.6))


@query("SELECT record_id, step_idx, CASE WHEN step_idx < 2 THEN price ELSE quantity END AS value FROM li", "li")
def merge_switch(spark, sf_dir):
    rows = V.line_records(spark, sf_dir)
    return rows.select("record_id", F.posexplode(rewards.merge_switch(F.col("price"), F.col("quantity"), 2)).alias("step_idx", "value"))


@query("SELECT record_id, step_idx, round(price + 0.25 * quantity, 6) AS value FROM li", "li")
def elementwise_sum(spark, sf_dir):
    rows = V.line_records(spark, sf_dir)
    return rounded(rows.select("record_id", F.posexplode(rewards.elementwise_sum(F.col("price"), F.col("quantity"), 0.25)).alias("step_idx", "value")))


@query("""SELECT record_id, step_idx, CASE WHEN step_idx >= 1 THEN ('0x' || substr(md5('5:' || record_id || ':' || step_idx), 1, 7))::BIGINT / 268435456.0::DOUBLE ELSE discount END AS value FROM li""", "li")
def random_tail(spark, sf_dir):
    rows = V.line_records(spark, sf_dir)
    return rows.select("record_id", F.posexplode(rewards.random_tail(F.col("discount"), 1, 5, F.col("record_id"))).alias("step_idx", "value"))


# -- selection and matching --------------------------------------------------------------------


@query("SELECT record_id, arg_max(step_idx, {'p': price, 'i': -step_idx}) AS step_idx, max(price) AS price, arg_max(answer, {'p': price, 'i': -step_idx}) AS answer FROM li GROUP BY 1", "li")
def best_of_n(spark, sf_dir):
    return select.best_of_n(V.line_steps(spark, sf_dir).select("record_id", "step_idx", "price", "answer"), "record_id", "step_idx", "price")


@query("""WITH v AS (SELECT record_id, answer, CAST(count(*) AS DOUBLE) AS votes, min(step_idx) AS first_index, count(*) AS n_votes FROM li GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY votes DESC, first_index) AS place FROM v) SELECT record_id, answer, votes, first_index, n_votes FROM r WHERE place = 1""", "li")
def majority(spark, sf_dir):
    return select.majority_vote(V.line_steps(spark, sf_dir), "record_id", "step_idx", "answer").drop("best_score")


@query("""WITH m AS (SELECT *, max(price / 20000) OVER (PARTITION BY record_id) AS top FROM li), w AS (SELECT *, exp(price / 20000 - top) / sum(exp(price / 20000 - top)) OVER (PARTITION BY record_id) AS weight FROM m),
    v AS (SELECT record_id, answer, sum(weight) AS votes, min(step_idx) AS first_index, max(price) AS best_score, count(*) AS n_votes FROM w GROUP BY 1, 2),
    t AS (SELECT *, max(votes) OVER (PARTITION BY record_id) AS lead FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY best_score DESC, first_index) AS place FROM t WHERE votes >= lead - 1e-12)
    SELECT record_id, answer, round(votes, 6) AS votes, first_index, best_score, n_votes FROM r WHERE place = 1""", "li")
def weighted_majority(spark, sf_dir):
    return rounded(select.majority_vote(V.line_steps(spark, sf_dir), "record_id", "step_idx", "answer", "price", 20000.0, tie="score"))


@query("SELECT count(*) AS n, round(100 * avg(CASE WHEN answer = 'N' THEN 1.0 ELSE 0 END), 6) AS accuracy FROM li WHERE step_idx = 0", "li")
def single_accuracy(spark, sf_dir):
    return rounded(select.single_accuracy(V.line_steps(spark, sf_dir), "step_idx", F.col("answer") == "N"))


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('9:' || o_orderkey), o_orderkey) AS place FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW', '2-HIGH'))
    SELECT o_orderkey, o_orderpriority FROM r WHERE place <= CASE WHEN o_orderpriority = '1-URGENT' THEN 34 ELSE 33 END""")
def balanced_subset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return select.balanced_subset(orders, "o_orderpriority", ["1-URGENT", "5-LOW", "2-HIGH"], 100, 9, "o_orderkey")


@query("SELECT c_custkey, ('0x' || substr(md5('4:' || c_custkey), 1, 7))::BIGINT / 268435456.0 < 0.9 AS is_train FROM customer")
def hash_split(spark, sf_dir):
    return select.hash_split(table(spark, sf_dir, "customer").select("c_custkey"), 0.9, 4, "c_custkey")


@query("SELECT c_custkey FROM customer ORDER BY md5('4:' || c_custkey), c_custkey LIMIT 50")
def hash_sample(spark, sf_dir):
    return select.hash_sample(table(spark, sf_dir, "customer").select("c_custkey"), 50, 4, "c_custkey")


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, (count(*) OVER () + 3) // 4 AS length FROM orders) SELECT o_orderkey FROM n WHERE place >= length AND place < 2 * length""")
def shard_slice(spark, sf_dir):
    return select.shard(table(spark, sf_dir, "orders").select("o_orderkey"), 4, 1, "o_orderkey")


GREEDY = """WITH RECURSIVE c AS (SELECT o_orderpriority, o_orderkey AS record_id, CAST(count(*) FILTER (l_returnflag <> 'R') - count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS gap
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    q AS (SELECT *, sign(gap) AS side, row_number() OVER (PARTITION BY o_orderpriority, sign(gap) ORDER BY abs(gap), record_id) AS pos FROM c),
    n AS (SELECT o_orderpriority, count(*) FILTER (gap > 0) AS np, count(*) FILTER (gap < 0) AS nm, count(*) FILTER (gap = 0) AS nz FROM c GROUP BY 1),
    w AS (SELECT o_orderpriority, 0::BIGINT AS k, 0::BIGINT AS bal, 0::BIGINT AS ip, 0::BIGINT AS im, 0::BIGINT AS iz, 0::BIGINT AS record_id FROM n
        UNION ALL SELECT w.o_orderpriority, w.k + 1, w.bal + q.gap, w.ip + (q.side = 1)::BIGINT, w.im + (q.side = -1)::BIGINT, w.iz + (q.side = 0)::BIGINT, q.record_id
        FROM w JOIN n ON n.o_orderpriority = w.o_orderpriority JOIN q ON q.o_orderpriority = w.o_orderpriority AND q.side = CASE
            WHEN w.bal > 0 THEN CASE WHEN w.im < n.nm THEN -1 WHEN w.iz < n.nz THEN 0 WHEN w.ip < n.np THEN 1 END
            WHEN w.bal < 0 THEN CASE WHEN w.ip < n.np THEN 1 WHEN w.iz < n.nz THEN 0 WHEN w.im < n.nm THEN -1 END
            ELSE CASE WHEN w.iz < n.nz THEN 0 WHEN w.ip < n.np THEN 1 WHEN w.im < n.nm THEN -1 END END
            AND q.pos = 1 + CASE q.side WHEN 1 THEN w.ip WHEN -1 THEN w.im ELSE w.iz END
        WHERE w.k < 50)
    SELECT o_orderpriority, record_id, k - 1 AS pick, bal AS balance FROM w WHERE k > 0"""


@query(GREEDY)
def greedy_balance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderpriority")
    counted = V.line_values(spark, sf_dir).groupBy("record_id").agg(F.sum(1 - F.col("error")).alias("plus"), F.sum("error").alias("minus"))
    return select.greedy_balance(counted.join(orders, "record_id"), "o_orderpriority", "record_id", "plus", "minus", 50)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS place FROM lineitem)
    SELECT o_orderkey, o_orderpriority, l_quantity, l_quantity IS NOT NULL AS matched FROM orders LEFT JOIN (SELECT * FROM r WHERE place = 1) ON o_orderkey = l_orderkey""".replace("PARTITION BY l_orderkey, l_linenumber ORDER BY ", "PARTITION BY l_orderkey ORDER BY l_linenumber DESC, "))
def exact_merge(spark, sf_dir):
    """Orders beside the last of all their lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), "l_quantity"
    )
    return match.exact_merge(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), lines, ["o_orderkey"], "ord")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti_resume(spark, sf_dir):
    """Customers without an urgent order."""
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return match.unfinished(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("""WITH p AS (SELECT s_suppkey AS left_id, c_custkey AS right_id, s_name AS a, c_name AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey),
    m AS (SELECT *, list_transform(range(1, length(b) + 1), lambda j: CAST(list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = b[j] THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END)) AS BIGINT)) AS masks FROM p),
    l AS (SELECT left_id, right_id, 2.0::DOUBLE * bit_count(list_reduce(list_prepend(0::BIGINT, masks), lambda r, x: (r | x) & ~((r | x) - ((r << 1) | 1)))) / (length(a) + length(b)) AS similarity FROM m)
    SELECT left_id, right_id, round(similarity, 6) AS similarity FROM l WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) = 1""")
def fuzzy_merge(spark, sf_dir):
    """Suppliers and customers of a nation whose names are alike; the best customer of each."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return rounded(match.best_partners(s, c, "nation", "name", "id", 0.6).select("left_id", "right_id", "similarity"))


@query("""WITH q AS (SELECT c_custkey AS record_id, c_mktsegment AS task, c_mktsegment AS question FROM customer), i AS (SELECT 'a' AS source, 'BUILDING' AS question, 'x' AS answer UNION ALL SELECT 'b', 'BUILDING', 'y' UNION ALL SELECT 'b', 'MACHINERY', 'z')
    SELECT record_id, task, question, CASE question WHEN 'BUILDING' THEN 'y' WHEN 'MACHINERY' THEN 'z' END AS gold_answer, CASE WHEN question IN ('BUILDING', 'MACHINERY') THEN 'b' ELSE 'none' END AS match_source,
    CASE WHEN question IN ('BUILDING', 'MACHINERY') THEN 'exact' ELSE 'none' END AS match_type FROM q""")
def gold_attach_priority(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("task"), F.col("c_mktsegment").alias("question"))
    index = spark.createDataFrame([("a", "BUILDING ", "x"), ("b", " BUILDING", "y"), ("b", "MACHINERY", "z")], "source string, question string, answer string")
    return match.attach_gold(rows, index, {"building": ["b", "a"]}, ["a", "b"])


@query("""WITH s AS (SELECT c_mktsegment IN ('BUILDING', 'MACHINERY') AS hit FROM customer) SELECT CASE WHEN hit THEN 'b' ELSE 'none' END AS match_source, CASE WHEN hit THEN 'exact' ELSE 'none' END AS match_type, count(*) AS n FROM s GROUP BY 1, 2""")
def match_report(spark, sf_dir):
    return match.match_report(gold_attach_priority(spark, sf_dir))


@query("""WITH k AS (SELECT c_custkey AS record_id, c_custkey % 4 AS kind, md5(CAST(c_custkey AS VARCHAR)) AS known, c_mktsegment AS task, c_name FROM customer)
    SELECT record_id, CASE kind WHEN 3 THEN NULL WHEN 2 THEN 'b' || c_name ELSE 'a' || c_name END AS gold_answer, CASE kind WHEN 3 THEN 'none' WHEN 2 THEN 'b' ELSE 'a' END AS match_source,
    CASE kind WHEN 0 THEN 'exact' WHEN 3 THEN 'none' ELSE 'fuzzy' END AS match_type FROM k""")
def gold_attach_fuzzy(spark, sf_dir):
    """Questions that stand in the index, that differ by a character or two, that only the second
    source has nearly, and that are new; all begin alike."""
    key, kind = F.col("c_custkey"), F.col("c_custkey") % 4
    opening = F.lit("Find the value of the number ")
    known = F.concat(opening, F.md5(key.cast("string")))
    said = (
        F.when(kind == 0, known).when(kind == 1, F.concat(known, F.lit(" ?"))).when(kind == 2, F.concat(F.lit("  "), F.translate(known, "v", "")))
        .otherwise(F.concat(opening, F.md5(F.concat(F.lit("new "), key.cast("string")))))
    )
    rows = table(spark, sf_dir, "customer").select(key.alias("record_id"), F.lit("Math").alias("task"), said.alias("question"))
    source = lambda name, kinds: table(spark, sf_dir, "customer").where(kind.isin(*kinds)).select(F.lit(name).alias("source"), known.alias("question"), F.concat(F.lit(name), "c_name").alias("answer"))
    index = source("a", (0, 1)).unionByName(source("b", (0, 1, 2)))
    return match.attach_gold(rows, index, {"math": ["a", "b"]}, ["a"]).select("record_id", "gold_answer", "match_source", "match_type")


# -- text, answers, heads ----------------------------------------------------------------------


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i / 100)) + 0.5, 5) AS score FROM embeddings""")
def linear_head(spark, sf_dir):
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", C.head_score(F.col("embedding"), [i / 100 for i in range(1, 65)], 0.5).alias("score")), 5)


@query(r"""SELECT doc_id, md5(regexp_replace(text, '\d+([.,/]\d+)*', '[MASKED]', 'g')) AS masked FROM documents""")
def mask_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.mask_numbers(F.col("text"))).alias("masked"))


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(s, '^\s+|\s+$', '', 'g')) <> '')) AS INTEGER) AS n
    FROM documents WHERE NOT regexp_matches(text, '(?i)step\s*\d+\s*:') AND NOT regexp_matches(text, '\n\s*\n')""")
def split_steps(spark, sf_dir):
    """Steps of every document. The SQL has the rule of lines only; no text of the given tables needs another."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.split_steps(F.col("text"))).alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN round(p_retailprice, 2) = round(p_retailprice, 0) WHEN 1 THEN true WHEN 2 THEN p_size % 2 = 0 WHEN 3 THEN p_size % 3 = 0 ELSE false END AS equal FROM part""")
def numeric_equiv(spark, sf_dir):
    """Thousands, percentages, fractions, mixed numbers, texts and nulls."""
    price, size, kind = F.col("p_retailprice").cast("decimal(18,2)"), F.col("p_size").cast("string"), F.col("p_partkey") % 5
    left = (
        F.when(kind == 0, price.cast("string")).when(kind == 1, F.concat(size, F.lit("%"))).when(kind == 2, F.concat(size, F.lit(" 1/2")))
        .when(kind == 3, F.concat(F.lit(" word"), F.when(F.col("p_size") % 3 == 0, "").otherwise("s")))
    )
    right = (
        F.when(kind == 0, F.format_number(F.round("p_retailprice", 0), 0)).when(kind == 1, F.concat(F.lit("$"), (F.col("p_size") / 100).cast("string")))
        .when(kind == 2, F.concat((2 * F.col("p_size") + 1 + F.col("p_size") % 2).cast("string"), F.lit("/2"))).when(kind == 3, F.lit("word ")).otherwise(F.lit("1"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", A.numeric_equal(left, right).alias("equal"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NUM:' || (p_size // gcd(p_size, 12)) || '/' || (12 // gcd(p_size, 12)) WHEN 1 THEN 'NUM:' || (-p_size // gcd(p_size, 8)) || '/' || (8 // gcd(p_size, 8))
    WHEN 2 THEN 'NUM:' || (p_size // gcd(p_size, 4)) || '/' || (4 // gcd(p_size, 4)) WHEN 3 THEN 'NUM:' || (1000 + p_size) || '/1' END AS key FROM part""")
def canonical_key(spark, sf_dir):
    """LaTeX fractions, plain ones with a sign, decimals, thousands and nulls."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    said = (
        F.when(kind == 0, F.concat(F.lit("the answer is: \\frac{"), size, F.lit("}{12}"))).when(kind == 1, F.concat(F.lit("-"), size, F.lit("/8")))
        .when(kind == 2, (F.col("p_size") / 4).cast("string")).when(kind == 3, F.concat(F.lit("$"), F.format_number(F.col("p_size") + 1000, 0)))
    )
    return table(spark, sf_dir, "part").select("p_partkey", A.canonical_key(said).alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN chr(CAST(65 + p_size % 4 AS INTEGER)) END AS letter FROM part""")
def mcq_extract(spark, sf_dir):
    """Letters in brackets, in a box, on the answer line, alone at the end, and none."""
    letter, kind = A.choice_of_index(F.col("p_size") % 4), F.col("p_partkey") % 5
    said = (
        F.when(kind == 0, F.concat(F.lit("So the answer is ("), letter, F.lit(").")))
        .when(kind == 1, F.concat(F.lit("not (A) so \\boxed{\\text{"), letter, F.lit("}}")))
        .when(kind == 2, F.concat(F.lit("(A) is wrong\nAnswer: "), letter))
        .when(kind == 3, F.concat(F.lit("I choose\n"), letter, F.lit(".\n")))
        .otherwise(F.lit("no idea at all"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", A.choice_letter(said).alias("letter"))


@query("""SELECT p_partkey, p_size % 3 = 0 AND p_partkey % 4 <> 3 AS correct FROM part""")
def graded_answers(spark, sf_dir):
    """Fractions, pairs and sums with a symbol, of which every third is right, and no answer."""
    size, kind, off = F.col("p_size").cast("string"), F.col("p_partkey") % 4, (F.col("p_size") % 3 != 0).cast("int")
    box = lambda *parts: F.concat(F.lit("Thus \\boxed{"), *parts, F.lit("}"))
    pred = F.when(kind == 0, box(F.lit("\\frac{"), size, F.lit("}{2}"))).when(kind == 1, box(F.lit("(1, "), size, F.lit(")"))).when(kind == 2, box(F.lit("x + "), size)).otherwise(F.lit(""))
    gold = (
        F.when(kind == 1, F.concat(F.lit("$(1,"), (F.col("p_size") + off).cast("string"), F.lit(")$"))).when(kind == 2, F.concat(F.lit("$"), (F.col("p_size") + off).cast("string"), F.lit("+x$")))
        .otherwise(F.concat(F.lit("$"), (F.col("p_size") / 2 + off).cast("string"), F.lit("$")))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", pred.alias("generation"), gold.alias("gold"))
    return A.graded(rows, "math", "generation", "gold").select("p_partkey", "correct")


@query("""WITH v AS (SELECT p_partkey AS record_id, p_size AS x, unnest([p_size + 1.0, p_size - 1.0, p_size + 2.0, p_size - 2.0, p_size + 10.0, p_size - 10.0, p_size * 0.9::DOUBLE, p_size * 1.1::DOUBLE]::DOUBLE[]) AS v FROM part),
    s AS (SELECT DISTINCT record_id, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(round(v, 6) AS VARCHAR) END AS negative FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY md5('2:' || record_id || ':' || negative), negative) AS rank FROM s) SELECT record_id, CAST(rank AS INTEGER) AS rank, negative FROM r WHERE rank <= 4""")
def hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_size").cast("string").alias("gold"))
    return negatives.wrong_answers(rows, "gold", None, 4, 2)


@query("""WITH t AS (SELECT conv_id, turn, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, turn, coalesce(r, false) AS repeated FROM t""")
def repeated_turns(spark, sf_dir):
    return steps.repeated_steps(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "repeated")


@query("""WITH c AS (SELECT *, sum(quantity) OVER (PARTITION BY record_id ORDER BY step_idx) AS s FROM li) SELECT record_id, CAST(count(*) FILTER (s <= 60) AS INTEGER) AS fits FROM c GROUP BY 1""", "li")
def pack_within(spark, sf_dir):
    lengths = F.transform("quantity", lambda q: q.cast("long"))
    return V.line_records(spark, sf_dir).select("record_id", steps.pack_within(lengths, 60).alias("fits"))


@query("""SELECT conv_id, md5(string_agg(trim(text) || ' <m>', ' ' ORDER BY turn) FILTER (trim(text) <> '')) AS joined FROM conversations GROUP BY 1""")
def join_with_marker(spark, sf_dir):
    rows = steps.records_from_steps(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], {"text": F.col("text")})
    return rows.select("conv_id", F.md5(steps.join_with_marker(F.col("text"), "<m>")).alias("joined"))
