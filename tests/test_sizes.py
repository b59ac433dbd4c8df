"""Steps that have to grow no faster than their tables: partitions, pairs compared, shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwright.functions.answers import canonical_key, reduced
from stepwright.operators import match, metrics, negatives
from stepwright.operators.ordered import quantiles
from stepwright.plans import more, queries  # noqa: F401
from stepwright.plans import views as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wrong_answers_are_dealt_before_variants(spark, monkeypatch):
    """One file is one task; its records are dealt to several before their variants are made."""
    monkeypatch.setattr(negatives, "RECORDS_IN_TASK", 50)
    rows = spark.range(200).coalesce(1).select(F.col("id").alias("record_id"), F.col("id").cast("string").alias("gold"))
    got = negatives.wrong_answers(rows, "gold", None, 4, 2)
    shown = plan(got)
    assert shown.index("Generate") < shown.index("hashpartitioning(record_id") and shown.count("hashpartitioning") == 1
    assert got.count() == 800


def test_key_is_made_once(spark):
    """The cleaned answer stands once in its key's expression, and terms are reduced in few steps."""
    rows = spark.createDataFrame([("12",)], "a string").select(canonical_key(F.col("a")).alias("k"))
    assert plan(rows).count("answer\\s+is") == 1
    pairs = [(0, 7), (12, -18), (7, 0), (None, 3), (3, None), (9, 0), (8944394323791464, 5527939700884757), (10**18, 10), (-45, 1), (6, 10**9)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(reduced(F.col("a"), F.col("b"))).collect()]
    assert got == ["0/1", "-2/3", None, None, None, None, "8944394323791464/5527939700884757", "100000000000000000/1", "-45/1", "3/500000000"]


def test_small_blocks_make_no_grams(spark, monkeypatch):
    """Texts of blocks with a few of them meet as they are; larger blocks still go by their grams, and null blocks have no pairs."""
    made, cut = [], match.rare_grams
    monkeypatch.setattr(match, "rare_grams", lambda texts, q, least: (made.append(texts), cut(texts, q, least))[1])
    word = lambda i: "some words and the number " + str(i) * 9
    left = [(b, word(b)) for b in range(30)] + [(99, word(i)) for i in range(20)] + [(None, word(1))]
    right = [(b, word(b) + "!") for b in range(0, 30, 2)] + [(99, word(i) + "!") for i in range(20)] + [(None, word(1))]
    frames = [spark.createDataFrame(rows, "block int, text string") for rows in (left, right)]
    got = match.near_texts(*frames, 0.95).collect()
    assert sorted((r["block"], r["left_text"]) for r in got) == sorted([(b, word(b)) for b in range(0, 30, 2)] + [(99, word(i)) for i in range(20)])
    assert {r["block"] for r in made[0].collect()} == {99}


BY_RECORD = ["loo_delta", "sequential_delta", "marginal_delta", "contrastive_normalized", "contrast_terms", "entropy_loo", "entropy_sequential", "entropy_shapley", "shapley_values", "weighted_majority"]


@pytest.mark.parametrize("name", BY_RECORD)
def test_lines_are_dealt_once_by_their_number(spark, monkeypatch, name):
    """Only the lines themselves are shuffled, to as many tasks as they need."""
    monkeypatch.setattr(V, "LINES_IN_TASK", 1000)
    shown = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    cuts = [line for line in shown.splitlines() if "Exchange" in line]
    assert cuts and all("REPARTITION_BY_NUM" in c and "l_orderkey" in c for c in cuts)


def test_places_without_both_have_no_gain(spark):
    from stepwright.operators.rewards import shapley

    orders = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 6), (1, 0, 2, 7), (2, 0, 0, 5)], "record_id long, perm int, pos int, step_idx int")
    values = spark.createDataFrame([(1, 0, -1, 1.0), (1, 0, 0, 3.0), (1, 0, 2, 4.0), (1, 0, 3, 9.0), (2, 0, 0, 1.0)], "record_id long, perm int, pos int, lp double")
    assert [tuple(r) for r in shapley(orders, values).collect()] == [(1, 5, 2.0)]


@pytest.mark.parametrize("name", ["auc_summary", "category_tuning", "tune_error_f1", "global_summary"])
def test_lines_without_order_are_not_dealt(spark, name):
    """What needs no place of a line neither ranks nor deals the lines, nor joins them to themselves."""
    shown = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "l_linenumber" not in shown and "REPARTITION_BY_NUM" not in shown


def test_copies_do_not_multiply_pairs(spark, monkeypatch):
    """The best partners are those of all pairs, and of equal texts one pair goes on to be ranked."""
    left = spark.createDataFrame([(i, i % 2, f"Supplier#{i % 6:03}") for i in range(24)], "id long, b int, t string")
    right = spark.createDataFrame([(i, i % 2, f"Supplied#{i % 10:03}") for i in range(40, 0, -1)] + [(99, None, "Supplied#001"), (98, 1, None)], "id long, b int, t string")
    want = match.best_similar(match.similar_pairs(left, right, "b", "t", 0.6), ["left_id"], "right_id")
    ranked, rank = [], match.best_similar
    monkeypatch.setattr(match, "best_similar", lambda pairs, *a: (ranked.append(pairs), rank(pairs, *a))[1])
    got = match.best_partners(left, right, "b", "t", "id", 0.6)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 24
    assert ranked[0].count() == 2 * 3 * 5  # of 480 pairs of rows


def shuffled_rows(spark):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    nothing = jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(nothing(), False, False, gateway.new_array(jvm.double, 0), nothing())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_tuning_shuffles_hardly_any_rows(spark, keys):
    """Of all different values only those near the two quantiles are shuffled, and no row goes to its key's task."""
    rows = spark.range(0, 40_000, 1, 4).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 40_009 + 0.25).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("e"))
    known = shuffled_rows(spark)
    best = metrics.tune_error_f1(rows, "s", "e", keys=keys).collect()
    assert len(best) == 2 ** len(keys)
    assert sum(n for stage, n in shuffled_rows(spark).items() if stage not in known) < 8_000


def test_quantiles_of_ranges(spark):
    """Exact for large keys and small ones, many ties, shares at and beside the ends, null keys and one value."""
    rng = np.random.default_rng(3)
    values = {1: rng.normal(0, 1, 30_000), 2: np.repeat(rng.normal(0, 1, 3), 7_000), 3: rng.normal(0, 1, 5), 4: np.ones(1), None: rng.integers(0, 40, 12_000).astype(float)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k int, v double").repartition(5)
    shares = [0.0, 0.0001, 0.01, 0.25, 0.2501, 0.5, 0.999, 1.0]
    got = {r["k"]: r for r in quantiles(rows, "v", shares, ["k"], few=10).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k]["n"] == len(vs) and np.allclose(got[k]["q"], np.quantile(vs, shares), rtol=0, atol=1e-12)
    one = quantiles(rows, "v", shares, few=10).first()
    assert np.allclose(one["q"], np.quantile(np.concatenate(list(values.values())), shares), rtol=0, atol=1e-12)
