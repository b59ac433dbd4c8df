"""Step rewards: Monte-Carlo values, advantages, contributions from log-probabilities, merging.

A log-probability relation has record_id, template_id, context_kind (base, prefix, single,
without, full, perm), context_idx, target_kind (gold, neg), target_idx, lp_sum and eff_len. It
comes from a table, so no model is needed; contributions are joins and averages over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions.columns import numbers_to, safe_div
from stepwright.functions.text import renumber
from stepwright.operators.contributions import neighbours, order_gains


def monte_carlo(rollouts: DataFrame, correct: str = "correct", keys: tuple[str, ...] = ("record_id", "step_idx")) -> DataFrame:
    """Share of correct rollouts from each prefix."""
    return rollouts.groupBy(*keys).agg(F.avg(F.col(correct).cast("double")).alias("value"))


def advantage(steps: DataFrame, value: str = "value", record: str = "record_id", order: str = "step_idx", start: float | None = None) -> DataFrame:
    """Gain of each step's value over the one before; the first against start (null without)."""
    before = F.lag(value).over(Window.partitionBy(record).orderBy(order))
    return steps.withColumn("advantage", F.col(value) - (before if start is None else F.coalesce(before, F.lit(float(start)))))


def advantage_shaped(steps: DataFrame, base: str, prover: str, alpha: float, start: str | None = None, record: str = "record_id", order: str = "step_idx") -> DataFrame:
    """Base value plus alpha times the prover's gain; the first gain is over column start, or 0."""
    before = F.lag(prover).over(Window.partitionBy(record).orderBy(order))
    before = F.coalesce(before, F.col(start) if start else F.lit(0.0))
    return steps.withColumn("shaped", F.col(base) + alpha * (F.col(prover) - before))


def outcome_only(n_steps: Column, correct: Column) -> Column:
    """0 for all steps but the last, which has the outcome."""
    return F.transform(numbers_to(n_steps), lambda i: F.when(i == n_steps, correct.cast("double")).otherwise(0.0))


def pooled_logprob(logprob: DataFrame, normalize: bool = False) -> DataFrame:
    """Mean over templates and negatives: record_id, context_kind, context_idx, target_kind, lp."""
    lp = safe_div(F.col("lp_sum"), F.col("eff_len")) if normalize else F.col("lp_sum")
    by_target = logprob.groupBy("record_id", "context_kind", "context_idx", "target_kind", "template_id").agg(F.avg(lp).alias("lp"))
    return by_target.groupBy("record_id", "context_kind", "context_idx", "target_kind").agg(F.avg("lp").alias("lp"))


def _contrast(logprob: DataFrame, how: str, weight: float, normalize: bool) -> DataFrame:
    """Gain of gold less weight times the gain of negatives, per record and step; how as in neighbours."""
    both = neighbours(pooled_logprob(logprob, normalize), how, "lp").where("before is not null and after is not null")
    part = lambda kind: F.max(F.when(F.col("target_kind") == kind, F.col("after") - F.col("before")))
    rows = both.groupBy("record_id", "step_idx").agg(part("gold").alias("gold"), part("neg").alias("neg"))
    return rows.withColumn("reward", F.col("gold") - weight * F.coalesce("neg", F.lit(0.0)))


def sequential_contrast(logprob: DataFrame, weight: float = 1.0, normalize: bool = False) -> DataFrame:
    """What each step adds to the prefix before it. Base stands for the empty prefix."""
    return _contrast(logprob, "sequential", weight, normalize)


def marginal_contrast(logprob: DataFrame, weight: float = 1.0, normalize: bool = False) -> DataFrame:
    """What each step alone adds to the base context."""
    return _contrast(logprob, "marginal", weight, normalize)


def leave_one_out_contrast(logprob: DataFrame, weight: float = 1.0, normalize: bool = False) -> DataFrame:
    """What the full solution loses without each step."""
    return _contrast(logprob, "loo", weight, normalize)


def permutation_orders(steps: DataFrame, permutations: int, seed: int = 0, *keep: str) -> DataFrame:
    """record_id, perm, pos, step_idx and the columns to keep: seeded orders of each record's steps."""
    rows = steps.select("record_id", "step_idx", *keep).dropDuplicates(["record_id", "step_idx"]).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    order = Window.partitionBy("record_id", "perm").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "perm", "record_id", "step_idx")), "step_idx")
    return rows.withColumn("pos", F.row_number().over(order) - 1)


def shapley(orders: DataFrame, perm_logprob: DataFrame) -> DataFrame:
    """Mean gain of each step over its predecessors in the orders.

    perm_logprob: record_id, perm, pos, lp, where pos -1 is the empty context and pos p the first
    p + 1 steps of the order.
    """
    rows = order_gains(orders, perm_logprob, "lp")
    return rows.groupBy("record_id", "step_idx").agg(F.avg("gain").alias("shapley"))


def truncated_support(logits: DataFrame, top_k: int, top_p: float, keys: tuple[str, ...] = ("record_id", "pos"), cap: int = 3096) -> DataFrame:
    """Per position: log-probability of gold over the support, and its size.

    The support is the top_k tokens, the tokens whose preceding mass is under top_p (these among
    the cap first ones), and gold. Without gold the log-probability is minus infinity.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("logit"), "token_id")
    whole = Window.partitionBy(*keys)
    rows = logits.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(whole)))
    rows = rows.withColumns({"p": F.col("e") / F.sum("e").over(whole), "place": F.row_number().over(w)})
    rows = rows.withColumn("mass", F.sum("p").over(w) - F.col("p"))
    held = rows.where((F.col("place") <= top_k) | ((F.col("mass") < top_p) & (F.col("place") <= cap)) | F.col("is_gold"))
    gold = F.sum(F.when(F.col("is_gold"), F.col("e")))
    return held.groupBy(*keys).agg(F.coalesce(F.log(gold / F.sum("e")), F.lit(float("-inf"))).alias("logp"), F.count(F.lit(1)).alias("support"))


def merge_switch(base: Column, other: Column, switch_at: int) -> Column:
    """The first switch_at rewards of base, then those of other; lengths cut to the shorter."""
    n = F.least(F.size(base), F.size(other))
    head = F.slice(base, F.lit(1), F.least(n, F.lit(switch_at)))
    return F.concat(head, F.slice(other, F.lit(switch_at + 1), F.greatest(n - switch_at, F.lit(0))))


def random_tail(rewards: Column, switch_at: int, seed: int, *ids: Column) -> Column:
    """rewards with uniform draws from switch_at on, a function of seed, ids and position."""
    return F.transform(rewards, lambda v, i: F.when(i >= switch_at, unit_draw(seed, *ids, i)).otherwise(v))


def unit_draw(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) by the MD5 of seed and ids, the same on every run and engine."""
    shown = F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(shown), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def beta_tail(rewards: Column, switch_at: int, a: int, b: int, seed: int, *ids: Column) -> Column:
    """rewards with draws of a beta distribution (whole a and b) from switch_at on: the a-th smallest
    of a + b - 1 uniform draws has it."""
    draws = lambda i: F.array_sort(F.array(*[unit_draw(seed, *ids, i, F.lit(k)) for k in range(a + b - 1)]))
    return F.transform(rewards, lambda v, i: F.when(i >= switch_at, F.element_at(draws(i), a)).otherwise(v))


def elementwise_sum(a: Column, b: Column, alpha: float = 1.0) -> Column:
    """a + alpha b over the common length."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x + alpha * y)


def perturb(records: DataFrame, steps: str, banks: dict[str, str], weights: dict[str, float], seed: int, *ids: str, numbered: bool = False) -> DataFrame:
    """records with one inserted step: kind drawn by weights, text from banks, place by hash.

    Adds perturbation, perturbation_pos and incorrect_mask; steps holds the longer array, and with
    numbered its steps begin with their new places.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 30)) / F.lit(float(1 << 30))
    total, upto, kind = sum(weights.values()), 0.0, None
    for name, weight in weights.items():
        upto += weight / total
        kind = (F.when if kind is None else kind.when)(u < upto, name)
    kind = F.coalesce(kind, F.lit(list(weights)[-1]))
    text = F.element_at(F.create_map(*[F.lit(x) for pair in banks.items() for x in pair]), F.col("perturbation"))
    place = F.pmod(F.xxhash64(F.lit(seed + 1), *ids), F.size(steps) + 1).cast("int")
    return (
        records.withColumn("perturbation", kind)
        .withColumn("perturbation_pos", place)
        .withColumn(steps, F.concat(F.slice(steps, F.lit(1), F.col("perturbation_pos")), F.array(text), F.slice(steps, F.col("perturbation_pos") + 1, F.size(steps))))
        .withColumn(steps, renumber(F.col(steps)) if numbered else F.col(steps))
        .withColumn("incorrect_mask", F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: (i == F.col("perturbation_pos")).cast("int")))
    )


def gold_support(logits: DataFrame, ks: list[int], keys: tuple[str, ...] = ("record_id", "pos")) -> DataFrame:
    """Per position: gold_logp, gold_rank (from 1; of equal logits the smaller token first), mass_above
    (probability of the tokens before gold) and mass_<k>, that of the k first tokens.

    Tokens are compared with gold's own logit in one aggregate, without an order of the vocabulary;
    only the largest of ks tokens of a position are ever ordered. Null logits are no tokens; without
    gold its columns are null. Where gold is marked more than once, its best token counts.
    """
    keys = list(keys)
    rows = logits.where("logit is not null").select(*keys, F.col("logit").cast("double").alias("logit"), "token_id", F.coalesce("is_gold", F.lit(False)).alias("is_gold"))
    best = F.max(F.when(F.col("is_gold"), F.struct("logit", (-F.col("token_id")).alias("__token"))))
    tops = rows.groupBy(*keys).agg(F.max("logit").alias("__top"), best.alias("__gold"))
    e = F.exp(F.col("logit") - F.col("__top"))
    above = F.struct("logit", (-F.col("token_id")).alias("__token")) > F.col("__gold")
    whole = rows.join(tops, keys).groupBy(*keys).agg(
        F.sum(e).alias("__sum"), F.count_if(above).alias("__above"), F.coalesce(F.sum(F.when(above, e)), F.lit(0.0)).alias("__mass"),
        F.first("__top").alias("__top"), F.first("__gold").alias("__gold"),
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("logit"), "token_id"))
    first = rows.withColumn("__place", place).where(F.col("__place") <= max(ks)).join(tops.drop("__gold"), keys)
    masses = first.groupBy(*keys).agg(*[F.sum(F.when(F.col("__place") <= k, e)).alias(f"__m{k}") for k in ks])
    known = lambda c: F.when(F.col("__gold").isNotNull(), c)
    return whole.join(masses, keys).select(
        *keys,
        (F.col("__gold.logit") - F.col("__top") - F.log("__sum")).alias("gold_logp"),
        known(F.col("__above") + 1).alias("gold_rank"),
        known(F.col("__mass") / F.col("__sum")).alias("mass_above"),
        *[(F.col(f"__m{k}") / F.col("__sum")).alias(f"mass_{k}") for k in ks],
    )
