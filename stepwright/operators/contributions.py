"""Contributions of steps beside the contrasts of log-probabilities: entropies, sampled answers,
masking, their single terms, and the grid of prompts that a scorer has to answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions.records import filled
from stepwright.operators.steps import contexts

CONTEXT = ["record_id", "context_kind", "context_idx"]


def entropy_bits(tokens: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Entropy in bits of the token distributions of a key, summed over its places."""
    return tokens.groupBy(*keys).agg((-F.sum(F.when(F.col(p) > 0, F.col(p) * F.log2(p)).otherwise(0.0))).alias("h_bits"))


def neighbours(values: DataFrame, how: str, value: str) -> DataFrame:
    """values (CONTEXT and others) as rows of a step: before and after, without and with the step.

    how: sequential (the prefix up to the step against the one before it), marginal (the step alone
    against no step) or loo (all steps against all others). One pass over windows of a record; what has
    nothing to be held against is null.
    """
    others = [c for c in values.columns if c not in (*CONTEXT, value)]
    kind, at = F.col("context_kind"), F.col("context_idx")
    if how == "sequential":
        rows = values.where("context_kind in ('base', 'prefix')").withColumn("step_idx", F.when(kind == "base", -1).otherwise(at))
        along = Window.partitionBy("record_id", *others).orderBy("step_idx")
        before = F.when(F.lag("step_idx").over(along) == F.col("step_idx") - 1, F.lag(value).over(along))
        return rows.withColumn("before", before).where("step_idx >= 0").select("record_id", *others, "step_idx", "before", F.col(value).alias("after"))
    single, whole = {"marginal": ("single", "base"), "loo": ("without", "full")}[how]
    rows = values.where(kind.isin(single, whole))
    common = F.max(F.when(kind == whole, F.col(value))).over(Window.partitionBy("record_id", *others))
    rows = rows.withColumn("__common", common).where(kind == single)
    before, after = ("__common", value) if how == "marginal" else (value, "__common")
    return rows.select("record_id", *others, at.alias("step_idx"), F.col(before).alias("before"), F.col(after).alias("after"))


def entropy_contrast(entropies: DataFrame, how: str) -> DataFrame:
    """record_id, step_idx and reward: by how many bits the step lowers the answer's entropy.

    entropies: CONTEXT and h_bits; how as in neighbours.
    """
    rows = neighbours(entropies.select(*CONTEXT, "h_bits"), how, "h_bits")
    return rows.select("record_id", "step_idx", (F.col("before") - F.col("after")).alias("reward"))


def contrast_terms(logprob: DataFrame, how: str) -> DataFrame:
    """The terms of a contrast before any mean: per template, target and step before, after and delta."""
    rows = neighbours(logprob.select(*CONTEXT, "template_id", "target_kind", "target_idx", "lp_sum"), how, "lp_sum")
    return rows.withColumn("delta", F.col("after") - F.col("before"))


def sampled_gain(samples: DataFrame) -> DataFrame:
    """Per record and step the mean of lp_after - lp_before over samples with a parsed answer, 0 without.

    samples: record_id, step_idx, parsed, lp_before, lp_after; answers were drawn after the step.
    """
    gain = F.when(F.coalesce(F.col("parsed") != "", F.lit(False)), F.col("lp_after") - F.col("lp_before"))
    return samples.groupBy("record_id", "step_idx").agg(F.coalesce(F.avg(gain), F.lit(0.0)).alias("reward"))


def masking_contribution(original: DataFrame, masked: DataFrame, value: str = "value") -> DataFrame:
    """What a step's value loses when its numbers are masked, to four digits."""
    after = masked.select("record_id", "step_idx", F.col(value).alias("__masked"))
    return original.join(after, ["record_id", "step_idx"]).select("record_id", "step_idx", F.round(F.col(value) - F.col("__masked"), 4).alias("contribution"))


def support_sweep(logits: DataFrame, configs: DataFrame, keys: tuple[str, ...] = ("record_id", "pos")) -> DataFrame:
    """Per position and config (config, top_k, top_p): support, the share of mass in it, logp of gold.

    Tokens are ranked once; each meets every config, of which there are a fixed few.
    """
    whole, ranked = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("logit"), "token_id")
    rows = logits.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(whole)))
    rows = rows.withColumns({"p": F.col("e") / F.sum("e").over(whole), "place": F.row_number().over(ranked)}).withColumn("mass", F.sum("p").over(ranked) - F.col("p"))
    held = rows.crossJoin(F.broadcast(configs)).where((F.col("place") <= F.col("top_k")) | (F.col("mass") < F.col("top_p")) | F.col("is_gold"))
    gold = F.sum(F.when(F.col("is_gold"), F.col("e")))
    return held.groupBy("config", *keys).agg(F.count(F.lit(1)).alias("support"), F.sum("p").alias("covered"), F.coalesce(F.log(gold / F.sum("e")), F.lit(float("-inf"))).alias("logp"))


def order_gains(orders: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """record_id, step_idx and gain: by how much the value at each place of an order is above the place before.

    orders: record_id, perm, pos, step_idx; values: record_id, perm, pos and the value, both with a row for
    a place. They are laid over each other and grouped, not joined, so tables that are dealt by record stay
    where they are.
    """
    place = ["record_id", "perm", "pos"]
    steps = orders.select(*place, "step_idx", F.lit(None).cast(values.schema[value].dataType).alias("value"))
    both = steps.unionByName(values.select(*place, F.lit(None).cast(orders.schema["step_idx"].dataType).alias("step_idx"), F.col(value).alias("value")))
    rows = both.groupBy(*place).agg(F.max("step_idx").alias("step_idx"), F.max("value").alias("value"))
    along = Window.partitionBy("record_id", "perm").orderBy("pos")
    before = F.when(F.lag("pos").over(along) == F.col("pos") - 1, F.lag("value").over(along))
    return rows.withColumn("gain", F.col("value") - before).where("gain is not null and step_idx is not null").select("record_id", "step_idx", "gain")


def entropy_shapley(orders: DataFrame, perm_entropy: DataFrame) -> DataFrame:
    """record_id, step_idx and reward: by how many bits each step lowers the answer's entropy beyond
    what stands before it, on average over the orders.

    orders: record_id, perm, pos, step_idx. perm_entropy: record_id, perm, pos and h_bits, where pos -1 is
    the empty context and pos p the first p + 1 steps of the order; a place without both has no part.
    """
    rows = order_gains(orders, perm_entropy, "h_bits")
    return rows.groupBy("record_id", "step_idx").agg((-F.avg("gain")).alias("reward"))


def prompt_grid(records: DataFrame, templates: DataFrame, kinds: tuple[str, ...] = ("base", "prefix", "single", "without", "full"), joint: str = "\n") -> DataFrame:
    """Every prompt and target that a scorer is asked for: record, template, context and target.

    records: record_id, question, steps, gold, negatives; templates: template_id and template with
    {question} and {context} (a fixed few). No step stands in the base context.
    """
    made = contexts("record_id", F.lit(None).cast("string"), F.col("steps"), joint)
    kind = lambda name, texts: F.transform(texts, lambda t, i: F.struct(F.lit(name).alias("context_kind"), i.alias("context_idx"), t.alias("context")))
    texts = {"base": F.array(F.lit("")), "full": F.array(made["full"])} | {k: made[k] for k in ("prefix", "single", "without")}
    target = lambda name, t, i: F.struct(F.lit(name).alias("target_kind"), i.alias("target_idx"), t.alias("target"))
    targets = F.concat(F.array(target("gold", F.col("gold"), F.lit(0))), F.transform("negatives", lambda t, i: target("neg", t, i)))
    rows = records.select("record_id", "question", targets.alias("targets"), F.explode(F.flatten(F.array(*[kind(k, texts[k]) for k in kinds]))).alias("c"))
    rows = rows.crossJoin(F.broadcast(templates)).select("*", F.explode("targets").alias("t"))
    prompt = filled(F.col("template"), question=F.col("question"), context=F.col("c.context"))
    return rows.select("record_id", "template_id", "c.context_kind", "c.context_idx", "t.target_kind", "t.target_idx", prompt.alias("prompt"), "t.target")
