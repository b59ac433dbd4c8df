"""Merging two sets of rewards for the same solutions, and the index of gold answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions.text import squeeze_spaces, squeezed_lines
from stepwright.operators.match import closest_udf, near_texts, record_key, unique_by
from stepwright.operators.rewards import elementwise_sum, unit_draw


def keyed(records: DataFrame, question: str = "question", steps: str = "steps") -> DataFrame:
    """records with __q (question) and __text (steps, a line each), white space squeezed."""
    return records.withColumns({"__q": squeeze_spaces(F.col(question)), "__text": squeezed_lines(F.col(steps))})


#: Solutions of a question that its records hold beside them, and buckets in which they are counted before.
OTHERS_HELD, QUESTION_BUCKETS = 64, 1 << 16


def crowded(theirs: DataFrame) -> DataFrame | None:
    """__q of the questions with more than OTHERS_HELD rows, or None if there are none.

    Rows are counted by buckets of questions first. A bucket that has hardly more than the others
    is not looked into, so what a question may hold is that excess more.
    """
    bucket = F.pmod(F.xxhash64("__q"), F.lit(QUESTION_BUCKETS))
    counts = {r[0]: r[1] for r in theirs.groupBy(bucket).count().collect()}
    usual = sum(counts.values()) / QUESTION_BUCKETS
    full = [b for b, n in counts.items() if n > OTHERS_HELD + usual + 6 * usual**0.5]
    if not full:
        return None
    many = theirs.where(bucket.isin(full)).groupBy("__q").count().where(F.col("count") > OTHERS_HELD).select("__q")
    return None if many.isEmpty() else many


def partners_held(mine: DataFrame, theirs: DataFrame, order: str, least: float) -> DataFrame:
    """mine (see keyed) with __reward and match of each row's partner, null without one.

    Each question is gathered once and its solutions go to its records, which choose from them.
    """
    hashed = lambda df: df.withColumn("__h", F.xxhash64("__q"))  # noqa: E731  numbers are sorted faster than texts
    row = F.struct(F.col(order).alias("place"), F.col("__text").alias("text"), F.col("__reward").alias("reward"))
    held = hashed(theirs).groupBy("__h", "__q").agg(F.sort_array(F.collect_list(row)).alias("__held"))
    rows = hashed(mine).join(held, ["__h", "__q"], "left")
    rows = rows.withColumn("__exact", F.try_element_at(F.filter("__held", lambda h: h["text"].eqNullSafe(F.col("__text"))), F.lit(-1)))
    exact = F.col("__exact").isNotNull()
    asked = lambda c: F.when(~exact & F.col("__text").isNotNull(), c)
    rows = rows.withColumn("__at", closest_udf("blocks", least)(asked(F.col("__text")), asked(F.transform("__held", lambda h: h["text"]))))
    return rows.withColumns({
        "__reward": F.when(exact, F.col("__exact.reward")).otherwise(F.get("__held", F.col("__at"))["reward"]),
        "match": F.when(exact, "exact").when(F.col("__at").isNotNull(), "fuzzy"),
    }).drop("__h", "__held", "__exact", "__at")


def partners_joined(mine: DataFrame, theirs: DataFrame, record: str, order: str, least: float) -> DataFrame:
    """As partners_held for questions with many solutions: no row holds another's."""
    keyed_ = lambda df: df.withColumn("__key", F.sha2(F.to_json(F.struct("__q", "__text")), 256))
    mine, theirs = keyed_(mine), keyed_(theirs)
    last = unique_by(theirs, ["__key"], [F.col(order)], "last").select("__key", "__reward", F.lit("exact").alias("match"))
    exact = mine.join(last, "__key", "left")
    fuzzy = fuzzy_of(exact.where("match is null"), theirs, record, order, least).withColumnRenamed("__reward", "__near")
    rows = exact.join(fuzzy, record, "left")
    return rows.withColumns({
        "__reward": F.coalesce("__reward", "__near"), "match": F.coalesce("match", F.when(F.col("similarity").isNotNull(), "fuzzy")),
    }).drop("__key", "__near", "similarity")


def partners(mine: DataFrame, theirs: DataFrame, record: str, order: str, least: float) -> DataFrame:
    """mine with __reward and match: the last row of theirs in order with equal question and steps, else
    the most similar of the same question."""
    many = crowded(theirs)
    if many is None:
        return partners_held(mine, theirs, order, least)
    rest = [df.join(many, "__q", "left_anti") for df in (mine, theirs)]
    some = [df.join(many, "__q", "left_semi") for df in (mine, theirs)]
    return partners_held(*rest, order, least).unionByName(partners_joined(*some, record, order, least))


def fuzzy_of(missing: DataFrame, other: DataFrame, record: str, order: str, least: float) -> DataFrame:
    """Per record without an exact partner the most similar solution of the same question, the first
    in order among equals, if its similarity reaches least.

    Different solutions of a question are found by their rare grams and compared once.
    """
    held = other.select("__q", F.col("__text").alias("__other_text"), "__reward", F.col(order).alias("__place"))
    named = lambda df, text: df.select(F.col("__q").alias("block"), F.col(text).alias("text"))
    near = near_texts(named(missing, "__text"), named(held, "__other_text"), least, "blocks")
    near = near.select(F.col("block").alias("__q"), F.col("left_text").alias("__text"), F.col("right_text").alias("__other_text"), "similarity")
    pairs = missing.select(record, "__q", "__text").join(near, ["__q", "__text"]).join(held, ["__q", "__other_text"])
    best = F.row_number().over(Window.partitionBy(record).orderBy(F.desc("similarity"), "__place"))
    return pairs.withColumn("__best", best).where("__best = 1").select(record, "__reward", "similarity")


def merge_records(
    base: DataFrame, other: DataFrame, record: str, base_reward: str, reward: str, order: str,
    switch_at: int = 1, least: float = 0.95, lengths: str = "trim", tail: str = "other", seed: int = 0,
) -> DataFrame:
    """Rewards of base up to switch_at and those of other from there, per record of base.

    base and other: question and steps; other's last row in order of equal solutions counts. A
    record finds its partner by question and steps, else by similar steps of the same question.
    Without a partner its first switch_at base rewards stay; without steps or base rewards it goes.
    Adds step_reward, match (exact, fuzzy, none), n_kept, ragged and trimmed, and cuts steps.

    lengths: trim cuts to the shortest of steps and rewards; strict leaves step_reward of ragged
    rows null, for a user to look at, and stops no other row. tail: other takes other's rewards,
    uniform takes seeded draws instead, and then rows that are ragged (if strict) or without a
    partner are left out.
    """
    if lengths not in ("trim", "strict") or tail not in ("other", "uniform"):
        raise ValueError(f"unknown lengths {lengths!r} or tail {tail!r}")
    mine, theirs = keyed(base), keyed(other.select("question", "steps", F.col(reward).alias("__reward"), order)).select("__q", "__text", "__reward", order)
    nothing = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    # sizes are taken before rows are joined, so arrays that nobody asks for stay behind
    mine = mine.withColumn(base_reward, nothing(base, base_reward)).withColumns({"__n_steps": F.greatest(F.size("steps"), F.lit(0)), "__n_base": F.size(base_reward)})
    rows = partners(mine, theirs, record, order, least)
    rows = rows.withColumns({"__reward": F.coalesce("__reward", F.array().cast(other.schema[reward].dataType)), "match": F.coalesce("match", F.lit("none"))})
    n_steps, n_base, n_other = F.col("__n_steps"), F.col("__n_base"), F.size("__reward")
    none = F.col("match") == "none"
    kept = F.least(n_steps, n_base, F.when(none, switch_at).when(n_other > 0, n_other).otherwise(n_steps))
    rows = rows.withColumns({"n_kept": kept, "ragged": ~none & ((n_steps != n_base) | (n_base != n_other)), "trimmed": ~none & (kept != n_steps)})
    rows = rows.where(~none | ((n_steps > 0) & (n_base > 0)))
    n = F.col("n_kept")
    head = F.slice(base_reward, F.lit(1), F.least(n, F.lit(switch_at)))
    rest = F.slice("__reward", F.lit(switch_at + 1), F.greatest(n - switch_at, F.lit(0)))
    if tail == "uniform":
        rest = F.transform(rest, lambda _, i: unit_draw(seed, F.col(record), i + switch_at))
        rows = rows.where(~none & (~F.col("ragged") if lengths == "strict" else F.lit(True)))
    merged = F.concat(head, rest)
    if lengths == "strict":
        merged = F.when(~F.col("ragged"), merged)
    return rows.withColumn("step_reward", merged).withColumn("steps", F.slice("steps", F.lit(1), n)).select(record, *[c for c in base.columns if c != record], "match", "n_kept", "ragged", "trimmed", "step_reward")


def merge_counts(base: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: base records, exact and fuzzy matches, records without a partner, rows cut short."""
    total = base.agg(F.count(F.lit(1)).alias("total"))
    counts = merged.agg(F.count_if(F.col("match") == "exact").alias("exact"), F.count_if(F.col("match") == "fuzzy").alias("fuzzy"), F.count_if("trimmed").alias("trimmed"))
    return total.crossJoin(counts).select("total", "exact", "fuzzy", (F.col("total") - F.col("exact") - F.col("fuzzy")).alias("missing"), "trimmed")


def pair_join(left: DataFrame, right: DataFrame, record: str, left_reward: str, right_reward: str, order: str, tolerant: bool = True, lengths: str = "trim") -> DataFrame:
    """record, step_idx, x and y: rewards of both sides for the same question and steps.

    tolerant: white space is squeezed before solutions are compared. The first row of right in
    order counts. lengths: trim cuts to the shorter, strict leaves out pairs of unlike lengths.
    """
    exact = F.sha2(F.concat_ws("\u0001", "question", F.array_join("steps", "\u0002")), 256)
    with_key = lambda df: df.withColumn("__key", record_key(F.col("question"), F.col("steps")) if tolerant else exact)
    first = unique_by(with_key(right), ["__key"], [F.col(order)], "first").select("__key", F.col(right_reward).alias("__y"))
    both = with_key(left).join(first, "__key").select(record, F.col(left_reward).alias("__x"), "__y")
    if lengths == "strict":
        both = both.where(F.size("__x") == F.size("__y"))
    n = F.least(F.size("__x"), F.size("__y"))
    pairs = F.arrays_zip(F.slice("__x", F.lit(1), n).alias("x"), F.slice("__y", F.lit(1), n).alias("y"))
    return both.select(record, F.posexplode(pairs).alias("step_idx", "p")).select(record, "step_idx", "p.x", "p.y")


def gold_index(sources: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """source, question and answer of several tables; of equal questions of a source the table named
    first wins, and within a table the smallest answer. Rows without question or answer are left out.

    sources: (name, table, question, answer), such as a test part before the training part.
    """
    parts = [t.select(F.lit(s).alias("source"), squeeze_spaces(q).alias("question"), F.trim(a).alias("answer"), F.lit(i).alias("__table")) for i, (s, t, q, a) in enumerate(sources)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.where("question != '' and answer != ''")
    return unique_by(rows, ["source", "question"], [F.col("__table"), F.col("answer")], "first").drop("__table")


def sum_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, alpha: float = 1.0, strict: bool = False, order: str | None = None) -> DataFrame:
    """left with reward, a + alpha * b element by element, for the rows whose keys right has too.

    The first row of right in order counts for a key (any, if no order is named). Both arrays stay as
    raw_<a> and raw_<b>. Of unlike lengths the common part is taken; strict leaves such rows out. Null
    arrays, and null keys, have no partner.
    """
    one = unique_by(right, keys, [F.col(order)], "first") if order else right.dropDuplicates(keys)
    other = one.select(*keys, F.col(b).alias(f"raw_{b}")).where(F.col(f"raw_{b}").isNotNull())
    rows = left.withColumnRenamed(a, f"raw_{a}").where(F.col(f"raw_{a}").isNotNull()).join(other, keys)
    if strict:
        rows = rows.where(F.size(f"raw_{a}") == F.size(f"raw_{b}"))
    return rows.withColumn("reward", elementwise_sum(F.col(f"raw_{a}"), F.col(f"raw_{b}"), alpha))
