"""Selection among candidates, voting, balanced and hashed subsets, stepwise decoding."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.operators.normalize import softmax_weights
from stepwright.operators.ordered import running


def best_of_n(candidates: DataFrame, question: str, index: str, score: str) -> DataFrame:
    """The candidate with the highest score of each question; the first index wins ties."""
    rest = [c for c in candidates.columns if c not in (question, index, score)]
    order = F.struct(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("s"), (-F.col(index)).alias("i"), F.col(score).alias("v"), *rest)
    best = candidates.groupBy(question).agg(F.max(order).alias("b"))
    return best.select(question, (-F.col("b.i")).alias(index), F.col("b.v").alias(score), *[f"b.{c}" for c in rest])


def majority_vote(candidates: DataFrame, question: str, index: str, answer: str, score: str | None = None, temperature: float = 1.0, tie: str = "first") -> DataFrame:
    """The answer with the most votes of each question, and a candidate that gave it.

    Votes count 1, or the softmax of the scores if a score is named. Empty answers don't vote.
    Ties within 1e-12 go to the answer seen first, or with tie='score' to the best score.
    """
    rows = candidates.where(F.col(answer).isNotNull() & (F.col(answer).cast("string") != ""))
    rows = softmax_weights(rows, score, [question], temperature) if score else rows.withColumn("weight", F.lit(1.0))
    best = F.max(F.col(score).cast("double")) if score else F.lit(0.0)
    votes = rows.groupBy(question, answer).agg(F.sum("weight").alias("votes"), F.min(index).alias("first_index"), best.alias("best_score"), F.count(F.lit(1)).alias("n_votes"))
    lead = F.max("votes").over(Window.partitionBy(question))
    order = [F.desc("best_score"), "first_index"] if tie == "score" else ["first_index"]
    place = F.row_number().over(Window.partitionBy(question).orderBy(*order))
    return votes.withColumn("__lead", lead).where(F.col("votes") >= F.col("__lead") - 1e-12).withColumn("__place", place).where("__place = 1").drop("__lead", "__place")


def single_accuracy(candidates: DataFrame, index: str, correct: Column) -> DataFrame:
    """Accuracy in percent of the first candidates."""
    return candidates.where(F.col(index) == 0).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(correct.cast("double"))).alias("accuracy"))


def hashed(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def balanced_subset(df: DataFrame, group: str, groups: list[str], size: int, seed: int, *ids: str) -> DataFrame:
    """size rows in equal parts of the groups (the first ones get what is left over), by hash."""
    share, more = divmod(size, len(groups))
    quota = F.element_at(F.create_map(*[F.lit(x) for i, g in enumerate(groups) for x in (g, share + (i < more))]), F.col(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(hashed(seed, *ids), *ids))
    return df.where(F.col(group).isin(groups)).withColumn("__place", place).where(F.col("__place") <= quota).drop("__place")


def hash_split(df: DataFrame, share: float, seed: int, *ids: str) -> DataFrame:
    """df with is_train: true for about share of the ids, the same in every run."""
    u = F.conv(F.substring(hashed(seed, *ids), 1, 7), 16, 10).cast("double") / float(16**7)
    return df.withColumn("is_train", u < share)


def hash_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows without replacement, the first by hash."""
    return df.orderBy(hashed(seed, *ids), *ids).limit(n)


def dev_budget(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n records in order, on which thresholds are tuned."""
    return df.orderBy(*order).limit(n)


def row_range(df: DataFrame, order: str, start: int, stop: int | None = None) -> DataFrame:
    """The rows from place start (from 0) up to stop in the order of a column without repeats, null last.

    Places are running counts over parts of the order, so no task sorts or takes all rows.
    """
    held = df.withColumn("__one", F.lit(1))
    placed = running(held.where(F.col(order).isNotNull()), order, ["__one"]).withColumn("__place", F.col("cum___one") - 1)
    inside = placed.where((F.col("__place") >= start) & (F.lit(True) if stop is None else F.col("__place") < stop))
    return inside.select(*df.columns)


def shard(df: DataFrame, shards: int, number: int, *order: str) -> DataFrame:
    """The rows of one of shards contiguous slices of equal length in the given order.

    Places are found from bucket counts of the first order column, not by one global sort.
    """
    from stepwright.operators.ordered import running

    counts = df.groupBy(order[0]).agg(F.count(F.lit(1)).alias("c"))
    starts = running(counts, order[0], ["c"]).select(order[0], (F.col("cum_c") - F.col("c")).alias("__before"))
    total = df.count()
    length = -(-total // shards)
    place = F.col("__before") + F.row_number().over(Window.partitionBy(order[0]).orderBy(*order)) - 1
    return df.join(starts, order[0]).withColumn("__place", place).where((F.col("__place") >= number * length) & (F.col("__place") < (number + 1) * length)).drop("__before", "__place")


def greedy_balance(counts: DataFrame, group: str, record: str, plus: str, minus: str, size: int) -> DataFrame:
    """Up to size records per group so that signs stay balanced.

    Records are in classes by their dominant sign; each next record is the first, in the order of
    |plus - minus| and record, of the class that works against the running imbalance. A class is
    only read from its front, so its first size records are all that the choice can need: they are
    cut in Spark, and one task sees 3 * size rows of a group at most.
    """
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(gap=frame[plus] - frame[minus])
        frame = frame.iloc[frame["gap"].abs().to_numpy().argsort(kind="stable")]
        queues = {s: frame[frame["gap"].map(lambda g: (g > 0) - (g < 0)) == s].to_dict("records")[::-1] for s in (1, -1, 0)}
        taken, balance = [], 0
        while len(taken) < size and any(queues.values()):
            wanted = (-1, 0, 1) if balance > 0 else (1, 0, -1) if balance < 0 else (0, 1, -1)
            row = next(queues[s] for s in wanted if queues[s]).pop()
            balance += row["gap"]
            taken.append((row[group], row[record], len(taken), int(balance)))
        return pd.DataFrame(taken, columns=[group, record, "pick", "balance"])

    gap = F.col(plus) - F.col(minus)
    side = F.when(gap > 0, 1).when(gap < 0, -1).otherwise(0)
    place = F.row_number().over(Window.partitionBy(group, "__side").orderBy(F.abs(gap).asc_nulls_last(), record))
    rows = counts.select(group, record, plus, minus, side.alias("__side")).withColumn("__place", place)
    rows = rows.where(F.col("__place") <= size).select(group, record, plus, minus)
    sorted_pick = lambda frame: pick(frame.sort_values(record, kind="stable"))
    return rows.groupBy(group).applyInPandas(sorted_pick, f"{group} {kinds[group]}, {record} {kinds[record]}, pick long, balance long")


def stepwise_decode(questions: DataFrame, propose: Callable[[DataFrame, int], DataFrame], max_steps: int, materialise: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Score-guided decoding with one kept candidate per step.

    questions: question_id. propose(state, k) gives question_id, cand_idx, step_text and score of
    the candidates for step k, where state has question_id and steps so far. A question stops
    without candidates, at a repeated step, or after max_steps. Each round is one DataFrame.
    """
    state = questions.select("question_id", F.array().cast("array<string>").alias("steps"), F.array().cast("array<double>").alias("scores"), F.lit(False).alias("stopped"))
    for k in range(max_steps):
        found = best_of_n(propose(state.where("not stopped"), k), "question_id", "cand_idx", "score")
        joined = state.join(found, "question_id", "left")
        goes = ~F.col("stopped") & F.col("step_text").isNotNull()
        again = F.coalesce(F.try_element_at("steps", F.lit(-1)) == F.col("step_text"), F.lit(False))
        state = materialise(
            joined.select(
                "question_id",
                F.when(goes & ~again, F.concat("steps", F.array("step_text"))).otherwise(F.col("steps")).alias("steps"),
                F.when(goes & ~again, F.concat("scores", F.array(F.col("score").cast("double")))).otherwise(F.col("scores")).alias("scores"),
                (F.col("stopped") | ~goes | again).alias("stopped"),
            )
        )
    return state
