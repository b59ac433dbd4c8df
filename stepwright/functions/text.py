"""Text of annotated records: cleaning, splitting into steps, labels, markers; all as columns.

Patterns are written for Java with Unicode classes, so they agree with patterns of other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = r"(?i)\bstep\s*\d+\s*:"
#: Marks the end of a step in raw annotated text. Fixed value.
RAW_MARKER = " ки"
ANSWER = r"(?i)the\s+answer\s+is\s*:"


def clean_spaces(text: Column) -> Column:
    """No-break and zero-width spaces to blanks, runs of blanks and tabs to one, none before a newline."""
    text = F.regexp_replace(text, "[\u00a0\u200b]", " ")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    return F.trim(F.regexp_replace(text, " +\\n", "\n"))


def squeeze_spaces(text: Column) -> Column:
    """All white space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)[\\s\u200b]+", " "))


#: What squeeze_spaces changes in lines: white space but blanks and line ends, and blanks beside others or at an end.
LOOSE = "[\t\u000b-\r\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]| (?=[ \n]|\\z)|(?<![^\n]) "


def squeezed_lines(steps: Column) -> Column:
    """squeeze_spaces of each step, a line each; steps that need none are told by one look at all of them."""
    joined = F.array_join(steps, "\n", "")
    ends = F.length(joined) - F.length(F.replace(joined, F.lit("\n"), F.lit("")))
    tight = ~joined.rlike(LOOSE) & (ends < F.greatest(F.size(steps), F.lit(1)))
    return F.when(tight, joined).otherwise(F.array_join(F.transform(steps, squeeze_spaces), "\n"))


def question_of(text: Column) -> Column:
    """What stands before the first step, answer clause, step marker of raw text or calculation (`<<`)."""
    before = F.regexp_extract(clean_spaces(text), r"(?is)^(.*?)(?:\bstep\s*\d+\s*:|\bthe\s+answer\s+is\s*:|$)", 1)
    return F.regexp_replace(F.substring_index(F.substring_index(before, RAW_MARKER, 1), "<<", 1), r"\A\s+|\s+\z", "")


def strip_sign(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*[+-]\s*$", ""))


def answer_of(text: Column) -> Column:
    """What follows the answer clause, to the line's end, without a trailing sign."""
    return strip_sign(F.regexp_extract(clean_spaces(text), r"(?i)the\s+answer\s+is\s*:\s*([^\n]*)", 1))


def bodies_of(text: Column) -> Column:
    """The steps' texts: after each 'Step n:', up to the next or the answer clause, signs stripped."""
    parts = F.split(clean_spaces(text), STEP)
    bodies = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(bodies, lambda b: strip_sign(F.split(b, ANSWER, 2)[0]))


def parse_records(records: DataFrame) -> DataFrame:
    """record_id, question, steps, step_pm, correct_mask, gold_answer, answer_target, task.

    records: record_id, label (question, steps with signs, answer clause), value (signs per step,
    null without), gold_answer (overrides the parsed one) and task. The mask comes from value,
    1 for '+'; a step beyond it gets 0.
    """
    bodies = bodies_of(F.col("label"))
    gold = F.coalesce(F.nullif(F.trim("gold_answer"), F.lit("")), answer_of(F.col("label")))
    rows = records.select(
        "record_id", question_of(F.col("label")).alias("question"), bodies.alias("bodies"), "value", gold.alias("gold_answer"), "task"
    )
    n = F.size("bodies")
    each = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    sign = lambda i: F.coalesce(F.try_element_at("value", i), F.lit("-"))
    per = lambda f: F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(each, f))
    return rows.select(
        "record_id", "question",
        per(lambda i: F.concat(F.lit("Step "), i.cast("string"), F.lit(": "), F.get("bodies", i - 1))).alias("steps"),
        per(sign).alias("step_pm"),
        F.transform(per(sign), lambda s: (s == "+").cast("int")).alias("correct_mask"),
        "gold_answer", F.concat(F.lit("The answer is: "), F.col("gold_answer")).alias("answer_target"), "task",
    )


def split_steps(text: Column, marker: str = "<extra_0>") -> Column:
    """Steps of a generated solution by the first rule that applies: the marker; 'Step k:' lines;
    paragraphs; lines. An answer line ends the steps unless there are markers; null has no steps."""
    text = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n"))
    body = F.regexp_replace(F.regexp_replace(text, r"(?ims)^\s*(?:answer\s*:|the\s+answer\s+is)\b.*", ""), r"\A\s+|\s+\z", "")
    kept = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    steps = kept(F.transform(F.split(body, r"(?im)(?=^\s*step\s*\d+\s*:)"), lambda p: F.regexp_replace(p, r"(?i)^\s*step\s*\d+\s*:\s*", "")))
    return (
        F.when(F.contains(text, F.lit(marker)), kept(F.split(text, f"\\Q{marker}\\E")))
        .when(F.regexp_like(body, F.lit(r"(?im)^\s*step\s*\d+\s*:")), steps)
        .when(F.regexp_like(body, F.lit(r"\n\s*\n")), kept(F.split(body, r"\n\s*\n")))
        .otherwise(kept(F.split(body, "\n")))
    )


def solution_sentences(text: Column) -> Column:
    """Sentences of a solution; a point inside a number does not end one."""
    return F.filter(F.transform(F.split(text, r"(?<=\.)(?!\d)\s+"), lambda s: F.trim(s)), lambda s: s != "")


def renumber(steps: Column) -> Column:
    """Steps with their leading tag replaced by their place."""
    return F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), F.regexp_replace(s, r"(?i)^\s*step\s*\d+\s*:\s*", "")))


def mask_numbers(text: Column, mask: str = "[MASKED]") -> Column:
    """Fractions and numbers replaced by a mask."""
    return F.regexp_replace(text, r"\\d?frac\{[^{}]*\}\{[^{}]*\}|\d+(?:[.,/]\d+)*", mask)


def judge_score(text: Column) -> Column:
    """The number after 'SCORE:', cut to [0, 1]; 0.5 if there is none."""
    found = F.nullif(F.regexp_extract(text, r"(?i)score\s*[:=]\s*(-?\d*\.?\d+)", 1), F.lit(""))
    number = F.coalesce(found.try_cast("double"), F.lit(0.5))  # greatest() would take 0.0 for a null
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))


def next_step_of(text: Column) -> Column:
    """First line without its step tag; null for an answer line."""
    line = F.trim(F.regexp_replace(F.split(F.trim(text), "\n", 2)[0], r"(?i)^\s*step\s*\d+\s*:\s*", ""))
    return F.when(~F.regexp_like(line, F.lit(ANSWER)) & (line != ""), line)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
