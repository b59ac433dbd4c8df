"""Partners of records: questions of few and of many solutions against a plain search, and how often records are made."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from stepwright.functions.text import squeeze_spaces, squeezed_lines
from stepwright.operators import match, merge
from stepwright.plans import more, queries  # noqa: F401


def spaced(text):
    return " ".join((text or "").replace("\u200b", " ").split())


def best_of(record, other, least):
    """match and reward by looking at every row of other."""
    key = lambda r: (spaced(r[0]), None if r[1] is None else "\n".join(map(spaced, r[1])))
    q, text = key(record)
    ranked = sorted((r for r in other if spaced(r[0]) == q), key=lambda r: r[3])
    same = [r for r in ranked if key(r)[1] == text]
    if same:
        return "exact", same[-1][2]
    near = [(-s, r[3], r[2]) for r in ranked if text is not None and key(r)[1] is not None and (s := SequenceMatcher(None, text, key(r)[1]).ratio()) >= least]
    return ("fuzzy", min(near)[2]) if near else ("none", None)


@pytest.mark.parametrize("held", [64, 3, 0])
def test_partners_against_all_rows(spark, monkeypatch, held):
    """Questions with more solutions than a row may hold are joined instead, with the same partners."""
    monkeypatch.setattr(merge, "OTHERS_HELD", held)
    rng = random.Random(held)
    words = lambda: ["".join(rng.choice("ab ") for _ in range(rng.randrange(9))) + rng.choice(["", " \u200b", "  x"]) for _ in range(rng.randrange(4))]
    bank = [words() for _ in range(12)] + [["the long solution of a question", "with its two steps"], ["a" * 150, "b" * 70], None, [], [""]]
    vary = lambda s: s if s is None or rng.random() < 0.4 else [*s[:-1], (s[-1] if s else "") + rng.choice(["!", "", "?!", " "])]
    question = lambda: rng.choice([" q  one", "q one ", "q two", "q three", None])
    base = [(i, question(), vary(rng.choice(bank)), [1.0]) for i in range(150)]
    other = [(question(), vary(rng.choice(bank)), rng.choice([None, [float(i)]]), i) for i in rng.sample(range(90), 90)] + [("q four", ["s"], [0.5], 90)]
    left = spark.createDataFrame(base, "id int, question string, steps array<string>, reward array<double>")
    right = spark.createDataFrame(other, "question string, steps array<string>, new array<double>, at int")
    theirs = merge.keyed(right.withColumnRenamed("new", "__reward")).select("__q", "__text", "__reward", "at")
    assert (merge.crowded(theirs) is None) == (held == 64)
    got = {r["id"]: (r["match"] or "none", r["__reward"]) for r in merge.partners(merge.keyed(left), theirs, "id", "at", 0.9).collect()}
    want = {r[0]: best_of(r[1:], other, 0.9) for r in base}
    assert got == want and {m for m, _ in want.values()} == {"exact", "fuzzy", "none"}


@pytest.mark.parametrize("name", ["merge_policy", "random_tail_merge", "merge_counts"])
def test_records_are_made_once_for_each_side(spark, monkeypatch, name):
    """Neither grams nor pairs are made, and lines are gathered by each side only once."""
    monkeypatch.setattr(merge, "near_texts", None)
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    shown = rows._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("collect_list(struct(l_linenumber") == 2 and "Window [" not in shown


def test_squeezed_lines(spark):
    rng = random.Random(5)
    odd = ["a", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u1680", "\u180e", "\u2000", "\u200a", "\u200b", "\u200c", "\u2028", "\u202f", "\u205f", "\u3000", "\ufeff"]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(odd if rng.random() < 0.3 else "ab c") for _ in range(rng.randrange(6)))
    rows = [([text() for _ in range(rng.randrange(4))],) for _ in range(4000)] + [(None,), ([],), ([""],), (["", ""],), (["a\nb"],), (["a\n"],), ([" a"],), (["a ", "b"],)]
    df = spark.createDataFrame(rows, "s array<string>")
    each = F.array_join(F.transform("s", squeeze_spaces), "\n")
    assert df.where(~squeezed_lines(F.col("s")).eqNullSafe(each)).count() == 0


def test_block_ratio_of_parts():
    rng = random.Random(6)
    for n in (0, 1, 5, 60, 199, 200, 260):
        for _ in range(20):
            b = "".join(rng.choice("ab c") for _ in range(n))
            i = rng.randrange(n + 1)
            a = b[i : i + rng.randrange(n + 1)]
            for p, q in ((a, b), (b, a), (a + "x", b)):
                assert match.block_ratio(p, q) == SequenceMatcher(None, p, q).ratio()
