"""Operators that must do the whole job: all rows, all rules, all groups."""

import re

import numpy as np
import pytest

from stepwright.operators import match, select, stats
from stepwright.plans import queries


def tau_b(x, y):
    a, b = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    return (a * b).sum() / np.sqrt((a != 0).sum() * (b != 0).sum())


@pytest.mark.parametrize("n, kx, ky", [(6000, 400, 2), (5000, 1000, 37), (300, 5, 300)])
def test_kendall_counts_all_rows(spark, n, kx, ky):
    rng = np.random.default_rng(n)
    x = rng.integers(0, kx, n)
    y = (x * ky // kx + rng.integers(0, ky, n)) // 2
    rows = list(zip(x.tolist(), y.tolist()))
    got = stats.kendall(spark.createDataFrame([*rows, (None, 1), (1, None)], "x long, y long"), "x", "y").first()
    assert got["n"] == n and got["tau"] == pytest.approx(tau_b(x, y))


def test_kendall_of_constants(spark):
    got = stats.kendall(spark.createDataFrame([(1, 2), (1, 3)], "x long, y long"), "x", "y").first()
    assert got["n"] == 2 and np.isnan(got["tau"])
    assert stats.kendall(spark.createDataFrame([], "x long, y long"), "x", "y").first()["n"] == 0


def greedy(rows, size):
    left = {s: sorted((abs(p - m), r, p - m) for r, p, m in rows if (p > m) - (p < m) == s) for s in (1, 0, -1)}
    taken, balance = [], 0
    while len(taken) < size and any(left.values()):
        order = (-1, 0, 1) if balance > 0 else (1, 0, -1) if balance < 0 else (0, 1, -1)
        _, r, gap = next(left[s] for s in order if left[s]).pop(0)
        balance += gap
        taken.append((r, len(taken), balance))
    return taken


def test_greedy_balance_hands_few_rows_to_a_task(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 10 else "b", i, int(p), int(m)) for i, (p, m) in enumerate(rng.integers(0, 6, (3000, 2)))]
    rows += [("few", 5000, 2, 0), ("few", 5001, 1, 1)]
    picked = select.greedy_balance(spark.createDataFrame(rows, "g string, r long, p long, m long"), "g", "r", "p", "m", 20)
    for g in ("hot", "b", "few"):
        got = sorted((r["r"], r["pick"], r["balance"]) for r in picked.where(f"g = '{g}'").collect())
        assert got == sorted(greedy([r[1:] for r in rows if r[0] == g], 20))
    assert "WindowGroupLimit" in picked._jdf.queryExecution().toString()


def steps_of(text):
    """The rules by plain reading of lines."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    if "<extra_0>" in text:
        return [p.strip() for p in text.split("<extra_0>") if p.strip()]
    lines = []
    for line in text.split("\n"):
        if re.match(r"(?i)\s*(?:answer\s*:|the\s+answer\s+is)\b", line):
            break
        lines.append(line)
    if any(re.match(r"(?i)\s*step\s*\d+\s*:", x) for x in lines):
        parts = [[]]
        for x in lines:
            tag = re.match(r"(?i)\s*step\s*\d+\s*:", x)
            parts = [*parts, [x[tag.end() :]]] if tag else [*parts[:-1], parts[-1] + [x]]
        return [p for p in ("\n".join(q).strip() for q in parts) if p]
    body = "\n".join(lines).strip()
    return [p.strip() for p in (re.split(r"\n\s*\n", body) if re.search(r"\n\s*\n", body) else lines) if p.strip()]


def test_split_steps_of_all_documents(spark, tmp_path):
    texts = [None, "", " \n ", "a\nb", "a\n\nb\nc\n \nd", "Step 1: x\nmore\n\nstep 2 : y\nThe answer is: 4\nz", "intro\nStep 1: x", "p\r\n\r\nq", "a <extra_0> b\n\nc", "one\nAnswer:5\ntwo", "see Step 1: here\nb", "a\nb\n\n", "a\nb\n\nThe answer is 3"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n"] for r in queries.QUERIES["split_steps"](spark, str(tmp_path)).collect()}
    assert got == {i: len(steps_of(t)) for i, t in enumerate(texts)}


def test_gold_is_attached_by_similar_questions(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcde "), int(n))).strip() for n in rng.integers(9, 120, 60)]
    index = [("abc"[i % 3], " ".join(t.split()), f"g{i}") for i, t in enumerate(texts)]
    index += [("b", index[0][1] + "x", "near"), ("a", index[1][1] + "y", "near too")]
    records = []
    for i, (_, q, _) in enumerate(index * 3):
        at = rng.integers(0, len(q), int(rng.integers(0, 5)))
        q = "".join("" if k in at and rng.random() < 0.5 else c + ("z" if k in at else "") for k, c in enumerate(q))
        records.append((i, ["m", "other", None][i % 3], q))
    records += [(900, "m", ""), (901, "m", None), (902, "m", index[1][1])]

    def answer(task, q):
        q = " ".join((q or "").split())
        exact = {s: sorted((k, g) for t, k, g in index if t == s and k == q) for s in "abc"}
        ratios = {s: sorted((-match.indel_ratio(q, k), k, g) for t, k, g in index if t == s and q and match.indel_ratio(q, k) >= 0.95) for s in "abc"}
        asks = [(s, kind) for s in "ab" for kind in ("exact", "fuzzy")] if task == "m" else [(s, kind) for kind in ("exact", "fuzzy") for s in "cab"]
        for s, kind in asks:
            hits = (exact if kind == "exact" else ratios)[s]
            if hits:
                return hits[0][-1], s, kind
        return None, "none", "none"

    got = match.attach_gold(
        spark.createDataFrame(records, "record_id long, task string, question string"),
        spark.createDataFrame(index, "source string, question string, answer string"), {"m": ["a", "b"]}, ["c", "a", "b"],
    )
    found = {r["record_id"]: (r["gold_answer"], r["match_source"], r["match_type"]) for r in got.collect()}
    assert found == {i: answer(t, q) for i, t, q in records}
    assert {t for _, _, t in found.values()} == {"exact", "fuzzy", "none"}
