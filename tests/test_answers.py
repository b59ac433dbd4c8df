"""Grading, extraction and similarity on hand-written pairs."""

import pytest
from pyspark.sql import functions as F

from stepwright.functions import answers as A
from stepwright.operators.match import block_ratio, common_subsequence, indel_ratio

PAIRS = [
    (r"\frac 58", r"\frac{5}{8}", True), (r"\frac{\sqrt7}3", r"\frac{\sqrt{7}}{3}", True), (r"5\sqrt{3}", "sqrt{75}", True), (".75", r"\frac34", True),
    ("9 square feet", "9", True), (r"\dfrac{2}{9}", r"\frac{2}{9}", True), ("(4,5,6)", "(4, 5, 6)", True), (r"x \in [1,7]", "[1, 7]", True),
    (r"(-\infty,1)\cup(2,9)", r"(-\infty, 1) \cup (2, 9)", True), (r"\frac{y+2}{4}}", "y/4 + 1/2", True), ("(x+3)(x-1)", "(x + 3)(x - 1)", True),
    (r"\{3,4\}", r"\{4,3\}", True), ("(3,4)", "(4,3)", False), ("no solution", r"\emptyset", True), ("DNE", r"\infty", False), ("12,345", "12345", True),
    ("2 1/4", "2.25", True), ("75%", "0.75", True), (r"(2, \frac{\pi}{3})", r"(2,\frac{\pi}{3})", True), ("[0,2)", "[0,2]", False), ("40", "0.4", False),
    (r"\begin{pmatrix} -3/7 \\ 2 \end{pmatrix}", r"\begin{pmatrix} -\frac37 \\ 2 \end{pmatrix}", True), ("", "1", False), (None, "1", False),
    ("9**9**9**9", "1", False), ("__import__('os')", "1", False),
]


@pytest.mark.parametrize("a,b,equal", PAIRS)
def test_same_answer(a, b, equal):
    assert A.same_answer(a, b) is equal


def test_percent_and_order():
    assert A.same_answer("40", "0.4", percent=True)
    assert A.same_answer("1, 2", "2, 1", unordered=True) and not A.same_answer("1, 2", "2, 1")


def test_extraction(spark):
    rows = [("So \\boxed{\\frac{1}{2}}.", "\\frac{1}{2}"), ("The answer is: 42.", "42"), ("only 7 apples", "7"), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", A.extract_answer_udf("t"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_scorers(spark):
    rows = [("The answer is: 1,200", "steps #### 1200"), ("no number", "#### 3")]
    got = A.graded(spark.createDataFrame(rows, "generation string, gold string"), "gsm8k", "generation", "gold")
    assert [r["correct"] for r in got.collect()] == [True, False]
    rows = [("so (B) it is. \\boxed{\\text{C}}", "2"), ("Answer: A", "1")]
    got = A.graded(spark.createDataFrame(rows, "generation string, gold string"), "mmlu", "generation", "gold")
    assert [r["correct"] for r in got.collect()] == [True, False]
    rows = [("thus \\boxed{\\frac{3}{6}}", "$\\frac12$")]
    for scorer in ("math", "omni"):
        assert A.graded(spark.createDataFrame(rows, "generation string, gold string"), scorer, "generation", "gold").first()["correct"]
    assert A.graded(spark.createDataFrame([("\\boxed{017}", "17")], "generation string, gold string"), "aime", "generation", "gold").first()["correct"]


def test_numeric_columns(spark):
    rows = [("1 1/2", "1.5", True), ("25%", "0.25", True), ("-3/4", "-0.75", True), ("$1,000", "1000.0", True), ("x", "y", False), ("x", "x", True), (None, "1", False), ("1/0", "1", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", A.numeric_equal(F.col("a"), F.col("b")))
    assert all(r["got"] == r["want"] for r in df.collect())
    keys = [("the answer is: \\frac{6}{8}", "NUM:3/4"), ("0.75 m", "NUM:3/4"), ("-2/-4", "NUM:-1/2"), ("12", "NUM:12/1"), ("Blue", "blue")]
    df = spark.createDataFrame(keys, "t string, want string").withColumn("got", A.canonical_key(F.col("t")))
    assert [r["got"] for r in df.collect()][:2] == ["NUM:3/4", "NUM:3/4"]
    assert df.collect()[3]["got"] == "NUM:12/1" and df.collect()[4]["got"] == "blue"


def test_similarity():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in [("kitten", "sitting"), ("", "abc"), ("same", "same"), ("abcabba", "cbabac"), ("a" * 70 + "b", "b" + "a" * 70)]:
        assert common_subsequence(a, b) == lcs(a, b)
    assert indel_ratio("", "") == 1.0 and block_ratio("abc", "abc") == 1.0


#: Pairs with one key, and pairs with two.
SAME = [
    ("x+1", "1+x"), ("2x=4", "x=2"), ("2y=4x+2", "y-2x=1"), ("(1,2)\\cup[2,3)", "(1,3)"), (r"\{1,\{2,3\}\}", r"\{\{3,2\},1\}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}"),
    ("3:4", r"\frac34"), (r"(-\infty,0]\cup[0,\infty)", r"(-\infty,\infty)"), (r"[1,2]\cup\{3\}", r"\{3\} \cup [1, 2]"), ("x^2+y^2=1", "2x^2+2y^2=2"), (r"3\sqrt{2}", r"\sqrt{18}"),
    (r"\frac{x^2-1}{x-1}", "x+1"), (r"\frac{xy+x}{y+1}", "x"), ("8^{1/3}", "2"), (r"\frac{1}{1+\sqrt2}", r"\sqrt{2}-1"), (r"\frac{1}{2+i}", r"\frac{2-i}{5}"), ("Blue", " Blue "),
    (r"\begin{pmatrix} 1/2 \\ x+1 \end{pmatrix}", r"\begin{pmatrix} .5 \\ 1+x \end{pmatrix}"), (r"\sqrt2\sqrt3", r"\sqrt{6}"), (r"(2, \frac{\pi}{3})", r"(2,\frac13\pi)"), ("[1,3]\\cup[2,5]\\cup(7,7)", "[1,5]"),
    (r"\frac{1}{\sqrt2+\sqrt3+\sqrt5}", r"\frac{2\sqrt3+3\sqrt2-\sqrt{30}}{12}"), ("no solution", r"\varnothing"),
]
UNLIKE = [
    ("(x+2)(x+1)(x-1)(x-2)(x-3)+x", "x"), ("(1,2)\\cup(2,3)", "(1,3)"), ("(1,2)", "[1,2)"), ("(1,2)", "(2,1)"), (r"\{1,2\}", r"\{1,1,2\}"), ("2x=4", "x=3"), ("x+1", "x-1"), (r"\sqrt{5}", "5"),
    ("x^2=4", "x=2"), ("1", "-1"), ("Blue", "Red"), (r"\pi", "3.14"), (r"\{1,\{2,3\}\}", r"\{1,2,3\}"), ("x", "y"),
]


@pytest.mark.parametrize(("a", "b", "equal"), [(*p, True) for p in SAME] + [(*p, False) for p in UNLIKE])
def test_answer_keys(a, b, equal):
    assert (A.answer_key(a) == A.answer_key(b)) is equal
    assert A.same_answer(a, b) is equal and A.same_answer(b, a) is equal


def test_plus_minus():
    for a, b in ((r"1 \pm \sqrt{2}", r"1+\sqrt2, 1-\sqrt2"), (r"\pm 3", "-3, 3"), (r"2 \mp x", r"2 \pm x")):
        assert A.same_answer(a, b) and A.answer_key(a, True) == A.answer_key(b, True)
    assert not A.same_answer(r"\pm 3", "3") and not A.same_answer(r"\pm 3", "3, 3")


def test_unions_against_points():
    """Merged unions hold the same points, and equal sets of points have one key."""
    import itertools
    import random

    rng = random.Random(1)
    points = [x / 2 for x in range(-1, 10)]
    keys = {}
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            a, b = sorted(rng.choices(range(5), k=2))
            parts.append((rng.choice("(["), a, b, rng.choice(")]")))
        inside = lambda x: any((a < x or (x == a and o == "[")) and (x < b or (x == b and c == "]")) for o, a, b, c in parts)
        text = "\\cup".join(f"{o}{a},{b}{c}" for o, a, b, c in parts) + "\\cup(9,9)"
        keys.setdefault(tuple(map(inside, points)), set()).add(A.answer_key(text))
    assert all(len(k) == 1 for k in keys.values()) and len(set(itertools.chain(*keys.values()))) == len(keys) > 30


def test_forms_agree_with_values():
    """Random expressions: a form has the value of its expression, and equal forms equal values."""
    import cmath
    import random

    from stepwright.functions import algebra

    rng = random.Random(4)

    def grow(n):
        if n == 0:
            return rng.choice(["x", "y", "2", "3", "(1/2)", "sqrt(2)", "sqrt(12)", "i", "pi"])
        op = rng.choice("+-*/")
        return f"({grow(n - 1)}{op}{grow(n - 1)})"

    names = {"sqrt": cmath.sqrt, "i": 1j, "pi": cmath.pi, "x": 1.7, "y": -0.6}
    at = lambda n: cmath.sqrt(int(n[1:])) if n[0] == "√" else names[n]
    seen = 0
    for _ in range(150):
        text = grow(3)
        form = algebra.parsed(text)
        if form is None:
            continue
        value = lambda p: sum(float(c) * cmath.exp(sum(k * cmath.log(at(n)) for n, k in x)) for x, c in p.items())
        assert cmath.isclose(value(form.num) / value(form.den), eval(text, {"__builtins__": {}}, names), rel_tol=1e-6, abs_tol=1e-9)
        assert algebra.parsed(f"({text}*(x+1))/(x+1)").key() == form.key() and algebra.parsed(f"{text}+y-y").key() == form.key()
        seen += 1
    assert seen > 100


def test_forms_are_bounded():
    for text in ("9**9**9**9", "(x+y+z+1)**24*(x-y)**24", "(" * 120 + "x" + ")" * 120, "x**999999", "1/0", "10**64*10**64*" * 9 + "1"):
        assert A.algebra.parsed(text) is None or A.algebra.parsed(text).key()


def test_safe_grade(spark):
    """A comparison that never ends costs its limit and nothing else; after a row of them the batch is passed."""
    import time

    def compare(a, b):
        while a == "endless":
            pass
        return A.same_answer(a, b)

    late, skipped = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    rows = [(0, "x+1", "1+x"), (1, "endless", "y"), (2, "1/2", "0.5"), (3, "endless", "z"), (4, "endless", "t"), (5, "x+2", "2+x"), (6, None, "1"), (7, "7", "7.0")]
    df = spark.createDataFrame(rows, "id int, a string, b string").coalesce(1)
    began = time.time()
    got = {r["id"]: (r["g"]["correct"], r["g"]["how"]) for r in df.select("id", A.safe_grade(F.col("a"), F.col("b"), 0.5, 2, compare, late, skipped).alias("g")).collect()}
    assert got == {0: (True, "compared"), 1: (False, "late"), 2: (True, "plain"), 3: (False, "late"), 4: (False, "skipped"), 5: (False, "skipped"), 6: (False, "plain"), 7: (True, "plain")}
    assert (late.value, skipped.value) == (2, 2) and time.time() - began < 60


def test_scorers_of_letters_and_boxes(spark):
    rows = [("the answer is (c).", "C", True), ("\\boxed{B}", "A", False), ("\\boxed{Paris}", "paris", True), ("\\boxed{2x=6}", "$x=3$", True)]
    got = A.graded(spark.createDataFrame(rows, "generation string, gold string, want boolean"), "omni", "generation", "gold").collect()
    assert [r["correct"] for r in got] == [r["want"] for r in got]
    rows = [("either \\boxed{x=2} or \\boxed{-\\frac{1}{2}}", "-0.5, 4x=8", True), ("\\boxed{1}", "1, 2", False), ("\\boxed{40}", "0.4", True)]
    got = A.graded(spark.createDataFrame(rows, "generation string, gold string, want boolean"), "olympiad", "generation", "gold").collect()
    assert [r["correct"] for r in got] == [r["want"] for r in got]


def test_keys_of_numbers(spark):
    keys = [(".5", "NUM:1/2"), ("-.5", "NUM:-1/2"), ("1/0", "1/0"), ("\\frac{3}{0}", "\\frac{3}{0}"), ("√5", "√5"), ("\\sqrt{5}", "\\sqrt{5}"), ("\u22123", "NUM:-3/1"), ("3.5/2", "NUM:7/2"), ("-2/-4", "NUM:-2/1"), ("1,200.50", "NUM:2401/2"), ("0/7", "NUM:0/1")]
    df = spark.createDataFrame(keys, "t string, want string").withColumn("got", A.canonical_key(F.col("t")))
    assert [(r["t"], r["got"]) for r in df.collect()] == keys


def test_gold_and_question_texts(spark):
    from stepwright.functions import records as R
    from stepwright.functions import text as X

    rows = [("so \\boxed{\\frac{1}{2}} and \\boxed{a{b{c}d}e}", "a{b{c}d}e"), ("= \\boxed{\\frac{1}{2}}.", "\\frac{1}{2}"), ("open \\boxed{1\nlast $x$ line $y$", "y"), ("one\n\ntwo ", "two"), (None, "")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", R.gold_in_solution(F.col("t")))
    assert [(r["got"]) for r in df.collect()] == [w for _, w in rows]
    rows = [("How many? Step 1: 2 <<1+1=2>>", "How many?"), ("How many <<3*4=12>> are there?", "How many"), ("Count them. ки Step 1: a ки", "Count them."), ("Ask. The answer is: 3", "Ask."), ("only", "only")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", X.question_of(F.col("t")))
    assert [(r["got"]) for r in df.collect()] == [w for _, w in rows]
