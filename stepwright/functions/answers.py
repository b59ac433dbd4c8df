"""Extraction, normalisation and comparison of answers.

Plain numbers and choices are columns; expressions with nested braces, containers and symbols are
compared in Arrow-batched pandas UDFs: by canonical forms (algebra.py), which also give every answer
a key to group and join by, and where these leave something undivided by values at fixed points.
"""

from __future__ import annotations

import ast
import cmath
import math
import re
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwright.functions import algebra

NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?|-?\.\d+"


def last_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The last match of the pattern, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def simple_box(text: Column) -> Column:
    """Content of the last box without braces inside."""
    return F.nullif(F.trim(last_match(text, r"\\boxed\{([^{}]*)\}", 1)), F.lit(""))


def hash_gold(text: Column) -> Column:
    """What follows the last '####'."""
    return F.nullif(F.trim(last_match(text, r"####\s*([^\n]+)", 1)), F.lit(""))


def answer_line(text: Column) -> Column:
    found = last_match(text, r"(?i)(?:the\s+)?(?:final\s+)?answer(?:\s+is)?\s*[:=]?\s*([^\n]+)", 1)
    return F.nullif(F.regexp_replace(F.trim(found), r"[.\s]+$", ""), F.lit(""))


def numeric_value(text: Column) -> Column:
    """Value of a plain number, thousands, mixed or pure fraction, or percentage; null otherwise."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"[$,]", ""), r"\\[%$]", "%")
    percent = F.regexp_extract(t, r"^(-?\d*\.?\d+)\s*%$", 1)
    whole, over, under = (F.regexp_extract(t, r"^(-?\d+)\s+(\d+)\s*/\s*(\d+)$", i).try_cast("double") for i in (1, 2, 3))
    a, b = (F.regexp_extract(t, r"^(-?\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)$", i).try_cast("double") for i in (1, 2))
    mixed = whole + F.when(F.startswith(t, F.lit("-")), -1.0).otherwise(1.0) * F.try_divide(over, under)
    return F.coalesce(t.try_cast("double"), percent.try_cast("double") / 100, mixed, F.try_divide(a, b))


def numeric_equal(a: Column, b: Column) -> Column:
    """Equal text, or values within a relative 1e-6 or an absolute 1e-9."""
    x, y = numeric_value(a), numeric_value(b)
    near = F.abs(x - y) <= F.greatest(F.lit(1e-6) * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-9))
    return F.coalesce((F.trim(a) == F.trim(b)) | near, F.lit(False))


def reduced(num: Column, den: Column) -> Column:
    """num/den in lowest terms with a positive denominator, as text; null for a zero denominator.

    Euclid's algorithm, in as many steps as the digits of the smaller number can need (five for each,
    and two where nothing is left to do), which stand still once they are done.
    """
    return F.get(F.transform(F.array(F.struct(num.alias("num"), den.alias("den"))), lambda x: _lowest(x["num"], x["den"])), 0)


def _lowest(num: Column, den: Column) -> Column:
    start = F.struct(F.abs(num).alias("a"), F.abs(den).alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["a"], s["b"])).alias("b"))
    steps = 5 * F.length(F.least(F.abs(num), F.abs(den)).cast("string")) + 2
    sign = F.when(den < 0, -1).otherwise(1)
    shown = lambda d: F.concat((sign * num / d).cast("long").cast("string"), F.lit("/"), (F.abs(den) / d).cast("long").cast("string"))
    return F.when(den != 0, F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: shown(F.greatest(s["a"], F.lit(1)))))


def canonical_key(text: Column) -> Column:
    """'NUM:p/q' of the first fraction or number in an answer, else the text in lower case.

    A number may lack its whole part. A fraction over zero is no number, nor is what stands under a root.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^.*answer\s+is\s*:", ""), r"[$,]", ""))
    # the cleaned text is an element of an array, so that it is made once and not at each place that reads it
    return F.get(F.transform(F.array(F.replace(t, F.lit("\u2212"), F.lit("-"))), _key_of_cleaned), 0)


def _key_of_cleaned(t: Column) -> Column:
    pick = lambda pattern, i: F.regexp_extract(t, pattern, i).try_cast("long")
    latex = r"\\d?frac\{\s*(-?\d+)\s*\}\{\s*(-?\d+)\s*\}"
    plain = r"(?<![\d.])(-?\d+)\s*/\s*(\d+)"
    decimal = r"(-?)(?:(\d+)(?:\.(\d{1,9}))?|\.(\d{1,9}))"
    sign, whole = F.regexp_extract(t, decimal, 1), F.regexp_extract(t, decimal, 2)
    tail = F.concat(F.regexp_extract(t, decimal, 3), F.regexp_extract(t, decimal, 4))
    scaled = F.concat(sign, whole, tail).try_cast("long")
    power = F.rpad(F.lit("1"), F.length(tail) + 1, "0").try_cast("long")
    key = (
        F.when(F.regexp_like(t, F.lit(r"sqrt|\u221a")), F.lit(None))
        .when(F.regexp_like(t, F.lit(latex)), reduced(pick(latex, 1), pick(latex, 2)))
        .when(F.regexp_like(t, F.lit(plain)), reduced(pick(plain, 1), pick(plain, 2)))
        .otherwise(reduced(scaled, power))
    )
    return F.coalesce(F.concat(F.lit("NUM:"), key), F.lower(t))


def choice_letter(text: Column, letters: str = "A-D") -> Column:
    """The chosen letter: in a box, on the answer line, in parentheses, or alone at the end."""
    plain = F.regexp_replace(text, r"\\(?:text|mathrm|textbf|mathbf)\s*\{([^{}]*)\}", "$1")
    tries = (
        rf"\\boxed\{{\s*\(?([{letters}])\)?[^{{}}]*\}}",
        rf"(?i:answer(?:\s+is)?)\s*[:=]?\s*\(?([{letters}])\)?\b",
        rf"(?i:correct(?:\s+(?:option|choice))?(?:\s+is)?)\s*[:=]?\s*\(?([{letters}])\)?\b",
        rf"\(([{letters}])\)",
        rf"(?m)^\s*([{letters}])\s*[.)]?\s*$",
    )
    return F.coalesce(*[last_match(plain, p, 1) for p in tries])


def choice_of_index(index: Column) -> Column:
    return F.when((index >= 0) & (index < 26), F.char(F.lit(65) + index))


# -- grading of expressions --------------------------------------------------------------------


def balanced_after(text: str, start: int) -> str | None:
    """Content of the braces that open at start."""
    depth = 0
    for i in range(start, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return text[start + 1 : i]
    return None


def all_boxes(text: str | None) -> list[str]:
    """Contents of the boxes that are closed, in order."""
    found = [balanced_after(text, m.end() - 1) for m in re.finditer(r"\\(?:boxed|fbox)\s*\{", text or "")]
    return [x.strip() for x in found if x is not None]


def last_box(text: str | None) -> str | None:
    return next(reversed(all_boxes(text)), None)


def olympiad_answer(text: str | None) -> str | None:
    """All boxes' contents, one after the other; without a box as extract_answer."""
    boxes = [x for x in dict.fromkeys(all_boxes(text)) if x]
    return ", ".join(boxes) or extract_answer(text)


def extract_answer(text: str | None) -> str | None:
    """Box, then answer line, then the last formula, then the last number, then the last line."""
    if not text or not text.strip():
        return None
    boxed = last_box(text)
    if boxed:
        return boxed
    for pattern in (r"(?i)answer(?:\s+is)?\s*[:=]?\s*([^\n]+)", r"\$([^$]+)\$", rf"({NUMBER})"):
        found = re.findall(pattern, text)
        if found:
            return found[-1].strip().rstrip(".").strip("$ ")
    return text.strip().splitlines()[-1].strip()


#: What counts as no answer, and units that are dropped at the end. Fixed values.
NOTHING = {"nosolution", "\\varnothing", "\\emptyset", "emptyset", "none", "{}"}
UNITS = r"(?:square\s+)?(?:degrees?|feet|foot|ft|inch(?:es)?|cm|mm|km|meters?|metres?|miles?|hours?|minutes?|seconds?|dollars?|cents?|units?)"


def clean_answer(text: str, name: bool = False) -> str:
    """LaTeX wrappers, units and spacing removed; fractions and roots in plain brackets.

    A name before the answer (`x =`) goes too, unless name keeps it.
    """
    t = text.strip().strip("$").replace("\\left", "").replace("\\right", "").replace("\\!", "").replace("\\,", "")
    t = re.sub(r"(?<!\\)\\ ", " ", t)
    t = re.sub(r"\\(?:dfrac|tfrac|cfrac)", r"\\frac", t)
    t = re.sub(r"\\(?:text|mathrm|mathbf|textbf|mbox)\s*\{([^{}]*)\}", r" \1", t)
    t = re.sub(r"\^\s*\{?\\circ\}?", "", t).replace("\\%", "%").replace("\\cdot", "*").replace("\\times", "*").replace("\\pi", "pi").replace("\\infty", "oo").replace("\\pm", "±").replace("\\mp", "∓")
    t = re.sub(r"(?i)\s*" + UNITS + r"\.?$", "", t)
    t = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", t) if not re.search(r"[(\[{]", t) else t
    for _ in range(8):  # innermost first
        new = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"((\1)/(\2))", t)
        new = re.sub(r"\\frac\s*(\d)\s*(\d)", r"((\1)/(\2))", re.sub(r"\\frac\s*\{([^{}]*)\}\s*(\d)", r"((\1)/(\2))", re.sub(r"\\frac\s*(\d)\s*\{([^{}]*)\}", r"((\1)/(\2))", new)))
        new = re.sub(r"\\?sqrt\s*\{([^{}]*)\}", r"sqrt(\1)", re.sub(r"\\sqrt\s*(\d)", r"sqrt(\1)", new))
        new = re.sub(r"\^\s*\{([^{}]*)\}", r"^(\1)", new)
        if new == t:
            break
        t = new
    t = re.sub(r"^\s*[a-zA-Z]\s*\\in\s*" if name else r"^\s*[a-zA-Z]\s*(?:=|\\in)\s*", "", t)
    t = re.sub(r"^(-?\d+)\s*:\s*(\d+)$", r"((\1)/(\2))", t.strip())
    spare = t.count("}") - t.count("{")
    return (t[:-spare] if spare > 0 and t.endswith("}" * spare) else t).strip().rstrip(".")


NAMES: dict[str, complex] = {"pi": math.pi, "e": math.e, "i": 1j}
FUNCTIONS: dict[str, Callable] = {"sqrt": cmath.sqrt, "abs": abs, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "log": cmath.log, "ln": cmath.log, "exp": cmath.exp}


def to_python(text: str) -> str:
    """An answer as an expression of the restricted grammar: implied products written out."""
    t = text.replace("\\", "").replace("^", "**").replace("{", "(").replace("}", ")")
    mixed = re.match(r"^(-?)(\d+)\s*\(\((\d+)\)/\((\d+)\)\)$", t.strip()) or re.match(r"^(-?)(\d+)\s+(\d+)/(\d+)$", t.strip())
    if mixed:
        return f"{mixed[1]}({mixed[2]}+Fraction({mixed[3]})/{mixed[4]})".replace("Fraction", "")
    t = re.sub(r"\s+", "", t)
    t = re.sub(r"(\d|\))(?=[a-zA-Z(])", r"\1*", t)
    return re.sub(r"(?<![a-zA-Z])([a-z])(?=[a-z(])(?!(?:qrt|bs|in|os|an|og|n|xp|i)\b)", r"\1*", t)


def evaluate(node: ast.AST, at: dict[str, complex]):
    """Value of a parsed expression: a Fraction while that is exact, else a complex number."""
    if isinstance(node, ast.Expression):
        return evaluate(node.body, at)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return Fraction(str(node.value))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = evaluate(node.operand, at)
        return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.BinOp):
        a, b = evaluate(node.left, at), evaluate(node.right, at)
        if isinstance(node.op, ast.Pow):
            if isinstance(a, Fraction) and isinstance(b, Fraction) and b.denominator == 1 and abs(b) <= 64:
                return a ** int(b)
            if abs(complex(b)) > 64:
                raise ValueError("exponent too large")
            return complex(a) ** complex(b)
        if not (isinstance(a, Fraction) and isinstance(b, Fraction)):
            a, b = complex(a), complex(b)
        for kind, f in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: a / b)):
            if isinstance(node.op, kind):
                return f()
    if isinstance(node, ast.Name):
        return NAMES[node.id] if node.id in NAMES else at[node.id]
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1:
        return FUNCTIONS[node.func.id](complex(evaluate(node.args[0], at)))
    raise ValueError("not an expression of the grammar")


@lru_cache(maxsize=10_000)
def form_of(text: str) -> algebra.Form | None:
    """The canonical form of a cleaned answer without spaces; a percentage is a hundredth. Words have none."""
    if any(w not in FUNCTIONS for w in re.findall(r"[A-Za-z]{3,}", text.replace("oo", ""))):
        return None
    t = f"(({text.replace('%', '')})/100)" if "%" in text else text
    return algebra.parsed(to_python(t))


def same_value(a: str, b: str) -> bool:
    """Are two expressions equal? By their forms, where these decide; numbers, and what is left
    undivided, by values at fixed points. False for what can't be read."""
    if max(len(a), len(b)) > 300:
        return False
    forms = form_of(a), form_of(b)
    if all(forms) and all(f.whole() for f in forms):
        if forms[0].key() == forms[1].key():
            return True
        if any(f.letters() for f in forms):
            return False
    try:
        left, right = (ast.parse(to_python(t), mode="eval") for t in (a, b))
        names = sorted({n.id for tree in (left, right) for n in ast.walk(tree) if isinstance(n, ast.Name)} - set(NAMES) - set(FUNCTIONS))
        tried = 0
        for point in (-2, -1, 1, 2, 3) if names else (0,):
            at = {n: Fraction(point + 7 * i, 1 + i) for i, n in enumerate(names)}
            try:
                x, y = evaluate(left, at), evaluate(right, at)
            except ZeroDivisionError:
                continue
            tried += 1
            if isinstance(x, Fraction) and isinstance(y, Fraction):
                if x != y and not math.isclose(x, y, rel_tol=1e-9):
                    return False
            elif not cmath.isclose(complex(x), complex(y), rel_tol=1e-6, abs_tol=1e-9):
                return False
        return tried > 0
    except (ValueError, SyntaxError, KeyError, OverflowError, TypeError, RecursionError, MemoryError):
        return False


def top_level(text: str, mark: str = ",") -> list[str]:
    """Parts of a text at marks outside brackets."""
    parts, depth = [""], 0
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c == mark and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts]


INTERVAL = re.compile(r"^([(\[])([^,]+),([^,]+)([)\]])$")


def end_of_interval(text: str) -> tuple[float, str] | None:
    """Value and key of an interval's end."""
    if text.lstrip("+-") == "oo":
        return (-math.inf, "-oo") if text.startswith("-") else (math.inf, "oo")
    form = form_of(text)
    value = form and form.value()
    return None if value is None else (value, form.key())


def intervals_of(text: str) -> list[algebra.Interval] | None:
    """The intervals and sets of numbers of a union without spaces; None for anything else."""
    out: list[algebra.Interval] = []
    for part in re.split(r"\\cup|∪|(?<=[)\]}])U(?=[(\[{])", text.replace("\\{", "{").replace("\\}", "}")):
        m = INTERVAL.match(part)
        points = [(x, x) for x in top_level(part[1:-1])] if part[:1] == "{" and part[-1:] == "}" else [(m[2], m[3])] if m else []
        if not points:
            return None
        for low, high in points:
            ends = end_of_interval(low), end_of_interval(high)
            if None in ends:
                return None
            (a, x), (b, y) = ends
            out.append(algebra.Interval(a, b, x, y, not m or m[1] == "[", not m or m[4] == "]"))
    return out


def both_signs(text: str) -> list[str]:
    """What stands with a plus-minus, once for each sign."""
    if "±" not in text and "∓" not in text:
        return [text]
    return [text.replace("±", "+").replace("∓", "-"), text.replace("±", "-").replace("∓", "+")]


def matrix_rows(text: str) -> list[list[str]] | None:
    found = re.search(r"\\begin\{[bpv]?matrix\}(.*?)\\end\{[bpv]?matrix\}", text, re.S)
    return found and [r.split("&") for r in re.split(r"\\\\", found[1]) if r.strip()]


def equation_of(text: str) -> str | None:
    """Key of an equation up to a factor; None for what is none."""
    t = re.sub(r"\s+", "", text)
    if t.count("=") != 1 or re.search(r"[<>≤≥!,]|\\[lg]e", t):
        return None
    sides = [form_of(x) for x in t.split("=")]
    return algebra.equation_key(*sides) if all(sides) else None


def answer_key(text: str | None, unordered: bool = False) -> str | None:
    """A key that equal answers share, to group and join by; null for no text.

    Values and expressions by their canonical form, equations up to a factor, unions of intervals
    merged, sets (and with unordered also bare lists) as multisets, tuples and intervals and
    matrices by their parts, in any nesting; a plus-minus is the set of both. What is none of
    these is its text without spaces, after `T:`.
    """
    if text is None or not text.strip():
        return None
    t = clean_answer(text, True)
    tight = re.sub(r"\s+", "", t)
    if tight.lower() in NOTHING:
        return "{}"
    if (rows := matrix_rows(t)) is not None:
        return "M[" + ";".join(",".join(answer_key(c) or "" for c in r) for r in rows) + "]"
    if (equation := equation_of(t)) is not None:
        return equation
    tight = re.sub(r"^[a-zA-Z]=", "", tight)
    parts = re.split(r"\\cup|∪|(?<=[)\]}])U(?=[(\[{])", tight)
    if len(parts) > 1:
        found = intervals_of(tight)
        return algebra.union_key(found) if found is not None else "∪".join(sorted(answer_key(p) or "" for p in parts))
    plain = tight.replace("\\{", "{").replace("\\}", "}")
    if plain[:1] == "{" and plain[-1:] == "}":
        return "{" + ",".join(sorted(answer_key(x) or "" for p in top_level(plain[1:-1]) for x in both_signs(p))) + "}"
    inner = top_level(tight[1:-1]) if tight[:1] in "([" and tight[-1:] in ")]" else []
    if len(inner) > 1:
        return tight[0] + ",".join(end[1] if (end := end_of_interval(x)) else answer_key(x) or "" for x in inner) + tight[-1]
    listed = [x for p in top_level(tight) for x in both_signs(p)]
    if len(listed) > 1:
        keys = [answer_key(x) or "" for x in listed]
        return "{" + ",".join(sorted(keys)) + "}" if unordered or "±" in tight or "∓" in tight else ",".join(keys)
    form = form_of(tight)
    return form.key() if form is not None else "T:" + tight


def same_answer(pred: str | None, gold: str | None, percent: bool = False, unordered: bool = False) -> bool:
    """Are two answers equal: text, nothing, equations, matrices, unions, sets, tuples and intervals, or values.

    percent: also equal up to a factor of 100. unordered: lists match in any order.
    """
    if pred is None or gold is None:
        return False
    a, b = clean_answer(pred), clean_answer(gold)
    tight = [re.sub(r"\s+", "", t) for t in (a, b)]
    if tight[0] == tight[1] and tight[0]:
        return True
    empty = [t.lower() in NOTHING for t in tight]
    if any(empty):
        return all(empty)
    if any("=" in t for t in (pred, gold)) and answer_key(pred) == answer_key(gold):
        return True
    cells = [matrix_rows(t) for t in (a, b)]
    if any(cells):
        rows = [m for m in cells if m]
        return len(rows) == 2 and [len(r) for r in rows[0]] == [len(r) for r in rows[1]] and all(same_answer(x, y) for p, q in zip(*rows) for x, y in zip(p, q))
    if any("±" in t or "∓" in t for t in tight):
        return answer_key(a, True) == answer_key(b, True)
    unions = [re.split(r"\\cup|∪|(?<=[)\]}])U(?=[(\[{])", t) for t in tight]
    if max(map(len, unions)) > 1:
        found = [intervals_of(t) for t in tight]
        if None not in found:
            return algebra.union_key(found[0]) == algebra.union_key(found[1])
        return matched(*unions, lambda x, y: same_answer(x, y))
    braces = [t.replace("\\{", "{").replace("\\}", "}") for t in tight]
    if all(t.startswith("{") and t.endswith("}") for t in braces):
        return matched(*(top_level(t[1:-1]) for t in braces), lambda x, y: same_answer(x, y))
    parts = [top_level(t[1:-1]) if t[:1] in "([" and t[-1:] in ")]" else top_level(t) for t in tight]
    if max(map(len, parts)) > 1:
        if len(parts[0]) != len(parts[1]) or (tight[0][0] in "([" and tight[1][0] in "([" and (tight[0][0], tight[0][-1]) != (tight[1][0], tight[1][-1])):
            return False
        alike = lambda x, y: same_answer(x, y, percent)
        return matched(*parts, alike) if unordered else all(alike(x, y) for x, y in zip(*parts))
    sides = [t.replace("%", "") for t in tight]
    if "%" in a or "%" in b:
        scale = [f"(({s})/100)" if "%" in t else s for s, t in zip(sides, tight)]
        return same_value(*scale) or (percent and same_value(*sides))
    if same_value(*tight) or same_value(a, b):
        return True
    return percent and (same_value(tight[0], f"({tight[1]})*100") or same_value(tight[0], f"({tight[1]})/100"))


def matched(left: list[str], right: list[str], equal: Callable[[str, str], bool]) -> bool:
    """Do the lists pair off, in any order?"""
    rest = list(right)
    for x in left:
        hit = next((y for y in rest if equal(x, y)), None)
        if hit is None:
            return False
        rest.remove(hit)
    return not rest


@F.pandas_udf(T.StringType())
def extract_answer_udf(text: pd.Series) -> pd.Series:
    return text.map(extract_answer)


@F.pandas_udf(T.StringType())
def olympiad_answer_udf(text: pd.Series) -> pd.Series:
    return text.map(olympiad_answer)


def answer_key_column(answer: Column, unordered: bool = False) -> Column:
    """answer_key as a column."""

    @F.pandas_udf(T.StringType())
    def keys(found: pd.Series) -> pd.Series:
        known = {t: answer_key(t, unordered) for t in found.dropna().unique()}
        return found.map(known.get).astype(object)

    return keys(answer)


@lru_cache(maxsize=20_000)
def compared(pred: str | None, gold: str | None, percent: bool = False, unordered: bool = False) -> bool:
    """same_answer, which a worker remembers: repeated pairs are compared once."""
    return same_answer(pred, gold, percent, unordered)


def grade_udf(percent: bool = False, unordered: bool = False):
    """A pandas UDF: is the first answer equal to the second?"""

    @F.pandas_udf(T.BooleanType())
    def grade(pred: pd.Series, gold: pd.Series) -> pd.Series:
        return pd.Series([compared(p, g, percent, unordered) for p, g in zip(pred, gold)])

    return grade


def grade_column(pred: Column, gold: Column, **options) -> Column:
    """Equality of answers: plain numbers and equal texts as columns, the rest by the evaluator."""
    settled = F.coalesce(numeric_equal(pred, gold), F.lit(False))
    rest = lambda c: F.when(~settled, c)  # noqa: E731  settled rows reach the evaluator as nulls
    return settled | grade_udf(**options)(rest(pred), rest(gold))


class Late(Exception):
    """A comparison took longer than its limit."""


@contextmanager
def deadline(seconds: float) -> Iterator[None]:
    """Late is raised in the block once it has run so long; only a process's main thread has alarms,
    elsewhere the block runs without a limit."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def ring(*_):
        raise Late

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def safe_grade(pred: Column, gold: Column, limit_seconds: float = 5.0, trip: int = 24, compare: Callable = same_answer, late=None, skipped=None, **options) -> Column:
    """Equality of answers as a struct: correct, and how it was found.

    how: `plain` for null answers, equal texts and plain numbers, which are columns; `compared`;
    `late` where a comparison was stopped at its limit, and `skipped` once trip comparisons of a
    batch in a row were: the rest of the batch is graded by plain equality alone. Both count as
    unequal. late and skipped: accumulators that count them.
    """
    plain = F.coalesce(numeric_equal(pred, gold), F.lit(False))

    @F.pandas_udf("correct boolean, how string")
    def grade(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows, streak = [], 0
        for p, g in zip(x, y):
            if p is None or g is None:
                rows.append((False, "plain"))
            elif streak >= trip:
                rows.append((False, "skipped"))
                if skipped is not None:
                    skipped.add(1)
            else:
                try:
                    with deadline(limit_seconds):
                        rows.append((bool(compare(p, g, **options)), "compared"))
                    streak = 0
                except Late:
                    rows.append((False, "late"))
                    streak += 1
                    if late is not None:
                        late.add(1)
        return pd.DataFrame(rows, columns=["correct", "how"])

    rest = lambda c: F.when(~plain, c)  # noqa: E731  settled rows reach the worker as nulls
    graded = grade(rest(pred), rest(gold))
    return F.struct((plain | graded["correct"]).alias("correct"), graded["how"].alias("how"))


def choose(text: Column, gold: Column, letters: str = "A-D") -> Column:
    """Did the text choose the gold index (0-based)?"""
    return F.coalesce(choice_letter(text, letters) == choice_of_index(gold), F.lit(False))


def integer_answer(text: Column) -> Column:
    return F.coalesce(simple_box(text), last_match(text, r"-?\d+")).try_cast("long")


def omni_equal(pred: Column, gold: Column) -> Column:
    """As grade_column, but case does not count in equal texts, and where the gold is a letter from A
    to E the last such letter that stands alone in the prediction is its answer."""
    letter = F.upper(F.trim(gold))
    chosen = last_match(F.upper(F.regexp_replace(F.trim(pred), r"[./\s]+$", "")), r"\b([A-E])\b", 1)
    alike = F.coalesce(F.lower(F.trim(pred)) == F.lower(F.trim(gold)), F.lit(False))
    return alike | F.coalesce(F.regexp_like(letter, F.lit("^[A-E]$")) & (chosen == letter), F.lit(False)) | grade_column(pred, gold)


#: Scorer of each benchmark: how a prediction and a gold text become columns, and the comparison.
SCORERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "gsm8k": (lambda c: F.coalesce(simple_box(c), answer_line(c), last_match(c, NUMBER)), hash_gold, numeric_equal),
    "math": (extract_answer_udf, extract_answer_udf, grade_column),
    "omni": (extract_answer_udf, extract_answer_udf, omni_equal),
    "olympiad": (olympiad_answer_udf, lambda c: c, lambda a, b: grade_column(a, b, percent=True, unordered=True)),
    "mmlu": (choice_letter, lambda c: choice_of_index(c.try_cast("int")), lambda a, b: F.coalesce(a == b, F.lit(False))),
    "aime": (integer_answer, integer_answer, lambda a, b: F.coalesce(a == b, F.lit(False))),
}


def graded(df, scorer: str, generation: str, gold: str):
    """df with pred, gold_answer and correct by the named scorer."""
    predict, reference, equal = SCORERS[scorer]
    rows = df.withColumns({"pred": predict(F.col(generation)), "gold_answer": reference(F.col(gold))})
    return rows.withColumn("correct", equal(F.col("pred"), F.col("gold_answer")))
