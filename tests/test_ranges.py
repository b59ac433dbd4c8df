"""Files read in ranges: equal to one pass at every cut, and to the plain readers on sound files."""

import gzip
import json
import random

import pytest

from stepwright.sources import files, ranges

DAMAGED = b"\xef\xbb\xbf" + rb"""some words, don't {mind}
{"a": 1, "t": "it's {\"deep\"} \\"}
{"a": 2, "t": "cut off
{'a': 3, 't': 'a "literal"', 'n': None}
{"a": [4,
{"a": 5} {"a": 6}{"a": 7}
""" + b"""[{"a": 8, "x": {"y": [{"z": 1}]}},
 {"a": 9, "t": "\xc3\xa9 \xe6\xbc\xa2"},
 {
  "a": 10,
  "list": [
   {"b": 1},
   {"b": 2}
  ]
 }
]
}} ]] "open
{"records": [{"a": 11}, {"a": 12}, 5]}
{"a": 13, "t": "back\\\\slash at end\\\\"}
{"a": 14"""
#: Values of a in the readable records.
READ = [1, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13]


pytestmark = pytest.mark.filterwarnings("ignore::SyntaxWarning")


def whole(data):
    return [o for _, c in ranges.chunks(iter([data])) for o in ranges.objects(c, "file", True)]


def split(data, cuts):
    """What tasks of these ranges read, each from its own start state."""
    ends = [*cuts[1:], len(data)]
    state, depth, out = ranges.START, 0, []
    for a, b in zip(cuts, ends):
        pieces = (data[i : i + 7] for i in range(a, len(data), 7))
        for at, chunk in ranges.chunks(pieces, state, depth, b - a):
            assert at < b - a
            out += ranges.objects(chunk, "file", True)
        end, (add, least) = ranges.range_map(data[a:b])[state]
        state, depth = end, max(depth + add, least)
    return out


def test_damaged_text():
    assert [o["a"] for o in whole(DAMAGED) if not isinstance(o["a"], list)] == READ
    assert whole(DAMAGED)[5]["x"] == {"y": [{"z": 1}]} and whole(DAMAGED)[1]["n"] is None


def test_every_cut():
    want = whole(DAMAGED)
    for i in range(1, len(DAMAGED)):
        assert split(DAMAGED, [0, i]) == want, i
    rng = random.Random(1)
    for _ in range(300):
        cuts = sorted({0, *(rng.randrange(1, len(DAMAGED)) for _ in range(rng.randrange(30)))})
        assert split(DAMAGED, cuts) == want
    assert split(DAMAGED, list(range(len(DAMAGED)))) == want


def test_random_texts_at_random_cuts():
    """Any bytes of the automaton's alphabet: a split never changes what is read."""
    rng = random.Random(2)
    for _ in range(1500):
        data = "".join(rng.choice(['{', '}', '"', "'", "\\", "\n", ",", ":", "[", "a", " ", '{"a":1}', '"k":']) for _ in range(rng.randrange(60))).encode()
        cuts = sorted({0, *(rng.randrange(1, max(2, len(data))) for _ in range(rng.randrange(6)))} - {len(data)})
        assert split(data, cuts) == whole(data), (data, cuts)


def test_sound_files_are_read_whole():
    """Arrays, indented or on one line, and lines give all their records in order."""
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("ab{}[]\"'\\,:\n é") for _ in range(rng.randrange(12)))
    grow = lambda n: {text() or "k": grow(n - 1) if n and rng.random() < 0.5 else [text(), {"x": text()}, None] for _ in range(3)}
    rows = [{"id": i} | grow(3) for i in range(60)]
    forms = [json.dumps(rows), json.dumps(rows, indent=2), json.dumps(rows, indent=0), "\n".join(map(json.dumps, rows)), "".join(map(json.dumps, rows)), "\r\n".join(json.dumps(r, ensure_ascii=False) for r in rows)]
    forms += [json.dumps(rows, indent="\t", ensure_ascii=False), "\n".join(map(repr, rows))]
    for form in forms:
        data = form.encode()
        assert whole(data) == rows
        assert split(data, list(range(0, len(data), 997))) == rows


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_read_ranges(spark, tmp_path, size):
    (tmp_path / "a.txt").write_bytes(DAMAGED)
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"a": i, "t": "x" * i} for i in range(50)], "meta": {"a": 99}}, indent=1))
    (tmp_path / "c.jsonl.gz").write_bytes(gzip.compress(b'{"a": 200}\n') + gzip.compress(b'{"a": 201}\nbad\n{"a": 202}'))
    (tmp_path / "d.json").write_bytes(b"")
    got = ranges.read_ranges(spark, [f"{tmp_path}/*"], "a long, t string", range_bytes=size).collect()
    found = lambda name: sorted(r["a"] for r in got if r["source_file"] == name and r["a"] is not None)
    assert found("a.txt") == READ and found("c.jsonl.gz") == [200, 201, 202] and found("d.json") == []
    assert found("b.json") == [*range(50)]
    assert {r["a"]: r["line"] for r in got if r["source_file"] == "a.txt"}[13] == 19
    assert sorted(r["a"] for r in files.read_damaged(spark, [f"{tmp_path}/a.txt"], "a long, t string").where("a is not null").collect()) == READ


def test_strict_names_file_and_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'{{"a": {i}}}\n' for i in range(40)) + '{"a": oops}\n{"a": 1}\n')
    with pytest.raises(Exception, match=r"x\.jsonl:41: "):
        ranges.read_ranges(spark, [str(tmp_path)], "a long", skip=False, range_bytes=50).collect()


def test_long_unclosed_text_is_bounded(monkeypatch):
    """A record that never ends is not held whole, and what follows the place where it is given up is read."""
    monkeypatch.setattr(ranges, "LONGEST", 100)
    data = b'{"a": [' + b"1, " * 200 + b'\n{"a": 7}\n{"a": 8}\n'
    pieces = lambda: (data[i : i + 16] for i in range(0, len(data), 16))
    assert [o for _, c in ranges.chunks(pieces()) for o in ranges.objects(c, "f", True)] == [{"a": 8}]
