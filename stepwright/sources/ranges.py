"""Damaged and wrapped record files, however large, read in ranges by many tasks.

A file is cut at any bytes. Whether a range starts inside a string or an object is found without
reading what stands before it: in a first pass each range is run through a small automaton from
every state it may start in, which gives a map of start states to end states and, for each, what the
range does to the depth of braces. The maps of a file's ranges, composed in order, give each range's
true start. In the second pass each task takes the records that start in its range and reads on only
to the end of the last of them.

The automaton: strings in either quotes, in which a backslash takes the next character, and which no
line end is inside of; braces outside strings; and whether the last character outside strings goes on
to something (`,`, `:`, `[`, `(` or `{`). An opening brace that stands where nothing goes on starts a
record, so one that was never closed ends there. A record is JSON or a Python literal; of what is
neither, the lines after its first are searched again. Outside records anything is passed over.
"""

from __future__ import annotations

import ast
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WRAPPERS = ("records", "data", "items")
#: The head of a file that is one object around a list of records.
WRAPPED = re.compile(rb'^(?:\xef\xbb\xbf)?\s*\{\s*"(?:%s)"\s*:\s*\[' % "|".join(WRAPPERS).encode())
PLAIN = re.compile(rb"""["'{}]""")
QUOTED = {ord(q): re.compile(rb"[\\\n" + q.encode() + rb"]") for q in "\"'"}
#: What the last character outside strings goes on to: nothing, an element, or the value of a key.
NOTHING, ELEMENT, VALUE = 0, 1, 2
GOES_ON = {ord(c): VALUE if c == ":" else ELEMENT for c in ",:[("}
#: Bytes of a range, of one read beyond it, and of the longest record.
RANGE, STEP, LONGEST = 32 << 20, 1 << 20, 64 << 20

#: A state: the open quote (0 for none), whether a backslash was last, what the last character goes on to.
State = tuple[int, bool, int]
STATES: list[State] = [*((0, False, n) for n in (NOTHING, ELEMENT, VALUE)), *((ord(q), e, NOTHING) for q in "\"'" for e in (False, True))]
START = STATES[0]
#: What a stretch does to the depth d of braces: max(d + add, least).
Depth = tuple[int, int]
NEVER = -(1 << 60)
SAME, NESTED, FRESH, CLOSED = (0, NEVER), (1, NEVER), (NEVER, 1), (-1, 0)


def after(first: Depth, then: Depth) -> Depth:
    return max(NEVER, first[0] + then[0]), max(NEVER, first[1] + then[0], then[1])


class Walk:
    """The automaton; feed gives the braces outside strings, with what each does to the depth and
    whether it opens the value of a key."""

    def __init__(self, state: State = START):
        self.quote, self.escaped, self.goes_on = state

    def state(self) -> State:
        return self.quote, self.escaped, NOTHING if self.quote else self.goes_on

    def feed(self, data: bytes) -> Iterator[tuple[int, Depth, bool]]:
        i = 0
        if self.escaped and data:
            self.escaped, i = False, int(data[0] != 10)
        while i < len(data):
            if self.quote:
                found = QUOTED[self.quote].search(data, i)
                if found is None:
                    return
                at, i = found.start(), found.end()
                if data[at] != 92:  # the quote, or a line's end
                    self.quote, self.goes_on = 0, NOTHING
                elif i == len(data):
                    self.escaped = True
                elif data[i] != 10:
                    i += 1
                continue
            found = PLAIN.search(data, i)
            between = data[i : found.start() if found else len(data)].rstrip()
            if between:
                self.goes_on = GOES_ON.get(between[-1], NOTHING)
            if found is None:
                return
            at, i = found.start(), found.end()
            if data[at] == 123:
                step, value, self.goes_on = NESTED if self.goes_on else FRESH, self.goes_on == VALUE, ELEMENT
                yield at, step, value
            elif data[at] == 125:
                self.goes_on = NOTHING
                yield at, CLOSED, False
            else:
                self.quote = data[at]


def effect(data: bytes, state: State) -> tuple[State, Depth]:
    """End state of a stretch and what it does to the depth."""
    walk, depth = Walk(state), SAME
    for _, step, _ in walk.feed(data):
        depth = after(depth, step)
    return walk.state(), depth


def range_map(data: bytes) -> dict[State, tuple[State, Depth]]:
    """effect from every state; what follows the first line's end is walked once."""
    line = data.find(b"\n") + 1
    if not line:
        return {s: effect(data, s) for s in STATES}
    rest = data[line:]
    first = re.search(rb"\S", rest)
    if first and first[0] == b"{":
        end, depth = effect(rest[first.end() :], (0, False, ELEMENT))
        tails = {n: (end, after(NESTED if n else FRESH, depth)) for n in (NOTHING, ELEMENT, VALUE)}
    elif first:
        tails = dict.fromkeys((NOTHING, ELEMENT, VALUE), effect(rest, START))
    else:
        tails = {n: ((0, False, n), SAME) for n in (NOTHING, ELEMENT, VALUE)}
    out = {}
    for s in STATES:
        (_, _, goes_on), depth = effect(data[:line], s)
        out[s] = tails[goes_on][0], after(depth, tails[goes_on][1])
    return out


def read_object(text: bytes) -> object:
    """A chunk as JSON or a Python literal; ValueError for neither."""
    chars = text.decode("utf-8", "replace")
    try:
        return json.loads(chars)
    except ValueError:
        try:
            return ast.literal_eval(chars)
        except (SyntaxError, TypeError, MemoryError, RecursionError) as error:
            raise ValueError(str(error)) from None


def chunks(pieces: Iterator[bytes], state: State = START, depth: int = 0, most: float = float("inf"), wrapped: bool = False) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of each record that starts within the first `most` bytes of the pieces, whole
    or not; pieces are only read as far as it takes. A record over LONGEST is left out, and so are
    values of other keys in a wrapped file."""
    walk, held, base = Walk(state), b"", 0  # held: bytes from base on
    start: int | None = None
    taken = True
    for piece in pieces:
        offset = base + len(held)
        if start is None:
            held, base = b"", offset
        held += piece
        for at, step, value in walk.feed(piece):
            at += offset
            new = max(depth + step[0], step[1])
            opens = step == FRESH or (step == NESTED and depth == 0)
            if start is not None and (opens or new == 0):
                end = at if opens else at + 1
                if taken and end - start <= LONGEST:
                    yield start, held[start - base : end - base]
                start = None
            if at >= most and start is None:
                return
            if opens:
                start, taken = at, not (wrapped and value)
            depth = new
        if start is not None:
            if base + len(held) - start > LONGEST:
                held, base = b"", base + len(held)  # too long: its bytes are not kept
            else:
                held, base = held[start - base :], start
        elif offset + len(piece) >= most:
            return
    if start is not None and taken and base <= start:
        yield start, held[start - base :]


def objects(chunk: bytes, place: str, skip: bool) -> Iterator[dict]:
    """The records of a chunk: its own, or those of its list; of a damaged one those of its later lines."""
    try:
        found = read_object(chunk)
    except ValueError as error:
        if not skip:
            raise ValueError(f"{place}: {error}") from None
        _, _, later = chunk.partition(b"\n")
        for _, part in chunks(iter([later])):
            yield from objects(part, place, skip)
        return
    if isinstance(found, dict):
        inner = next((found[w] for w in WRAPPERS if isinstance(found.get(w), list)), None)
        yield from (x for x in ([found] if inner is None else inner) if isinstance(x, dict))
    elif not skip:
        raise ValueError(f"{place}: no object")


# -- tasks and jobs


def pieces_of(path: str, begin: int, step: int = STEP) -> Iterator[bytes]:
    """The file's bytes from begin on; of a .gz its unpacked bytes."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with store.open_input_file(name) as source:
        source.seek(begin)
        unpacker = zlib.decompressobj(31) if name.endswith(".gz") else None
        while data := source.read(step):
            while unpacker and data:
                yield unpacker.decompress(data)
                data = unpacker.unused_data
                if unpacker.eof:
                    unpacker = zlib.decompressobj(31)
                else:
                    break
            if not unpacker:
                yield data


def first_bytes(path: str, begin: int, n: int) -> bytes:
    return b"".join(pieces_of(path, begin, n)) if path.endswith(".gz") else next(pieces_of(path, begin, n), b"") if n else b""


def summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, begin, end -> the range's lines and its map, as text."""
    for frame in frames:
        rows = []
        for path, begin, end in zip(frame["path"], frame["begin"], frame["end"]):
            data = first_bytes(path, begin, end - begin)
            head = WRAPPED.match(data[:4096]) if begin == 0 else None
            body = data[head.end() :] if head else data
            found = range_map(body)
            table = [[STATES.index(found[s][0]), *found[s][1]] for s in STATES]
            rows.append((path, begin, end, data.count(b"\n"), head.end() if head else 0, json.dumps(table)))
        yield pd.DataFrame(rows, columns=["path", "begin", "end", "lines", "head", "map"])


def starts(frame: pd.DataFrame) -> pd.DataFrame:
    """A file's ranges with the state, depth and line that each starts in."""
    state, depth, line, rows = START, 0, 1, []
    for r in frame.sort_values("begin").itertuples():
        rows.append((r.path, r.begin + r.head, r.end, STATES.index(state), depth, line, bool(frame["head"].max())))
        end, add, least = json.loads(r.map)[STATES.index(state)]
        state, depth, line = STATES[end], max(depth + add, least), line + r.lines
    return pd.DataFrame(rows, columns=["path", "begin", "end", "state", "depth", "line", "wrapped"])


def records(skip: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rows, line, seen, size = [], r.line, 0, 0
                most = float("inf") if r.path.endswith(".gz") else r.end - r.begin

                def counted() -> Iterator[bytes]:
                    nonlocal text, base
                    for piece in pieces_of(r.path, 0 if r.path.endswith(".gz") else r.begin):
                        text, base = text + piece, base
                        yield piece

                text, base = b"", 0
                for at, chunk in chunks(counted(), STATES[r.state], r.depth, most, r.wrapped):
                    line += text.count(b"\n", seen - base, at - base)
                    text, base, seen = text[at - base :], at, at
                    found = [json.dumps(o, default=str) for o in objects(chunk, f"{r.path}:{line}", skip)]
                    rows += [(r.path, line, o) for o in found]
                    size += sum(map(len, found))
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=["path", "line", "object"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["path", "line", "object"])

    return run


def read_ranges(spark: SparkSession, paths: list[str], schema: StructType | str, skip: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """source_file, line and the fields of the schema, of each record of the files.

    Files are of one object, of an array or a list in an object (its first field; objects that are
    values of other fields are passed over, those in further lists are not), of objects one after
    another, or of lines that may be damaged. skip: what can't be read is passed over; otherwise it
    is an error that names the file and the line. A compressed file is one range.
    """
    files = spark.read.format("binaryFile").load(sorted(set(paths))).select("path", "length")
    cuts = F.when(F.endswith("path", F.lit(".gz")), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ends = F.when(F.endswith("path", F.lit(".gz")), F.col("length")).otherwise(F.least("length", F.col("begin") + range_bytes))
    ranges = files.select("path", "length", F.explode(cuts).alias("begin")).select("path", "begin", ends.alias("end"))
    ranges = ranges.repartition(F.col("path"), F.col("begin"))
    found = ranges.mapInPandas(summaries, "path string, begin long, end long, lines long, head long, map string")
    placed = found.groupBy("path").applyInPandas(starts, "path string, begin long, end long, state int, depth long, line long, wrapped boolean")
    placed = placed.repartition(F.col("path"), F.col("begin"))
    kind = schema if isinstance(schema, str) else schema.simpleString()
    rows = placed.mapInPandas(records(skip), "path string, line long, object string")
    name = F.substring_index("path", "/", -1).alias("source_file")
    return rows.select(name, "line", F.from_json("object", kind).alias("r")).select("source_file", "line", "r.*")
