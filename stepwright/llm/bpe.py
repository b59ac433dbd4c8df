"""Byte-level BPE encoding and decoding.

Encoding: the merges are compiled into a finite-state transducer over bytes that is determinised
as it is used. A state is the set of readings of the bytes so far: for each place where the next
token may begin, the trie node that the bytes since then have reached, the token before it, and
the tokens chosen but not yet certain. A byte moves every reading along; tokens on which all
readings agree are emitted, so output lags by no more than the longest token that is still open.
Of the readings that end a token at a place exactly one is right: its last two tokens must be
what the merges make of their joint bytes. Pieces of text (matches of the pattern) start in the
same state and are flushed at their end; the time is linear in the bytes, however long a piece.

Decoding: a small state machine holds the bytes of an unfinished UTF-8 sequence between tokens
and gives out text as soon as it is whole.

State tables are caches of bounded size: they are dropped and built anew when full.

Defined cases: a null or empty text has no tokens; an empty table gives an empty result; other
columns are not read. Vocabulary files are read on the driver and broadcast (a fixed size).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stepwright.llm.common import kept_in_worker, map_texts_in_batches

ROOT = 0
#: In a reading: whatever token came before, those ahead fit it.
ANY = -1
#: The next state (its number times 256), with the ids that are emitted, as text, if there are any.
Move = int | tuple[int, str]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a file of 'base64 rank' lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged_parts(piece: bytes, ranks: dict[bytes, int], until: int) -> list[bytes]:
    """The merges applied in order of rank until so many parts are left or none applies."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks) << 1))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def merged_halves(token: bytes, ranks: dict[bytes, int]) -> list[bytes] | None:
    """The two parts that the last merge joins to the token; None if the merges end elsewhere."""
    halves = merged_parts(token, ranks, 2)
    return halves if len(halves) == 2 else None


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by the definition of the merges: quadratic, for tests."""
    return [ranks[p] for p in merged_parts(piece, ranks, 1)]


class Transducer:
    """Bytes of one piece to token ids; see the module's text.

    Ids are given as text, joined by commas. max_states, max_pieces and max_pairs bound the tables
    of determinised states, of whole short pieces and of neighbouring tokens; max_heads bounds the
    table of moves from the start by the first characters of a piece, head of them, at once.
    small: a reading with at most so many tokens ahead is settled at once, see ahead().
    """

    def __init__(
        self, ranks: dict[bytes, int], max_states: int = 200_000, max_pieces: int = 100_000, max_pairs: int = 50_000,
        max_heads: int = 60_000, head: int = 5, small: int = 8,
    ):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.max_states, self.max_pieces, self.max_pairs = max_states, max_pieces, max_pairs
        self.max_heads, self.head = max_heads, head
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        below: list[list[int] | None] = [[]]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                follow = self.children[node].get(byte)
                if follow is None:
                    follow = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    below.append([])
                elif below[node] is not None and len(below[node]) > small:
                    below[node] = None
                if below[node] is not None:
                    below[node].append(rank)
                node = follow
            self.ends[node] = rank
        #: per node the tokens that go on from it, if they are few
        self.below = [b if b is not None and len(b) <= small else None for b in below]
        self.spines: dict[tuple[int, int], tuple[int, ...]] = {}
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.reset()

    def reset(self) -> None:
        """Drop all determinised states but the start."""
        start = ((ROOT, None, ()),)
        self.readings = [start]
        self.numbers = {start: 0}
        self.moves: dict[int, Move] = {}
        self.heads: dict[str, tuple[int, str]] = {}

    def spine(self, token: int, side: int) -> tuple[int, ...]:
        """The parts at one end of a token while it is merged, from its byte to the whole; () if
        the merges do not make this token of its bytes. side 0: left end, 1: right end."""
        known = self.spines.get((token, side))
        if known is None:
            whole = self.tokens[token]
            halves = merged_halves(whole, self.ranks) if len(whole) > 1 else None
            if halves is None:
                known = (token,) if len(whole) == 1 else ()
            else:
                known = (*self.spine(self.ranks[halves[side]], side), token)
            self.spines[token, side] = known
        return known

    def fits(self, last: int | None, token: int) -> bool:
        """Do the merges leave the two tokens apart when they meet (or the one whole, if first)?

        They do not if at some moment the part at the right end of the first and the part at the
        left end of the second make a token of a lower rank than what either becomes next. At
        equal ranks the merge further left comes first.
        """
        if last is None:
            return bool(self.spine(token, 0))
        known = self.adjacent.get((last, token))
        if known is not None:
            return known
        lefts, rights = self.spine(last, 1), self.spine(token, 0)
        known = bool(rights)
        never = len(self.ranks) << 1
        i = j = 0
        while known and i < len(lefts) and j < len(rights):
            next_left = lefts[i + 1] if i + 1 < len(lefts) else never
            next_right = rights[j + 1] if j + 1 < len(rights) else never
            joint = self.ranks.get(self.tokens[lefts[i]] + self.tokens[rights[j]])
            if joint is not None and joint < next_left and joint <= next_right:
                known = False
            if next_left <= next_right:
                i += 1
            else:
                j += 1
        if len(self.adjacent) > self.max_pairs:
            self.adjacent.clear()
        self.adjacent[last, token] = known
        return known

    def ahead(self, node: int, last: int | None) -> tuple[bool, int | None]:
        """May a reading at node go on, and the token before it as far as it still matters.

        Where few tokens lie ahead they are tried at once: with none that fits, the reading ends;
        with all fitting, it need not remember what came before (ANY). Fewer states remain.
        """
        tokens = self.below[node]
        if tokens is None or last == ANY:
            return True, last
        fitting = sum(self.fits(last, t) for t in tokens)
        return fitting > 0, ANY if fitting == len(tokens) else last

    def determinise(self, place: int) -> Move:
        """The move from a state by a byte (place: state times 256 plus byte)."""
        follow = []
        byte = place & 255
        for node, last, open_tokens in self.readings[place >> 8]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            if self.children[child]:
                alive, matters = self.ahead(child, last)
                if alive:
                    follow.append((child, matters, open_tokens))
            token = self.ends[child]
            if token is not None and (last == ANY or self.fits(last, token)):
                follow.append((ROOT, token, (*open_tokens, token)))
        paths = [open_tokens for _, _, open_tokens in follow]
        sure, least, shortest = 0, paths[0], min(map(len, paths))
        while sure < shortest and all(p[sure] == least[sure] for p in paths):
            sure += 1
        key = tuple([(node, last, open_tokens[sure:]) for node, last, open_tokens in follow] if sure else follow)
        state = self.numbers.get(key)  # one integer for all moves to a state
        if state is None:
            state = self.numbers[key] = len(self.readings) << 8
            self.readings.append(key)
        move = self.moves[place] = (state, "".join([f",{t}" for t in least[:sure]])) if sure else state
        return move

    def walk(self, data: bytes, state: int) -> tuple[int, str]:
        """The state after the bytes, and the ids emitted on the way, each after a comma."""
        out: list[str] = []
        follow = self.moves.get
        for byte in data:
            move = follow(state | byte)
            if move is None:
                if len(self.readings) > 2 * self.max_states:  # in one endless piece: keep where it is
                    here = self.readings[state >> 8]
                    self.reset()
                    follow = self.moves.get
                    state = self.numbers.setdefault(here, len(self.readings) << 8)
                    if state == len(self.readings) << 8:
                        self.readings.append(here)
                move = self.determinise(state | byte)
            if move.__class__ is int:
                state = move
            else:
                state, emitted = move
                out.append(emitted)
        return state, "".join(out)

    def encode(self, text: str) -> str:
        """Ids of one piece, joined by commas."""
        whole = self.ranks.get(text.encode())
        if whole is not None:
            return str(whole)
        if len(self.readings) > self.max_states:
            self.reset()
        begun = self.heads.get(text[: self.head])
        if begun is None:
            begun = self.walk(text[: self.head].encode(), 0)
            if len(self.heads) >= self.max_heads:
                self.heads.clear()
            self.heads[text[: self.head]] = begun
        state, emitted = self.walk(text[self.head :].encode(), begun[0])
        rest = next((open_tokens for node, _, open_tokens in self.readings[state >> 8] if node == ROOT), ())
        return (begun[1] + emitted + "".join([f",{t}" for t in rest]))[1:]

    def piece(self, text: str) -> str:
        """Ids of a piece as text; short pieces are remembered.

        When the table is full it becomes the older one, from which pieces in use come back.
        """
        known = self.older.get(text)
        if known is None:
            known = self.encode(text)
        if len(text) <= 40:
            if len(self.pieces) >= self.max_pieces:
                self.older, self.pieces = self.pieces, {}
            self.pieces[text] = known
        return known


class Utf8Decoder:
    """Incremental UTF-8: feed() gives the text that is whole and keeps the rest."""

    def __init__(self):
        self.pending = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Length of the incomplete sequence at the end: its lead byte says how many bytes it needs."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                needs = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if needs > back else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data) - self.unfinished(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encoding and streaming decoding of whole texts with one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # the library's engine counts only Unicode's White_Space as \s
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.transducer = Transducer(ranks)
        self.spelled = {str(rank): token for token, rank in ranks.items()}

    def runs(self, text: str, most: int = 100_000) -> Iterator[str]:
        """Ids of the text as text, in runs of pieces of bounded length."""
        piece = self.transducer.piece
        known = self.transducer.pieces
        if len(text) < most:
            found = [self.pattern.findall(text)] if text else []
        else:
            found = batched((m.group() for m in self.pattern.finditer(text)), most)
        for pieces in found:
            yield ",".join([known.get(p) or piece(p) for p in pieces])

    def encode(self, text: str) -> list[int]:
        return [int(i) for run in self.runs(text) for i in run.split(",")]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.transducer.tokens.__getitem__, ids))

    def decode(self, ids, step: int = 4096) -> Iterator[str]:
        """The text of the ids, given out while they are read."""
        decoder = Utf8Decoder()
        for some in batched(ids, step):
            yield decoder.feed(self.decode_bytes(some))
        yield decoder.close()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes."""
        n, shown, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Utf8Decoder()
        for run in self.runs(text):
            if n:
                shown.update(b",")
            shown.update(run.encode())
            ids = run.split(",")
            n += len(ids)
            decoded.update(decoder.feed(b"".join(map(self.spelled.__getitem__, ids))).encode())
        decoded.update(decoder.close().encode())
        return n, shown.hexdigest(), decoded.hexdigest()


def codec_of(call: str, broadcast, pattern: str) -> Codec:
    """The worker's codec for one call of an operator, built once per process."""
    return kept_in_worker(("bpe", call), lambda: Codec(broadcast.value, pattern))


def map_texts(docs: DataFrame, path: str, pattern: str, per_text: Callable[[Codec, str], tuple], names: list[str], types: list[str]) -> DataFrame:
    """doc_id and what per_text(codec, text) gives, for every document."""
    ranks, call = docs.sparkSession.sparkContext.broadcast(load_ranks(path)), uuid.uuid4().hex

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(call, ranks, pattern)
        for batch in found:
            rows = [per_text(codec, text or "") for text in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], arrow[t]) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(["doc_id " + kind, *(f"{n} {t}" for n, t in zip(names, types))])
    return map_texts_in_batches(docs.select("doc_id", "text"), batches, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids: the token ids of every whole text."""
    return map_texts(docs, path, pattern, lambda codec, text: (codec.encode(text),), ["ids"], ["array<int>"])


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give the empty text."""
    ranks, call = tokens.sparkSession.sparkContext.broadcast(load_ranks(path)), uuid.uuid4().hex

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(call, ranks, pattern)
        for batch in found:
            texts = ["".join(codec.decode(ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return map_texts_in_batches(tokens.select("doc_id", "ids"), batches, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and decoded again."""
    return map_texts(
        docs, path, pattern, lambda codec, text: codec.digest(text),
        ["n_tokens", "ids_sha256", "decoded_sha256"], ["long", "string", "string"],
    )
