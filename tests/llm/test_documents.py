"""Operators on documents against plain Python, on a table of odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import odd
import pytest
import xxhash
from pyspark.sql import functions as F

from stepwright.llm import bpe, exact_dedup, line_dedup, mixing, simhash, suffix_dedup

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("digest", "size", "slot", "kept", "body", "fp", "row_id", "anchors", "hash", "key", "taken", "n", "target")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# -- exact dedup


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    docs = odd.documents(spark, names=CLASH)
    digest = (lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 5), 4, "0"))) if weak else exact_dedup.sha256_bytes
    got = exact_dedup.exact_groups(docs, digest, files_per_batch=1).collect()
    groups = defaultdict(list)
    for r in odd.rows():
        groups[WHITE.sub("", r[1] or "")].append(r)
    best = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0] for k, v in groups.items()}
    want = Counter((r[0], best[WHITE.sub("", r[1] or "")], len(groups[WHITE.sub("", r[1] or "")])) for r in odd.rows())
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    if not weak:
        assert {r["digest"].hex() for r in got} == {sha(k) for k in groups}


def test_exact_dedup_keeps_rows(spark):
    docs = odd.documents(spark, names=CLASH)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({WHITE.sub("", r[1] or "") for r in odd.rows()})
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).count() == 0


# -- lines


def test_line_dedup(spark):
    docs = odd.documents(spark, names=("pos", "line", "hash", "first", "doc", "body", "dropped"))
    got = {}
    for r in line_dedup.dedup_lines(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_lines"], r["n_dropped"], r["text"]))
    key = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for r in odd.rows():
        for s in (r[1] or "").split("\n"):
            holders[key(s)].add(r[0])
    first = {k: min(v, key=lambda d: (d is None, d or 0)) for k, v in holders.items()}
    want = {}
    for r in odd.rows():
        lines = (r[1] or "").split("\n")
        gone = [len(key(s)) >= 10 and len(holders[key(s)]) >= 2 and first[key(s)] != r[0] for s in lines]
        want.setdefault(r[0], set()).add((len(lines), sum(gone), "\n".join(s for s, g in zip(lines, gone) if not g)))
    assert got == want
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# -- repeated substrings


def brute_repeats(texts, length):
    counts = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if counts[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        yield bytes(b for b, g in zip(t, gone) if not g), sum(gone)


def test_repeated_substrings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1500)
    docs = odd.documents(spark, names=("anchors", "runs", "body", "blocks", "core", "sha256"))
    import random

    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = noise(1500), noise(420)
    more = [(100 + i, noise(rng.randrange(900)) + passage[rng.randrange(600) : 900 + rng.randrange(600)] + other + noise(300), None, None, 0) for i in range(12)]
    docs = docs.unionByName(odd.documents(spark, more, ("anchors", "runs", "body", "blocks", "core", "sha256")))
    texts = [(r[1] or "").encode() for r in [*odd.rows(), *more]]
    ids = [r[0] for r in [*odd.rows(), *more]]
    want = Counter((i, len(t), gone, sha(kept)) for i, t, (kept, gone) in zip(ids, texts, brute_repeats(texts, 400)))
    got = Counter(
        (r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()
    )
    assert got == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# -- mixing


def test_mix_targets_and_counts(spark):
    data = [(1000 + i, "w " * (i % 7 + 1), None, f"s{min(i % 9, 4)}" if i % 11 else None, 0) for i in range(600)] + odd.rows()
    docs = odd.documents(spark, data, CLASH)
    rows = mixing.mix_counts(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d[0], len(WORD.findall(d[1] or ""))) for d in data)
    sizes, taken = Counter(), Counter()
    target = {}
    for d in data:
        sizes[d[3]] += len(WORD.findall(d[1] or ""))
    by_id = {d[0]: d[3] for d in data if d[0] is not None}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            source = by_id[r["doc_id"]]
            assert r["source_size"] == sizes[source]
            target[source] = r["target"]
            taken[source] += r["taken"]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, free, total = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:  # share out, stop the full ones, share their excess again
        level = (total - sum(want.values())) / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level >= 2 * sizes[s]}
        if not full:
            want |= {s: weights[s] * level for s in free}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    for s, t in target.items():
        assert t == pytest.approx(want[s])
        if s is not None:
            assert abs(taken[s] - t) <= max(60, 0.05 * t)
    again = mixing.mix_counts(docs).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix_counts(docs.limit(0)).count() == 0


def test_mixed_documents_hold_what_is_taken(spark):
    docs = odd.documents(spark, names=("slot", "size", "epoch"))
    words = sum(len(WORD.findall(r["text"] or "")) for r in mixing.mix_documents(docs).collect())
    assert words == sum(r["taken"] for r in mixing.mix_counts(docs).collect())
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(docs.limit(0)).count() == 0


# -- simhash


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("most", [64, 1])
def test_simhash(spark, most):
    base = [f"w{i}" for i in range(400)]
    near = [(200 + k, " ".join(base[:k] + ["new"] + base[k + 1 :]), None, None, 0) for k in range(0, 120, 3)]
    data = odd.rows() + near
    docs = odd.documents(spark, data, ("fp", "component_id", "key", "a", "b"))
    prints = [brute_fingerprint(d[1]) for d in data]
    root = list(range(len(data)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    least = {}
    for d, r in zip(data, root):
        if d[0] is not None:
            least[r] = min(least.get(r, d[0]), d[0])
    want = Counter((d[0], f, least.get(r)) for d, f, r in zip(data, prints, root))
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs, most_in_block=most).collect())
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pivots_and_midpoints_agree(spark):
    import random

    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for s in seeds for _ in range(8)}
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    pairs = {frozenset((a[0], b[0])) for a in signed for b in signed if a != b and ((a[0] ^ b[0]) % 2**64).bit_count() <= 2}
    assert {frozenset((r["a"], r["b"])) for r in simhash.pivot_links(df, 2, 10_000).collect()} == pairs
    assert {frozenset((r["a"], r["b"])) for r in simhash.midpoint_links(df, 2).collect()} <= pairs


# -- byte-level BPE


def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.load_ranks(path)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = odd.documents(spark, names=("ids", "n_tokens"))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, path, pattern).collect())
    want = Counter()
    for r in odd.rows():
        ids = theirs.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), sha(",".join(map(str, ids))), sha(r[1] or ""))] += 1
    assert got == want
    tokens = bpe.encode_documents(docs, path, pattern)
    assert Counter((r["doc_id"], r["text"]) for r in bpe.decode_documents(tokens, path, pattern).collect()) == Counter((r[0], r[1] or "") for r in odd.rows())
    assert bpe.round_trip(docs.limit(0), path, pattern).count() == 0


def test_bpe_small_tables():
    """Every state and piece table overflows, and the result stays."""
    import random

    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    small = bpe.Transducer(ranks, max_states=20, max_pieces=5, max_heads=3)
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("theranioést漢") for _ in range(rng.randrange(1, 40)))
        whole = ranks.get(piece.encode())
        assert [int(i) for i in small.piece(piece).split(",")] == ([whole] if whole is not None else bpe.merged(piece.encode(), ranks))


def test_utf8_decoder_cuts_anywhere():
    data = "aé漢🙂b".encode()
    for cut in range(len(data) + 1):
        decoder = bpe.Utf8Decoder()
        assert decoder.feed(data[:cut]) + decoder.feed(data[cut:]) + decoder.close() == "aé漢🙂b"
