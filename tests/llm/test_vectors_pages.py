"""Nearest neighbours against brute force, and archives against the pages they were made of."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwright.llm import ann, warc


def vectors():
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, rows[100][1]) for i in range(60)]  # copies of a query's vector
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [float("inf")] * 8), (2004, [1.0]), (2005, [None] + [1.0] * 7), (None, [1.0] * 8), (5, rows[5][1])]
    return rows, odd


def exact(rows, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    for i, q in rows:
        if i % 100 == 0:
            order = sorted((float(d), int(j)) for d, j in zip(ann.exact_distances(np.array([q]), v)[0], ids) if j != i)
            for rank, (d, j) in enumerate(order[:k], 1):
                yield i, rank, j, d


def test_search(spark):
    rows, odd = vectors()
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"cell": F.lit(1), "row": F.lit(2), "v": F.lit(3)})
    want = set(exact(rows, 10))
    assert {tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0).collect()} == want
    some = {tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0, least=1, per_cell=6, slice_size=20).collect()}
    assert len(some) == len(want) and len(some & want) >= 0.9 * len(want)
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id in (100, 200)"), F.col("vec_id") % 100 == 0).count() == 2


def test_recall_with_production_settings(spark):
    """20,000 vectors, some in tight clusters, so that walks do not take in the whole table."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32)) * 2
    points = np.concatenate([rng.normal(size=(14_000, 32)), *(c + rng.normal(size=(100, 32)) * 0.05 for c in centres)])
    points = points[rng.permutation(len(points))]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(8)
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 100 == 0, chunk_size=64).collect()}
    true = set()
    for i in range(0, len(points), 100):
        d = ((points - points[i]) ** 2).sum(1)
        d[i] = np.inf
        true |= {(i, int(j)) for j in np.argsort(d)[:10]}
    recall = len(got & true) / len(true)
    print(f"recall {recall:.3f}")
    assert len(got) == len(true) and recall >= 0.9


def test_cells_come_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(5), rng.random(7)
    cells = list(ann.cells_in_order(a, b, np.ones(35, int), 35))
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)


def pages():
    rng = random.Random(4)
    big = "<p>" + "x" * 5000 + "</p>"
    rows = [(i, f"http://a/{i}", "".join(rng.choice("abc <>é") for _ in range(rng.randrange(300)))) for i in range(30)]
    return rows + [(40, None, big), (41, "http://b\r\nX: y", big), (39, "u", big), (50, "u", None), (51, "u", ""), (52, "u", "small"), (53, "u", "small"), (None, "u", big), (60, "u", "\r\n\r\n" * 40)]


def test_archive(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit(2), "record_type": F.lit(3)})
    first = {}
    for i, _, html in sorted(pages(), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    want = set()
    for i, _, html in pages():
        data = (html or "").encode()
        again = len(data) >= 100 and first[html] != i
        want.add((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    assert {tuple(r) for r in warc.archive_round_trip(df).collect()} == want
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_headers_are_pushed_down(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    warc.write_pages(df, f"file://{tmp_path}/w", max_file_bytes=2000)
    found = warc.read_warc(spark, f"file://{tmp_path}/w", ["record_type", "refers_to"]).where("record_type = 'revisit'")
    assert {r["refers_to"] for r in found.collect()} == {"<urn:page:39>"}
    reader = warc.WarcReader({"path": f"file://{tmp_path}/w"}, found.schema)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == []
    inflated = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert inflated == found.count()


def test_plain_members_without_lengths(tmp_path):
    import gzip

    record = {"record_type": "response", "record_id": "<urn:page:1>", "payload": b"p" * 20_000}
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(warc.record_bytes(record)) * 3)
    from pyspark.sql.types import BinaryType, StructField, StructType

    reader = warc.WarcReader({"path": str(tmp_path)}, StructType([StructField("payload", BinaryType())]))
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert got == [b"p" * 20_000] * 3


def test_archives_without_compression(tmp_path):
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    records = [{"record_type": "response", "record_id": f"<urn:page:{i}>", "payload": b"p" * n} for i, n in enumerate((0, 9_000, 5))]
    records.append({"record_type": "revisit", "record_id": "<urn:page:9>", "refers_to": "<urn:page:1>"})
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.record_bytes, records)))
    reader = warc.WarcReader({"path": str(tmp_path)}, StructType([StructField("record_id", StringType()), StructField("payload", BinaryType())]))
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == [{"record_id": r["record_id"], "payload": r.get("payload")} for r in records]
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == []
    assert [r["record_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["<urn:page:9>"]


def read_all(path, columns=("record_id", "payload"), wanted=None, **options):
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    schema = StructType([StructField(c, BinaryType() if c == "payload" else StringType()) for c in columns])
    reader = warc.WarcReader({"path": str(path), **options}, schema)
    if wanted:
        assert list(reader.pushFilters([warc.EqualTo(("record_id",), wanted)])) == []
    parts = reader.partitions()
    return [r for p in parts for b in reader.read(p) for r in b.to_pylist()], parts


def warc_records(n, size=300):
    return [{"record_type": "response", "record_id": f"<urn:page:{i}>", "payload": bytes([65 + i % 26]) * (size + i)} for i in range(n)]


def test_appends_add_up(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    pages = [(i, f"u{i}", f"<p>{i}</p>" * 40) for i in range(3)]
    for page in pages:
        warc.write_pages(spark.createDataFrame([page], "page_id long, url string, html string"), folder)
    (tmp_path / "w" / "part-left-by-a-lost-task.warc.gz").write_bytes(warc.gzip_member(warc.record_bytes(warc_records(1)[0]), 1))
    got = warc.read_warc(spark, folder).collect()
    assert sorted((r["record_id"], r["payload"].decode()) for r in got) == [(f"<urn:page:{i}>", h) for i, _, h in pages]
    warc.page_records(spark.createDataFrame([pages[1]], "page_id long, url string, html string")).write.format("warc").mode("overwrite").save(folder)
    assert [r["record_id"] for r in warc.read_warc(spark, folder).collect()] == ["<urn:page:1>"]


def test_member_with_several_records(tmp_path):
    """One member with three records, with and without its lengths, beside members of one record."""
    import gzip

    rows = warc_records(6, 20_000)
    three = b"".join(map(warc.record_bytes, rows[:3]))
    for n, first in enumerate((gzip.compress(three), warc.gzip_member(three, 1))):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / "a.warc.gz").write_bytes(first + gzip.compress(warc.record_bytes(rows[3])) + warc.gzip_member(warc.record_bytes(rows[4]), 1) + gzip.compress(warc.record_bytes(rows[5])))
        assert read_all(folder)[0] == [{"record_id": r["record_id"], "payload": r["payload"]} for r in rows]
        assert [r["record_id"] for r in read_all(folder, ("record_id",))[0]] == [r["record_id"] for r in rows]
        for r in rows:
            assert read_all(folder, wanted=r["record_id"])[0] == [{"record_id": r["record_id"], "payload": r["payload"]}]


def test_truncated_archives_are_errors(tmp_path):
    import gzip

    records = b"".join(map(warc.record_bytes, warc_records(2)))
    for n, data in enumerate((gzip.compress(records)[:-40], gzip.compress(records[:-200]), records[:-200], gzip.compress(records + b"loose words"))):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / ("a.warc" if n == 2 else "a.warc.gz")).write_bytes(data)
        with pytest.raises(ValueError, match="a (truncated record|record without a header) at byte"):
            read_all(folder)


@pytest.mark.parametrize("most", [100, 999, 5000])
def test_files_are_split_at_members(spark, tmp_path, most):
    """Ranges of any size give each record once, and no range gives another's."""
    rng = random.Random(most)
    html = lambda: "".join(rng.choice("abcdefgh<>") for _ in range(rng.randrange(10, 900)))
    pages = spark.createDataFrame([(i, "u", html()) for i in range(120)], "page_id long, url string, html string").coalesce(1)
    warc.write_pages(pages, f"file://{tmp_path}/w")
    got, parts = read_all(tmp_path / "w", partition_bytes=str(most))
    assert sorted(r["record_id"] for r in got) == sorted(f"<urn:page:{i}>" for i in range(120)) and len(parts) > 5
    assert all(b - a <= most for p in parts for _, a, b in p.ranges)


def test_slices_of_cells():
    """Each entry lies in exactly one of the slices to which a query of its cell is sent; others hold none of its cells."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 30, (7, 9))
    sizes[2, 4], sizes[5, 0] = 900, 101
    slices = ann.Slices(sizes, 50)
    rows, cols = np.nonzero(sizes)
    at = np.repeat(np.arange(len(rows)), sizes[rows, cols])
    spots = rng.integers(0, 1 << 31, len(at))
    found = list(zip(rows[at].tolist(), *(x.tolist() for x in slices.of_entries(rows[at], cols[at], spots))))
    held = {}
    for key in found:
        held[key] = held.get(key, 0) + 1
    assert max(held.values()) <= 120  # of 900 in the largest cell
    for r, c, key in zip(rows[at].tolist(), cols[at].tolist(), found):
        sent = slices.of_cells(r, [c])
        assert key[1:] in sent and all(v == [c] for v in sent.values()) and len(sent) == max(1, -(-sizes[r, c] // 50))


def test_hot_cell_gives_the_same_neighbours(spark):
    """A third of all vectors in one cell, dealt to slices of 40 entries and to one slice alone."""
    rng = np.random.default_rng(6)
    spread = rng.normal(size=(900, 8))
    tight = rng.normal(0, 0.01, (450, 8)) + 3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate((spread, tight)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    search = lambda size: {tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0, least=200, per_cell=10, slice_size=size, chunk_size=8).collect()}
    assert search(40) == search(100_000)
