"""The pipeline's stages against their operators' own decisions, on the smallest tables."""

import corpus_pipeline
import odd
import pyarrow.parquet as pq
import pytest
from test_near_copies import kept_by_all_pairs

from stepwright.llm import common, exact_dedup, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    clean = {r["doc_id"] for r in seen["toxicity"].select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert sum(labels.get(i) == 0 for i in clean) >= 0.98 * sum(y == 0 for y in labels.values())
    kept = {r["keep_id"] for r in exact_dedup.exact_groups(seen["toxicity"]).collect()}
    assert {r["doc_id"] for r in seen["exact_dedup"].collect()} == kept
    roots = kept_by_all_pairs([(r["doc_id"], r["text"]) for r in seen["exact_dedup"].collect()])
    assert {r["doc_id"] for r in seen["simhash_near_dedup"].collect()} == roots
    assert {r["doc_id"] for r in seen["mixing"].collect()} <= roots
    assert seen["byte_bpe"].count() == seen["mixing"].count()


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    """Nulls in any column, empty and long texts, repeated rows and ids, extra columns of clashing names."""
    extra = ("digest", "fp", "node", "root", "size", "slot", "score", "kept", "taken", "ids")
    data = [] if empty else odd.rows()
    docs = odd.documents(spark, data, extra)
    docs.write.parquet(str(tmp_path / "docs"))
    docs, n = spark.read.parquet(str(tmp_path / "docs")), len(data)
    for name, stage in corpus_pipeline.STAGES:
        before = [r["text"] for r in docs.select("text").collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(extra) <= set(docs.columns)
        if name == "exact_dedup":
            assert docs.count() == len({"".join((t or "").translate(dict.fromkeys(b" \t\n\x0b\x0c\r"))) for t in before})
        if name == "simhash_near_dedup":
            assert docs.count() == len(kept_by_all_pairs(list(enumerate(before))))
    assert docs.count() <= 2 * n


def test_near_copies_go_by_row(spark, tmp_path):
    """Of rows with one doc_id, null too, only those go that are near copies of another."""
    from stepwright.llm.near_copies import drop_near_copies
    from stepwright.llm.simhash import drop_near_duplicates

    base = " ".join(f"w{i}" for i in range(80))
    data = [(3, base), (7, base + " end"), (7, "a text of its own that nothing else is like"), (None, base + " tail"), (None, "some other text which stays too"), (9, None), (9, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted([repr((3, base)), repr(data[2]), repr(data[4]), repr((9, None))])
    assert sorted(repr(tuple(r)) for r in drop_near_copies(docs).collect()) == want
    got = drop_near_duplicates(docs).collect()
    assert {r["text"] for r in got} >= {data[2][1], data[4][1], None} and sum(r["text"] is None for r in got) == 1


def test_scratch_is_given_back(spark):
    """What a settled operator leaves is its result's table alone."""
    docs = odd.documents(spark)
    common.drop_scratch(spark)
    groups = exact_dedup.exact_groups(docs)
    n = groups.count()
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{common.scratch_root(spark)}/stepwright/{spark.sparkContext.applicationId}")
    names = [f.getPath().getName() for f in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    assert sorted(x.rsplit("-", 1)[0] for x in names) == ["dedup-result", "located"] and n == len(odd.rows())


def test_exact_state_goes_on_after_a_restart(spark, tmp_path):
    """A second run with the same state folder counts the new records in and reads no old ones."""
    docs = common.with_locators(spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string"))
    records, folder, state = exact_dedup.digest_records(docs), str(tmp_path / "records"), str(tmp_path / "state")
    records.where("doc_id < 5").write.parquet(folder)
    first = exact_dedup.run_state(spark, folder, records.schema, 10, state).collect()
    assert sorted(r["group_size"] for r in first) == [1, 2, 2]
    records.where("doc_id >= 5").write.mode("append").parquet(folder)
    second = exact_dedup.run_state(spark, folder, records.schema, 10, state).collect()
    assert sorted((r["doc_id"], r["group_size"]) for r in second) == [(0, 3), (1, 3), (2, 3)]
    third = exact_dedup.run_state(spark, folder, records.schema, 10, state).collect()
    assert sorted(map(repr, third)) == sorted(map(repr, second))


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    key = lambda r: repr(r)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=key)
