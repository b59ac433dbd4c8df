"""One query per corpus operator, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.llm.ann import search
from stepwright.llm.bpe import round_trip
from stepwright.llm.chat import format_chats
from stepwright.llm.collocations import collocations
from stepwright.llm.decontaminate import contamination
from stepwright.llm.exact_dedup import exact_groups
from stepwright.llm.hard_negatives import hard_negatives
from stepwright.llm.line_dedup import dedup_lines
from stepwright.llm.mixing import mix_counts
from stepwright.llm.simhash import near_duplicates
from stepwright.llm.suffix_dedup import remove_repeats
from stepwright.llm.toxicity import held_out, score_documents, train
from stepwright.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_repeated_substrings": op2_repeated_substrings,
    "op3_line_dedup": op3_line_dedup,
    "op4_multi_index": op4_multi_index,
    "op5_chat_format": op5_chat_format,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_decontaminate": op12_decontaminate,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op1_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source, md5('7:' || doc_id) AS spot,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), totals AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) AS source_no
            FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, CAST([3, 1, 2][(source_no - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap,
                   CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total
            FROM totals
        ), filled AS (
            SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed
        ), targets AS (
            SELECT source, source_no, source_size, CASE WHEN cap / weight <= level THEN cap ELSE
                   least(weight * max(CASE WHEN cap / weight > level THEN level END) OVER (), cap) END AS target
            FROM filled
        ), lines AS (
            SELECT doc_id, size, source_size, target,
                   CASE WHEN target > 0 THEN CAST(least(2 * source_size, greatest(1, round(target))) AS BIGINT) ELSE 0 END AS reach,
                   sum(size) OVER (PARTITION BY source_no ORDER BY spot, doc_id) - size AS start
            FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(greatest(0, least(size, reach - start)) + greatest(0, least(size, reach - start - source_size)) AS BIGINT) AS taken
        FROM lines
    """,
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), shared AS (
            SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
            SELECT doc_id, pos, line, shared.key IS NOT NULL AND doc_id <> first AS gone FROM keyed LEFT JOIN shared USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op4_multi_index": r"""
        WITH sound AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
            FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op6_warc": r"""
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM firsts
    """,
    "op10_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS z
            FROM documents
        ), ranked AS (
            SELECT doc_id, z, count(*) OVER (PARTITION BY z) AS group_size,
                   row_number() OVER (PARTITION BY z ORDER BY n DESC, doc_id) AS place,
                   first_value(doc_id) OVER (PARTITION BY z ORDER BY n DESC, doc_id) AS keep_id
            FROM normal
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(z) AS text_sha256 FROM ranked
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), split AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
        ), grams AS (
            SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(ws) >= k)
        ), counts AS (
            SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
        ), often AS (
            SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE a >= 10
        ), sizes AS (
            SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
        ), cuts AS (
            SELECT lang, k, phrase, a, ws, c, array_to_string(ws[1:c], ' ') AS first, array_to_string(ws[c + 1:], ' ') AS rest
            FROM (SELECT *, unnest(range(1, k)) AS c FROM often WHERE k > 1)
        ), graded AS (
            SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, cuts.c, x.a AS l, y.a AS r,
                   CAST((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
            FROM cuts JOIN often x ON x.lang = cuts.lang AND x.phrase = cuts.first JOIN often y ON y.lang = cuts.lang AND y.phrase = cuts.rest
        ), lowest AS (
            SELECT * FROM graded QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
        ), covered AS (
            SELECT DISTINCT o.lang, array_to_string(o.ws[s:s + 1], ' ') AS phrase, o.a AS longer
            FROM often o, (VALUES (1), (2)) AS starts(s) WHERE o.k = 3
        ), kept AS (
            SELECT * FROM lowest AS c WHERE NOT EXISTS (
                SELECT 1 FROM covered WHERE covered.lang = c.lang AND covered.phrase = c.phrase AND 100 * covered.longer >= 50 * c.a)
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN sizes USING (lang)
        QUALIFY rank <= 2000
    """,
    "op12_decontaminate": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS doc, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), items AS (
            SELECT item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
            FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
        ), places AS (
            SELECT doc, n, i, array_to_string(ws[i:i + n - 1], ' ') AS phrase
            FROM (SELECT doc, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)
        ), found AS (
            SELECT doc, n, i, item_id FROM places JOIN windows USING (n, phrase)
        ), hits AS (
            SELECT doc, count(DISTINCT p) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc, n, i FROM found)) GROUP BY doc
        ), named AS (
            SELECT doc, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
            FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hits USING (doc) LEFT JOIN named USING (doc)
    """,
    "op13_hard_negatives": r"""
        WITH sound AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS other_id,
                   CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
}
