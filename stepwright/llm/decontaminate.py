"""Benchmark decontamination by a distributed positional inverted index.

The index is dealt by document: each task that reads documents writes a segment, the postings
(term, row, position) of its texts in the order of terms, so a term that stands in every text is
spread over all segments and nothing is shuffled to build it. A query takes the posting lists of
a phrase's rarest words, moves each posting back by its word's offset in the phrase and
intersects the lists on (row, phrase, start); what is left is looked up word by word. Lists of
common words are read for the few rows that the rare ones leave, never joined as a whole.

Words are compared as strings; the 64-bit hash beside them only orders the segments.

Every step is a DataFrame expression. The words of the test phrases are broadcast only while they
are at most MOST_TERMS; beyond, the lists meet them by a shuffle, which adaptive execution splits
where a word is common.

Defined cases: a null text, of a document or of an item, has no words and no windows; an item
without words occurs nowhere; repeated documents are rows of their own and give equal results;
repeated items and items of equal text each count by item_id, and rows of one item_id are one
item; the words of an item whose item_id is null are hit, but it is neither counted nor listed;
an empty documents table gives an empty result, an empty benchmark no hits; columns beside doc_id,
text and item_id are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.llm.common import materialise, maybe_among, settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII letters and digits and everything beyond ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of phrase words that a join may broadcast (some 40 bytes each).
MOST_TERMS = 200_000
#: Lists of so many of a phrase's rarest words are intersected before anything is looked up.
RAREST = 2


def words_of(text: Column) -> Column:
    """The text's words with A-Z in lower case; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD_PATTERN), F.lit(0))


def positional_index(docs: DataFrame, label: str = "postings") -> DataFrame:
    """term (hash), word, row, pos of every word of every text, written as segments in the order of term.

    Each row of docs also has one entry without a word: its doc_id, with its number of words as pos.
    """
    ended = F.concat(words_of(F.col("text")), F.array(F.lit(None).cast("string")))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # before the explode, so one number a row
    entries = numbered.select("doc_id", "row", F.posexplode(ended).alias("pos", "word"))
    entries = entries.select(
        F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"),
        "word", "row", "pos", F.when(F.col("word").isNull(), F.col("doc_id")).alias("doc_id"),
    )
    return materialise(entries.sortWithinPartitions("term"), label)


def few(table: DataFrame) -> DataFrame:
    """table, to be broadcast where its size is within MOST_TERMS."""
    return F.broadcast(table) if table.limit(MOST_TERMS + 1).count() <= MOST_TERMS else table


@dataclass(frozen=True)
class Phrases:
    """Phrases as posting lists see them.

    terms: phrase, offset, term, word, n (the phrase's words), freq (of the word in the index), rank
    (1: the phrase's rarest word). Phrases with a word that the index lacks are left out.
    """

    terms: DataFrame


def ranked_phrases(index: DataFrame, phrases: DataFrame) -> Phrases:
    """phrases: phrase (long), words (array of strings, not empty)."""
    terms = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
    terms = materialise(terms.withColumn("term", F.xxhash64("word")), "phrase-terms")
    vocabulary = materialise(terms.select("term", "word").distinct(), "phrase-vocabulary")
    counts = index.select("term", "word").join(few(vocabulary), ["term", "word"]).groupBy("term", "word").agg(F.count("*").alias("freq"))
    counts = materialise(counts, "phrase-counts")
    by_rarity = Window.partitionBy("phrase").orderBy("freq", "word", "offset")
    whole = Window.partitionBy("phrase")
    ranked = terms.join(few(counts), ["term", "word"])
    ranked = ranked.withColumns({"rank": F.row_number().over(by_rarity), "known": F.count("*").over(whole)})
    return Phrases(materialise(ranked.where("known = n").drop("known"), "phrase-ranks"))


def offset_lists(index: DataFrame, terms: DataFrame) -> DataFrame:
    """row, phrase, n, start: each posting of terms' words, moved back by the word's offset."""
    lists = index.select("term", "word", "row", "pos").join(few(terms), ["term", "word"])
    return lists.select("row", "phrase", "n", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")


def phrase_matches(index: DataFrame, phrases: Phrases) -> DataFrame:
    """row, phrase, n, start: every exact occurrence, the n words from position start on."""
    place = ["row", "phrase", "n", "start"]
    rare = phrases.terms.where(F.col("rank") <= RAREST)
    found = offset_lists(index, rare).groupBy(*place).agg(F.count("*").alias("met"))
    found = materialise(found.where(F.col("met") == F.least("n", F.lit(RAREST))), "phrase-candidates")
    rest = phrases.terms.where(F.col("rank") > RAREST).select("phrase", "offset", "term", "word")
    wanted = found.join(few(rest), "phrase").withColumn("pos", F.col("start") + F.col("offset"))
    vocabulary = materialise(rest.select("term", "word").distinct(), "phrase-rest")
    postings = index.select("term", "word", "row", "pos").join(few(vocabulary), ["term", "word"], "left_semi")
    postings = maybe_among(postings, found.select("row").distinct(), ("row",))
    met = wanted.join(postings, ["row", "pos", "term", "word"]).groupBy(*place).agg(F.count("*").alias("met"))
    total = found.unionByName(met).groupBy(*place).agg(F.sum("met").alias("met"))
    return total.where("met = n").drop("met")


def proximity_matches(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    """row, phrase, at: positions of a phrase's rarest word beside which all its words stand.

    They stand in any order, each as often as in the phrase, within n + slop consecutive words
    that hold position `at`. Only positions that near are gathered, so a group has at most
    2 * (n + slop) of them.
    """
    head = phrases.terms.where("rank = 1").select("phrase", "term", "word", F.col("n").alias("size"))
    heads = index.select("term", "word", "row", "pos").join(few(head), ["term", "word"])
    heads = materialise(heads.select("row", "phrase", F.col("pos").alias("at"), (F.col("size") + slop).alias("span")), "near-heads")
    places = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("span") + 1), F.col("at") + F.col("span") - 1)
    near = heads.select("row", "phrase", "at", "span", F.explode(places).alias("pos"))
    needs = phrases.terms.groupBy("phrase", "term", "word").agg(F.count("*").alias("need"))
    postings = maybe_among(index.select("term", "word", "row", "pos").where("word IS NOT NULL"), heads.select("row").distinct(), ("row",))
    there = near.join(postings, ["row", "pos"]).join(few(needs), ["phrase", "term", "word"])
    lists = there.groupBy("row", "phrase", "at", "span", "term", "word", "need").agg(F.collect_list("pos").alias("spots"))
    lists = lists.groupBy("row", "phrase", "at", "span").agg(F.collect_list(F.struct("need", "spots")).alias("lists"))
    n_words = needs.groupBy("phrase").agg(F.count("*").alias("distinct"))
    full = lists.join(few(n_words), "phrase").where(F.size("lists") == F.col("distinct"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("span") + 1), F.col("at"))
    within = lambda s, x: F.size(F.filter(x["spots"], lambda p: (p >= s) & (p < s + F.col("span")))) >= x["need"]
    return full.where(F.exists(starts, lambda s: F.forall("lists", lambda x: within(s, x)))).select("row", "phrase", "at")


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, words: the item's windows of width words; the whole of a shorter item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, width))).alias("words"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs, and items: the sorted item_ids.

    width: words of a window; an item of fewer words is one window.
    """
    return settle(docs.sparkSession, lambda: _contamination(docs, benchmark, width), "contamination")


def _contamination(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    index = positional_index(docs.select("doc_id", "text"))
    windows = materialise(item_windows(benchmark, width).distinct(), "item-windows")
    phrases = materialise(windows.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    matches = materialise(phrase_matches(index, ranked_phrases(index, phrases)), "phrase-matches")
    # distinct hit positions: each stretch counts from where those before it in its row end
    spans = matches.select("row", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi")).distinct()
    before = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest("lo", F.coalesce(F.max("hi").over(before), F.lit(0)))
    hits = spans.select("row", F.greatest(F.lit(0), F.col("hi") - reach).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    members = windows.where("item_id IS NOT NULL").join(phrases, "words").select("phrase", "item_id").distinct()
    items = matches.select("row", "phrase").distinct().join(few(members), "phrase").select("row", "item_id").distinct()
    items = items.groupBy("row").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    rows = index.where("word IS NULL").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    rows = rows.join(hits, "row", "left").join(items, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), items.alias("items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, text of the documents that hold no window of the benchmark; rows of one doc_id go together."""
    hit = contamination(docs, benchmark, width).where("contaminated").select("doc_id").distinct()
    same = docs["doc_id"].eqNullSafe(hit["doc_id"])
    return docs.join(hit, same, "left_anti").select("doc_id", "text")
