"""Further registered queries: record fields, merging, contributions, choice of thresholds, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwright.functions import answers as A
from stepwright.functions import records as R
from stepwright.functions import text as X
from stepwright.operators import analysis
from stepwright.operators import contributions as K
from stepwright.operators import merge as M
from stepwright.operators import metrics, normalize, rewards, scoring, select, stats, steps
from stepwright.plans import views as V
from stepwright.plans.queries import logprobs, query, rounded
from stepwright.plans.views import table
from stepwright.sources.catalogue import variant_text

# -- record fields -----------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN p_brand WHEN 4 THEN p_name ELSE '' END AS answer FROM part""")
def answer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, texts, lists (also spelled in a text), objects and nulls to the answer's text."""
    name, brand = F.col("p_name"), F.col("p_brand")
    shown = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    kind = F.col("p_partkey") % 6
    value = (
        F.when(kind == 0, F.col("p_size").cast("string"))
        .when(kind == 1, F.to_json(F.array(brand, name, F.lit(" "))))
        .when(kind == 2, F.concat(F.lit("['"), brand, F.lit("', '"), name, F.lit("']")))
        .when(kind == 3, shown(text=brand, value=name))
        .when(kind == 4, shown(other=brand, multiple=F.array(brand, name)))
    )
    return table(spark, sf_dir, "part").select("p_partkey", R.answer_text(value).alias("answer"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_brand WHEN 2 THEN p_name ELSE '' END AS gold FROM part""")
def solution_gold(spark, sf_dir):
    """Golds in boxes, between dollars, as the last line, and of no solution."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("\\boxed{0} then $1$\nso \\boxed{ "), size, F.lit("} holds\n")))
        .when(kind == 1, F.concat(F.lit("first $0$\nso $1$ and $ "), F.col("p_brand"), F.lit(" $\n \n")))
        .when(kind == 2, F.concat(F.lit("some words\n  "), F.col("p_name"), F.lit("  \n")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", R.gold_in_solution(text).alias("gold"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS price, CAST(p_size AS DOUBLE) AS score FROM part""")
def raw_view(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("raw_price"), F.col("p_size").cast("double").alias("raw_score")
    )
    return R.with_raw_fallback(rows, ["price", "score", "absent"]).select("p_partkey", "price", "score")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 2.5::DOUBLE WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 3.5::DOUBLE ELSE 4.5::DOUBLE END ELSE 5.5::DOUBLE END AS value FROM part""")
def step_values(spark, sf_dir):
    """A step's value from its own column, a nested one, the long form or a suffixed column."""
    kind = F.col("p_partkey") % 4
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(kind == 0, F.lit("1.5")).alias("cmi"),
        F.when(kind == 1, F.struct(F.lit(2.5).alias("cmi"))).alias("rewards"),
        F.when(kind == 2, F.lit("cmi")).otherwise(F.lit("loo")).alias("metric"),
        F.when(F.col("p_size") % 2 == 0, 3.5).otherwise(0.0).alias("norm_value"), F.lit(4.5).alias("value"), F.lit(5.5).alias("cmi_norm"),
    )
    return rows.select("p_partkey", R.step_value(rows, "cmi").alias("value"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mi_loo' WHEN 1 THEN 'mi_Shapley' WHEN 2 THEN 'cpmi_x' ELSE p_brand END AS name FROM part""")
def reward_names(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    given = F.when(kind == 0, " LOO ").when(kind == 1, "mi_Shapley").when(kind == 2, "cpmi_x").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", R.reward_name(given).alias("name"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, p_type) AS answer, p_size % 2 = 0 AS same, p_size % 3 = 0 AS gold,
    CAST(p_size % 7 AS INTEGER) = 3 AS right_length, p_size % 7 = 3 AND p_size % 2 = 0 AS numeric FROM part""")
def field_tests(spark, sf_dir):
    """The better answer, equality of tasks, a gold at all, and tests of lists."""
    size, gold = F.col("p_size"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    other = F.when(size % 2 == 0, F.concat(F.lit("  "), F.upper("p_type"), F.lit(" "))).when(size % 4 == 1, F.lit("x"))
    values = F.when(size % 7 > 0, F.transform(F.sequence(F.lit(1), F.greatest(size % 7, F.lit(1))), lambda i: F.when(size % 2 == 0, i.cast("string")).otherwise(F.lit("1a"))))
    return table(spark, sf_dir, "part").select(
        "p_partkey", R.picked_answer(gold, F.col("p_type")).alias("answer"), R.same_task(F.col("p_type"), other).alias("same"),
        R.has_gold(F.coalesce(gold, F.lit(" "))).alias("gold"), R.of_length(values, F.lit(3)).alias("right_length"), R.numeric_list(values, F.lit(3)).alias("numeric"),
    )


def checked_conversations(spark, sf_dir):
    rows = steps.records_from_steps(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], {"text": F.col("text")})
    n = F.size("text")
    rows = rows.select("conv_id", F.when(n % 4 > 0, F.lit("Q")).alias("question"), F.when(n % 4 > 1, F.col("text")).alias("steps"), F.when(n % 4 > 2, F.lit("A")).otherwise(" ").alias("target"))
    return R.usable(rows)


@query("""WITH n AS (SELECT conv_id, count(*) % 4 AS n FROM conversations GROUP BY 1) SELECT CASE n WHEN 0 THEN 'question' WHEN 1 THEN 'steps' WHEN 2 THEN 'target' END AS drop_reason, count(*) AS n FROM n GROUP BY 1""")
def drop_report(spark, sf_dir):
    return R.drop_report(checked_conversations(spark, sf_dir))


@query("SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) % 4 <> 3")
def failed_rows(spark, sf_dir):
    rows = checked_conversations(spark, sf_dir).select("conv_id", F.when(F.col("drop_reason").isNull(), True).alias("match_ok"))
    return R.failed_rows(rows)


@query("""SELECT p_partkey, md5('Question: ' || p_name || chr(10) || '(A) ' || p_brand || chr(10) || '(B) ' || p_type || chr(10) || '(C) ' || p_size || chr(10) || 'Answer:') AS prompt FROM part""")
def choice_prompts(spark, sf_dir):
    block = R.choices_block(F.array("p_brand", "p_type", F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(R.filled(F.lit("Question: {question}\n{choices}\nAnswer:"), question=F.col("p_name"), choices=block)).alias("prompt"))


@query("""WITH r AS (SELECT vec_id, CAST(embedding[2 * i + 1] AS DOUBLE) AS a, CAST(embedding[2 * i + 2] AS DOUBLE) AS b, i FROM embeddings, (SELECT unnest(range(32)) AS i))
    SELECT vec_id, i AS token, round(CASE WHEN i % 2 = 0 THEN 1 / (1 + exp(a - b)) ELSE 1 / (1 + exp(-a)) END, 6) AS reward FROM r WHERE i % 3 = 0 AND i < 30""")
def logits_to_rewards(spark, sf_dir):
    """Rows of two logits and of one, at the tokens that a mask (shorter than the rows) marks."""
    row = lambda i: F.when(i % 2 == 0, F.transform(F.slice("embedding", 2 * i + 1, F.lit(2)), lambda x: x.cast("double"))).otherwise(F.array(F.get("embedding", 2 * i).cast("double")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: (i % 3 == 0).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", R.step_rewards(F.transform(F.sequence(F.lit(0), F.lit(31)), row), mask).alias("r"))
    return rounded(rows.select("vec_id", F.posexplode("r").alias("at", "reward")).select("vec_id", (F.col("at") * 3).cast("long").alias("token"), "reward"))


# -- merging -----------------------------------------------------------------------------------


def two_sides(spark, sf_dir):
    """Records of orders and those of another labelling: every third is altered at its end, every
    seventh is missing, every eleventh has a reward too few; each also stands there as an older row,
    which an exact match passes over and a similar one takes first."""
    text = "concat_ws(' ', string(bigint(l_quantity)), l_returnflag) AS text"
    records = V.line_records(spark, sf_dir, [*(f for f in V.LINE_FIELDS if f.endswith(("price", "quantity", "tax"))), text]).withColumnRenamed("text", "steps")
    base = records.select("record_id", F.concat(F.lit("order  "), F.col("record_id").cast("string")).alias("question"), "steps", F.col("price").alias("base_reward"))
    other = records.select("record_id", F.concat(F.lit(" order "), F.col("record_id").cast("string")).alias("question"), "steps", "quantity", "tax")
    last = F.concat(F.slice("steps", F.lit(1), F.size("steps") - 1), F.array(F.concat(F.element_at("steps", -1), F.lit("!"))))
    other = other.where("record_id % 7 <> 0").withColumn("steps", F.when(F.col("record_id") % 3 == 0, last).otherwise(F.col("steps")))
    fewer = F.when(F.col("record_id") % 11 == 0, F.slice("quantity", F.lit(1), F.size("quantity") - 1)).otherwise(F.col("quantity"))
    # each row twice by a flag, so rows are counted without what they hold
    new, at = F.col("new"), F.col("record_id")
    other = other.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("new"))
    return base, other.select("question", "steps", F.when(new, fewer).otherwise(F.col("tax")).alias("mi_loo"), F.when(new, at).otherwise(-at - 1).alias("at"))


SIDES = """r AS (SELECT record_id, count(*) AS n, sum(length(CAST(CAST(quantity AS BIGINT) AS VARCHAR)) + 2) + count(*) - 1 AS chars FROM li GROUP BY 1),
    m AS (SELECT *, CASE WHEN record_id % 7 = 0 THEN 'none' WHEN record_id % 3 <> 0 THEN 'exact' WHEN 2 * chars / (2 * chars + 1) >= 0.95::DOUBLE THEN 'fuzzy' ELSE 'none' END AS match FROM r),
    k AS (SELECT *, CASE WHEN match = 'none' THEN least(n, 2) WHEN match = 'exact' AND record_id % 11 = 0 AND n > 1 THEN n - 1 ELSE n END AS kept FROM m)"""


@query(f"""WITH {SIDES} SELECT record_id, match, CAST(kept AS INTEGER) AS n_kept, match = 'exact' AND record_id % 11 = 0 AS ragged, match <> 'none' AND kept <> n AS trimmed, step_idx,
    CASE WHEN step_idx < 2 THEN price WHEN match = 'fuzzy' THEN tax ELSE quantity END AS reward FROM k JOIN li USING (record_id) WHERE step_idx < kept""", "li")
def merge_policy(spark, sf_dir):
    base, other = two_sides(spark, sf_dir)
    rows = M.merge_records(base, other, "record_id", "base_reward", "mi_loo", "at", switch_at=2)
    return rows.select("record_id", "match", "n_kept", "ragged", "trimmed", F.posexplode("step_reward").alias("step_idx", "reward"))


@query(f"""WITH {SIDES} SELECT count(*) AS total, count(*) FILTER (match = 'exact') AS exact, count(*) FILTER (match = 'fuzzy') AS fuzzy, count(*) FILTER (match = 'none') AS missing,
    count(*) FILTER (match <> 'none' AND kept <> n) AS trimmed FROM k""", "li")
def merge_counts(spark, sf_dir):
    base, other = two_sides(spark, sf_dir)
    return M.merge_counts(base, M.merge_records(base, other, "record_id", "base_reward", "mi_loo", "at", switch_at=2))


@query(f"""WITH {SIDES} SELECT record_id, step_idx, CASE WHEN step_idx < 1 THEN price ELSE ('0x' || substr(md5('3:' || record_id || ':' || step_idx), 1, 7))::BIGINT / 268435456.0::DOUBLE END AS reward
    FROM k JOIN li USING (record_id) WHERE match = 'fuzzy' OR match = 'exact' AND record_id % 11 <> 0""", "li")
def random_tail_merge(spark, sf_dir):
    base, other = two_sides(spark, sf_dir)
    rows = M.merge_records(base, other, "record_id", "base_reward", "mi_loo", "at", lengths="strict", tail="uniform", seed=3)
    return rows.select("record_id", F.posexplode("step_reward").alias("step_idx", "reward"))


@query(f"""WITH {SIDES} SELECT record_id, step_idx, price AS x, tax AS y FROM k JOIN li USING (record_id) WHERE match = 'exact'""", "li")
def pair_rewards(spark, sf_dir):
    """The older rewards, which come first in order."""
    base, other = two_sides(spark, sf_dir)
    return M.pair_join(base, other, "record_id", "base_reward", "mi_loo", "at")


@query(f"""WITH {SIDES}, e AS (SELECT price AS x, tax AS y FROM k JOIN li USING (record_id) WHERE match = 'exact') SELECT 'x' AS a, 'y' AS b, round(corr(x, y), 6) AS r, count(*) AS n FROM e""", "li")
def pair_correlation(spark, sf_dir):
    return rounded(stats.correlation_matrix(pair_rewards(spark, sf_dir), ["x", "y"])).select("a", "b", "r", "n")


@query("""WITH u AS (SELECT 'parts' AS source, p_brand AS question, 'b' || p_size AS answer, 1 AS t FROM part UNION ALL SELECT 'parts', p_type, 't' || p_size, 0 FROM part WHERE p_size % 2 = 0
        UNION ALL SELECT 'parts', p_brand, 'x' || p_size, 0 FROM part WHERE p_size > 45 UNION ALL SELECT 'nations', n_name, 'r' || n_regionkey, 2 FROM nation),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, question ORDER BY t, answer) AS place FROM u) SELECT source, question, answer FROM r WHERE place = 1""")
def gold_index(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    said = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return M.gold_index([
        ("parts", part.where("p_size % 2 = 0"), F.col("p_type"), said("t", "p_size")), ("parts", part.where("p_size > 45"), F.col("p_brand"), said("x", "p_size")),
        ("parts", part, F.concat(F.lit(" "), F.col("p_brand")), said("b", "p_size")), ("nations", nation, F.col("n_name"), said("r", "n_regionkey")),
    ])


# -- contributions -----------------------------------------------------------------------------


def entropies(spark, sf_dir):
    """Entropies that fall with the root of the numbers in the context."""
    rows = logprobs(spark, sf_dir).where("target_kind = 'gold' and template_id = 0")
    return rows.select("record_id", "context_kind", "context_idx", (64 / (1 + F.col("lp_sum"))).alias("h_bits"))


ENTROPY = """WITH s AS (SELECT *, sum(quantity) OVER (PARTITION BY record_id ORDER BY step_idx) AS upto, sum(quantity) OVER (PARTITION BY record_id) AS every FROM li)
    SELECT record_id, step_idx, round(64 / (1 + sqrt({before})) - 64 / (1 + sqrt({after})), 6) AS reward FROM s"""


@query(ENTROPY.format(before="upto - quantity", after="upto"), "li")
def entropy_sequential(spark, sf_dir):
    return rounded(K.entropy_contrast(entropies(spark, sf_dir), "sequential"))


@query(ENTROPY.format(before="0", after="quantity"), "li")
def entropy_marginal(spark, sf_dir):
    return rounded(K.entropy_contrast(entropies(spark, sf_dir), "marginal"))


@query(ENTROPY.format(before="every - quantity", after="every"), "li")
def entropy_loo(spark, sf_dir):
    return rounded(K.entropy_contrast(entropies(spark, sf_dir), "loo"))


@query("""WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT vec_id, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM t), p AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)
    SELECT vec_id, round(-sum(p * log2(p)), 6) AS h_bits FROM p GROUP BY 1""")
def entropy_bits(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return rounded(K.entropy_bits(normalize.softmax_weights(rows, "x", ["vec_id"]), ["vec_id"], "weight"))


@query("""SELECT record_id, CAST(step_idx % 2 AS INTEGER) AS step_idx, round(coalesce(avg(CASE WHEN discount > 0.03::DOUBLE THEN tax - discount END), 0), 6) + 0.0 AS reward FROM li GROUP BY 1, 2""", "li")
def sampled_gain(spark, sf_dir):
    """Lines stand for sampled answers; those of a small discount could not be parsed."""
    samples = V.line_steps(spark, sf_dir).select(
        "record_id", (F.col("step_idx") % 2).alias("step_idx"), F.when(F.col("discount") > 0.03, F.col("answer")).otherwise(F.when(F.col("discount") > 0.01, F.lit(""))).alias("parsed"),
        F.col("discount").alias("lp_before"), F.col("tax").alias("lp_after"),
    )
    return rounded(K.sampled_gain(samples)).withColumn("reward", F.col("reward") + 0.0)


@query("SELECT record_id, step_idx, round(discount * 3 - tax, 4) + 0.0 AS contribution FROM li", "li")
def masking_contribution(spark, sf_dir):
    rows = V.line_steps(spark, sf_dir)
    made = K.masking_contribution(rows.select("record_id", "step_idx", (F.col("discount") * 3).alias("value")), rows.select("record_id", "step_idx", F.col("tax").alias("value")))
    return made.withColumn("contribution", F.col("contribution") + 0.0)


@query("""WITH s AS (SELECT *, sum(quantity) OVER (PARTITION BY record_id ORDER BY step_idx) AS upto FROM li), f AS (SELECT unnest(['gold', 'neg']) AS target_kind), t AS (SELECT unnest([0, 1]) AS template_id),
    d AS (SELECT record_id, template_id, target_kind, 0 AS target_idx, step_idx, sqrt(upto - quantity) / CASE target_kind WHEN 'neg' THEN 2 ELSE 1 END AS before, sqrt(upto) / CASE target_kind WHEN 'neg' THEN 2 ELSE 1 END AS after FROM s, f, t)
    SELECT record_id, template_id, target_kind, target_idx, step_idx, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM d""", "li")
def contrast_terms(spark, sf_dir):
    return rounded(K.contrast_terms(logprobs(spark, sf_dir), "sequential"))


@query("""WITH t AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token_id, CAST(unnest(embedding) AS DOUBLE) * 10 AS logit FROM embeddings),
    e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e, token_id = vec_id % 64 AS is_gold FROM t), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS place FROM e),
    c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) - p AS mass FROM p), k AS (SELECT unnest([{'c': 'narrow', 'k': 4, 'p': 0.3::DOUBLE}, {'c': 'wide', 'k': 16, 'p': 0.9::DOUBLE}]) AS o)
    SELECT o.c AS config, vec_id AS record_id, 0 AS pos, count(*) AS support, round(sum(p), 6) AS covered, round(ln(sum(e) FILTER (is_gold) / sum(e)), 6) AS logp FROM c, k WHERE place <= o.k OR mass < o.p OR is_gold GROUP BY 1, 2""")
def support_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.lit(0).alias("pos"), F.posexplode("embedding").alias("token_id", "x"))
    rows = rows.select("record_id", "pos", "token_id", (F.col("x").cast("double") * 10).alias("logit"), (F.col("token_id") == F.col("record_id") % 64).alias("is_gold"))
    configs = spark.createDataFrame([("narrow", 4, 0.3), ("wide", 16, 0.9)], "config string, top_k int, top_p double")
    return rounded(K.support_sweep(rows, configs))


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    c AS (SELECT DISTINCT conv_id, 'base' AS kind, 0 AS i, '' AS context FROM t UNION ALL SELECT conv_id, 'prefix', i, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) FROM t
        UNION ALL SELECT conv_id, 'single', i, text FROM t UNION ALL SELECT conv_id, 'full', 0, string_agg(text, chr(10) ORDER BY turn) FROM t GROUP BY 1
        UNION ALL SELECT a.conv_id, 'without', a.i, coalesce(string_agg(b.text, chr(10) ORDER BY b.turn) FILTER (b.i <> a.i), '') FROM t a JOIN t b USING (conv_id) GROUP BY 1, 3),
    g AS (SELECT unnest([{'k': 'gold', 'i': 0, 't': 'g'}, {'k': 'neg', 'i': 0, 't': 'x'}, {'k': 'neg', 'i': 1, 't': 'y'}]) AS g), p AS (SELECT unnest([{'i': 1, 'a': 'Solve: ', 'b': '|'}, {'i': 2, 'a': 'Q', 'b': ' ~ '}]) AS p)
    SELECT conv_id AS record_id, p.i AS template_id, kind AS context_kind, CAST(c.i AS INTEGER) AS context_idx, g.k AS target_kind, g.i AS target_idx, md5(p.a || 'q' || conv_id || p.b || context) AS prompt, g.t AS target FROM c, g, p""")
def prompt_grid(spark, sf_dir):
    rows = steps.records_from_steps(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], {"steps": F.col("text")})
    rows = rows.select(F.col("conv_id").alias("record_id"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question"), "steps", F.lit("g").alias("gold"), F.array(F.lit("x"), F.lit("y")).alias("negatives"))
    templates = spark.createDataFrame([(1, "Solve: {question}|{context}"), (2, "Q{question} ~ {context}")], "template_id int, template string")
    return K.prompt_grid(rows, templates).withColumn("prompt", F.md5("prompt"))


@query("""WITH d AS (SELECT record_id, step_idx, discount, [('0x' || substr(md5('6:' || record_id || ':' || step_idx || ':0'), 1, 7))::BIGINT / 268435456.0::DOUBLE, ('0x' || substr(md5('6:' || record_id || ':' || step_idx || ':1'), 1, 7))::BIGINT / 268435456.0::DOUBLE,
        ('0x' || substr(md5('6:' || record_id || ':' || step_idx || ':2'), 1, 7))::BIGINT / 268435456.0::DOUBLE, ('0x' || substr(md5('6:' || record_id || ':' || step_idx || ':3'), 1, 7))::BIGINT / 268435456.0::DOUBLE] AS u FROM li)
    SELECT record_id, step_idx, CASE WHEN step_idx >= 1 THEN list_sort(u)[2] ELSE discount END AS value FROM d""", "li")
def beta_tail(spark, sf_dir):
    rows = V.line_records(spark, sf_dir)
    return rows.select("record_id", F.posexplode(rewards.beta_tail(F.col("discount"), 1, 2, 3, 6, F.col("record_id"))).alias("step_idx", "value"))


@query("""SELECT record_id, step_idx, round(value, 6) AS raw_value, round(greatest(1e-6, least(1 - 1e-6, value / 400)), 6) AS value FROM ev""", "ev")
def kept_raw(spark, sf_dir):
    rows = V.event_steps(spark, sf_dir).select("record_id", "step_idx", "value")
    return rounded(normalize.keeping_raw(rows, "value", F.col("value") / 400))


# -- choice of direction and threshold ---------------------------------------------------------

CHOICE = """gold AS (SELECT record_id, coalesce(min(CASE WHEN error = 1 THEN step_idx END), -1) AS gold, record_id % 3 AS split FROM ev GROUP BY 1),
    st AS (SELECT ev.record_id, step_idx, value / 500 AS s, gold = -1 OR step_idx < gold AS ok FROM ev JOIN gold USING (record_id) WHERE {dev}),
    rk AS (SELECT ok, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM st),
    au AS (SELECT (sum(r) FILTER (ok) - count(*) FILTER (ok) * (count(*) FILTER (ok) + 1) / 2.0) / (count(*) FILTER (ok) * count(*) FILTER (NOT ok)) AS auc FROM rk),
    tu AS (SELECT record_id, step_idx, CASE WHEN auc < 0.5 THEN 1 - s ELSE s END AS s FROM st, au),
    ca AS (SELECT DISTINCT unnest(list_append(quantile_cont(s, [{shares}]), 0.0)) AS threshold FROM tu), pat AS (SELECT unnest([1, 2, 3]) AS patience),
    b AS (SELECT record_id, step_idx, threshold, s <= threshold AS b1, coalesce(lead(s) OVER w <= threshold, false) AS b2, coalesce(lead(s, 2) OVER w <= threshold, false) AS b3 FROM tu, ca WINDOW w AS (PARTITION BY record_id, threshold ORDER BY step_idx)),
    pr AS (SELECT record_id, patience, threshold, coalesce(min(CASE WHEN b1 AND (patience < 2 OR b2) AND (patience < 3 OR b3) THEN step_idx END), -1) AS predicted FROM b, pat GROUP BY 1, 2, 3),
    sc AS (SELECT patience, threshold, avg(CASE WHEN gold <> -1 THEN CAST(predicted = gold AS INT) END) AS error_acc, avg(CASE WHEN gold = -1 THEN CAST(predicted = gold AS INT) END) AS correct_acc FROM pr JOIN gold USING (record_id) GROUP BY 1, 2),
    f AS (SELECT *, coalesce(2 * coalesce(error_acc, 0) * coalesce(correct_acc, 0) / nullif(coalesce(error_acc, 0) + coalesce(correct_acc, 0), 0), 0) AS f1 FROM sc),
    ch AS (SELECT auc, auc < 0.5 AS invert, f.* FROM f, au ORDER BY round(f1, 12) DESC, patience, threshold LIMIT 1)"""
SHARES = ", ".join(repr(0.05 + 0.9 * i / 36) for i in range(37))


def scored_users(spark, sf_dir):
    rows = V.event_steps(spark, sf_dir).select("record_id", "step_idx", (F.col("value") / 500).alias("score"))
    return rows, V.gold_errors(spark, sf_dir).withColumn("split", F.col("record_id") % 3)


@query(f"""WITH {CHOICE.format(dev='true', shares=SHARES)} SELECT round(auc, 6) AS auc, invert, patience, round(threshold, 6) AS threshold, round(error_acc, 6) AS error_acc, round(correct_acc, 6) AS correct_acc, round(f1, 6) AS f1 FROM ch""", "ev")
def direction_and_threshold(spark, sf_dir):
    rows, gold = scored_users(spark, sf_dir)
    return rounded(metrics.choose_threshold(rows, "record_id", "step_idx", "score", gold.drop("split")))


@query(f"""WITH {CHOICE.format(dev='split = 0', shares=SHARES)}, al AS (SELECT record_id, step_idx, CASE WHEN invert THEN 1 - value / 500 ELSE value / 500 END <= threshold AS b1, patience FROM ev, ch),
    ld AS (SELECT *, coalesce(lead(b1) OVER w, false) AS b2, coalesce(lead(b1, 2) OVER w, false) AS b3 FROM al WINDOW w AS (PARTITION BY record_id ORDER BY step_idx)),
    fi AS (SELECT record_id, coalesce(min(CASE WHEN b1 AND (patience < 2 OR b2) AND (patience < 3 OR b3) THEN step_idx END), -1) AS predicted FROM ld GROUP BY 1),
    e AS (SELECT split, avg(CASE WHEN gold <> -1 THEN CAST(predicted = gold AS INT) END) AS error_acc, avg(CASE WHEN gold = -1 THEN CAST(predicted = gold AS INT) END) AS correct_acc FROM fi JOIN gold USING (record_id) GROUP BY 1)
    SELECT split, round(error_acc, 6) AS error_acc, round(correct_acc, 6) AS correct_acc, round(coalesce(2 * coalesce(error_acc, 0) * coalesce(correct_acc, 0) / nullif(coalesce(error_acc, 0) + coalesce(correct_acc, 0), 0), 0), 6) AS f1 FROM e""", "ev")
def tuned_on_one_split(spark, sf_dir):
    """Direction, patience and threshold chosen on split 0 and applied to all splits."""
    rows, gold = scored_users(spark, sf_dir)
    choice = metrics.choose_threshold(rows, "record_id", "step_idx", "score", gold.where("split = 0").drop("split"))
    return rounded(metrics.evaluate_splits(rows, "record_id", "step_idx", "score", gold, "split", choice))


@query("""WITH g AS (SELECT -score AS score, label FROM lab), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM g),
    a AS (SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)) AS auc FROM r)
    SELECT round(greatest(auc, 1 - auc), 6) AS auc, auc < 0.5 AS flipped FROM a""", "lab")
def auto_flip(spark, sf_dir):
    rows = V.labelled(spark, sf_dir).withColumn("score", -F.col("score"))
    return rounded(metrics.roc_auc(rows, "score", "label").select(*metrics.auto_flipped(F.col("auc"))))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 256")
def dev_budget(spark, sf_dir):
    return select.dev_budget(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 256, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("""WITH e AS (SELECT min(quantity) AS lx, max(quantity) AS hx, min(price) AS ly, max(price) AS hy FROM li), u AS (SELECT (quantity - lx) * 20 / (hx - lx) AS u, (price - ly) * 12 / (hy - ly) AS v FROM li, e),
    c AS (SELECT u, v, floor(u + 0.5) AS c0, floor(v + 0.5) AS r0, floor(u) AS c1, floor(v) AS r1 FROM u),
    d AS (SELECT *, (u - c0) ** 2 + 3 * (v - r0) ** 2 >= (u - c1 - 0.5) ** 2 + 3 * (v - r1 - 0.5) ** 2 AS shifted FROM c)
    SELECT CAST(CASE WHEN shifted THEN c1 ELSE c0 END AS BIGINT) AS "column", CAST(CASE WHEN shifted THEN r1 ELSE r0 END AS BIGINT) AS "row", shifted, count(*) AS n FROM d GROUP BY 1, 2, 3""", "li")
def hexagon_counts(spark, sf_dir):
    return stats.hexagon_counts(V.line_values(spark, sf_dir), "quantity", "price", 20)


# -- canonical answers -------------------------------------------------------------------------


@query("""SELECT p_partkey, p_size AS n, CASE p_partkey % 12 WHEN 9 THEN false WHEN 10 THEN p_size = 3 WHEN 11 THEN p_size % 2 = 0 ELSE true END AS equal FROM part""")
def answer_keys(spark, sf_dir):
    """Two spellings of an answer: have they one key, and are they graded equal? Sums, equations up to
    a factor, radicals, fractions of polynomials, unions of intervals, nested sets, a plus-minus,
    matrices; and a pair that agrees at five points only, near misses of equations and of unions."""
    n, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 12
    text = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    more = lambda k: (F.col("p_size") + k).cast("string")
    pairs = [
        (text("x+", n), text(n, " + x")),
        (text("2x=", (F.col("p_size") * 2).cast("string")), text("$x=", n, "$")),
        (text(r"\frac{", n, r"}{\sqrt{2}}"), text(r"\frac{", n, r"\sqrt2}{2}")),
        (text(r"\frac{x^2-", (F.col("p_size") * F.col("p_size")).cast("string"), "}{x-", n, "}"), text("x+", n)),
        (text("(0,", n, r")\cup[", n, ",", more(1), ")"), text("(0,", more(1), ")")),
        (text(r"\{1,\{", n, r",x\}\}"), text(r"\{\{x, ", n, r"\}, 1\}")),
        (text(r"1 \pm \sqrt{", n, "}"), text(r"\{1-\sqrt{", n, r"}, 1+\sqrt{", n, r"}\}")),
        (text(r"\begin{pmatrix} 1/2 \\ x+", n, r" \end{pmatrix}"), text(r"\begin{pmatrix} .5 \\ ", n, r"+x \end{pmatrix}")),
        (text(r"(x+1)^2+", n), text("x^2+2x+", more(1))),
        (text("(x+2)(x+1)(x-1)(x-2)(x-3)+", n, "x"), text(n, "x")),
        (text("2x=", more(1)), text("x=2")),
        (text("(0,", n, r")\cup[", F.floor(F.col("p_size") / 2).cast("string"), ",", n, "]"), text("(0,", F.when(F.col("p_size") % 2 == 0, n).otherwise(more(1)), "]")),
    ]
    either = lambda side: F.coalesce(*[F.when(kind == i, p[side]) for i, p in enumerate(pairs)])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("n"), either(0).alias("a"), either(1).alias("b"))
    rows = rows.withColumns({"same_key": A.answer_key_column(F.col("a")) == A.answer_key_column(F.col("b")), "graded": A.grade_column(F.col("a"), F.col("b"))})
    # both ways have to say the same; null where they differ
    return rows.select("p_partkey", "n", F.when(F.col("same_key") == F.col("graded"), F.col("graded")).alias("equal"))


@query("""SELECT p_size AS n, count(*) AS votes, CAST(count(DISTINCT p_partkey % 3) AS BIGINT) AS spellings FROM part GROUP BY p_size""")
def votes_by_key(spark, sf_dir):
    """Answers in three spellings, counted by their canonical key."""
    n, kind = F.col("p_size"), F.col("p_partkey") % 3
    said = (
        F.when(kind == 0, F.concat(F.lit(r"\frac{"), n.cast("string"), F.lit("}{4}x+1"))).when(kind == 1, F.concat(F.lit("1 + "), (n / 4).cast("string"), F.lit("x")))
        .otherwise(F.concat(F.lit(r"\frac{"), (n * 2).cast("string"), F.lit("x+8}{8}")))
    )
    rows = table(spark, sf_dir, "part").select(n.alias("n"), kind.alias("kind"), A.answer_key_column(said).alias("key"))
    return rows.groupBy("key").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("votes"), F.countDistinct("kind").alias("spellings")).drop("key")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'NUM:' || CAST(p_size // 2 AS VARCHAR) || '/1' ELSE 'NUM:' || CAST(p_size AS VARCHAR) || '/2' END
    WHEN 1 THEN 'NUM:1/2' WHEN 2 THEN 'NUM:-1/2' WHEN 3 THEN CAST(p_size AS VARCHAR) || '/0' WHEN 4 THEN '\\sqrt{' || CAST(p_size AS VARCHAR) || '}' ELSE NULL END AS key FROM part""")
def number_keys(spark, sf_dir):
    """Numbers without a whole part, fractions over zero and roots, which are no numbers, and nulls."""
    n, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    said = (
        F.when(kind == 0, F.concat(n, F.lit("/2"))).when(kind == 1, F.lit("the answer is: .5")).when(kind == 2, F.lit("-.5"))
        .when(kind == 3, F.concat(n, F.lit("/0"))).when(kind == 4, F.concat(F.lit(r"\sqrt{"), n, F.lit("}")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", A.canonical_key(said).alias("key"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '\\frac{' || CAST(p_size AS VARCHAR) || '}{2}' WHEN 1 THEN '(1, \\{' || p_brand || '\\})' ELSE p_brand END AS gold FROM part""")
def nested_box_gold(spark, sf_dir):
    """Golds in boxes with braces inside, and with braces that stay open."""
    n, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit(r"so \boxed{7} or \boxed{\frac{"), n, F.lit("}{2}}. end")))
        .when(kind == 1, F.concat(F.lit(r"= \boxed{ (1, \{"), F.col("p_brand"), F.lit(r"\}) }")))
        .otherwise(F.concat(F.lit("\\boxed{open\n$"), F.col("p_brand"), F.lit("$")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", R.gold_in_solution(text).alias("gold"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_partkey % 4 < 4 THEN ' how many?' END AS question FROM part""")
def questions_of_raw(spark, sf_dir):
    """Questions before a step, an answer clause, a raw step marker and a calculation."""
    kind = F.col("p_partkey") % 4
    tail = F.when(kind == 0, F.lit(" Step 1: a <<1+1=2>>")).when(kind == 1, F.lit("\nThe answer is: 3")).when(kind == 2, F.lit(" ки Step 1: b")).otherwise(F.lit(" <<3*4=12>> left"))
    return table(spark, sf_dir, "part").select("p_partkey", X.question_of(F.concat(F.col("p_name"), F.lit(" how many?"), tail)).alias("question"))


# -- scoring boundary, ragged parts, support -----------------------------------------------------


@query("""WITH r AS (SELECT DISTINCT coalesce(text, '') AS prompt, coalesce(role, '') AS target FROM conversations), s AS (SELECT DISTINCT coalesce(text, '') AS prompt, coalesce(role, '') AS target FROM conversations WHERE conv_id % 3 = 0)
    SELECT md5(prompt) AS prompt, target FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.prompt = r.prompt AND s.target = r.target)""")
def missing_requests(spark, sf_dir):
    """Prompts and targets without a stored result, each once; a third of the conversations has results."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("prompt"), F.col("role").alias("target"))
    stored = rows.where("conv_id % 3 = 0").select(scoring.request_digest(F.col("prompt"), F.col("target"), "model-a").alias("digest"))
    return scoring.missing_requests(rows, stored, "model-a").select(F.md5("prompt").alias("prompt"), "target")


@query("""WITH l AS (SELECT record_id, step_idx AS part, CASE WHEN step_idx % 3 = 2 THEN 0 ELSE CAST(quantity AS BIGINT) % 3 END AS n FROM li), e AS (SELECT *, sum(n) OVER (PARTITION BY record_id ORDER BY part) AS e FROM l)
    SELECT li.record_id, e.part, CAST(li.step_idx - (e - n) AS INTEGER) AS idx, li.price AS value FROM li JOIN e ON li.record_id = e.record_id AND li.step_idx >= e - n AND li.step_idx < e""", "li")
def ragged_split(spark, sf_dir):
    """Scores of an order in one row, cut into parts of 0 to 2 of them; lengths may miss the row's end."""
    rows = V.line_steps(spark, sf_dir)
    lengths = rows.select("record_id", F.col("step_idx").alias("part"), F.when(F.col("step_idx") % 3 == 2, 0).otherwise(F.col("quantity").cast("long") % 3).alias("n"))
    return steps.split_flat(rows.select("record_id", F.col("step_idx").alias("pos"), F.col("price").alias("value")), lengths)


@query("""WITH t AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token_id, CAST(unnest(embedding) AS DOUBLE) * 10 AS logit FROM embeddings),
    p AS (SELECT *, token_id = vec_id % 70 AS is_gold, exp(logit - max(logit) OVER w) AS e, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS place FROM t WINDOW w AS (PARTITION BY vec_id)),
    q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, max(CASE WHEN is_gold THEN place END) OVER (PARTITION BY vec_id) AS g FROM p)
    SELECT vec_id AS record_id, 0 AS pos, round(ln(sum(p) FILTER (is_gold)), 6) AS gold_logp, max(g) AS gold_rank, CASE WHEN max(g) IS NOT NULL THEN round(coalesce(sum(p) FILTER (place < g), 0), 6) END AS mass_above,
    round(sum(p) FILTER (place <= 1), 6) AS mass_1, round(sum(p) FILTER (place <= 8), 6) AS mass_8 FROM q GROUP BY 1""")
def gold_support(spark, sf_dir):
    """Rank of gold and the mass before it; for some rows gold is no token at all."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.lit(0).alias("pos"), F.posexplode("embedding").alias("token_id", "x"))
    rows = rows.select("record_id", "pos", "token_id", (F.col("x").cast("double") * 10).alias("logit"), (F.col("token_id") == F.col("record_id") % 70).alias("is_gold"))
    return rounded(rewards.gold_support(rows, [1, 8]))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN p_brand WHEN 4 THEN p_name WHEN 5 THEN p_brand WHEN 6 THEN p_name ELSE '' END AS answer FROM part""")
def variant_answers(spark, sf_dir):
    """Numbers, texts, lists, lists spelled in a text, objects in lists, objects in objects and nulls,
    as VARIANT values and without Python."""
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 8
    shown = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    value = (
        F.when(kind == 0, F.col("p_size").cast("string")).when(kind == 1, F.to_json(F.array(brand, name, F.lit(" "))))
        .when(kind == 2, F.to_json(F.array(F.concat(F.lit("['"), brand, F.lit("', '"), name, F.lit("']"))))).when(kind == 3, shown(text=brand, value=name))
        .when(kind == 4, shown(other=brand, multiple=F.array(brand, name))).when(kind == 5, F.concat(F.lit("["), shown(other=name), F.lit(","), shown(latex=brand), F.lit("]")))
        .when(kind == 6, shown(content=F.struct(F.array(name).alias("answer"))))
    )
    return table(spark, sf_dir, "part").select("p_partkey", variant_text(F.try_parse_json(value)).alias("answer"))


@query("""WITH p AS (SELECT event_type AS tag, value AS wall_s, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE (event_type LIKE 'c%' OR event_type LIKE 'p%') AND event_type LIKE '%c%' AND user_id % 2 = 1)
    SELECT tag, count(*) AS calls, count(*) AS prompts, CAST(4 * count(*) AS BIGINT) AS samples, round(sum(wall_s), 4) AS wall_s, CAST(sum(k) AS BIGINT) AS tokens, round(max(wall_s), 4) AS peak_mem_gb, round(sum(k) / sum(wall_s), 4) AS tokens_per_s FROM p GROUP BY 1""")
def profile_filtered(spark, sf_dir):
    """Costs of the records with given beginnings, parts and fields of their tags."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tag"), F.lit(1).alias("num_prompts"), F.lit(4).alias("n"), F.col("value").alias("wall_s"), F.from_json("props", "k long")["k"].alias("gen_tokens"),
        F.col("value").alias("peak_mem_gb"), F.create_map(F.lit("side"), F.when(F.col("user_id") % 2 == 1, "odd").otherwise("even")).alias("meta"),
    )
    parts = [stats.profile_filter(rows, prefix=p, contains="c", side="odd") for p in ("c", "p")]
    return rounded(stats.profile_rollup(parts[0].unionByName(parts[1])), 4)


# -- joined sums, ranges, Shapley values of entropies, the analysis ------------------------------


@query("""WITH o AS (SELECT record_id, step_idx, quantity, perm, sum(quantity) OVER (PARTITION BY record_id, perm ORDER BY md5('3:' || perm || ':' || record_id || ':' || step_idx), step_idx) AS upto FROM li, (SELECT unnest(range(4)) AS perm))
    SELECT record_id, step_idx, round(avg(1 / sqrt(1 + upto - quantity) - 1 / sqrt(1 + upto)), 6) AS reward FROM o GROUP BY 1, 2""", "li")
def entropy_shapley(spark, sf_dir):
    """Sampled orders over entropies that fall as steps are added."""
    rows = V.line_steps(spark, sf_dir).select("record_id", "step_idx", "quantity")
    orders = rewards.permutation_orders(rows, 4, 3, "quantity")
    w = Window.partitionBy("record_id", "perm").orderBy("pos")
    upto = orders.select("record_id", "perm", "pos", (1 / F.sqrt(1 + F.sum("quantity").over(w))).alias("h_bits"))
    empty = orders.where("pos = 0").select("record_id", "perm", F.lit(-1).alias("pos"), F.lit(1.0).alias("h_bits"))
    return rounded(K.entropy_shapley(orders, upto.unionByName(empty)))


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey % 3 + 1 AS n, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k, o_custkey % 4 + 1 AS n, o_totalprice AS p FROM orders WHERE o_orderkey % 3 = 0)
    SELECT a.k AS order_key, CAST(least(a.n, b.n) AS INTEGER) AS n, round(list_sum(list_transform(range(least(a.n, b.n)), lambda i: (a.p + i) + 0.5 * (b.p * i))), 4) AS total FROM a JOIN b USING (k)""")
def sum_join(spark, sf_dir):
    """Rewards of two tables added element by element, where both have the order."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    side = lambda m, n, f, name: table(spark, sf_dir, "orders").where(key % m == 0).select(key.alias("order_key"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % n), f).alias(name))
    rows = M.sum_join(side(2, 3, lambda i: price + i, "base"), side(3, 4, lambda i: price * i, "extra"), ["order_key"], "base", "extra", 0.5)
    return rounded(rows.select("order_key", F.size("reward").alias("n"), F.aggregate("reward", F.lit(0.0), lambda a, v: a + v).alias("total")), 4)


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 700 OFFSET 123")
def row_range(spark, sf_dir):
    return select.row_range(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 123, 823)


@query("""WITH m AS (SELECT record_id, step_idx, error, unnest(['price', 'discount']) AS metric, unnest([price, discount]) AS value FROM li WHERE abs(price) <= 40000), a AS (SELECT metric, 1 - error AS label, value FROM m),
    r AS (SELECT metric, label, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS rank FROM a),
    s AS (SELECT metric, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg, sum(rank) FILTER (label = 1) AS ranks FROM r GROUP BY 1), u AS (SELECT *, (ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) AS auc FROM s),
    e AS (SELECT metric, (avg(value) FILTER (label = 1) - avg(value) FILTER (label <> 1)) / (sqrt(((count(*) FILTER (label = 1) - 1) * var_samp(value) FILTER (label = 1) + (count(*) FILTER (label <> 1) - 1) * var_samp(value) FILTER (label <> 1)) / (count(*) - 2)) + 1e-12) AS d FROM a GROUP BY 1)
    SELECT metric, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(greatest(auc, 1 - auc), 6) AS auc, auc < 0.5 AS flipped, round(2 * auc - 1, 6) AS cliff_delta, round(d, 6) AS cohen_d FROM u JOIN e USING (metric)""", "li")
def auc_summary(spark, sf_dir):
    """The figures of each metric in its better direction, as the analysis has them."""
    rows = V.in_long_form(V.line_values(spark, sf_dir).where("abs(price) <= 40000"))
    return rounded(analysis.auc_summary(rows, ["price", "discount"]).select("metric", "n_pos", "n_neg", "auc", "flipped", "cliff_delta", "cohen_d"))
