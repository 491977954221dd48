"""Registered queries of evaluation: nearest vectors judged by label, readings judged by what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.functions.ranks import nearest_rank
from folioquery.functions.text import query_terms
from folioquery.operators import corpus as C
from folioquery.operators import evaluation as E
from folioquery.operators import facts as X
from folioquery.operators import ledger as L
from folioquery.operators import retrieval as R
from folioquery.operators.keywords import rank_all
from folioquery.plans.queries_facts import texts
from folioquery.plans.queries_ledger import SQL_LEDGER, payments
from folioquery.plans.queries_retrieval import chunks, vectors
from folioquery.plans.registry import query
from folioquery.sources.store import kept, signature, spread, written
from folioquery.sources.tables import table

SQL_Q = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, list_dot_product(q.v, v.v) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s QUALIFY rank <= 20),
f AS (SELECT query_id, min(rank) AS first FROM r JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = item_id WHERE a.label = b.label GROUP BY query_id),
q AS (SELECT vec_id AS query_id, label % 3 AS style FROM v WHERE vec_id % 100 = 0)
"""


@query("retrieval_quality", "WITH " + SQL_Q + "SELECT style, count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM q LEFT JOIN f USING (query_id) GROUP BY style")
def retrieval_quality(spark, sf):
    v = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    asked = v.where("vec_id % 100 = 0")
    found = R.cosine(v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 21)
    found = R.ranked(found.drop("rank").where("query_id <> chunk_id"), 20).select("query_id", "rank", F.col("chunk_id").alias("item_id"))
    of_query, of_item = (d.select(F.col("vec_id").alias(c), "label") for d, c in ((asked, "query_id"), (v, "item_id")))
    relevant = found.select("query_id", "item_id").join(of_query, "query_id").join(of_item, ["item_id", "label"]).select("query_id", "item_id")
    scored = E.quality(found, relevant, asked.select(F.col("vec_id").alias("query_id"), (F.col("label") % 3).alias("style")))
    return scored.select("style", "queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr")])


@query("retrieval_quality_modes")
def quality_by_mode(spark, sf):
    """Each hundredth vector asks, with the first eight words of its document, in each of the three modes, limit 20.

    The asking document itself is left out of its ranking; items of the same label are relevant.
    """
    v = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    asking = v.where("vec_id % 100 = 0")
    documents = table(spark, sf, "documents", "doc_id", "text")
    opening = documents.select(F.col("doc_id").alias("vec_id"), F.array_join(F.slice(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), 1, 8), " ").alias("text"))
    asked = asking.join(opening, "vec_id", "left").select(F.col("vec_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("embedding").alias("vector"))
    own = written(chunks(spark, sf), "chunks", "zstd")  # each leg is made once for all modes; an index of all words would take several times the table's disk
    terms = query_terms(F.col("text"))
    keyword = written(rank_all(own, asked.select("query_id", terms.alias("terms"), F.lit(1).alias("least"))), "keyword-leg")
    meaning = written(R.cosine(vectors(spark, sf), asked.select("query_id", "vector")), "meaning-leg")
    of_query, of_item = (d.select(F.col("vec_id").alias(c), "label") for d, c in ((asking, "query_id"), (v, "item_id")))
    styles = asking.select(F.col("vec_id").alias("query_id"), (F.col("label") % 3).alias("style"))
    scored = None
    for mode in ("KEYWORDS", "MEANING", "MERGED"):
        found = R.per_item(R.fuse(keyword, meaning, R.SearchOptions(mode=mode)), own, 21).where("query_id <> item_id")
        found = R.ranked(found.drop("rank"), 20).select("query_id", "rank", "item_id")
        relevant = found.select("query_id", "item_id").join(of_query, "query_id").join(of_item, ["item_id", "label"]).select("query_id", "item_id")
        one = E.quality(found, relevant, styles).select(F.lit(mode).alias("mode"), "style", "queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr")])
        scored = one if scored is None else scored.unionByName(one)
    return scored


@query("character_errors")
def errors(spark, sf):
    """Over whole texts, which DuckDB's levenshtein is too slow for."""
    rows = table(spark, sf, "documents", "lang", "text").where(F.length("text") > 0).select("lang", F.col("text").alias("truth"), F.translate("text", "e", "c").alias("text"))
    return E.character_errors(rows).withColumn("error", F.round("error", 6))


@query("latency_percentiles", "SELECT event_type, list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95, list_sort(list(value))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS p50 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentiles(spark, sf):
    rows = table(spark, sf, "events", "event_type", "value")
    return nearest_rank(rows, ["event_type"], "value", 95, "p95").join(nearest_rank(rows, ["event_type"], "value", 50, "p50"), "event_type")


SQL_STYLE = "(['en', 'hi', 'te', 'rt', 'mix'])[1 + CAST(o_orderkey % 5 AS INT)]"


@query("language_split", f"WITH q AS (SELECT o_orderkey AS query_id, {SQL_STYLE} AS style, (['en', 'hi', 'te'])[1 + CAST(o_custkey % 3 AS INT)] AS target_lang, 1 + o_orderkey % 7 AS first FROM orders), s AS (SELECT *, CASE WHEN (style IN ('en', 'rt', 'mix') AND target_lang = 'en') OR (style = target_lang AND style IN ('hi', 'te')) THEN 'same' ELSE 'cross' END AS side FROM q) SELECT side AS style, count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(1.0 / first), 6) AS mrr FROM s GROUP BY side")
def languages(spark, sf):
    """Rankings whose relevant item stands at a place known from the order."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    q = o.select(F.col("o_orderkey").alias("query_id"), F.element_at(F.array(*map(F.lit, ("en", "hi", "te", "rt", "mix"))), (1 + F.col("o_orderkey") % 5).cast("int")).alias("style"), F.element_at(F.array(*map(F.lit, ("en", "hi", "te"))), (1 + F.col("o_custkey") % 3).cast("int")).alias("target_lang"))
    rankings = o.select(F.col("o_orderkey").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank")).withColumn("item_id", F.col("rank"))
    relevant = o.select(F.col("o_orderkey").alias("query_id"), (1 + F.col("o_orderkey") % 7).cast("int").alias("item_id"))
    scored = E.language_split(rankings, relevant, q)
    return scored.select("style", "queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr")])


@query("ledger_truth_by_month", SQL_LEDGER + ", t0 AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY id) AS n FROM payments WHERE outcome = 'SUCCESS' AND direction = 'PAID' AND reference IS NOT NULL AND amount_paise IS NOT NULL AND paid_date IS NOT NULL), t AS (SELECT substr(paid_date, 1, 7) AS month, sum(amount_paise) AS truth_paise FROM t0 WHERE n = 1 GROUP BY 1), c AS (SELECT month, sum(amount_paise) AS counted_paise FROM counted GROUP BY month) SELECT month, CAST(coalesce(truth_paise, 0) AS BIGINT) AS truth_paise, CAST(coalesce(counted_paise, 0) AS BIGINT) AS counted_paise, round(CASE WHEN truth_paise > 0 THEN coalesce(counted_paise, 0) / truth_paise END, 6) AS share FROM t FULL JOIN c USING (month)")
def truth_by_month(spark, sf):
    own = payments(spark, sf).where("amount_paise IS NOT NULL AND paid_date IS NOT NULL").withColumnRenamed("amount_paise", "paise")
    counted = L.buckets(payments(spark, sf)).where("bucket = 'COUNTED'").select(F.col("amount_paise").alias("paise"), "paid_date")
    return E.ledger_by_month(own, counted).withColumn("share", F.round("share", 6))


@query("answer_outcomes", "SELECT style, count(*) FILTER (r = 'correct') AS correct, count(*) FILTER (r = 'wrong') AS wrong, count(*) FILTER (r = 'made_up') AS made_up, count(*) FILTER (r = 'declined') AS declined, count(*) FILTER (r = 'not_a_question') AS not_a_question FROM (SELECT 's' || o_custkey % 4 AS style, CASE WHEN o_orderkey % 6 = 0 THEN 'not_a_question' WHEN o_orderkey % 6 = 1 THEN 'declined' WHEN o_orderkey % 5 = 0 THEN 'made_up' WHEN o_orderkey % 3 = 0 THEN 'wrong' ELSE 'correct' END AS r FROM orders) GROUP BY style")
def answered(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    expected = o.selectExpr("o_orderkey AS query_id", "concat('s', o_custkey % 4) AS style", "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS STRING) END AS value")
    given = o.where("o_orderkey % 6 <> 0").selectExpr("o_orderkey AS query_id", "CASE WHEN o_orderkey % 6 = 1 THEN 'DECLINED' ELSE 'FOUND' END AS outcome", "CASE WHEN o_orderkey % 6 <> 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE CAST(o_custkey AS STRING) END END AS value")
    return E.outcomes(given, expected)


@query("fact_hit_rates", "SELECT 'DATE' AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS lang, count(*) AS facts, round(avg(CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS share FROM orders GROUP BY 2")
def hits(spark, sf):
    """Dates read from texts made of orders, against truth that is another day for each fourth."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    truth = o.selectExpr("o_orderkey AS item_id", "'DATE' AS kind", "concat(date_format(CASE WHEN o_orderkey % 4 = 0 THEN date_add(CAST(o_orderdate AS DATE), 1) ELSE CAST(o_orderdate AS DATE) END, 'yyyy-MM-dd'), CASE WHEN o_orderkey % 3 < 2 THEN date_format(o_orderdate, \"'T'HH:mm\") ELSE '' END) AS value", "CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS lang")
    return E.hit_rates(X.facts(texts(spark, sf)), truth).withColumn("share", F.round("share", 6))


MODES = ["OFF", "LOOKALIKE", "GUARD", "ALTERNATIVE"]


#: Readings of an amount by what is left of the order's number by 7: a clean one, two digits as look-alikes of another script, a
#: foreign digit behind it, the sign lost and read as a 2, nothing, the sign lost, another one, of which nothing was written.
SQL_DAMAGED = """CASE {k} WHEN 0 THEN 'Amount: ₹' || {w} WHEN 1 THEN 'Amount: ₹' || {w} || '৪০' WHEN 2 THEN 'Amount: ₹' || {w} || '৯' WHEN 3 THEN 'Paid' || {nl} || '2' || {w}
  WHEN 4 THEN 'Amount: none' WHEN 5 THEN 'Total' || {nl} || {w} ELSE 'Amount: ₹' || {w} || '३' END"""


@query("amount_outcomes", """WITH o AS (SELECT o_orderkey % 7 AS k, unnest(['OFF', 'LOOKALIKE', 'GUARD', 'ALTERNATIVE']) AS mode FROM orders),
r AS (SELECT *, CASE WHEN k = 0 THEN 'CC' WHEN k = 1 THEN CASE WHEN mode = 'OFF' THEN 'WC' ELSE 'CF' END WHEN k = 2 THEN CASE WHEN mode IN ('OFF', 'LOOKALIKE') THEN 'WC' ELSE 'WF' END
  WHEN k = 3 THEN 'WF' WHEN k = 4 THEN 'N' WHEN k = 5 THEN 'CF' ELSE CASE WHEN mode IN ('OFF', 'LOOKALIKE') THEN 'CC' ELSE 'CF' END END AS r FROM o)
SELECT mode, count(*) AS items, count(*) FILTER (r = 'CC') AS correct_confident, count(*) FILTER (r = 'CF') AS correct_flagged, count(*) FILTER (r = 'WC') AS wrong_confident, count(*) FILTER (r = 'WF') AS wrong_flagged, count(*) FILTER (r = 'N') AS none,
  count(*) FILTER (r IN ('CC', 'CF') OR (k = 3 AND mode = 'ALTERNATIVE')) AS offered, count(*) FILTER (k = 6 AND r <> 'CC') AS regressed, count(*) FILTER (k = 6 AND r = 'CF') AS false_flags FROM r GROUP BY mode""")
def amounts(spark, sf):
    """Amounts of damaged readings in each mode, judged against what was written."""
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice").selectExpr("o_orderkey", "o_orderkey % 7 AS k", "CAST(CAST(o_totalprice AS BIGINT) + 1000 AS STRING) AS w")
    true = "CASE k WHEN 1 THEN w || '80' WHEN 2 THEN w || '9' ELSE w END AS true_value"
    shown = o.selectExpr("o_orderkey AS item_id", true, SQL_DAMAGED.format(k="k", w="w", nl="chr(10)") + " AS text")
    return E.amount_outcomes(E.judged_amounts(X.amounts(shown, MODES), MODES))


def sweep_index(spark, sf):
    """Texts made of orders as an index, one chunk an item; its postings are only made where they are read."""
    chunks = texts(spark, sf).select(F.col("item_id").alias("chunk_id"), "item_id", F.lit(0).alias("ordinal"), "text")

    def make() -> R.Index:
        own = written(spread(chunks), "orders-chunks")
        return R.Index(own, R.postings(own), written(R.statistics(own), "orders-statistics"))

    return kept(spark, ("orders-index", *signature(spark, f"{sf}/orders.parquet")), make)


def sweep_vectors(spark, sf):
    """Items share the vectors of the table in turn: their meaning leads to a few dozen items, one of which is right."""
    own = table(spark, sf, "embeddings", "vec_id", "embedding")
    return table(spark, sf, "orders", "o_orderkey").join(F.broadcast(own.agg(F.count("*").alias("n")))).select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % F.col("n")).alias("vec_id")).join(own, "vec_id").select("chunk_id", F.col("vec_id").alias("same"), F.col("embedding").alias("vector"))


#: Questions about the order {k} by what is left of its number by 9: text, whether a value is asked for, which one is right.
UTR = "CAST(100000000000 + o_orderkey AS STRING)"
SWEPT = [
    (f"concat('how much was transaction ', {UTR})", True, "amount"), (f"concat('when was transaction ', {UTR}, ' paid')", True, "day"), (f"concat('shop payment paid ', {UTR}, ' ka amount kitna tha mein')", True, "amount"),
    ("concat('how much was the shop payment paid ', CAST(900000000000 + o_orderkey AS STRING))", True, None), ("concat('hai shop photo c', o_custkey)", False, None), (f"concat('what amount bhara shop paid ', {UTR})", True, "amount"),
    (f"concat('how much was the boat shop payment paid ', {UTR})", True, None), ("concat('amount paid to c', o_custkey, ' kitna ')", True, "amount"), (f"concat('se ', {UTR}, ' ko payment september')", False, None),
]


def swept(spark, sf):
    """Queries and their relevant items: each order whose number is divisible by 100 asks one question against all of them."""
    choose = lambda place: "CASE (o_orderkey div 300) % 9 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(r[place] for r in SWEPT)) + " END"
    values = {"amount": "regexp_replace(regexp_replace(format_number(o_totalprice, 2), ',', ''), '[.]?0+$', '')", "day": "concat(date_format(o_orderdate, 'yyyy-MM-dd'), CASE WHEN o_orderkey % 3 < 2 THEN date_format(o_orderdate, \"'T'HH:mm\") ELSE '' END)", None: "CAST(NULL AS STRING)"}
    value = "CASE (o_orderkey div 300) % 9 " + " ".join(f"WHEN {k} THEN {values[r[2]]}" for k, r in enumerate(SWEPT)) + " END"
    own = table(spark, sf, "embeddings", "vec_id", "embedding")
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").where("o_orderkey % 100 = 0")
    asked = o.selectExpr("o_orderkey AS query_id", f"{choose(0)} AS text", f"{choose(1)} AS asks", f"{value} AS value").join(F.broadcast(own.agg(F.count("*").alias("n"))))
    near = asked.withColumn("vec_id", (F.col("query_id") + F.when(F.col("query_id") % 400 == 0, 1).otherwise(0)) % F.col("n"))
    return near.join(own, "vec_id").select("query_id", "text", F.col("embedding").alias("vector"), "asks", "value"), o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("item_id"))


@query("variant_sweep")
def sweep(spark, sf):
    """Five variants of retrieval by four answer gates, over questions about texts made of orders whose answers are known."""
    queries, relevant = swept(spark, sf)
    found = E.sweep(sweep_index(spark, sf), sweep_vectors(spark, sf), queries, relevant, X.facts)
    return found.select("variant", "gate", "queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr")], "correct", "wrong", "made_up", "declined", "not_a_question")


@query("choose_variant", "WITH s AS (SELECT 'l' || l_linenumber AS variant, round(avg(l_discount), 6) AS metric, round(avg(l_quantity), 6) AS guard FROM lineitem GROUP BY 1) SELECT variant, metric, guard FROM s WHERE guard >= (SELECT guard FROM s WHERE variant = 'l1') - 0.5 ORDER BY metric DESC, variant LIMIT 1")
def variant(spark, sf):
    """With some loss of the guard allowed."""
    scores = table(spark, sf, "lineitem", "l_linenumber", "l_discount", "l_quantity").groupBy(F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("variant")).agg(F.round(F.avg("l_discount"), 6).alias("metric"), F.round(F.avg("l_quantity"), 6).alias("guard"))
    return E.choose_variant(scores, "l1", 0.5)


@query("variant_chosen", "WITH s AS (SELECT 'v' || o_custkey % 9 AS variant, round(avg(o_totalprice), 4) AS metric, CAST(count(*) AS DOUBLE) AS guard FROM orders GROUP BY 1) SELECT variant, metric, guard FROM s WHERE guard >= (SELECT guard FROM s WHERE variant = 'v0') ORDER BY metric DESC, variant LIMIT 1")
def chosen(spark, sf):
    """Of nine variants whose figures come from the orders, the best whose guard isn't below the first one's."""
    scores = table(spark, sf, "orders", "o_custkey", "o_totalprice").groupBy(F.concat(F.lit("v"), (F.col("o_custkey") % 9).cast("string")).alias("variant")).agg(F.round(F.avg("o_totalprice"), 4).alias("metric"), F.count("*").cast("double").alias("guard"))
    return E.choose_variant(scores, "v0")


def seeded(spark, sf):
    """The corpus that is made of the orders."""
    o, c = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), table(spark, sf, "customer", "c_custkey", "c_name")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.translate("c_name", "0123456789#", "abcdefghij ").alias("name"), F.round(F.col("o_totalprice") * 100).cast("long").alias("paise"), F.col("o_orderdate").cast("date").alias("day"))
    return C.documents(rows, 11)


SQL_SEEDED = "SELECT o_orderkey AS id, (['bill', 'receipt', 'card', 'note'])[1 + (o_orderkey * 7 + 11) % 4] AS type, (['en', 'hi', 'te'])[1 + (o_orderkey * 5 + 11) % 3] AS lang FROM orders"


@query("corpus_facts", f"SELECT kind, lang, count(*) AS facts, CAST(1 AS DOUBLE) AS share FROM (SELECT lang, unnest(CASE type WHEN 'card' THEN ['PHONE', 'ADDRESS'] WHEN 'note' THEN [] ELSE ['AMOUNT', 'DATE'] END) AS kind FROM ({SQL_SEEDED})) GROUP BY ALL")
def corpus_facts(spark, sf):
    """Which share of the facts of the seeded corpus is read from its texts, by kind and language."""
    corpus = seeded(spark, sf)
    truth = corpus.select(F.col("doc_id").alias("item_id"), "lang", F.explode("facts").alias("kind", "value"))
    return E.hit_rates(X.facts(corpus.select(F.col("doc_id").alias("item_id"), "text")), truth).withColumn("share", F.round("share", 6))


@query("corpus_questions", f"SELECT style, kind, count(*) AS questions, count(relevant) AS with_item FROM (SELECT lang AS style, CASE WHEN type = 'note' THEN 'find' WHEN (id // 10) % 3 = 0 THEN 'negative' ELSE 'value' END AS kind, CASE WHEN type = 'note' OR (id // 10) % 3 <> 0 THEN id END AS relevant FROM ({SQL_SEEDED}) WHERE id % 10 = 0) GROUP BY ALL")
def corpus_questions(spark, sf):
    """Questions about the seeded corpus, by language and kind."""
    return C.questions(seeded(spark, sf)).groupBy("style", "kind").agg(F.count("*").alias("questions"), F.count("relevant").alias("with_item"))
