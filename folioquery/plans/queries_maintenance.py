"""Registered queries of upkeep: logs of decisions, rates and reminders, versions, clearing, reports, runs over pending work, bursts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.functions import embedding
from folioquery.operators import ledger as L
from folioquery.operators import maintenance as M
from folioquery.operators import retrieval as R
from folioquery.operators.facts import facts
from folioquery.plans.queries_facts import texts
from folioquery.plans.queries_ledger import SQL_LEDGER, ledger
from folioquery.plans.queries_retrieval import chunks, vectors
from folioquery.plans.registry import query
from folioquery.sources.segments import Segments
from folioquery.sources.store import new_folder, written
from folioquery.sources.tables import table

SQL_LOG = "log AS (SELECT o_custkey AS id, o_orderdate AS decided_at, o_orderkey AS entry, CASE o_orderkey % 3 WHEN 0 THEN 'INCLUDE' WHEN 1 THEN 'EXCLUDE' END AS decision FROM orders), last AS (SELECT id, (arg_max({decision: decision}, (decided_at, entry))).decision AS decision FROM log GROUP BY id)"


def decisions(spark, sf):
    return table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_orderkey").selectExpr("o_custkey AS id", "o_orderdate AS decided_at", "o_orderkey AS entry", "CASE o_orderkey % 3 WHEN 0 THEN 'INCLUDE' WHEN 1 THEN 'EXCLUDE' END AS decision")


@query("decisions_made", "WITH " + SQL_LOG + " SELECT c_custkey AS id, CASE WHEN l.id IS NOT NULL THEN l.decision WHEN c_custkey % 2 = 0 THEN 'EXCLUDE' END AS decision FROM customer LEFT JOIN last l ON l.id = c_custkey")
def decided(spark, sf):
    """The last decision about each payment; a null one clears what was there."""
    own = table(spark, sf, "customer", "c_custkey").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN 'EXCLUDE' END AS decision")
    return M.decided(own, decisions(spark, sf))


@query("rates_saved", "SELECT 'C' || o_custkey % 7 AS \"from\", 'INR' AS \"to\", arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS rate FROM orders GROUP BY 1")
def rates(spark, sf):
    log = table(spark, sf, "orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderkey").selectExpr("concat('C', o_custkey % 7) AS `from`", "'INR' AS `to`", "o_totalprice AS rate", "o_orderdate AS saved_on", "o_orderkey AS entry")
    return M.rates(log).select("from", "to", "rate")


@query("reminders_open", "WITH l AS (SELECT o_custkey AS key, arg_max(o_orderkey % 4 <> 0, (o_orderdate, o_orderkey)) AS handled FROM orders GROUP BY 1) SELECT c_custkey AS key FROM customer LEFT JOIN l ON key = c_custkey WHERE NOT coalesce(handled, false)")
def open_reminders(spark, sf):
    log = table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_orderkey").selectExpr("o_custkey AS key", "o_orderdate AS at", "o_orderkey AS entry", "o_orderkey % 4 <> 0 AS handled")
    return M.handled(table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("key")), log)


@query("migrated_items", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(o_orderkey % 5 AS INT) END AS facts_version, CAST(NULL AS VARCHAR) AS ocr_engine, false AS telugu_pass FROM orders")
def migrated(spark, sf):
    """Items of the second version, some without a value, as of the fourth."""
    old = table(spark, sf, "orders", "o_orderkey").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 5 AS INT) END AS facts_version")
    return M.migrate(old)


@query("cleared_tables", "SELECT 'items' AS name, count(*) AS before, 0 AS rows FROM orders UNION ALL SELECT 'lines', count(*), 0 FROM lineitem")
def cleared(spark, sf):
    """Tables that are written, counted, emptied and counted again."""
    place, names = new_folder(spark, "cleared"), {"items": "orders", "lines": "lineitem"}
    for name, of in names.items():
        table(spark, sf, of).write.parquet(f"{place}/{name}")
    stored = {name: spark.read.parquet(f"{place}/{name}") for name in names}
    before = written(M.counts(**stored), "counts").withColumnRenamed("rows", "before")
    return before.join(M.counts(**M.cleared(stored)), "name")


@query("facts_backfilled", "SELECT run, items, CAST(CASE WHEN run = 3 THEN 2 ELSE run END AS INTEGER) AS version, facts FROM (SELECT unnest([1, 2, 3]) AS run), (SELECT count(*) AS facts FROM orders), LATERAL (SELECT count(*) AS items FROM orders WHERE run = 1 OR run = 2 AND o_orderkey % 3 = 0) WHERE run < 3 UNION ALL SELECT 3, 0, 2, count(*) FROM orders")
def backfilled(spark, sf):
    """Dates read from all items, then again from those whose stamp is old, then once more, with nothing left to do: items read, the newest stamp, facts stored."""
    place = new_folder(spark, "backfill")
    items, stored = Segments(spark, f"{place}/items", "id"), Segments(spark, f"{place}/facts", "fact_id")
    own = texts(spark, sf, once=True).select(F.col("item_id").alias("id"), "text", F.lit("INDEXED").alias("status"), F.lit(0).alias("facts_version"))
    items.change(own, unique=True)
    dates = lambda some: facts(some, kinds=("DATE",)).withColumn("fact_id", F.xxhash64("item_id", "line", "value"))
    runs = []
    for version in (1, 2, 2):
        n = M.backfill(items, stored, version, dates)
        newest = items.read().agg(F.max("facts_version")).first()[0]
        runs.append((len(runs) + 1, n, newest, stored.version().rows))
        if version == 1:  # two thirds were read by the newer rules already
            items.change(items.read().where("id % 3 <> 0").withColumn("facts_version", F.lit(2)), unique=True)
    return spark.createDataFrame(runs, "run int, items long, version int, facts long")


@query("table_counts", "SELECT 'items' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'pending', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'indexed', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'chunks', count(*) FROM lineitem UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'facts', count(*) FROM part UNION ALL SELECT 'payments', count(*) FROM customer UNION ALL SELECT 'notifications', count(*) FROM events")
def counted(spark, sf):
    own = lambda name, column: table(spark, sf, name, column)
    o = table(spark, sf, "orders", "o_orderstatus")
    return M.counts(items=o, pending=o.where("o_orderstatus = 'P'"), indexed=o.where("o_orderstatus = 'F'"), chunks=own("lineitem", "l_orderkey"), vectors=own("embeddings", "vec_id"), facts=own("part", "p_partkey"), payments=own("customer", "c_custkey"), notifications=own("events", "ts"))


@query("chunks_inserted", "SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT doc_id) FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> '') AS items, 3 AS version")
def inserted(spark, sf):
    """Chunks, postings and vectors written as one version, and read back through it."""
    place = new_folder(spark, "versions")
    index, own = M.insert_chunks(chunks(spark, sf), vectors(spark, sf), place, 3)
    version = M.complete_version(spark, place)
    both = index.chunks.agg(F.countDistinct("item_id").alias("items")).join(F.broadcast(own.agg(F.count("*").alias("vectors"))))  # a row each
    return both.select("vectors", "items", F.lit(version).alias("version"))


@query("json_report", "SELECT o_orderstatus AS status, count(*) AS items, CASE WHEN o_orderstatus <> 'P' THEN max(o_orderkey) END AS newest FROM orders GROUP BY 1")
def report(spark, sf):
    rows = table(spark, sf, "orders", "o_orderstatus", "o_orderkey").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("items"), F.max("o_orderkey").alias("newest"))
    return M.write_report(rows.withColumn("newest", F.when(F.col("status") != "P", F.col("newest"))), new_folder(spark, "report"))


@query("vector_bytes", "SELECT vec_id, 4 * len(embedding) AS n_bytes, true AS same FROM embeddings")
def codec(spark, sf):
    own = table(spark, sf, "embeddings", "vec_id", "embedding").withColumn("b", M.vector_bytes("embedding"))
    return own.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), (M.bytes_vector("b") == F.col("embedding")).alias("same"))


def digits(text: str) -> int:
    """A rule that some texts make raise."""
    if len(text) % 7 == 3:
        raise ValueError(f"cannot read {len(text)} letters")
    return sum("0" <= c <= "9" for c in text)


SQL_DIGITS = "SELECT doc_id AS id, CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'NO_TEXT' WHEN length(text) % 7 = 3 THEN 'FAILED' ELSE 'INDEXED' END AS status, CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND length(text) % 7 = 3 THEN 'ValueError: cannot read ' || length(text) || ' letters' END AS error, CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND length(text) % 7 <> 3 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) END AS found FROM documents"


@query("isolated_failures", SQL_DIGITS)
def isolated(spark, sf):
    """A rule over whole texts; those that make it raise are FAILED with its message."""
    return M.process(table(spark, sf, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id"), digits)


@query("drained", f"WITH d AS ({SQL_DIGITS}) SELECT count(*) AS done, count(*) AS total, count(*) FILTER (id % 4 <> 0 AND status = 'FAILED') AS failed FROM d")
def drained(spark, sf):
    """All pending items in one job; afterwards nothing is pending."""
    items = table(spark, sf, "documents", "doc_id", "text").selectExpr("doc_id AS id", "text", "CASE WHEN doc_id % 4 = 0 THEN 'INDEXED' ELSE 'PENDING' END AS status")
    after = M.drain(items, digits)
    return after.agg(F.count_if(F.col("status") != "PENDING").alias("done"), F.count("*").alias("total"), F.count_if(F.col("status") == "FAILED").alias("failed"))


@query("catch_up", "SELECT max(o_orderkey) AS in_store, max(o_orderkey) FILTER (o_orderstatus = 'F') AS in_index, max(o_orderkey) > coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), 0) AS run FROM orders")
def due(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderkey", "added_at")
    return M.catch_up(o, o.where("o_orderstatus = 'F'"))


@query("ledger_default_month", SQL_LEDGER + "SELECT coalesce(max(CASE WHEN month = '1995-07' THEN month END), max(month)) AS picked, coalesce(max(CASE WHEN month = '2040-01' THEN month END), max(month)) AS newest FROM totals")
def default_month(spark, sf):
    return L.month_totals(ledger(spark, sf)).agg(M.default_month(F.lit("1995-07")).alias("picked"), M.default_month(F.lit("2040-01")).alias("newest"))


@query("pooled_vectors", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM embeddings), m AS (SELECT vec_id, list_transform(list_zip(a, b), lambda p: (p[1] + p[2]) / 2) AS m FROM v) SELECT vec_id, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first, 1.0 AS length FROM m")
def pooled(spark, sf):
    """The mean of two token vectors of each text, at length one."""
    own = table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", embedding.pooled(F.array("embedding", F.reverse("embedding"))).alias("m"))
    return own.select("vec_id", F.round(F.col("m")[0], 6).alias("first"), F.round(F.sqrt(R.dot(F.col("m"), F.col("m"))), 6).alias("length"))


@query("prefixed_texts", "SELECT doc_id, sha256('passage: ' || coalesce(text, '')) AS passage, sha256('query: ' || coalesce(text, '')) AS question FROM documents")
def prefixed(spark, sf):
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2(embedding.passage(text), 256).alias("passage"), F.sha2(embedding.question(text), 256).alias("question"))


SQL_ENDED = "e.us > least(r.us + 7200000000, r.first + 21600000000)"


SQL_BURSTS = f"WITH RECURSIVE e AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), r AS (SELECT user_id, n, us, us AS first, 1 AS starts FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.us, CASE WHEN {SQL_ENDED} THEN e.us ELSE r.first END, CASE WHEN {SQL_ENDED} THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(sum(starts) AS BIGINT) AS bursts, count(*) AS changes FROM r GROUP BY 1"


@query("bounded_bursts", SQL_BURSTS)
def bursts(spark, sf):
    """Bursts of each user's events that two quiet hours end, or six hours in all."""
    own = table(spark, sf, "events", "user_id", "ts").select("user_id", F.col("ts").alias("at"))
    return M.bounded_bursts(own, "user_id", 7200, 21600).groupBy("user_id").agg(F.count("*").alias("bursts"), F.sum("changes").alias("changes"))
