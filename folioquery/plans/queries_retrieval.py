"""Registered queries of retrieval, over documents as items and their chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.functions.text import explanation, highlights, query_terms, shared_text, snippet
from folioquery.operators import retrieval as R
from folioquery.plans.registry import query
from folioquery.sources.store import kept, new_folder, signature, spread
from folioquery.sources.tables import table

# Queries by number: text, and the vec_id whose vector stands for its meaning.
ASKED = [(1, "the ering thation", 3), (2, "who is und der schlich", 8), (3, "que ment eau", 21), (4, "ando cion", 34), (5, "pathetic ation", 55), (6, "what is the", 89)]
VALUES = ", ".join(f"({a}, '{b}', {c})" for a, b, c in ASKED)
WORDS = r"[\p{L}\p{Nd}\p{M}\x{200C}\x{200D}]+"
STOP = "('a','an','the','is','was','are','were','of','to','in','on','for','and','or','my','me','i','how','what','when','where','which','who','show','find','get','did','do','does','much','many')"

SQL_CHUNKS = r"""
lines AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0B\x0C\r\x{0085}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
pieces AS (SELECT doc_id, flatten(list_transform(l, lambda x: list_transform(range(0, CAST(ceil(len(string_split(x, ' ')) / 256.0) AS BIGINT)), lambda i: array_to_string(list_slice(string_split(x, ' '), i * 256 + 1, i * 256 + 256), ' ')))) AS p FROM lines),
numbered AS (SELECT doc_id, p, generate_subscripts(p, 1) AS i FROM pieces),
line AS (SELECT doc_id, i, p[i] AS text, len(string_split(p[i], ' ')) AS n FROM numbered),
packed AS (
  WITH RECURSIVE r AS (
    SELECT doc_id, i, text, n, 0 AS ordinal, n AS filled FROM line WHERE i = 1
    UNION ALL
    SELECT l.doc_id, l.i, l.text, l.n, CASE WHEN r.filled + l.n > 256 THEN r.ordinal + 1 ELSE r.ordinal END, CASE WHEN r.filled + l.n > 256 THEN l.n ELSE r.filled + l.n END
    FROM r JOIN line l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
  SELECT * FROM r),
chunks AS (SELECT doc_id * 1048576 + ordinal AS chunk_id, doc_id AS item_id, ordinal, string_agg(text, chr(10) ORDER BY i) AS text FROM packed GROUP BY doc_id, ordinal)
"""
SQL_KEYWORD = SQL_CHUNKS + rf""",
q(query_id, text, vec_id) AS (VALUES {VALUES}),
asked AS (SELECT query_id, len(t) AS phrases, unnest(t) AS token FROM (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda w: len(w) >= 2 AND w NOT IN {STOP})) AS t FROM q)),
w AS (SELECT chunk_id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM chunks),
postings AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL),
stats AS (SELECT count(*) AS n, greatest(1.0, round(avg(len(w)))) AS avg_len FROM w),
hits AS (SELECT query_id, phrases, token, chunk_id, len, sum(tf) AS hits FROM asked JOIN postings ON starts_with(term, token) GROUP BY ALL),
df AS (SELECT query_id, token, count(*) AS df FROM hits GROUP BY ALL),
scored AS (SELECT query_id, phrases, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score, count(*) AS matched FROM hits JOIN df USING (query_id, token), stats GROUP BY query_id, phrases, chunk_id),
gated AS (SELECT * FROM scored WHERE matched >= greatest(1, least(greatest(1, phrases), ceil(phrases * {{coverage}} - 1e-9)))),
keyword AS (SELECT * FROM (SELECT query_id, chunk_id, score, matched, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM gated) WHERE rank <= 50)
"""
SQL_MEANING = """,
v AS (SELECT vec_id * 1048576 AS chunk_id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
meant AS (SELECT q.query_id, v.chunk_id, list_dot_product(own.v, v.v) AS score FROM q JOIN v own ON own.vec_id = q.vec_id, v),
meaning AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM meant) WHERE rank <= 50)
"""
SQL_FUSED = """,
legs AS (SELECT query_id, chunk_id, rank AS k, CAST(NULL AS BIGINT) AS m, CAST(NULL AS DOUBLE) AS s FROM keyword UNION ALL SELECT query_id, chunk_id, CAST(NULL AS BIGINT), rank, score FROM meaning),
fused AS (SELECT query_id, chunk_id, sum(1.0 / (60 + coalesce(k, m))) AS score, max(k) AS keyword_rank, max(m) AS meaning_rank, max(s) AS meaning_score FROM legs GROUP BY ALL)
"""
SQL_ITEMS = """,
deep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM fused) WHERE r <= 50),
one AS (SELECT * FROM (SELECT d.*, c.item_id, row_number() OVER (PARTITION BY query_id, item_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM deep d JOIN chunks c USING (chunk_id)) WHERE place = 1),
items AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM one) WHERE rank <= 20)
"""
keyword_sql = lambda coverage: "WITH RECURSIVE " + SQL_KEYWORD.replace("{coverage}", str(coverage))


def asked(spark, sf):
    rows = spark.createDataFrame(ASKED, "query_id long, text string, vec_id long")
    own = table(spark, sf, "embeddings", "vec_id", "embedding")
    return rows.join(own, "vec_id").select("query_id", "text", F.col("embedding").alias("vector"))


def texts(spark):
    return spark.createDataFrame(ASKED, "query_id long, text string, vec_id long").select("query_id", "text")


def chunks(spark, sf):
    return R.chunk(spread(table(spark, sf, "documents", "doc_id", "text")), "doc_id", "text")


def store(spark, sf):
    """The stored index of the documents' chunks, built once in an application and refreshed once the table changes."""
    path = f"{sf}/documents.parquet"
    held = kept(spark, ("index", path), lambda: {"store": R.index_store(spark, new_folder(spark, "search-index")), "of": None})
    now = signature(spark, path)
    if held["of"] != now:
        held["store"].refresh(chunks(spark, sf))
        held["of"] = now
    return held["store"]


def index(spark, sf):
    return R.stored_index(store(spark, sf))


def vectors(spark, sf):
    return table(spark, sf, "embeddings", "vec_id", "embedding").select((F.col("vec_id") * R.CHUNKS_AN_ITEM).alias("chunk_id"), F.col("embedding").alias("vector"))


@query("chunk_documents", "WITH RECURSIVE " + SQL_CHUNKS + "SELECT chunk_id, item_id, ordinal, text FROM chunks")
def chunk_documents(spark, sf):
    return chunks(spark, sf)


@query("query_terms", rf"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{WORDS}'), lambda w: NOT (regexp_full_match(w, '[\x00-\x7f]*') AND (len(w) < 2 OR w IN {STOP}))))), ' ') AS terms FROM documents")
def terms_of_texts(spark, sf):
    """Whole documents, taken as queries; their terms in order."""
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.array_join(F.array_sort(query_terms(F.col("text"))), " ").alias("terms"))


@query("postings", rf"SELECT term, count(*) AS df, sum(tf) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_statistics(spark, sf):
    whole = table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("chunk_id"), "text")
    return R.postings(whole).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("bm25", keyword_sql(0.0) + "SELECT query_id, chunk_id, round(score, 6) AS score, matched, rank FROM keyword")
def keyword(spark, sf):
    return R.bm25(index(spark, sf), texts(spark)).withColumn("score", F.round("score", 6))


@query("index_refreshed", keyword_sql(0.0) + "SELECT query_id, chunk_id, round(score, 6) AS score, matched, rank FROM keyword")
def refreshed(spark, sf):
    """The keyword leg over an index that was built from an older state of the table - a third of the items missing, the texts of another third other ones, and some items that are gone now - and then refreshed to what the table holds."""
    own = chunks(spark, sf)
    store = R.index_store(spark, new_folder(spark, "refreshed-index"))
    other = F.when(F.col("item_id") % 3 == 1, F.concat(F.reverse("text"), F.lit(" older"))).otherwise(F.col("text"))
    gone = own.where("item_id % 3 = 0").withColumns({"item_id": -F.col("item_id") - 1, "chunk_id": -F.col("chunk_id") - 1})
    store.change(own.where("item_id % 3 <> 0").withColumn("text", other).unionByName(gone))
    store.refresh(own)
    return R.bm25(R.stored_index(store), texts(spark)).withColumn("score", F.round("score", 6))


@query("bm25_gated", keyword_sql(0.5) + "SELECT query_id, chunk_id, round(score, 6) AS score, matched, rank FROM keyword")
def keyword_gated(spark, sf):
    return R.bm25(index(spark, sf), texts(spark), R.RECOMMENDED).withColumn("score", F.round("score", 6))


@query("bm25_exact_mean", keyword_sql(0.0).replace("round(avg(len(w)))", "avg(len(w))") + "SELECT query_id, chunk_id, round(score, 6) AS score, matched, rank FROM keyword")
def keyword_exact(spark, sf):
    """The keyword leg by a mean length that isn't rounded."""
    return R.bm25(R.stored_index(store(spark, sf), exact_mean=True), texts(spark)).withColumn("score", F.round("score", 6))


@query("recent_snippets", "WITH RECURSIVE " + SQL_CHUNKS + ", last AS (SELECT doc_id AS item_id, source AS name, doc_id // 3 AS indexed_at FROM documents WHERE doc_id % 4 <> 0 ORDER BY doc_id // 3 DESC, doc_id DESC LIMIT 20) SELECT l.item_id, name, indexed_at, c.text AS snippet FROM last l LEFT JOIN chunks c ON c.item_id = l.item_id AND c.ordinal = 0")
def recently(spark, sf):
    """The items that were worked on last, with their first chunks."""
    items = table(spark, sf, "documents", "doc_id", "source", "text").selectExpr("doc_id AS item_id", "source AS name", "CASE WHEN doc_id % 4 = 0 THEN 'PENDING' ELSE 'INDEXED' END AS status", "doc_id div 3 AS indexed_at", "text")
    return R.recent(items, 20).select("item_id", "name", "indexed_at", "snippet")


@query("cosine_top_k", f"WITH q(query_id, text, vec_id) AS (VALUES {VALUES})" + SQL_MEANING + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM meaning")
def meaning(spark, sf):
    return R.cosine(vectors(spark, sf), asked(spark, sf)).withColumn("score", F.round("score", 6))


@query("rank_fusion", keyword_sql(0.0) + SQL_MEANING + SQL_FUSED + "SELECT query_id, chunk_id, round(score, 9) AS score, keyword_rank, meaning_rank FROM fused")
def fused(spark, sf):
    own = R.fuse(R.bm25(index(spark, sf), texts(spark)), R.cosine(vectors(spark, sf), asked(spark, sf)))
    return own.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "keyword_rank", "meaning_rank")


@query("hybrid_search", keyword_sql(0.5) + SQL_MEANING + SQL_FUSED + SQL_ITEMS + "SELECT query_id, rank, item_id, chunk_id, round(score, 9) AS score, keyword_rank, meaning_rank FROM items")
def hybrid(spark, sf):
    found = R.search(index(spark, sf), vectors(spark, sf), asked(spark, sf), R.RECOMMENDED)
    return found.select("query_id", "rank", "item_id", "chunk_id", F.round("score", 9).alias("score"), "keyword_rank", "meaning_rank")


@query("search_by_words", keyword_sql(0.5) + ", fused AS (SELECT query_id, chunk_id, score, rank AS keyword_rank FROM keyword)" + SQL_ITEMS + "SELECT query_id, rank, item_id, chunk_id, round(score, 6) AS score, keyword_rank FROM items")
def by_words(spark, sf):
    found = R.search(index(spark, sf), vectors(spark, sf), asked(spark, sf), R.SearchOptions(coverage=0.5, mode="KEYWORDS"))
    return found.select("query_id", "rank", "item_id", "chunk_id", F.round("score", 6).alias("score"), "keyword_rank")


@query("search_by_meaning", "WITH RECURSIVE " + SQL_CHUNKS + f", q(query_id, text, vec_id) AS (VALUES {VALUES})" + SQL_MEANING + ", fused AS (SELECT query_id, chunk_id, score, rank AS meaning_rank FROM meaning)" + SQL_ITEMS + "SELECT query_id, rank, item_id, chunk_id, round(score, 6) AS score, meaning_rank FROM items")
def by_meaning(spark, sf):
    found = R.search(index(spark, sf), vectors(spark, sf), asked(spark, sf), R.SearchOptions(mode="MEANING"))
    return found.select("query_id", "rank", "item_id", "chunk_id", F.round("score", 6).alias("score"), "meaning_rank")


@query("search_timings")
def timings(spark, sf):
    """Stages of one search with their milliseconds, and the number of chunks searched."""
    _, found = R.timed_search(index(spark, sf), vectors(spark, sf), asked(spark, sf), R.RECOMMENDED)
    return spark.createDataFrame([(name, ms, found.chunks_searched) for name, ms in found.stages.items()], "stage string, ms double, chunks_searched long")


@query("search_snippets")
def snippets(spark, sf):
    """Text to show for each keyword hit."""
    own = index(spark, sf)
    found = R.bm25(own, texts(spark), R.RECOMMENDED, 10).join(own.chunks, "chunk_id").join(texts(spark).withColumnRenamed("text", "asked"), "query_id")
    return found.select("query_id", "rank", "chunk_id", snippet(F.col("text"), query_terms(F.col("asked"))).alias("snippet"))


@query("search_explanations")
def explained(spark, sf):
    """Each hit's text, the places to highlight and why it was found."""
    own = index(spark, sf)
    found = R.search(own, vectors(spark, sf), asked(spark, sf), R.RECOMMENDED, 5).join(own.chunks.select("chunk_id", "text"), "chunk_id").join(texts(spark).withColumnRenamed("text", "asked"), "query_id")
    shown = found.withColumn("shown", snippet(F.col("text"), query_terms(F.col("asked")))).withColumn("spans", highlights(F.col("shown"), query_terms(F.col("asked"))))
    why = explanation(F.col("shown"), F.col("spans"), F.col("keyword_rank"), F.col("meaning_rank"), F.lit("photo"), F.lit(None).cast("date"))
    return shown.select("query_id", "rank", "shown", F.size("spans").alias("n_spans"), why.alias("why"))


@query("shared_texts", r"SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 300 THEN t WHEN contains(substr(t, 1, 300), ' ') THEN trim(regexp_replace(substr(t, 1, 300), ' [^ ]*$', '')) ELSE substr(t, 1, 300) END AS shared FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)")
def shared(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", shared_text(F.col("text")).alias("shared"))
