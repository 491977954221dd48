"""Queries over whole texts and whole tables: against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import regex

from folioquery.operators import evaluation
from folioquery.functions.text import STOPWORDS
from folioquery.plans import queries_retrieval, registry


WORD = regex.compile(r"[\p{L}\p{Nd}\p{M}\u200c\u200d]+")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_character_errors_of_whole_texts(spark):
    rng = random.Random(5)
    pairs = [("x" * 80 + "abc", "x" * 80 + "zzzz"), ("", ""), ("", "ab"), ("same", "same"), ("a  b\u00a0\n c", "a b c"), ("क\u200dष", "कष"), ("xabcdefg", "abcdefgx"), ("ab", "cdefgh"), ("end\n", "end")]
    pairs += [("".join(rng.choices("ab \U0001f600é", k=rng.randrange(150))), "".join(rng.choices("ab \U0001f600é", k=rng.randrange(150)))) for _ in range(30)]
    rows = spark.createDataFrame([(str(k), a, b) for k, (a, b) in enumerate(pairs)], "lang string, truth string, text string")
    clean = lambda t: " ".join(t.replace("\u200c", "").replace("\u200d", "").split())
    want = {str(k): min(1.0, edits(clean(a), clean(b)) / max(1, len(clean(a)))) for k, (a, b) in enumerate(pairs)}
    assert {r.lang: r.error for r in evaluation.character_errors(rows).collect()} == pytest.approx(want)


def keyword_leg(chunks, text):
    """Chunk ids by BM25 over prefix terms, best first, as many as a leg holds."""
    terms = [w for w in dict.fromkeys(WORD.findall(text.lower())) if not (w.isascii() and (len(w) < 2 or w in STOPWORDS))]
    words = {k: WORD.findall(t.lower()) for k, t in chunks.items()}
    mean = max(1, int(np.floor(np.mean([len(w) for w in words.values()]) + 0.5)))
    total = defaultdict(float)
    for t in terms:
        hits = {k: n for k, w in words.items() if (n := sum(x.startswith(t) for x in w))}
        idf = np.log((len(words) - len(hits) + 0.5) / (len(hits) + 0.5) + 1)
        for k, n in hits.items():
            total[k] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[k]) / mean))
    return sorted(total, key=lambda k: (-round(total[k], 9), k))[:50]


def test_retrieval_quality_asks_in_three_modes_over_the_whole_table(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    chunks = {r.chunk_id: r.text for r in queries_retrieval.chunks(spark, sf).collect()}
    label, x = {r.vec_id: r.label for r in v}, np.array([r.embedding for r in v], np.float64)
    asking = [k for k, r in enumerate(v) if r.vec_id % 100 == 0]
    want = {mode: defaultdict(list) for mode in ("KEYWORDS", "MEANING", "MERGED")}
    for k in asking:
        score = np.round(x @ x[k], 9)
        meaning = [v[j].vec_id << 20 for j in np.lexsort((np.arange(len(v)), -score))[:50]]
        keyword = keyword_leg(chunks, " ".join(texts.get(v[k].vec_id, "").split()[:8]))
        both = defaultdict(float)
        for leg in (keyword, meaning):
            for n, c in enumerate(leg, 1):
                both[c] += 1 / (60 + n)
        merged = sorted(both, key=lambda c: (-round(both[c], 9), c))[:50]
        for mode, leg in (("KEYWORDS", keyword), ("MEANING", meaning), ("MERGED", merged)):
            items = list(dict.fromkeys(c >> 20 for c in leg if c in chunks))[:21]
            near = [i for i in items if i != v[k].vec_id][:20]
            want[mode][v[k].label % 3].append(next((1 / n for n, i in enumerate(near, 1) if label.get(i) == v[k].label), 0.0))
    got = registry.queries()["retrieval_quality_modes"](spark, sf).collect()
    for mode, styles in want.items():
        assert sum(r.queries for r in got if r.mode == mode) == len(asking) > 0
        assert {r.style: r.mrr for r in got if r.mode == mode} == pytest.approx({s: np.mean(m) for s, m in styles.items()}, abs=1e-5), mode


def test_more_queries_than_are_sent_meet_vectors_in_blocks(spark, monkeypatch):
    """With blocks of any size, the same hits as one matrix product; vectors of other lengths, null ones and ties among them."""
    from folioquery.operators import retrieval as R

    draw = np.random.default_rng(3)
    x = np.round(draw.normal(size=(60, 4)), 2)
    x[10:14] = x[3]
    rows = [(100 + k, v.tolist()) for k, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, None), (902, []), (903, [None, 1.0, 1.0, 1.0]), (904, [2.0, 0.0])]
    q = np.round(draw.normal(size=(33, 4)), 2)
    asked = [(k, v.tolist()) for k, v in enumerate(q)] + [(70, [1.0, 1.0]), (71, None), (72, [0.0] * 9)]
    want = {}
    for k, v in enumerate(q):
        score = np.round(x @ v, 9)
        want[k] = [(int(100 + i), rank) for rank, i in enumerate(np.lexsort((np.arange(60), -score))[:7], 1)]
    want[70] = [(900, 1), (904, 2)]
    vectors, queries = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, vector array<double>")
    for block, sent in ((8192, 5), (7, 5), (1, 1)):
        monkeypatch.setattr(R, "BLOCK", block)
        monkeypatch.setattr(R, "SENT_VECTORS", sent)
        found = defaultdict(list)
        for r in R.cosine(vectors, queries, 7).orderBy("query_id", "rank").collect():
            found[r.query_id].append((r.chunk_id, r["rank"]))
        assert dict(found) == want
