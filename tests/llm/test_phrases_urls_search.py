"""op11 to op13: against brute force on small tables, and odd ones."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioquery.llm import phrases, search, urls
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_by_hand(pairs, least, longest, top, covered):
    f, n = defaultdict(Counter), Counter()
    for lang, text in pairs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def some_texts(seed, n):
    draw = random.Random(seed)
    words = ["The", "of", "cat", "Été", "x\x00y", "dog", "New", "York", "city", "sat"]
    return [(draw.choice(["en", "fr", None]), "".join(draw.choice(words[: draw.randint(2, 10)]) + draw.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b"]) for _ in range(draw.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("longest,top,covered,block_bytes,entries", [(3, 2000, 50, 1 << 20, 1 << 20), (3, 5, 100, 300, 40), (4, 50, 30, 900, 7), (2, 9, 50, 1, 1)])
def test_phrases(spark, longest, top, covered, block_bytes, entries):
    pairs = some_texts(longest + top, 60) + [("en", "New York city"), ("en", "New York city"), (None, "w " * 5000)]
    df = spark.createDataFrame([(k, t, lang, 1, "c") for k, (lang, t) in enumerate(pairs)], "doc_id long, text string, lang string, block long, word string")
    got = phrases.collocations(df.repartition(3), 4, longest, top, covered, block_bytes, entries)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(pairs, 4, longest, top, covered)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string", **dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")}


def test_phrases_of_odd_tables(odd, none):
    assert sorted(map(tuple, phrases.collocations(odd, 2, 3).collect())) == phrases_by_hand([("en", t) for _, t in ODD], 2, 3, 2000, 50)
    assert phrases.collocations(none).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    words = spark.createDataFrame([(1, "en", "a", big), (2, "en", "b", big)], "id long, lang string, word string, f long")
    pairs = spark.createDataFrame([(3, 1, 2, big - 1)], "id long, first long, rest long, f long")
    (row,) = phrases.candidates([words, pairs], 50).collect()
    assert (row.phrase, row.score) == ("a b", 10**6 * (big - 1) ** 2 // (big * big))


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "no scheme/es/", "http://", "http://ORG/", "http://org", "http://a.example.org/es/1", "http://example.org/es", "http://notexample.org/es/", "HTTP://Sub.Example.ORG/en/12?x=/es/",
    "http://example.org/en/2", "http://x.com/fr/#top", "http://x.com/de/", "http://com?/de/", "http://x.com/DE/", "http://x.net/a://b.org/es/", "http://casino.example.net/en/1", "http://www.library.example.net/en/1",
    "http://é.com/de/\nx", "http://x.net/" + "a" * 50_000, "http://x.com/fr/", "http://x.com/fr/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "<html>", "mine", "mine") for k, u in enumerate(URLS)] + [(None, "http://x.org/", None, "", "")], "page_id long, url string, html string, rule string, fitting string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(got) == len(URLS) + 1 and got[None].rule == "org/"
    for k, u in enumerate(URLS):
        host, path, rule = url_by_hand(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule.name), u
        assert got[k].verdict == (rule.verdict if rule else "block" if got[k].score >= 0.5 else "allow")
    assert got[URLS.index("http://casino.example.net/en/1")].verdict == "block" and got[URLS.index("http://www.library.example.net/en/1")].verdict == "allow"
    assert got[0].verdict == got[1].verdict == "allow"
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_classifier_on_urls_that_it_was_not_fitted_on(spark):
    rows = [(*url_by_hand(u)[:2], v == "block") for u, v in urls.labelled_urls()]
    assert len(rows) > 500
    held = np.random.default_rng(5).random(len(rows)) < 0.3
    w = urls.fit([r for r, h in zip(rows, held) if not h])
    test = [r for r, h in zip(rows, held) if h]
    score = urls.scored(w, [h for h, _, _ in test], [p for _, p, _ in test])
    assert ((score >= 0.5) == [b for *_, b in test]).mean() > 0.95
    labelled = spark.createDataFrame([("http://good.net/", "allow"), ("http://bad.net/", "block"), ("http://odd.net/", "other"), (None, "allow"), ("x", None)], "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://bad.net/"), (2, "http://good.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, labelled, ()).collect()} == {1: "block", 2: "allow"}
    assert {r.verdict for r in urls.judge(pages, labelled.where("verdict = 'block'"), ()).collect()} == {"block"}
    assert {r.verdict for r in urls.judge(pages, labelled.limit(0), ()).collect()} == {"allow"}


def search_by_hand(documents, items, top):
    term = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
    docs = [(i, Counter(re.findall(term, (t or "").translate(LOWER)))) for i, t in documents]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        terms, found = re.findall(term, (text or "").translate(LOWER)), []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found, key=lambda r: r[:3])[:top], 1)]
    return out


@pytest.mark.parametrize("top,block_terms,held,run_bytes,query_bytes", [(20, 4096, 256, 1 << 20, 1 << 20), (3, 30, 4, 2000, 100), (1, 1, 1, 1, 1), (5, 100, 3, 700, 1 << 20)])
def test_search(spark, rows, top, block_terms, held, run_bytes, query_bytes):
    draw = random.Random(top)
    words = [f"w{k}" for k in range(60)] + ["Été", "x9", "WORD"]
    text = lambda n: " ".join(draw.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    documents = [(k, text(draw.choice([1, 3, 10, 40, 200]))) for k in range(150)] + [(500, "w1 w1"), (400, "w1 w1"), (400, "w1 w1"), (None, "w2 w1"), *ODD]
    items = [(k, text(draw.randint(1, 12))) for k in range(12)] + [(3, "w1 w1 w40"), (3, "w1 w1 w40"), (None, "été"), (50, None), (51, "..."), (52, "unknownword")]
    asked = spark.createDataFrame([(*i, "mine", 7) for i in items], "item_id long, text string, query string, score long")
    got = search.search(rows(documents).repartition(3), asked, top, query_bytes, block_terms, held, run_bytes)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(search_by_hand(documents, items, top), key=repr)


def test_search_of_empty_tables(spark, rows, none):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert search.search(none, items).count() == 0
    assert search.search(rows([(1, "word")]), items.limit(0)).count() == 0
    assert search.search(rows([(1, None), (2, "?!")]), items).count() == 0


def test_search_leaves_blocks_out(spark, rows):
    """A block is only opened if its bound reaches the threshold."""
    documents = [(k, "rare word here" if k < 3 else f"common filler text number {k}") for k in range(300)]
    index = search.build_index(rows(documents).coalesce(1), block_terms=20)
    terms = search.Terms([b"rare common"])
    n, length = index.selectExpr("sum(n_docs)", "sum(n_terms)").first()
    scorer = search.Scorer(terms, search.frequencies(index, terms), n, length)
    opened = []
    scores = scorer.scores
    scorer.scores = lambda row, *a: (opened.append(1), scores(row, *a))[1]
    columns = ["docs", "known", "sizes", "starts", "terms", "counts", "words", "ends", "most", "shortest"]
    batches = index.select(*columns).toArrow().to_batches()
    (found,) = search.visited(scorer, 3, np.ones(1, np.int64), 10_000)(iter(batches))
    assert set(found["doc_id"].to_pylist()) == {0, 1, 2} and len(opened) < index.count() / 4
