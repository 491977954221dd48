"""op6 to op10 and op4, op5: against brute force."""

import hashlib
import os
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from folioquery.llm import ann, exact_dedup, extraction, line_dedup, near_dedup, pretok, sharding, toxicity
from tests.llm.conftest import ODD

LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


@pytest.mark.parametrize("capacity", [2, 1000])
def test_exact_dedup(rows, odd, none, capacity):
    many = [(i, f"Text {i % 37}" if i % 3 else "HOT copy") for i in range(400)] + [(900, "hot COPY"), (901, "É"), (902, "é")]
    for df, pairs in ((rows(many), many), (odd, ODD)):
        groups = defaultdict(list)
        for i, t in pairs:
            groups[(t or "").translate(LOWER)].append(i)
        want = []
        for i, t in pairs:
            norm = (t or "").translate(LOWER)
            keep = max((x for x in groups[norm] if x is not None), default=None)
            want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
        got = exact_dedup.exact_dedup(df, capacity).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_directory_doubles_where_a_bucket_is_full(spark):
    ends = [*range(5), *((1 << 59) * 2 + k for k in range(5)), -1]  # first four bits 0000, 0001 and 1111
    slots, bits = exact_dedup.directory(spark.createDataFrame([(k,) for k in ends], "key long"), 11, 4)
    got = {(r.bucket >> (bits - 4) if bits >= 4 else r.bucket << (4 - bits), min(r.depth, 4)) for r in slots.collect()}
    assert bits > 4 and got == {(0, 4), (1, 4), (8, 1)}
    slots, bits = exact_dedup.directory(spark.createDataFrame([(k << 56,) for k in range(-100, 100)], "key long"), 200, 16)
    held = defaultdict(int)
    for r in slots.collect():
        held[r.bucket, r.depth] += sum((k << 56) % (1 << 64) >> (64 - bits) == r.slot for k in range(-100, 100))
    assert sum(held.values()) == 200 and max(held.values()) <= 16
    for (a, m), (b, n) in zip(sorted(held), sorted(held)[1:]):
        assert b >= a + (1 << (bits - m))  # buckets don't overlap


def test_native(spark, rows):
    plan = exact_dedup.exact_dedup(rows([(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("shards", [1, 5, 20, 26])
def test_one_more_shard_takes_rows_only_into_itself(rows, shards):
    got = sharding.shard(rows([(i, "x") for i in range(4000)] + [(None, "x")]), shards).collect()
    moved = [r for r in got if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == shards for r in moved) and {r.shard for r in got} == set(range(shards))
    assert len(moved) < 2 * 4000 / (shards + 1)


def test_sharding(rows, odd, none):
    df = rows([(i, "x" * (i % 50)) for i in range(6000)])
    got = sharding.shard(df).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key" and r.size == r.doc_id % 50 + 8 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 50))
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.4 * 6000 / 24 and 150 < sum(r.grown_shard == 24 for r in got) < 330
    again = {r.doc_id: r.shard for r in sharding.shard(df.where("doc_id % 5 = 0").repartition(3)).collect()}
    assert all(again[r.doc_id] == r.shard for r in got if r.doc_id in again)
    heavy = sharding.shard(df, weights={3: 4.0}).collect()
    before = {r.doc_id: r.shard for r in got}
    moved = [(before[r.doc_id], r.shard) for r in heavy if before[r.doc_id] != r.shard]
    assert moved and all(b // 8 == 0 for _, b in moved)  # only into the subtree whose weight grew
    own = sharding.shard(odd).collect()
    assert len(own) == len(ODD) and sharding.shard(none).count() == 0
    assert all(sorted(r.slot for r in own if r.shard == s) == list(range(sum(r.shard == s for r in own))) for s in range(24))


def words(text):
    return regex.findall(r"[\p{L}]+|\p{N}+", (text or "").lower())


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def classes(pairs, linked):
    up = {i: i for i in pairs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(pairs)
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def weighted_similarity(texts):
    """(a, b) -> weighted Jaccard similarity of texts a and b, by dictionaries of shingles."""
    counts = {}
    for k, t in texts.items():
        w = words(t)
        counts[k] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    hashed = {tuple(words(" ".join(s))): near_dedup.counter(near_dedup.shingles([" ".join(s)])[0][0])[0] for c in counts.values() for s in c}
    df = Counter(hashed[s] for c in counts.values() for s in c)
    weight = lambda s, n: (1 + np.log(n)) * (1 + near_dedup.LIFT * (1 - np.log(df[hashed[s]]) / np.log(len(texts))))
    weights = {k: {s: weight(s, n) for s, n in c.items()} for k, c in counts.items()}

    def similarity(a, b):
        x, y = weights[a], weights[b]
        shared = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        return shared / (sum(x.values()) + sum(y.values()) - shared) if x and y else 0.0

    return similarity


def test_near_dedup(rows, odd, none):
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)])
    texts, i = {}, 0
    for group in range(12):
        base = rng.choice(vocabulary, 120)
        for _ in range(8):
            own = base.copy()
            own[rng.integers(0, 120, rng.integers(0, 4))] = rng.choice(vocabulary)
            texts[i] = " ".join(own)
            i += 1
    for _ in range(30):
        texts[i] = " ".join(rng.choice(vocabulary, 100))
        i += 1
    sets = {k: shingle_set(t) for k, t in texts.items()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = classes(texts, lambda a, b: jaccard(a, b) >= 0.8)
    got = {r.doc_id: r for r in near_dedup.near_dedup(rows(list(texts.items()))).collect()}
    assert len(got) == len(texts)
    for a in texts:  # every class of brute force is within one class; what is joined besides is nearly as similar
        assert got[a].class_id == got[want[a]].class_id
        assert got[a].class_id == a or max(jaccard(a, b) for b in texts if b != a and got[b].class_id == got[a].class_id) >= 0.75
        assert got[a].class_size == sum(r.class_id == got[a].class_id for r in got.values()) and got[a].kept == (got[a].class_id == a)
    own = near_dedup.near_dedup(odd).collect()
    found = defaultdict(set)
    for r in own:
        found[r.doc_id].add(r.class_id)
    assert len(own) == len(ODD) and found[1] == found[2] == {1} and found[3] == {3} and found[5] == found[6] == {5} and found[None] == {None}
    assert near_dedup.near_dedup(none).count() == 0


def test_a_large_group_of_near_copies_is_one_class(rows):
    rng = np.random.default_rng(4)
    base = [f"word{k}" for k in range(200)]
    texts = [(k, " ".join(base[:p] + [f"other{k}"] + base[p + 1 :])) for k, p in enumerate(rng.integers(0, 200, 300))]
    got = near_dedup.near_dedup(rows(texts)).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 300


def test_partners_among_many_that_are_nearly_similar(rows):
    name = lambda *k: "w" + "".join(chr(97 + int(d)) for d in "x".join(map(str, k)).replace("x", "9"))
    base, texts = [name(0, k) for k in range(400)], {}
    for i in range(150):  # any two at about 0.75; the first 80 in pairs at more than 0.8
        own = [name(1, i, k) for k in range(52)]
        if i < 80 and i % 2:
            own = [name(1, i - 1, k) for k in range(30)] + own[30:]
        texts[i] = " ".join(base[:180] + own + base[232:])
    similarity = weighted_similarity(texts)
    want = classes(texts, lambda a, b: similarity(a, b) >= 0.8)
    assert len(set(want.values())) == 110
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(rows(list(texts.items()))).collect()}
    assert got == want


def test_repeated_shingles_and_doc_ids(rows):
    long = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    text = " ".join([long] * 40)
    pairs = [(1, text), (2, text + " " + " ".join(f"v{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(45))), (3, "quite another text that is like none"), (3, long), (4, long + " end"), (4, long + " end")]
    similarity = weighted_similarity({k: t for k, (_, t) in enumerate(pairs)})
    got = {(r.doc_id, r.n): r for r in near_dedup.near_dedup(rows(pairs).withColumn("n", F.monotonically_increasing_id()), "n").collect()}
    assert similarity(3, 4) >= 0.8 > similarity(0, 3) and len(got) == 6
    own = sorted((d, r.class_id, r.class_size, r.kept) for (d, _), r in got.items())
    joined = similarity(0, 1) >= 0.8
    assert own[2:] == [(3, 3, 1, True), (3, 3, 3, True), (4, 3, 3, False), (4, 3, 3, False)] and own[:2] == [(1, 1, 1 + joined, True), (2, 1 if joined else 2, 1 + joined, not joined)]
    again = {r.doc_id: r.class_id for r in near_dedup.near_dedup(rows(pairs[:4][::-1])).collect() if r.doc_id < 3}
    assert again == {1: 1, 2: 1 if joined else 2}


def test_samples_estimate_similarity():
    rare = np.zeros(near_dedup.COUNTERS, np.float32)
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    sets = near_dedup.shingles([" ".join(f"w{name(k)}" for k in range(3000)), " ".join(f"w{name(k)}" if k % 60 else f"x{name(k)}" for k in range(3000))])
    hits = []
    for k in range(20):
        part = [(h[h % np.uint64(20) == k], t[h % np.uint64(20) == k]) for h, t in sets]
        x = near_dedup.samples(part, rare)
        hits.append((x[0] == x[1]).mean())
    exact = len(set(sets[0][0]) & set(sets[1][0])) / len(set(sets[0][0]) | set(sets[1][0]))
    assert abs(np.mean(hits) - exact) < 0.12


def test_toxicity(spark, rows, odd, none):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)])
    texts, toxic = [], {}
    for i in range(1500):
        own = list(rng.choice(vocabulary, 60))
        toxic[i] = int(i % 10 == 0)
        if toxic[i]:
            own[int(rng.integers(60))] = ["grumblefoot", "nastylout"][i % 2 if i % 20 else 1]
        texts.append((i, " ".join(own)))
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items() if i % 2 == 0] + [(None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(rows(texts), labels).collect()
    assert len(got) == 1500
    right = [r.predicted == toxic[r.doc_id] for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert np.mean(right) > 0.98
    for df, n in ((odd, len(ODD)), (none, 0)):
        own = toxicity.toxicity(df, labels.limit(0)).collect()
        assert len(own) == n and all(r.predicted == 0 for r in own)


def test_held_out_labels_change_nothing(spark, rows):
    texts = [(i, f"word{i % 50} badword" if i % 5 == 0 else f"word{i % 50} fine") for i in range(600)]
    base = [(i, int(i % 5 == 0)) for i in range(0, 600, 3)]
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in base]
    score = lambda known: sorted((r.doc_id, r.score) for r in toxicity.toxicity(rows(texts), spark.createDataFrame(known, "doc_id long, toxic int")).collect())
    assert score(base) == score(flipped)


def test_conflicting_labels(spark, rows):
    """Of several labels of a doc_id the largest counts."""
    texts = [(i, f"word{i % 50} badword" if i % 5 == 0 else f"word{i % 50} fine") for i in range(600)]
    once = [(i, int(i % 5 == 0)) for i in range(0, 600, 3)]
    score = lambda known: sorted((r.doc_id, r.score) for r in toxicity.toxicity(rows(texts), spark.createDataFrame(known, "doc_id long, toxic int")).collect())
    assert score(once) == score(once + [(i, 0) for i, _ in once] + [(i, None) for i, _ in once])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div>{body}<!-- x --><div id="comments"><p>first!</p></div><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    article = "<article><h1>A &amp; B</h1><p><b>One <i>tw</i>o<br>three<p>four&nbsp;five</article>"
    shared = "<div>Subscribe now to our letter</div><div>All rights</div>"
    pages = [
        (1, "http://h.example/a/1", PAGE.format(body=article)), (2, "http://h.example/a/2", PAGE.format(body=article)), (3, None, None), (4, "x", ""), (5, "http://g.example/p/1", PAGE.format(body=shared + "<div>Story one is long</div>")),
        (6, "http://g.example/p/2?q=1", PAGE.format(body=shared + "<div>Story two</div><div>goes on</div>")), (7, "http://solo.example/", "<p>Alone &lt;here&gt;"), (7, "http://solo.example/", "<p>Alone &lt;here&gt;"), (8, "http://z.example", "<p>open <div class='sidebar'>never closed"),
    ]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, path string")
    got = defaultdict(list)
    for r in extraction.extract(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    text = "A & B One two three four five"
    assert got == {1: [text], 2: [text], 3: [""], 4: [""], 5: ["Story one is long"], 6: ["Story two goes on"], 7: ["Alone <here>"] * 2, 8: ["open"]}
    assert extraction.extract(df.limit(0)).count() == 0


def test_marks_leave_the_article():
    text = lambda page: extraction.main_text(extraction.blocks(page), None)
    article = "<article><p>One</p><p class='notice'>two <span class='search-term'>three</span></p><div class='ad'>Buy</div></article>"
    for wrapper in ("class='content has-sidebar'", "id='page' class='with-header'", "class='sidebar'", "class=x"):
        assert text(f"<body><div class='ad'>Buy</div><div {wrapper}>{article}</div><div id='comments'>first!</div></body>") == "One two three"
    assert text(f"<div id='comments'><article>first!</article></div>{article}") == "One two three"
    assert text("<body><div class='widget'>All there is</div></body>") == "All there is"


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def is_subsequence(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


@pytest.mark.parametrize("bits", [1 << 30, 8])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(extraction, "HELD_BITS", bits)
    rng = np.random.default_rng(7)
    cases = [("aba", "ba"), ("abcbdab", "bdcaba"), ("", "a"), ("abc", "xac")] + [("".join(rng.choice(list("abcd"), rng.integers(0, 14))), "".join(rng.choice(list("abcd"), rng.integers(0, 14)))) for _ in range(300)]
    for own, other in cases:
        found = sorted(extraction.aligned(list(own), list(other)))
        assert len(found) == longest_common(own, other) and is_subsequence([own[k] for k in found], other)
    assert len(extraction.aligned(["same"] * 3000, ["x", *["same"] * 2999])) == 2999


def neighbours_by_brute_force(pages):
    """page_id -> text, each page against all others of its host."""
    out = {}
    order = sorted(pages, key=lambda p: (p[1], p[0]))
    for n, (i, url, page) in enumerate(order):
        own = [t for t, _, _ in extraction.blocks(page)]
        near = [(len(os.path.commonprefix([u, url])), m < n, -abs(m - n), extraction.blocks(x)) for m, (_, u, x) in enumerate(order) if [t for t, _, _ in extraction.blocks(x)] != own]
        out[i] = extraction.main_text(extraction.blocks(page), max(near, key=lambda x: x[:3])[3] if near else None)
    return out


def test_neighbours_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(9)
    lines = [f"<div>shared line {k}</div>" for k in range(6)]
    pages = []
    for i in range(60):
        kind = i % 5  # pages without an article; runs of copies at both ends and between
        body = "<div>copied page</div>" + lines[0] if kind in (0, 1) or i < 9 or i > 50 else f"<div>own text {i}</div>" + "".join(rng.permutation(lines)[: rng.integers(1, 5)])
        pages.append((i, f"http://h.example/{'ab'[i // 30]}/{i:03d}", f"<body><div>menu of all</div>{body}</body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = neighbours_by_brute_force([(i, u.split("example")[1], p) for i, u, p in pages])
    for ranges in (1, 3, 12, 40):
        assert {r.page_id: r.text for r in extraction.extract(df, ranges).collect()} == want
    assert any("menu of all" not in t for t in want.values())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:160] = x[100]  # copies: ties go to the smaller vec_id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0] * 5), (2004, [None] * 24), (None, [1.0] * 24)]
    found = defaultdict(list)
    for r in ann.search(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(found) == list(range(0, 1500, 20))
    exact, hits = x.astype(np.float64), 0
    for q, own in found.items():
        s = (exact * exact[q]).sum(1)
        assert [k for k, _, _ in own] == list(range(1, 21)) and all(abs(s[v] - c) < 1e-12 and v != q for _, v, c in own)
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -s))[:20].tolist()) & {v for _, v, _ in own})
    assert hits / 20 / len(found) >= 0.9
    assert [v for _, v, _ in found[100]][:20] == list(range(101, 121))


def test_recall_on_the_table(spark, sf, monkeypatch):
    """Of the table's queries at the scale that has most vectors, against brute force; lists that many queries probe in parts."""
    folder = sf.replace("0.001", "0.1") if os.path.isdir(sf.replace("0.001", "0.1")) else sf
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    results = []
    for part in (ann.QUERY_PART, 16):
        monkeypatch.setattr(ann, "QUERY_PART", part)
        found = defaultdict(list)
        for r in ann.search(df).orderBy("query_id", "rank").collect():
            found[r.query_id].append((r.vec_id, r.score))
        results.append(dict(found))
    hits = 0
    for q, own in found.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len({v for v, _ in own} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert results[0] == results[1] and len(found) == (ids % 20 == 0).sum() and hits / 20 / len(found) >= 0.9


def test_repeated_vectors(spark):
    """Each row of a vec_id is a candidate; its smallest vector asks."""
    got = ann.search(vectors(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [1.0, 0.0])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 3, 2.0), (0, 2, 3, 1.0), (0, 3, 4, 0.0)]


def test_few_vectors(spark):
    got = ann.search(vectors(spark, [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 20, 1.0), (0, 2, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 3, 0.0)]
    assert ann.search(vectors(spark, [(0, [1.0])])).count() == 0 and ann.search(vectors(spark, [])).count() == 0


def removed_by_brute_force(pairs):
    lines = [(i, k, frozenset(words(x))) for i, t in sorted(pairs, key=lambda p: p[0]) for k, x in enumerate((t or "").split("\n"))]
    out = {i: [] for i, _ in pairs}
    for n, (i, k, s) in enumerate(lines):
        if s and any(5 * len(s & t) >= 4 * len(s | t) for _, _, t in lines[:n]):
            out[i].append(k)
    return out


@pytest.fixture
def in_blocks(monkeypatch):
    """Small blocks, and words that are soon frequent; for the driver's and the workers' code."""

    def set_to(block, frequent):
        for name, value in (("BLOCK", block), ("FREQUENT", frequent), ("LOOKED_UP", 1 << 20 if block > 100 else 50), ("MANY", 24 if block > 100 else 3), ("CELLS", 1 << 22 if block > 100 else 40), ("BLOCK_WORDS", 1 << 17 if block > 100 else 60), ("VERIFIED", 1 << 20 if block > 100 else 300)):
            monkeypatch.setattr(line_dedup, name, value)

    return set_to


@pytest.mark.parametrize(("seed", "block", "frequent"), [(0, 2048, 1 << 14), (1, 4, 1 << 14), (2, 2048, 3), (3, 4, 1)])
def test_line_dedup(rows, in_blocks, seed, block, frequent):
    in_blocks(block, frequent)
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)])
    bases = [list(rng.choice(vocabulary, rng.integers(3, 14))) for _ in range(25)]
    pairs = []
    for i in range(60):
        own = []
        for _ in range(rng.integers(1, 6)):
            line = list(bases[rng.integers(25)])
            for _ in range(rng.integers(0, 3)):
                line[rng.integers(len(line))] = str(rng.choice(vocabulary))
            own.append(" ".join(line).upper() if rng.random() < 0.1 else " ".join(line))
        pairs.append((i, "\n".join(own)))
    got = line_dedup.line_dedup(rows(pairs))
    assert {r.doc_id: r.removed for r in got.collect()} == removed_by_brute_force(pairs)
    kept = {r.doc_id: r.text for r in line_dedup.apply(rows(pairs), got).collect()}
    assert all(kept[r.doc_id].count("\n") + 1 == r.n_lines - len(r.removed) or len(r.removed) == r.n_lines for r in got.collect())


def links_by_brute_force(pairs):
    """doc_id -> (class_id, n_links), over distinct sets of words; a copy has a link to its set's first line besides."""
    first, out = {}, {i: [i, 0] for i, _ in pairs}
    for i, t in sorted(pairs, key=lambda p: p[0]):
        for x in (t or "").split("\n"):
            s = frozenset(words(x))
            if not s:
                continue
            copied = s in first
            first.setdefault(s, (len(first), i))
            near = [d for o, (n, d) in first.items() if n < first[s][0] and 5 * len(s & o) >= 4 * len(s | o)] + [first[s][1]] * copied
            out[i] = [min([out[i][0], *near]), out[i][1] + len(near)]
    return {i: tuple(v) for i, v in out.items()}


def test_words_of_one_short_hash_are_told_apart(rows):
    """Lines of words whose first 32 bits agree pairwise, but for no word in common."""
    rng = np.random.default_rng(11)
    names = ["".join(chr(97 + c) for c in x) for x in rng.integers(0, 26, (400_000, 8))]
    short = pretok.hashed_words(["\n".join(names)])[2]
    order = np.argsort(short, kind="stable")
    at = np.flatnonzero(short[order][1:] == short[order][:-1])
    pairs = [(names[order[k]], names[order[k + 1]]) for k in at if names[order[k]] != names[order[k + 1]]]
    assert len(pairs) >= 10
    a, b = (" ".join(p[k] for p in pairs[:10]) for k in (0, 1))
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(rows([(1, a), (2, b), (3, b + " more")])).collect()}
    assert got == {1: [], 2: [], 3: [0]}


def test_words_of_one_hash_are_compared():
    words = pretok.Words(["one two three one", "two four"])
    words.hashes = np.full(len(words.hashes), 7, np.uint64)
    found = words.numbers()
    assert found[0] == found[3] and found[1] == found[4] and len(set(found.tolist())) == 4


@pytest.mark.parametrize(("block", "frequent"), [(2048, 1 << 14), (4, 1 << 14), (2048, 5), (4, 2)])
def test_line_dedup_gives_all_links(rows, in_blocks, block, frequent):
    in_blocks(block, frequent)
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)])
    sizes = [20, 20, 20, 60, 110]  # longer ones have more parities
    bases, pairs = [list(rng.choice(vocabulary, n, False)) for n in sizes], []
    for i in range(50):
        own = []
        for _ in range(3):
            n = sizes[base := rng.integers(5)]
            line = list(bases[base])
            for _ in range(rng.integers(0, max(4, n // 6))):
                line[rng.integers(n)] = str(rng.choice(vocabulary))
            own.append(" ".join(line))
        pairs.append((i, "\n".join(own)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in line_dedup.line_dedup(rows(pairs)).collect()}
    assert got == links_by_brute_force(pairs)


def postings_in_order(lines):
    """Postings of lines as the lists are met: in the order of list and size."""
    words = pretok.Words(["\n".join(lines)])
    often = np.zeros(line_dedup.COUNTERS, np.uint32)
    sets = line_dedup.Sets(words, len(lines), often)
    p = line_dedup.postings_of(sets, often, sets.size >= line_dedup.LEAST_SIZE, sets.keys()[:, 0], 1)
    order = np.lexsort((p["size"], p["list"]))
    return {name: p[name][order] for name in p}


def test_lists_compare_few_pairs_and_lose_none(monkeypatch):
    """Unlike sets that share a word are told apart by positions and first parities, before all filters (F1)."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)])
    lines = [" ".join(rng.choice(vocabulary, rng.integers(4, 80), False)) for _ in range(150)]
    for x in lines[:60]:
        near = x.split()
        near[rng.integers(len(near))] = str(rng.choice(vocabulary))
        lines.append(" ".join(near))
    p = postings_in_order(lines)
    x, y = np.triu_indices(len(p["list"]), 1)
    same = p["list"][x] == p["list"][y]
    x, y = x[same], y[same]
    ok = line_dedup.similar_sizes(p, x, y)
    met, similar = [], line_dedup.similar_sizes
    monkeypatch.setattr(line_dedup, "similar_sizes", lambda p, x, y: met.append(len(x)) or similar(p, x, y))
    found = np.flatnonzero(line_dedup.candidates(p))
    assert found.tolist() == sorted({*x[ok].tolist(), *y[ok].tolist()}) and len(found)
    near = (p["size"][x] * 5 >= p["size"][y] * 4).sum()  # what was compared before
    assert sum(met) < near / 4


def test_large_lists_are_verified_in_small_matrices():
    """Lines of few words take a matrix of these words, not of CELLS cells (F1)."""

    class Rows:
        """Stands for rows dealt and in order."""

        def repartition(self, *_):
            return self

        sortWithinPartitions = select = repartition

        def mapInArrow(self, run, _):
            return run

    common = " ".join(f"w{chr(97 + k)}" for k in range(20))
    texts = [f"{common} own{chr(97 + n)}" for n in range(26)]
    often = np.zeros(line_dedup.COUNTERS, np.uint32)
    sets = line_dedup.Sets(pretok.Words(["\n".join(texts)]), len(texts), often)
    keys = sets.keys()
    name = line_dedup.list_of(np.sort(pretok.Words([common]).hashes)[:1])[0]
    n = len(texts)
    assert n >= line_dedup.MANY
    fixed = lambda value, kind: pa.array(np.full(n, value), kind)
    batch = pa.RecordBatch.from_arrays([fixed(int(name), pa.int64()), *(fixed(0, pa.int32()) for _ in range(3)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.arange(n)), fixed(0, pa.int32()), pa.array(texts)], names=["list", "i", "j", "own", "a", "b", "doc_id", "line", "text"])
    run = line_dedup.verified(Rows(), often, 1 << 14)
    list(run(iter([batch])))
    tracemalloc.start()
    got = pa.Table.from_batches(list(run(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["matched"].to_pylist() == list(range(1, n)) and set(got["doc_id"].to_pylist()) == {0}
    assert peak < 4 << 20


def test_line_dedup_of_odd_rows(odd, none):
    got = {r.doc_id: (r.removed, r.n_links, r.n_lines, r.class_id) for r in line_dedup.line_dedup(odd).collect()}
    assert got[1] == ([], 0, 1, 1) and got[3] == ([], 0, 2, 3) and got[5][1:3] == (0, 2) and got[6] == ([0], 1, 1, 5) and got[None][3] is None
    assert line_dedup.line_dedup(none).count() == 0


def test_near_dedup_broadcasts_no_table(rows, monkeypatch):
    """What grows with the documents is never sent to the driver for a broadcast, however small it looks (F1, F2)."""
    plans, writes = [], near_dedup.written

    def seen(df, *args, **settings):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return writes(df, *args, **settings)

    monkeypatch.setattr(near_dedup, "written", seen)
    base = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    got = near_dedup.near_dedup(rows([(1, base), (2, base + " end"), (3, base), (4, "other words")]))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1)]
    assert len(plans) > 8 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_vectors_too_close_for_their_codes():
    """In a list whose members' codes are much alike, all of the nearest are found by how far the codes are off (F3)."""
    rng = np.random.default_rng(4)
    model = ann.Quantiser(rng.normal(size=(1500, 64)), 1500)
    x = rng.normal(size=64) + 1e-3 * rng.normal(size=(2000, 64))
    at, codes = model.encode(x)
    ids = np.flatnonzero(at == np.bincount(at).argmax())
    x, codes, list_ = x[ids], codes[ids], int(at[ids[0]])
    asked = np.arange(0, len(ids), 20)
    query, vec, score = ann.answers(model, list_, ids, codes, x, model.missed(list_, codes, x), ids[asked], x[asked], 20)
    assert len(ids) > 1000
    for k in asked:
        s = x @ x[k]
        s[k] = -np.inf
        own = query == ids[k]
        assert vec[own].tolist() == ids[np.lexsort((ids, -s))[:20]].tolist() and np.allclose(score[own], np.sort(s)[::-1][:20], rtol=0, atol=1e-10)
