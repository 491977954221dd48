"""Places in the order of values, segmentation into pieces, names in blocks, router sentences: against brute force and golden values."""

import random

import numpy as np

from folioquery.functions import embedding, ranks
from folioquery.operators import ledger, names, retrieval, routing


def test_ranks_of_small_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 50)
    monkeypatch.setattr(ranks, "MARGIN", 0.02)
    rng = np.random.default_rng(2)
    groups = {"a": rng.integers(0, 40, 3000), "b": rng.normal(size=2001), "c": np.array([5.0]), "d": np.array([2.0, 1.0]), "e": np.full(500, 7.0), "f": np.arange(51)}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v double")
    got = {r.g: r.m for r in ranks.upper_median(rows, ["g"], "v", "m").collect()}
    assert got == {g: float(np.sort(v)[len(v) // 2]) for g, v in groups.items()}
    for p in (0, 50, 95, 100):
        monkeypatch.setattr(ranks, "SENT_GROUPS", p % 100)  # bounds are joined, or sent
        got = {r.g: r.m for r in ranks.nearest_rank(rows, ["g"], "v", p, "m").collect()}
        assert got == {g: float(np.sort(v)[round(p / 100 * (len(v) - 1))]) for g, v in groups.items()}


def segmentations(text, pieces):
    if not text:
        yield 0.0, []
    for n in range(1, len(text) + 1):
        if text[:n] in pieces.scores:
            s, k = pieces.scores[text[:n]]
        elif n == 1:
            s, k = min(x for x, _ in pieces.scores.values()) - embedding.UNKNOWN_PENALTY, pieces.unknown
        else:
            continue
        for rest, ids in segmentations(text[n:], pieces):
            yield s + rest, [k, *ids]


def test_likeliest_pieces():
    rng = random.Random(3)
    for turn in range(40):
        words = {"".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(8)}
        pieces = embedding.Pieces({w: (-rng.random() * 5 - turn / 100, k + 1) for k, w in enumerate(sorted(words))}, 0)
        text = "".join(rng.choices("abcx", k=rng.randint(0, 9)))
        score, ids = max(segmentations(text, pieces), key=lambda x: x[0])
        folded = [k for n, k in enumerate(ids) if k or not n or ids[n - 1]]
        assert pieces.segment(text) == folded
    assert embedding.Pieces({"a": (-1.0, 5)}, 0).segment("xxaxx") == [0, 5, 0]


def test_pooled_vectors(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, [[3.0, 0.0], [0.0, 4.0], [3.0, 4.0]]), (2, [[1.0, 0.0]]), (3, [[0.0, 0.0]])], "id int, t array<array<float>>")
    got = {r.id: r.v for r in rows.select("id", embedding.pooled(F.col("t")).alias("v")).collect()}
    mean = np.array([2.0, 8 / 3])
    assert np.allclose(got[1], mean / np.linalg.norm(mean)) and got[2] == [1.0, 0.0] and got[3] is None


def test_router_says_what_it_understood(spark):
    typed = spark.createDataFrame([(1, "2+2"), (2, "spent this month"), (3, "when is the due date"), (4, "timer 5 min"), (5, "india"), (6, "beach photos"), (7, " ")], "query_id long, text string")
    apps = spark.createDataFrame([("India", "org.nation.india", "8")], "label string, package string, component string")
    got = {r.query_id: r.understood for r in routing.route(typed, "2026-10-05", apps=apps, mode="KEYWORDS").collect()}
    assert got[1].startswith("A calculation") and "this month" in got[2] and "a date" in got[3] and "a timer" in got[4]
    assert got[5] == "Matches the app “India”. Also looking in your files for “india”, by exact words only." and got[6] == "Looking in your files for “beach photos”, by exact words only." and got[7] is None


def test_money_beyond_doubles(spark):
    rows = spark.createDataFrame([(900719925474099301,), (-150,), (12345600,), (5,)], "p long")
    from pyspark.sql import functions as F

    assert [r.s for r in rows.select(ledger.money(F.col("p")).alias("s")).collect()] == ["₹9,00,71,99,25,47,40,993.01", "₹-1.50", "₹1,23,456", "₹0.05"]


def test_legs_by_themselves_keep_their_scores(spark):
    leg = lambda scores: spark.createDataFrame([(1, k, s, k) for k, s in enumerate(scores, 1)], "query_id long, chunk_id long, score double, rank int")
    words, meaning = leg([7.25, 3.0]), leg([0.9, 0.8, 0.7])
    got = lambda mode: sorted((r.chunk_id, r.score, r.keyword_rank, r.meaning_rank) for r in retrieval.fuse(words, meaning, retrieval.SearchOptions(mode=mode)).collect())
    assert got("KEYWORDS") == [(1, 7.25, 1, None), (2, 3.0, 2, None)] and got("MEANING") == [(1, 0.9, None, 1), (2, 0.8, None, 2), (3, 0.7, None, 3)]


def test_chunk_ids_of_long_items_dont_clash(spark):
    rows = spark.createDataFrame([(1, "\n".join(["w"] * 1500)), (2, "w")], "id long, text string")
    got = retrieval.chunk(rows, "id", "text", 1)
    assert got.count() == got.select("chunk_id").distinct().count() == 1501


def test_bounds_of_a_vocabulary_are_made_once():
    """Cutting a word doesn't go through the whole vocabulary (F7)."""
    class Counted(dict):
        gone = 0

        def values(self):
            Counted.gone += 1
            return super().values()

    own = embedding.Pieces(Counted(a=(-1.0, 5), ab=(-1.5, 6)), 0)
    assert [own.segment(t) for t in ("ab", "aab", "xxa")] == [[6], [5, 6], [0, 5]] and Counted.gone == 1
