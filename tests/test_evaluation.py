"""Choosers and sweeps against their rules worked out by hand, and upkeep that writes only what is due."""

import itertools

import pytest
from pyspark.sql import functions as F

from folioquery.operators import answers as A
from folioquery.operators import evaluation as E
from folioquery.operators import facts as X
from folioquery.operators import maintenance as M
from folioquery.operators import retrieval as R
from folioquery.plans import queries_evaluation as Q
from folioquery.plans.deploy import ship
from folioquery.sources.segments import Segments


@pytest.fixture(scope="module")
def cells(spark, sf):
    ship(spark)
    return {(r.variant, r.gate): r for r in Q.sweep(spark, sf).collect()}


def test_the_sweep_tells_its_cells_apart(cells):
    assert len(cells) == 20
    assert len({tuple(r)[2:] for r in cells.values()}) >= 8
    for (variant, gate), r in cells.items():
        assert r.queries > 0 and r.correct + r.wrong + r.made_up + r.declined + r.not_a_question == cells["B0", "A0"].correct + cells["B0", "A0"].wrong + cells["B0", "A0"].made_up + cells["B0", "A0"].declined + cells["B0", "A0"].not_a_question
        assert 0 < r.recall_1 <= r.recall_5 <= 1 and (r.recall_1, r.recall_5, r.mrr) == tuple(cells[variant, "A0"][c] for c in ("recall_1", "recall_5", "mrr"))
    assert len({(r.recall_1, r.recall_5, r.mrr) for r in cells.values()}) >= 3
    assert all(cells[v, "A1"].wrong + cells[v, "A1"].made_up <= cells[v, "A0"].wrong + cells[v, "A0"].made_up for v, *_ in E.VARIANTS)


@pytest.mark.parametrize("variant,gate", [("B0", "A0"), ("S2", "A1"), ("S3", "A3")])
def test_a_cell_by_itself(spark, sf, cells, variant, gate):
    """One search and one answer with these settings, as a user would call them, give the cell's figures."""
    _, extended, coverage, weight = next(v for v in E.VARIANTS if v[0] == variant)
    _, grounded, function_words, generic_words = next(g for g in E.GATES if g[0] == gate)
    queries, relevant = Q.swept(spark, sf)
    index = Q.sweep_index(spark, sf)
    found = R.search(index, Q.sweep_vectors(spark, sf), queries, R.SearchOptions(extended, coverage, weight)).cache()
    right = {r.query_id: r.item_id for r in relevant.collect()}
    rank = {r.query_id: r["rank"] for r in found.collect() if right[r.query_id] == r.item_id}
    n = len(right)
    cell = cells[variant, gate]
    assert (cell.queries, cell.recall_1, cell.recall_5) == (n, round(sum(k == 1 for k in rank.values()) / n, 6), round(sum(k <= 5 for k in rank.values()) / n, 6))
    assert cell.mrr == pytest.approx(sum(1 / k for k in rank.values()) / n, abs=1e-6)
    asked = queries.where("asks")
    top = found.where("rank <= 2").join(asked.select("query_id"), "query_id", "left_semi").join(index.chunks.select("item_id", "text"), "item_id")
    lacking = None
    if grounded:
        best = top.where("rank = 1").select("query_id", "text").join(A.classify(asked.select("query_id", "text")).where("kind IS NOT NULL"), "query_id").select("query_id", "topic", "text")
        lacking = A.ungrounded(best, index.postings.groupBy("term").agg(F.count("*").alias("df")), index.statistics.first()["n"], function_words, generic_words)
    given = {r.query_id: r for r in A.answer(top, asked.select("query_id", "text"), X.facts(top.select("item_id", "text").distinct()), lacking).collect()}
    got = {"correct": 0, "wrong": 0, "made_up": 0, "declined": 0, "not_a_question": 0}
    for r in asked.select("query_id", "value").collect():
        own = given[r.query_id]
        if own.outcome != "FOUND":
            got["declined" if own.outcome == "DECLINED" else "not_a_question"] += 1
        else:
            got["correct" if own.value == r.value else "made_up" if r.value is None else "wrong"] += 1
    assert {k: cell[k] for k in got} == got


def test_gates_policies_and_modes_are_chosen(spark):
    scores = spark.createDataFrame([("A0", 3, 1, 9), ("A1", 1, 0, 5), ("A2", 0, 1, 7), ("A3", 1, 0, 7)], "gate string, wrong long, made_up long, correct long")
    assert E.choose_gate(scores).first().gate == "A2"
    assert E.choose_gate(scores.where("gate <> 'A2'")).first().gate == "A3" and E.choose_gate(scores.limit(0)).count() == 0
    policies = spark.createDataFrame([("T0", 0.09, 0.95, 0.70), ("T1", 0.97, 0.94, 0.76), ("T2", 0.97, 0.95, 0.79), ("T3", 0.99, 0.93, 0.9), ("T4", 0.28, 1.0, 1.0)], "policy string, own double, other double, mrr double")
    assert E.choose_policy(policies, "T0").first().policy == "T1"
    assert E.choose_policy(policies.where("policy IN ('T0', 'T3', 'T4')"), "T0").count() == 0
    columns = "mode string, items long, correct_confident long, correct_flagged long, wrong_confident long, wrong_flagged long, none long, offered long, regressed long, false_flags long"
    row = lambda mode, right=100, flagged=0, wrong=5, wrong_flagged=0, regressed=0, false=0: (mode, 110, right, flagged, wrong, wrong_flagged, 5, 100, regressed, false)
    real = [row("OFF"), row("LOOKALIKE", 102, wrong=2), row("GUARD", 101, wrong=0, regressed=1), row("ALTERNATIVE", 100, wrong=0, wrong_flagged=2, false=2)]
    clean = [row(m) for m in Q.MODES]
    choose = lambda a, b: E.choose_mode(spark.createDataFrame(a, columns), spark.createDataFrame(b, columns), Q.MODES).first().mode
    assert choose(real, clean) == "LOOKALIKE"  # GUARD regresses, ALTERNATIVE flags too much
    assert choose([row("OFF", regressed=3), *real[1:]], [row("OFF"), row("LOOKALIKE", regressed=1), *clean[2:]]) == "OFF"
    tied = [row("OFF", wrong=0), row("LOOKALIKE", wrong=0), row("GUARD", 99, 2, wrong=0), row("ALTERNATIVE", 99, 2, wrong=0)]
    assert choose(tied, clean) == "GUARD"


def test_backfill_writes_what_is_due_once(spark, tmp_path, monkeypatch):
    ship(spark)
    items, stored = Segments(spark, f"file://{tmp_path}/items", "id"), Segments(spark, f"file://{tmp_path}/facts", "fact_id")
    rows = [(k, f"{'x' * k}", "INDEXED" if k % 4 else "FAILED", 1 if k % 2 else 2, "keep") for k in range(12)]
    items.change(spark.createDataFrame(rows, "id long, text string, status string, facts_version int, name string"))
    read = lambda letter: lambda some: some.select(F.concat(F.col("item_id").cast("string"), F.lit(letter)).alias("fact_id"), "item_id", F.length("text").alias("n"))
    assert M.backfill(items, stored, 1, read("a")) == 0 and stored.read() is None
    assert M.backfill(items, stored, 2, read("a")) == 6
    assert {(r.fact_id, r.n) for r in stored.read().collect()} == {(f"{k}a", k) for k in range(12) if k % 2}
    before = items.version(), stored.version()
    assert M.backfill(items, stored, 2, read("b")) == 0 and (items.version(), stored.version()) == before
    change = Segments.change
    monkeypatch.setattr(Segments, "change", lambda self, *a, **b: change(self, *a, **b) if self is stored else (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        M.backfill(items, stored, 3, read("b"))
    monkeypatch.setattr(Segments, "change", change)
    assert M.backfill(items, stored, 3, read("b")) == 9
    assert {r.fact_id for r in stored.read().collect()} == {f"{k}b" for k in range(12) if k % 4}
    assert {(r.id, r.facts_version, r.name) for r in items.read().collect()} == {(k, 3 if k % 4 else 2, "keep") for k in range(12)}


def test_clearing(spark, tmp_path):
    place = f"file://{tmp_path}/t"
    spark.range(10).write.parquet(place)
    got = M.cleared({"t": spark.read.parquet(place)})
    assert got["t"].count() == 0 and spark.read.parquet(place).columns == ["id"] and spark.read.parquet(place).count() == 0
    assert M.cleared(got)["t"].count() == 0


def test_search_variants_are_searches(spark):
    texts = ["alpha beta", "alpha", "beta gamma", "se alpha gamma", "delta"]
    index_rows = spark.createDataFrame([(k, k, 0, t) for k, t in enumerate(texts)], "chunk_id long, item_id long, ordinal int, text string")
    import tempfile

    index = R.build_index(index_rows, f"file://{tempfile.mkdtemp()}/index")
    vectors = spark.createDataFrame([(k, [float(k == 0), float(k == 1), 0.5]) for k in range(5)], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(1, "alpha se", [1.0, 0.0, 0.0]), (2, "gamma delta zeta", [0.0, 1.0, 0.0]), (3, " ", [0.0, 1.0, 0.0])], "query_id long, text string, vector array<double>")
    got = R.search_variants(index, vectors, queries, spark.createDataFrame(E.VARIANTS, "variant string, extended boolean, coverage double, weight double")).collect()
    for (name, extended, coverage, weight), (query_id, _) in itertools.product(E.VARIANTS, ((1, 0), (2, 0), (3, 0))):
        one = R.search(index, vectors, queries.where(F.col("query_id") == query_id), R.SearchOptions(extended, coverage, weight)).collect()
        mine = [r for r in got if (r.variant, r.query_id) == (name, query_id)]
        assert sorted((r["rank"], r.item_id, round(r.score, 9)) for r in mine) == sorted((r["rank"], r.item_id, round(r.score, 9)) for r in one)


def test_a_seeded_corpus(spark, sf):
    """The same rows and seed give the same corpus; its facts are in its texts; a question's answer is in the item that it names."""
    from folioquery.operators import corpus as C

    ship(spark)
    rows = spark.createDataFrame([(k, f"Shop {'abc'[k % 3]}", 1000 * k + k % 7, f"2026-0{1 + k % 9}-1{k % 10}") for k in range(120)], "id long, name string, paise long, day string")
    made = {r.doc_id: r for r in C.documents(rows, 5).collect()}
    assert made == {r.doc_id: r for r in C.documents(rows.repartition(7), 5).collect()} and len(made) == 120
    other = {r.doc_id: r for r in C.documents(rows, 6).collect()}
    assert all(made[k].anchor != other[k].anchor and made[k].type != other[k].type for k in made)
    assert {(r.type, r.lang) for r in made.values()} == {(t, lang) for t in C.TYPES for lang in C.LANGS} and len({r.anchor for r in made.values()}) == 120
    read = {}
    for r in X.facts(C.documents(rows, 5).select(F.col("doc_id").alias("item_id"), "text")).collect():
        read.setdefault(r.item_id, {}).setdefault(r.kind, []).append(r.value)
    for k, r in made.items():
        assert {kind: [v] for kind, v in r.facts.items() if v != "0"} == {kind: v for kind, v in read.get(k, {}).items()}, r
    kinds = {}
    for q in C.questions(C.documents(rows, 5), 2).collect():
        own = made[q.query_id]
        kinds[q.kind] = kinds.get(q.kind, 0) + 1
        assert (own.anchor in q.text) == (q.kind != "negative") == (q.relevant == q.query_id) and q.style == own.lang
        assert q.value in own.facts.values() if q.kind == "value" else q.value is None
    assert set(kinds) == {"value", "find", "negative"}
    asked = C.questions(C.documents(rows, 5), 1).where("kind = 'value'")
    assert {r.kind for r in A.classify(asked.select("query_id", "text")).collect()} == {"AMOUNT", "DATE", "PHONE"}
    with pytest.raises(Exception, match="anchor comes again"):
        C.documents(rows.unionByName(rows.limit(1)), 5).collect()
    assert C.questions(C.documents(rows.limit(0))).count() == 0


def test_edits_of_whole_texts():
    """Exact with bounds that meet and without, and quick for long texts (F6)."""
    import random
    import time

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    draw = random.Random(3)
    for n in range(400):
        a, b = ("".join(draw.choice("abcతె ") for _ in range(draw.randrange(1 + n % 80))) for _ in range(2))
        b = b if n % 2 else "".join(draw.choice(["", c, c, c, "x"]) for c in a)
        assert E.text_edits(a, b) == table(a, b) and (not a or not b or E.bit_edits(a, b) == table(a, b))
    assert E.text_edits(None, "a") is None
    long = "".join(draw.choice("abcde fgh") for _ in range(120_000))
    began = time.perf_counter()
    assert E.text_edits(long, long.replace("e", "c")) == long.count("e") and time.perf_counter() - began < 5
    assert E.text_edits(long[:20_000], long[1:20_000] + "z") == 2
