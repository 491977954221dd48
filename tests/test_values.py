"""Values of the queries that SQL can't express, worked out by plain Python over the same rows."""

import re

import pytest
from pyspark.sql import functions as F

from folioquery.functions.text import STOPWORDS
from folioquery.operators import answers as A
from folioquery.operators import facts as X
from folioquery.operators import names as O
from folioquery.operators import retrieval as R
from folioquery.plans import queries_answers, queries_names, queries_requests, queries_retrieval
from folioquery.plans.deploy import ship
from folioquery.plans.registry import queries


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def terms_of(text):
    found = dict.fromkeys(re.findall(r"\w+", text.lower()))
    return [w for w in found if not (w.isascii() and (len(w) < 2 or w in STOPWORDS))]


def snippet_of(text, terms, most=160):
    lines = [x for x in re.split(r"\r\n|[\n\x0b\x0c\r\x85  ]", text) if x.strip(" ")]
    if not lines:
        return ""
    n = [sum(t in x.lower() for t in terms) for x in lines]
    at = n.index(max(n))
    out = lines[at]
    if len(out) < most // 2 and at + 1 < len(lines):
        out += " · " + lines[at + 1]
    return out if len(out) <= most else out[: most - 1] + "…"


def test_snippets(spark, sf):
    texts = {r.chunk_id: r.text for r in queries_retrieval.chunks(spark, sf).collect()}
    asked = {k: t for k, t, _ in queries_retrieval.ASKED}
    rows = queries_retrieval.snippets(spark, sf).collect()
    ranks = {(r.query_id, r["rank"]): r.chunk_id for r in R.bm25(queries_retrieval.index(spark, sf), queries_retrieval.texts(spark), R.RECOMMENDED, 10).collect()}
    assert {(r.query_id, r["rank"]): r.chunk_id for r in rows} == ranks and len(rows) > 10
    for r in rows:
        assert r.snippet == snippet_of(texts[r.chunk_id], terms_of(asked[r.query_id]))


def test_explanations(spark, sf):
    own = queries_retrieval.index(spark, sf)
    texts = {r.chunk_id: r.text for r in own.chunks.collect()}
    asked = {k: t for k, t, _ in queries_retrieval.ASKED}
    hits = {(r.query_id, r["rank"]): r for r in R.search(own, queries_retrieval.vectors(spark, sf), queries_retrieval.asked(spark, sf), R.RECOMMENDED, 5).collect()}
    rows = queries_retrieval.explained(spark, sf).collect()
    assert len(rows) == len(hits) > 5
    for r in rows:
        hit, terms = hits[r.query_id, r["rank"]], terms_of(asked[r.query_id])
        shown = snippet_of(texts[hit.chunk_id], terms)
        spans = []
        for a, b in sorted(m.span() for t in terms for m in re.finditer(re.escape(t) + r"\w*", shown, re.I)):
            if spans and a <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(b, spans[-1][1])
            else:
                spans.append((a, b))
        first = {}
        for a, b in spans:
            first.setdefault(shown[a:b].lower(), shown[a:b])
        words = list(first.values())[:3]
        matched = f"Matched {', '.join(f'“{w}”' for w in words) or 'your words'} in the text in your image"
        by_words, by_meaning = hit.keyword_rank is not None, hit.meaning_rank is not None
        why = f"{matched}, and it is close in meaning to your search." if by_words and spans and by_meaning else f"{matched}." if by_words else "No exact words matched; the text in your image is close in meaning to your search."
        assert (r.shown, r.n_spans, r.why) == (shown, len(spans), why)


def test_timings(spark, sf):
    rows = {r.stage: r for r in queries_retrieval.timings(spark, sf).collect()}
    assert set(rows) == {"keywords", "meaning", "fusion", "items", "total"} and all(r.ms > 0 for r in rows.values())
    assert rows["total"].ms == pytest.approx(sum(r.ms for k, r in rows.items() if k != "total"))
    assert {r.chunks_searched for r in rows.values()} == {queries_retrieval.chunks(spark, sf).count()}


def hits_by_hand(kind, labels, requests, limit, ties):
    out = []
    for query_id, text in requests:
        found = sorted((-round(s, 9), *(row[k] for k in ties), row) for row in labels if (s := kind.score(text, *row)) >= kind.least - 1e-12)
        out += [(query_id, rank, row[0], round(-s, 6)) for rank, (s, *_, row) in enumerate(found[:limit], 1)]
    return sorted(out)


def test_nations_and_settings(spark, sf):
    nations = [(r.n_name, f"org.nation.{r.n_name.lower()}", str(r.n_nationkey)) for r in spark.read.parquet(f"{sf}/nation.parquet").collect()]
    asked = [(r.query_id, r.text) for r in queries_names.nations_typed(spark, sf).collect()]
    got = sorted((r.query_id, r["rank"], r.label, r.score) for r in queries_names.nations(spark, sf).collect())
    assert got == hits_by_hand(O.APPS, nations, asked, 4, (0, 2)) and len({q for q, *_ in got}) >= 20
    catalogue = [tuple(r) for r in queries_requests.settings_catalogue(spark).collect()]
    asked = [(r.query_id, r.text) for r in queries_requests.settings_typed(spark, sf).collect()]
    got = sorted((r.query_id, r["rank"], r.label, r.score) for r in queries_requests.settings(spark, sf).collect())
    want = hits_by_hand(O.SETTINGS, catalogue, asked, 2, (0,))
    assert got == want and 0.4 * len(asked) < len({q for q, *_ in got}) < len(asked)


BILL = "Electricity bill\nAmount due: ₹1,234\nDue date: 15 Sep 2026\nCustomer care phone: 98765 43210\nAddress: 12 Power House Road"
CARD = "Asha Clinic visiting card\nPhone: 91234 56789\nAddress: 4 Lake Road"
FEE = "School fee receipt\nTotal: ₹5,000\nLate fine: ₹50\nPaid on 3 Aug 2026"


@pytest.mark.parametrize(
    "asked,item,outcome,value,reason",
    [
        ("how much is the electricity bill", BILL, "FOUND", "1234", None),
        ("when is the electricity bill due", BILL, "FOUND", "2026-09-15", None),
        ("phone number of asha clinic", CARD, "FOUND", "+919123456789", None),
        ("address of asha clinic", CARD, "FOUND", "4 Lake Road", None),
        ("how much was the school fee", FEE, "FOUND", "5000", None),
        ("how much was the zeppelin rent in october", BILL, "DECLINED", None, "no clear item"),
        ("how much was asha clinic", CARD, "DECLINED", None, "no such value"),
        ("how much was anything", None, "DECLINED", None, "nothing found"),
        ("photos of the beach", BILL, "NOT_A_QUESTION", None, "no question"),
        ("how much did I spend on electricity", BILL, "NOT_A_QUESTION", None, "no question"),
    ],
)
def test_answers(spark, asked, item, outcome, value, reason):
    other = "meeting notes about nothing"
    rows = [(1, 1, 10, item, 1, 0.9), (1, 2, 11, other, 2, 0.88)] if item else []
    results = spark.createDataFrame(rows, "query_id long, rank int, item_id long, text string, meaning_rank int, meaning_score double")
    facts = X.facts(spark.createDataFrame([(10, item or "")], "item_id long, text string"))
    (r,) = A.answer(results, spark.createDataFrame([(1, asked)], "query_id long, text string"), facts).collect()
    assert (r.outcome, r.value, r.reason) == (outcome, value, reason)
    if outcome == "FOUND":
        assert r.evidence == "STRONG" and r.confidence > 0.55 and r.shown


def test_registered_answers(spark, sf):
    """What the registered query answers is what the texts say; it declines where they don't."""
    texts = {r.item_id: r.text for r in queries_answers.texts(spark, sf).collect()}
    first = {r.query_id: texts[r.item_id] for r in queries_answers.results(spark, sf).where("rank = 1").collect()}
    kinds = {1: "AMOUNT", 2: "DATE", 4: "AMOUNT", 6: "PHONE", 8: "AMOUNT", 9: "AMOUNT"}
    rows = {r.query_id: r for r in queries_answers.answered(spark, sf).collect()}
    assert {k: r.kind for k, r in rows.items() if r.kind} == kinds and set(rows) == {k for k, _ in queries_answers.ASKED}
    for k, r in rows.items():
        assert r.outcome == ("NOT_A_QUESTION" if k not in kinds else "FOUND" if r.value else "DECLINED")
        if r.outcome == "FOUND" and r.kind == "AMOUNT":
            assert r.value in {re.sub(r"\.?0+$", "", m) if "." in m else m for m in re.findall(r"(?:₹|Rs |INR )([0-9.]+)", first[k].replace(",", ""))}
    assert any(r.outcome == "FOUND" for r in rows.values()) and rows[9].outcome == "DECLINED" and rows[6].outcome == "DECLINED"


def test_every_query_reads_a_table(spark):
    """A folder that isn't there fails each of them."""
    light = ["calculate", "commands", "route", "spending_queries", "classify_questions", "display_values", "query_terms", "choose_variant", "settings_search", "cleared_tables", "facts_of_documents"]
    for name in light:
        with pytest.raises(Exception, match="nowhere"):
            queries()[name](spark, "/nowhere").collect()
    assert F.lit(1) is not None


def test_answer_options(spark):
    """A rare word that the item lacks matters only with grounding, a function word only without its switch."""
    rows = [(1, 1, 10, BILL, 1, 0.9), (2, 1, 10, BILL, 1, 0.9)]
    results = spark.createDataFrame(rows, "query_id long, rank int, item_id long, text string, meaning_rank int, meaning_score double")
    asked = spark.createDataFrame([(1, "how much is the electricity bill for zeppelin"), (2, "electricity bill ka amount kitna tha")], "query_id long, text string")
    chunks = spark.createDataFrame([(10, 10, BILL)] + [(k, k, "electricity bill words") for k in range(20, 140)], "chunk_id long, item_id long, text string")
    index, facts = R.Index(chunks, R.postings(chunks), R.statistics(chunks)), X.facts(spark.createDataFrame([(10, BILL)], "item_id long, text string"))
    given = lambda options: {r.query_id: r.outcome for r in A.ask(results, asked, facts, index, options).collect()}
    assert given(A.BASELINE) == {1: "FOUND", 2: "FOUND"}
    assert given(A.AnswerOptions(grounding=True)) == {1: "DECLINED", 2: "DECLINED"}
    assert given(A.RECOMMENDED) == {1: "DECLINED", 2: "FOUND"}


def test_an_app_doesn_t_find_itself(spark):
    apps = spark.createDataFrame([("Folio", "org.folio", "a"), ("Folio too", "org.other", "b"), ("Folio nameless", None, "c")], "label string, package string, component string")
    assert [r.label for r in O.search_apps(apps, [(1, "folio")], own="org.folio").orderBy("rank").collect()] == ["Folio nameless", "Folio too"]
    assert O.search_apps(apps, [(1, "folio")]).count() == 3
