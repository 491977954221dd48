"""Names found through the index, against scoring every pair."""

import itertools
import random

from folioquery.functions import names as N
from folioquery.operators import names as O
from folioquery.plans import queries_names as Q
from folioquery.plans.deploy import ship


def by_hand(kind, labels, requests):
    """All pairs that score, and how many pairs there are."""
    out = []
    for (query_id, text), row in itertools.product(requests, labels):
        s = kind.score(text, *row)
        if s >= kind.least - 1e-12:
            out.append((query_id, round(s, 9), *map(repr, row)))
    return sorted(out)


def found(spark, kind, labels, requests, schema):
    df = spark.createDataFrame(labels, schema)
    return sorted((r[0], round(r[1], 9), *map(repr, r[2:])) for r in O.scored(df, requests, kind).collect())


def spellings(seed, n):
    draw = random.Random(seed)
    parts = ["amma", "ravi", "Kumar", "chris", "Šárka", "phone", "అమ్మ", "राम", "కుమార్", "x", "go", "Goog", "le", "maps", "bank", "bang", "panc", "D'Souza", "-", "_", "1", "22", "é", "McKay", "th", "zz"]
    return ["".join(draw.choice(parts) + draw.choice(["", "", " ", "."]) for _ in range(draw.randint(1, 4))).strip() for _ in range(n)]


def typed(seed, names, n):
    """Names with letters swapped, left out, put in or changed, shortened, or as they are."""
    draw = random.Random(seed)
    out = ["", "a", "call", "call amma", "open yt", "12", "wifi", "a b c d", "x" * 41, "మమ్మీ"]
    for _ in range(n):
        t = list(draw.choice(names))
        for _ in range(draw.randint(0, 2)):
            k = draw.randrange(len(t) + 1) if t else 0
            match draw.randrange(4):
                case 0 if k + 1 < len(t):
                    t[k], t[k + 1] = t[k + 1], t[k]
                case 1 if k < len(t):
                    del t[k]
                case 2:
                    t.insert(k, draw.choice("abgkdtsjc"))
                case 3 if k < len(t):
                    t[k] = draw.choice("abgkdtsjc")
        t = "".join(t)
        out.append(draw.choice([t, t.lower(), t.split(" ")[0], t[: draw.randint(2, 6)], f"open {t}", t[1:]]))
    return list(enumerate(out))


def test_apps_contacts_and_settings(spark):
    ship(spark)
    names = spellings(1, 150)
    asked = typed(2, names, 250)
    apps = [(n, f"org.{n.split(' ')[0].lower()}.app{k % 7}", str(k)) for k, n in enumerate(names)] + [("Google Pay", "com.gpay", "gp"), ("YouTube", "com.google.youtube", "yt"), (None, None, "none"), ("", "", "empty")]
    assert found(spark, O.APPS, apps, asked, "label string, package string, component string") == by_hand(O.APPS, [(a or "", b or "", c) if a is not None else (a, b, c) for a, b, c in apps], asked)
    contacts = [(k, n, f"+91 {k}") for k, n in enumerate(names)] + [(900, "Amma", "1"), (901, "Mummy ji", "2"), (902, "అమ్మ", "3"), (900, "Amma", "1")]
    assert found(spark, O.CONTACTS, contacts, asked, "id long, name string, number string") == by_hand(O.CONTACTS, contacts, asked)
    settings = [(f"S{k}", "act", names[3 * k : 3 * k + 3]) for k in range(40)] + [("Wi-Fi", "wifi", ["wifi", "wi fi", "internet"]), ("None", "n", None)]
    assert found(spark, O.SETTINGS, settings, asked, "label string, action string, names array<string>") == by_hand(O.SETTINGS, settings, asked)


def test_requests_and_labels_as_tables(spark):
    labels = spark.createDataFrame([(f"name{k}", f"org.n{k}", str(k)) for k in range(30)], "label string, package string, component string")
    asked = spark.createDataFrame([(k, f"name{k}") for k in range(25)] + [(None, None)], "query_id long, text string")
    got = sorted(map(tuple, O.search_apps(labels, asked, 1).select("query_id", "label", "rank").collect()))
    assert got == sorted((k, f"name{k}", 1) for k in range(25))
    assert O.search_apps(labels.limit(0), asked).count() == 0 and O.search_apps(labels, asked.limit(0)).count() == 0


def test_customers_by_typed_names(spark, sf):
    """The registered query against every pair; few pairs are scored."""
    contacts = [tuple(r) for r in Q.customers(spark, sf).collect()]
    asked = [tuple(r) for r in Q.typed(spark, sf).collect()]
    want = by_hand(O.CONTACTS, contacts, asked)
    assert found(spark, O.CONTACTS, contacts, asked, "id long, name string, number string") == want and len(want) >= len(asked)
    pairs = O.candidates(O.numbered(Q.customers(spark, sf), O.CONTACTS), Q.typed(spark, sf), O.CONTACTS).count()
    assert len(want) <= pairs < 0.25 * len(contacts) * len(asked), pairs
    best = Q.found(spark, sf).collect()
    hits = {(r.query_id, r.rank): (r.id, r.score) for r in best}
    assert all(hits[q, 1][1] == max(round(s, 6) for i, s, *_ in want if i == q) for q in {i for i, *_ in want})
    assert sum(r.query_id == r.id for r in best) >= 0.8 * len(asked)


def test_keys_hold_what_scores():
    for q, label in [("germny", "Germany"), ("inda", "INDIA"), ("ab", "abc"), ("kumar", "కుమార్"), ("gumar", "Kumar"), ("abcdefgh", "bacdefhg"), ("souza", "D'Souza")]:
        keys, parts = O.keys_of_request(q)
        assert N.name_score(q, label) > 0 and (keys | parts) & O.keys_of_name(label), (q, label)


def test_keys_follow_the_least_score(spark, monkeypatch):
    """Kinds of any least score find what scoring all pairs finds; those of a high one look up few keys, and no table is broadcast (F4, F5)."""
    names = spellings(5, 60) + ["Kariteka Suna", "Kariteka Sunna", "Garideka Suna", "Kraiteka Suna", "Rinka"]
    requests = [*typed(6, names, 30), (901, "call kariteka suna"), (902, "call kriteka suna")]
    labels = [(k, n, str(k)) for k, n in enumerate(names)]
    for least in (0.71, 0.72, 0.75, 0.8, 0.82, 0.85):
        kind = O.Kind(O.CONTACTS.columns, O.CONTACTS.known, O.CONTACTS.asked, O.CONTACTS.score, least)
        assert found(spark, kind, labels, requests, "id long, name string, number string") == by_hand(kind, labels, requests)
    assert not any(k[0] in "e" for k in O.keys_of_name("Kariteka Suna", 0.8)) and 2 * len(O.keys_of_name("Kariteka Suna", 0.8)) < len(O.keys_of_name("Kariteka Suna"))
    rows = O.numbered(spark.createDataFrame(labels, "id long, name string, number string"), O.CONTACTS)
    plan = O.candidates(rows, spark.createDataFrame(requests, "query_id long, text string"), O.CONTACTS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
