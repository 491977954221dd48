from folioquery.operators import ingest, ledger, notifications, reading, reminders, retrieval, routing


def payments(spark, rows):
    names = "id item_id outcome direction amount_paise amount_confidence payee upi_id paid_date paid_time reference problem decision"
    kinds = "long long string string long double string string string string string string string".split()
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names.split(), kinds)))


def pay(id_, amount=100, sure=0.9, payee="A", day="2026-09-01", time="10:00", ref=None, outcome="SUCCESS", direction="PAID", problem=None, decision=None):
    return (id_, id_, outcome, direction, amount, sure, payee, None, day, time, ref, problem, decision)


def test_each_payment_is_in_one_bucket(spark):
    rows = [pay(1, ref="X"), pay(2, ref="X", sure=0.95, amount=101), pay(3, sure=0.45, payee="B"), pay(4, sure=0.45, payee="C", decision="INCLUDE"), pay(5, payee="D", decision="EXCLUDE"), pay(6, outcome="FAILED"), pay(7, day=None), pay(8, payee="E", time=None), pay(9, payee="E", time=None)]
    got = {r.id: (r.bucket, r.duplicate_of, r.amounts_differ) for r in ledger.buckets(payments(spark, rows)).collect()}
    assert got[1] == ("DUPLICATE", 2, True) and got[2][0] == "COUNTED"
    assert [got[k][0] for k in range(3, 10)] == ["NEEDS_CHECK", "COUNTED", "EXCLUDED", "NOT_SPENDING", "UNREADABLE", "COUNTED", "COUNTED"]


def test_empty_ledger(spark):
    empty = ledger.buckets(payments(spark, []))
    assert empty.count() == 0 and ledger.month_spine(ledger.month_totals(empty)).count() == 0
    assert ledger.spending_answer(empty).first().total_paise == 0


def test_bm25_of_one_term(spark):
    """100 chunks of 10 words, 5 of which hold the term twice."""
    import math

    rows = [(k, " ".join(["word"] * 8 + ["term"] * 2) if k < 5 else " ".join(["word"] * 10)) for k in range(100)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    found = retrieval.bm25(chunks, spark.createDataFrame([(1, "term")], "query_id long, text string")).collect()
    want = math.log(95.5 / 5.5 + 1) * (2 * 2.2) / (2 + 1.2)
    assert [r.chunk_id for r in found] == [0, 1, 2, 3, 4] and abs(found[0].score - want) < 1e-9


def test_rank_fusion(spark):
    leg = lambda ids: spark.createDataFrame([(1, i, 0.5, k) for k, i in enumerate(ids, 1)], "query_id long, chunk_id long, score double, rank int")
    fused = retrieval.ranked(retrieval.fuse(leg([1, 2, 3]), leg([3, 2, 9])), 9)
    assert [r.chunk_id for r in sorted(fused.collect(), key=lambda r: r.rank)] == [3, 2, 1, 9]


def test_blank_and_stopword_queries(spark):
    chunks = spark.createDataFrame([(0, 0, "the fee")], "chunk_id long, item_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(1, " ", [1.0, 0.0]), (2, "what is the", [1.0, 0.0]), (3, "fee", [0.0, 1.0])], "query_id long, text string, vector array<double>")
    got = {r.query_id: (r.keyword_rank, r.meaning_rank) for r in retrieval.search(chunks, vectors, asked).collect()}
    assert got == {2: (None, 1), 3: (1, 1)}


def test_chunks(spark):
    rows = [(1, "a b\n\n c   d \ne"), (2, ""), (3, None), (4, " ".join(["w"] * 7))]
    got = retrieval.chunk(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3).collect()
    assert sorted((r.item_id, r.ordinal, r.text) for r in got) == [(1, 0, "a b"), (1, 1, "c d\ne"), (4, 0, "w w w"), (4, 1, "w w w"), (4, 2, "w")]


def test_newest_copy_wins(spark):
    rows = [(1, 10, "x", False), (2, 20, "x", False), (3, 30, "x", True), (4, 5, " ", False)]
    got = {r.id: r.status for r in ingest.statuses(spark.createDataFrame(rows, "id long, added_at long, text string, failed boolean")).collect()}
    assert got == {1: "DUPLICATE", 2: "INDEXED", 3: "FAILED", 4: "NO_TEXT"}


def test_decisions_survive(spark):
    old = spark.createDataFrame([(1, 5, "EXCLUDE"), (2, 6, None)], "item_id long, amount long, decision string")
    new = spark.createDataFrame([(1, 7, None), (3, 8, None)], "item_id long, amount long, decision string")
    assert sorted(map(tuple, ingest.replace_payments(old, new).collect())) == [(1, 7, "EXCLUDE"), (2, 6, None), (3, 8, None)]


def test_sensitive_notifications(spark):
    rows = [("Your OTP is 123456", True), ("otp arrived", False), ("call 123456", False), ("आपका कोड 4321", True), ("Pinaka 123456", False)]
    df = spark.createDataFrame(rows, "text string, want boolean")
    from pyspark.sql import functions as F

    assert all(r.want == r.got for r in df.withColumn("got", notifications.sensitive(F.lit(""), F.col("text"))).collect())
    assert notifications.terms(" a bb  cc bb dd ee ff gg") == ["bb", "cc", "dd", "ee", "ff"] and notifications.escape_like("5%_\\") == "5\\%\\_\\\\"


def test_reminders(spark):
    rows = [(1, 1, "a", "Due date", "2026-10-10"), (2, 2, "b", "Due date:", "2026-10-10"), (3, 3, "c", "Due", "2026-10-07T10:00"), (4, 4, "d", "Issued", "2026-10-07"), (5, 5, "e", "Valid till", "--10-08"), (6, 6, "f", "Expiry", "2027-10-08")]
    got = reminders.suggest(spark.createDataFrame(rows, "fact_id long, item_id long, item_name string, label string, value string"), "2026-10-05").collect()
    assert [(r.fact_id, r.days_away) for r in got] == [(1, 5)]


def test_readings(spark):
    rows = [("a", [("one", 0.9), ("two", 0.4), (" ", 0.9)]), ("b", [])]
    got = reading.confident_lines(spark.createDataFrame(rows, "uri string, lines array<struct<text:string,confidence:double>>")).collect()
    assert {r.uri: (r.text, r.confidence, r.dropped_lines) for r in got} == {"a": ("one", 0.9, 2), "b": ("", 0.0, 0)}


def test_plans_for_facts(spark):
    rows = [(1, "DATE", "--10-01", 0.9), (2, "DATE", "2026-10-07T18:00", 0.5), (3, "PHONE", "+919876543210", 0.9), (4, "ADDRESS", "Main Road", 0.8)]
    got = routing.actions(spark.createDataFrame(rows, "fact_id long, kind string, value string, confidence double"), "2026-10-05").collect()
    made = {(r.fact_id, r.action): (r.target, r.note, r.low_confidence) for r in got}
    assert made[1, "CALENDAR"] == ("2027-10-01/all-day", "year not read", True) and made[2, "CALENDAR"] == ("2026-10-07T18:00/1h", "low confidence", True)
    assert made[3, "CALL"][0] == "tel:+919876543210" and made[4, "MAPS"][0] == "geo:0,0?q=Main+Road" and sum(a == "SHARE" for _, a in made) == 4


def test_calendar_times_don_t_depend_on_the_session(spark):
    """Whole days in UTC, hours in the event's zone (with its summer time), days without a year as the next ones."""
    import datetime as d
    from zoneinfo import ZoneInfo

    values = ["2026-10-05", "2026-10-05T18:45", "2026-07-01T00:00", "--02-29", "--10-04T09:00", "--10-05", "2026-02-30", "2026-10-05T25:00", "no day", None]
    facts = spark.createDataFrame(list(enumerate(values)), "fact_id int, value string")
    at = lambda *x, zone="UTC": int(d.datetime(*x, tzinfo=ZoneInfo(zone)).timestamp() * 1000)
    zone = "Europe/Berlin"
    want = {0: (True, at(2026, 10, 5)), 1: (False, at(2026, 10, 5, 18, 45, zone=zone)), 2: (False, at(2026, 7, 1, zone=zone)), 3: (True, at(2028, 2, 29)), 4: (False, at(2027, 10, 4, 9, zone=zone)), 5: (True, at(2026, 10, 5))}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session)
            got = {r.fact_id: (r.all_day, r.begin_ms, r.end_ms) for r in routing.calendar_times(facts, "2026-10-05", zone).collect()}
            assert got == {k: (day, begin, begin + (86_400_000 if day else 3_600_000)) for k, (day, begin) in want.items()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
