from folioquery.functions.facts import ascii_digits, read_facts, read_payment, repair


def values(text, kind, **more):
    return [(f.value, f.confidence) for f in read_facts(text, **more) if f.kind == kind]


def test_amounts():
    assert values("Total: ₹1,25,000", "AMOUNT") == [("125000", 0.9)]
    assert values("Paid 45,000.50 rupees", "AMOUNT") == [("45000.5", 0.85)]
    assert values("Amount: 2500", "AMOUNT") == [("2500", 0.7)]
    assert values("Paid to\n2,499", "AMOUNT") == [("2499", 0.45)]
    assert values("Transaction ID: 123456789", "AMOUNT") == []
    assert values("Rs 0", "AMOUNT") == [] and values("Rs 999999999999", "AMOUNT") == []


def test_digits_of_other_scripts():
    assert ascii_digits("१२३ ౪౫ 1२") == "123 45 1२"
    assert values("₹१,२३४", "AMOUNT") == [("1234", 0.9)]
    assert repair("Rs 1,2৪5") == "Rs 1,285" and repair("a৪5") == "a৪5"
    assert values("Rs 1,2৪5", "AMOUNT") == [("1285", 0.55)]


def test_dates():
    assert values("Date: 12/09/2026", "DATE") == [("2026-09-12", 0.85)]
    assert values("09/25/2026", "DATE") == [("2026-09-25", 0.6)]
    assert values("20 Sep 2026, 6:45 PM", "DATE") == [("2026-09-20T18:45", 0.9)]
    assert values("September 12, 2026", "DATE") == [("2026-09-12", 0.9)]
    assert values("12 सितंबर 2026", "DATE") == [("2026-09-12", 0.9)]
    assert values("29 Feb", "DATE") == [("--02-29", 0.5)]
    assert values("31/02/2026", "DATE") == []


def test_phones_and_addresses():
    assert values("Mobile: 98765 43210", "PHONE") == [("+919876543210", 0.9)]
    assert values("Order no: 9876543210", "PHONE") == []
    assert values("1800 123 4567", "PHONE") == [("18001234567", 0.7)]
    assert values("Address: 12 Main Road\nHyderabad\nPhone: 1", "ADDRESS") == [("12 Main Road, Hyderabad", 0.8)]
    assert values("Flat 5\nKondapur\nHyderabad 500084", "ADDRESS") == [("Flat 5, Kondapur, Hyderabad 500084", 0.6)]
    assert values("500081", "ADDRESS") == []


def test_payment():
    text = "PhonePe\nPayment successful\n₹2,499\nPaid to\nAnanda Stores\nUTR: 412345678901\n3 Oct 2026, 6:45 PM\nCashback ₹20"
    p = read_payment(text)
    assert (p["app"], p["outcome"], p["direction"], p["amount_paise"], p["payee"], p["reference"], p["paid_date"], p["paid_time"], p["problem"]) == ("PhonePe", "SUCCESS", "PAID", 249900, "Ananda Stores", "412345678901", "2026-10-03", "18:45", None)
    assert read_payment("Fee receipt\nAmount: Rs 500") is None
    assert read_payment("Google Pay\nPaid to Ravi\nRs 10")["problem"] == "date not read"
    assert read_payment("") is None


def test_lines_without_foreign_digits_are_not_rewritten(monkeypatch):
    """Most lines have neither foreign digits nor look-alikes, and come through as they are (F10, F11, F12)."""
    from folioquery.functions import facts as own

    class No:
        def sub(self, *args):
            raise AssertionError

    assert own.ascii_digits("१२ and 1२") == "12 and 1२" and own.repair("₹1৪0") == "₹180"
    monkeypatch.setattr(own, "DIGIT_RUN", No())
    monkeypatch.setattr(own, "REPAIR_RUN", No())
    assert [f.value for f in own.read_facts("Amount: ₹1,250.50\nphone 98765 43210")] == ["1250.5", "+919876543210"]


TEXTS = [
    "Amount: ₹1250", "Amount: ₹12৪০", "Amount: ₹125৯", "Paid\n21250", "Amount: none", "Total\n1250", "Rs 1,2৪5 and 300 rupees", "Total: 12 Mar 1999 45৪০", "Phone: 98765 43210\nAmount: 98৪5 43210",
    "UTR: 412345678901\n₹2,499\n3 Oct 2026, 6:45 PM", "5 9876543210 Mar 2020", "  two  blanks 12/09/2026 \r\n\n₹१,२३४\x85Flat 5\nKondapur\nHyderabad 500084", "Address: 12 Main Road\nHyderabad", "", " \n ",
]
MODES = ["OFF", "LOOKALIKE", "GUARD", "ALTERNATIVE"]


def test_modes_and_kinds_of_one_reading():
    """All modes at once, and some kinds only, give what is read mode by mode and kept of those kinds (F1, F2)."""
    from folioquery.functions.facts import KINDS, read_modes

    for text in TEXTS:
        each = [read_facts(text, mode) for mode in MODES]
        assert read_modes(text, MODES) == each
        for kinds in [*[(k,) for k in KINDS], ("DATE", "PHONE")]:
            assert read_modes(text, MODES, kinds) == [[f for f in found if f.kind in kinds] for found in each]
    assert values("Amount: ₹125৯", "AMOUNT", mode="GUARD") == [("125", 0.3)] and values("Paid\n21250", "AMOUNT", mode="ALTERNATIVE") == [("21250", 0.45), ("1250", 0.4)]
    assert values("5 9876543210 Mar 2020", "DATE") == [("2020-03-05", 0.9)]  # what a phone number leaves blank


def test_amounts_of_all_modes_are_read_once(spark):
    """A row for each row, its other columns kept; one pass of Python over the texts, whatever the number of modes (F1)."""
    from folioquery.operators import evaluation as E
    from folioquery.operators import facts as X

    rows = [(k // 2, "1250" if k % 3 else None, text) for k, text in enumerate([*TEXTS, None])]  # ids come twice
    read = X.amounts(spark.createDataFrame(rows, "item_id long, true_value string, text string"), MODES)
    own = sorted(((r.item_id, r.true_value, [(x.value, x.confidence, x.every) for x in r.readings]) for r in read.collect()), key=str)
    wanted = []
    for item, true, text in rows:
        found = [[f for f in read_facts(text or "", mode) if f.kind == "AMOUNT"] for mode in MODES]
        tops = [min(x, key=lambda f: (-f.confidence, f.line), default=None) for x in found]
        wanted.append((item, true, [(t and t.value, t and t.confidence, [f.value for f in x]) for t, x in zip(tops, found)]))
    assert own == sorted(wanted, key=str)
    out = E.amount_outcomes(E.judged_amounts(read, MODES))
    assert {r["mode"]: r["items"] for r in out.collect()} == dict.fromkeys(MODES, len(rows))


def test_amount_outcomes_reads_in_one_pass(spark, sf):
    import __spark_entry__

    plan = __spark_entry__.queries()["amount_outcomes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_dates_alone_are_read_without_the_rest(monkeypatch):
    """Lines that can't hold a date are left alone, amounts and addresses aren't looked for (F2)."""
    from folioquery.functions import facts as own

    text = "PhonePe\nPayment successful\n₹2,499\nUTR: 412345678901\n3 Oct 2026, 6:45 PM\nHyderabad 500084"
    lines = []
    monkeypatch.setattr(own, "Line", lambda k, *rest, kind=own.Line: lines.append(k) or kind(k, *rest))
    monkeypatch.setattr(own, "addresses", None)
    monkeypatch.setattr(own.Line, "amounts", None, raising=False)
    assert [(f.value, f.line) for f in own.read_facts(text, kinds=("DATE",))] == [("2026-10-03T18:45", 4)] and lines == [4]
