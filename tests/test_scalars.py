from datetime import date
from decimal import Decimal

import pytest

from folioquery.functions import names
from folioquery.functions.calc import command, evaluate

TODAY = date(2026, 10, 5)


@pytest.mark.parametrize(
    ("text", "shown"),
    [("2+3*4", "14"), ("-2^2", "4"), ("2^3^2", "512"), ("4500 + 18%", "5,310"), ("50% + 10%", "0.6"), ("10% of 20% of 50000", "1,000"), ("100 / 4", "25"), ("45 x 3", "135"), ("two hundred and fifty plus 3", "253"), ("डेढ़ लाख", "1,50,000"),
     ("5%", None), ("12", None), ("040-23456789", None), ("12/09/2026", None), ("3 of 4", None), ("2 +", None), ("photos", None), ("", None), ("in 2 weeks", "Mon 19 Oct 2026"), ("31 jan 2026 + 1 month", "Sat 28 Feb 2026"), ("days between 1 jan 2026 and 1 feb 2026", "31 days"),
     ("1 gb in mb", "1,024 MB"), ("0 c to f", "32 °F"), ("10 usd to inr", "835 INR"), ("835 inr to usd", "10 USD")],
)
def test_evaluate(text, shown):
    found = evaluate(text, TODAY, {("USD", "INR"): (Decimal("83.5"), date(2026, 10, 1))})
    assert (found and found.primary) == shown


def test_failures():
    assert evaluate("1 / 0", TODAY).kind == "FAILED"
    assert evaluate("5 kg in m", TODAY).kind == "FAILED"
    assert evaluate("10 usd to eur", TODAY).kind == "FAILED"
    assert evaluate("1 usd = 83.5 inr", TODAY).kind == "RATE_PROPOSAL"


def test_commands():
    assert command("set alarm 7") == [("ALARM", 420), ("ALARM", 1140)]
    assert command("wake me up alarm 0:30") == [("ALARM", 30)]
    assert command("alarm 12 am") == [("ALARM", 0)]
    assert command("timer 10") == [] and command("alarm 25") == [] and command("alarm clock shop") == []
    assert command("timer 25 hours") == []


def test_names():
    assert names.distance("ca", "abc") == 3
    assert names.distance("whatsapp", "whatsap") == 1 and names.distance("ab", "ba") == 1
    assert names.name_score("google pay", "Google Pay") == 1.0
    assert names.name_score("vatsap", "WhatsApp") == 0.82
    assert names.name_score("lakshmi", "లక్ష్మి") == 0.82
    assert names.app_score("open gpay", "Google Pay", "com.pay") == 1.0
    assert names.contact_score("call amma", "Mom") == 1.0 and names.contact_score("call amma", "Mohan") == 0.0


def test_functions_in_sql(spark):
    from folioquery.operators import scalars
    from folioquery.plans.deploy import ship

    ship(spark)
    scalars.register(spark)
    row = spark.sql("SELECT name_score('gogle', 'Google') AS a, sound_key('phone') AS b, fact_values('Rs 500 on 1/2/2026') AS c").first()
    assert (row.a, row.b, sorted(row.c)) == (0.8, "pn", ["AMOUNT:500", "DATE:2026-02-01"])


def test_patterns_are_compiled_once(monkeypatch):
    """A text costs no look-up in the cache of patterns, which took most of its time (F13)."""
    from regex import _main

    evaluate("3 + 4 x 2", date(2026, 10, 5), {})
    monkeypatch.setattr(_main, "_compile", lambda *a, **k: 1 / 0)
    assert evaluate("30 + 4 x 2", date(2026, 10, 5), {}).primary == "38"
