"""Notification history: what is kept, how it is searched, how long it stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CHARS, MOST_TERMS, RESULTS = 1000, 5, 40
# Categories of notifications that aren't kept, and words that go with one-time codes.
SKIPPED = ("progress", "service", "transport", "call", "alarm", "navigation", "sys", "err", "stopwatch", "status")
CODE_WORDS = "otp|one[- ]time|verification|passcode|password|cvv|pin|security code|login code|code is|कोड|ओटीपी|పాస్‌వర్డ్|ఓటీపీ"


def clean(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, MOST_CHARS)


def sensitive(title: Column, text: Column) -> Column:
    """A code word and a run of 4 to 8 digits in one message."""
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return whole.rlike(rf"(?iu)(?<![\p{{L}}\p{{M}}\p{{N}}])({CODE_WORDS})(?![\p{{L}}\p{{M}}\p{{N}}])") & whole.rlike(r"(?<![0-9])[0-9]{4,8}(?![0-9])")


def kept(rows: DataFrame, own_package: str) -> DataFrame:
    """rows(package, title, text, ongoing, group_summary, category, ...) that belong in the history, cleaned."""
    rows = rows.withColumns({"title": clean(F.col("title")), "text": clean(F.col("text"))})
    quiet = F.col("ongoing") | F.col("group_summary") | F.coalesce(F.col("category").isin(*SKIPPED), F.lit(False))
    blank = (F.col("title") == "") & (F.col("text") == "")
    return rows.where((F.col("package") != own_package) & ~quiet & ~blank & ~sensitive(F.col("title"), F.col("text")))


def terms(text: str) -> list[str]:
    """Words of two letters or more, each once, the first MOST_TERMS."""
    return list(dict.fromkeys(w for w in text.split() if len(w) >= 2))[:MOST_TERMS]


def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def holds(column: str, term: str) -> Column:
    """Whether a column holds a term as it stands, by a pattern in which the term's own signs mean nothing; sources that take patterns can be asked for it."""
    return F.call_function("like", F.col(column), F.lit(f"%{escape_like(term)}%"))


def search(rows: DataFrame, text: str, limit: int = RESULTS) -> DataFrame:
    """The newest rows that hold every term in app_label, title or text; upper and lower case of A-Z are alike."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for term in terms(text):
        own = fold(F.lit(term))
        rows = rows.where(F.contains(fold(F.col("title")), own) | F.contains(fold(F.col("text")), own) | F.contains(fold(F.col("app_label")), own))
    return rows.orderBy(F.desc("posted_at"), F.desc("id")).limit(limit)
