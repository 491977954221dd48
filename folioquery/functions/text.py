"""Text functions as columns: words, query terms, snippets."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{Nd}\p{M}\x{200C}\x{200D}]+)"

# Words too common to help keyword ranking.
STOPWORDS = (
    "a", "an", "the", "is", "was", "are", "were", "of", "to", "in", "on", "for", "and", "or", "my", "me", "i",
    "how", "what", "when", "where", "which", "who", "show", "find", "get", "did", "do", "does", "much", "many",
)
# Function and question words of Hindi, Telugu and their spellings in Roman script.
FUNCTION_WORDS = (
    "का", "की", "के", "को", "से", "में", "पर", "है", "हैं", "था", "थी", "थे", "और", "कि", "क्या", "कब", "कहाँ", "कहां", "कितना", "कितनी", "कितने",
    "मेरा", "मेरी", "मेरे", "मुझे", "दिखाओ", "बताओ", "बताइए", "दिखाइए", "कौन", "यह", "वह", "इस", "उस", "एक", "भी", "तो", "ही", "हो", "लिए", "द्वारा",
    "वाला", "वाली", "आया", "गया", "गई", "हुआ", "करना", "करें", "चाहिए", "किया", "पिछले",
    "ఎంత", "ఎప్పుడు", "ఏమిటి", "ఏంటి", "ఎక్కడ", "ఏ", "ఈ", "ఆ", "కి", "కు", "లో", "ని", "ను", "యొక్క", "తో", "నా", "నాకు", "నేను", "ఉంది", "ఉన్నాయి", "ఉన్న",
    "చూపించు", "చెప్పు", "గురించి", "లేదా", "మరియు", "అని", "ఇది", "అది", "ఏది", "ఎవరు", "ఎలా", "ఎన్ని", "కూడా", "చేశాను", "కట్టాను",
    "entha", "enta", "enti", "ekkada", "eppudu", "ela", "emiti", "undi", "unnayi", "ki", "ku", "lo", "ni", "nu", "naa", "naaku", "nenu", "chesanu", "cheyali",
    "kattanu", "kattali", "kosam", "gurinchi", "chupinchu", "cheppu", "ante",
    "kitna", "kitni", "kitne", "kab", "kahan", "kya", "ka", "ke", "ko", "mein", "me", "se", "hai", "hain", "tha", "thi", "the", "aur", "mera", "meri", "mujhe",
    "dikhao", "batao", "aaya", "kiya",
)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(text: Column) -> Column:
    """All words of a text in lower case: letters, digits, combining marks and joiners."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)


def query_terms(text: Column, keep_all: bool = False, extended: bool = False) -> Column:
    """Distinct words of a query in order; ASCII ones that are short or common go, unless keep_all; function words if extended."""
    found = F.array_distinct(words(F.coalesce(text, F.lit(""))))
    if not keep_all:
        found = F.filter(found, lambda w: ~(w.rlike(r"^[\x00-\x7f]*$") & ((F.length(w) < 2) | w.isin(*STOPWORDS))))
    return F.array_except(found, strings(FUNCTION_WORDS)) if extended else found


def clean_lines(text: Column) -> Column:
    """Lines trimmed, inner white space as one blank, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def snippet(text: Column, terms: Column, most: int = 160) -> Column:
    """The line that holds most of the terms (the first in a tie), and the next one if it is short; cut to most characters."""
    lines = F.filter(F.split(text, r"\R"), lambda x: F.trim(x) != "")
    scored = F.transform(lines, lambda x, i: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.lower(x), t))).alias("n"), (-i).alias("at")))
    at = -F.coalesce(F.array_max(scored)["at"], F.lit(0))
    line = F.coalesce(F.get(lines, at), F.lit(""))
    joined = F.when((F.length(line) < most // 2) & F.get(lines, at + 1).isNotNull(), F.concat(line, F.lit(" · "), F.get(lines, at + 1))).otherwise(line)
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most - 1), F.lit("…"))).otherwise(joined)


def highlights(text: Column, terms: Column) -> Column:
    """Where terms stand in a text, each up to the end of its word, as structs of start and end; places that touch are one."""

    def one(t: str, found: list[str]) -> list[dict]:
        spans = sorted(m.span() for w in found if w for m in regex.finditer(regex.escape(w) + r"[\p{L}\p{Nd}\p{M}]*", t, regex.IGNORECASE))
        out: list[list[int]] = []
        for start, end in spans:
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end])
        return [{"start": a, "end": b} for a, b in out]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([one(t or "", [] if f is None else list(f)) for t, f in zip(texts, found)])

    return run(text, terms)


def explanation(shown: Column, spans: Column, keyword_rank: Column, meaning_rank: Column, name: Column, day: Column) -> Column:
    """Why a result was found, in a sentence; at most three distinct words are quoted."""
    found = F.transform(spans, lambda s: F.substring(shown, s["start"] + 1, s["end"] - s["start"]))
    first = F.filter(found, lambda w, i: F.array_position(F.transform(found, F.lower), F.lower(w)) == i + 1)
    quoted = F.array_join(F.transform(F.slice(first, 1, 3), lambda w: F.concat(F.lit("“"), w, F.lit("”"))), ", ")
    noun = F.when(F.contains(F.lower(name), F.lit("screenshot")), "screenshot").otherwise("image")
    where = F.concat(F.lit("your "), noun, F.coalesce(F.concat(F.lit(" from "), F.date_format(day, "d MMM")), F.lit("")))
    words_found = keyword_rank.isNotNull() & (F.size(found) > 0)
    matched = F.concat(F.lit("Matched "), F.when(F.size(found) > 0, quoted).otherwise("your words"), F.lit(" in the text in "), where)
    both = F.concat(matched, F.lit(", and it is close in meaning to your search."))
    meaning = F.concat(F.lit("No exact words matched; the text in "), where, F.lit(" is close in meaning to your search."))
    return F.when(words_found & meaning_rank.isNotNull(), both).when(keyword_rank.isNotNull(), F.concat(matched, F.lit("."))).when(meaning_rank.isNotNull(), meaning).otherwise(F.concat(F.lit("Found in "), where, F.lit(".")))


def shared_text(text: Column, most: int = 300) -> Column:
    """Text handed over by another program: white space collapsed, cut between words; null if empty."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.substring(clean, 1, most)
    short = F.when(F.contains(cut, F.lit(" ")), F.trim(F.regexp_replace(cut, r" [^ ]*$", ""))).otherwise(cut)
    return F.when(clean == "", None).when(F.length(clean) <= most, clean).otherwise(short)
