"""Registered queries of vocabularies, over documents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from folioquery.functions.pieces import charsmap
from folioquery.operators import vocabulary as V
from folioquery.plans.queries_retrieval import WORDS
from folioquery.plans.registry import query
from folioquery.sources.store import new_folder
from folioquery.sources.tables import table


def plain(first: int = 0xC0, last: int = 0x17F) -> dict[str, str]:
    """Letters with marks and joined letters of a range, by what they decompose into, where that is ASCII."""
    out = {}
    for letter in map(chr, range(first, last + 1)):
        kept = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if kept != letter and kept.isascii():
            out[letter] = kept
    return out


LETTERS = plain() | {"ß": "ss"}
SIGNS = {"!!!": "?", "!!": "!", "...": "…", "\r\n": " ", "\n": " ", "\t": " "}
ONE = {a: b for a, b in LETTERS.items() if len(b) == 1}
SQL_PLAIN = f"translate(coalesce(text, ''), '{''.join(ONE)}', '{''.join(ONE.values())}')"
for _a, _b in {a: b for a, b in LETTERS.items() if len(b) > 1}.items():
    SQL_PLAIN = f"replace({SQL_PLAIN}, '{_a}', '{_b}')"
for _a, _b in SIGNS.items():
    SQL_PLAIN = f"replace({SQL_PLAIN}, {' || '.join(f'chr({ord(c)})' for c in _a)}, '{_b}')"


@query("normalised_texts", f"SELECT doc_id, CASE WHEN t = '' THEN '' ELSE rtrim('▁' || replace(t, ' ', '▁'), '▁') END AS text FROM (SELECT doc_id, trim(regexp_replace({SQL_PLAIN}, ' +', ' ', 'g'), ' ') AS t FROM documents)")
def normalised(spark, sf):
    """Whole texts through a character map: letters without their marks, signs by longest match, blanks as marks of words."""
    return V.normalised(table(spark, sf, "documents", "doc_id", "text"), charsmap(LETTERS | SIGNS))


def vocabulary(spark, sf):
    return V.model(V.counted(table(spark, sf, "documents", "text")), charsmap(LETTERS | SIGNS))


SQL_PIECES = rf"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT {V.MOST_WORDS}),
l AS (SELECT letter, sum(n) AS n FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS letter, n FROM w) GROUP BY letter ORDER BY n DESC, letter LIMIT {V.MOST_LETTERS}),
p AS (SELECT '▁' || word AS piece, CAST(ln(n / (SELECT sum(n) FROM w)) AS FLOAT) AS score FROM w UNION ALL SELECT letter, CAST(ln(n / (SELECT sum(n) FROM l)) - 10 AS FLOAT) FROM l)
SELECT CAST(3 + row_number() OVER (ORDER BY score DESC, piece) AS INTEGER) AS id, piece, round(CAST(score AS DOUBLE), 4) AS score, 1 AS kind FROM p
UNION ALL VALUES (0, '<unk>', 0.0, 2), (1, '<s>', 0.0, 3), (2, '</s>', 0.0, 3), (3, '▁', -20.0, 1)"""


@query("model_pieces", SQL_PIECES)
def pieces(spark, sf):
    """A vocabulary counted from the texts, written to a model file and read from it."""
    place = new_folder(spark, "models")
    V.write_model(spark, vocabulary(spark, sf), f"{place}/words.model")
    return V.read_models(spark, place).select("id", "piece", F.round(F.col("score").cast("double"), 4).alias("score"), "kind")


@query("piece_ids")
def ids(spark, sf):
    """Whole texts as ids of that vocabulary, as an embedding model takes them."""
    return V.ids(table(spark, sf, "documents", "doc_id", "text"), vocabulary(spark, sf)).select("doc_id", F.size("ids").alias("n_given"), F.array_join("ids", " ").alias("ids"), "n_ids")
