"""Fuzzy search of names: apps, contacts and settings by typed requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions import names as N
from folioquery.operators.requests import SETTINGS_NOISE
from folioquery.sources.store import new_folder, spread

#: Letters of pieces of a name: a request looks up one of its longest; edits at most between names that match.
PIECES, EDITS = (3, 6, 12), 2
#: Confusable sounds as one: what sounds alike by half an edit is equal then, so that only whole edits are left.
ALIKE = str.maketrans("gjcsdb", "kkkktp")


@dataclass(frozen=True)
class Kind:
    """What is searched for: the columns of a label, the names in them, the names asked for in a request, a pair's score and the least one that counts."""

    columns: list[str]
    known: Callable[..., list[str]]
    asked: Callable[[str], list[str]]
    score: Callable[..., float]
    least: float


def deletions(text: str, edits: int) -> set[str]:
    """text, and what is left of it without so many letters: two texts within as many edits share one of these."""
    out = new = {text}
    for _ in range(edits):
        new = {t[:k] + t[k + 1 :] for t in new for k in range(len(t))}
        out = out | new
    return out


def edits_of(length: int, whole: int) -> int:
    """How many edits a text of that length can be away from one that it matches; the whole name's length, or else the other text's, decides."""
    return 2 if whole >= 8 or length >= 6 else 1 if whole >= 4 or length >= 3 else 0


def spelt(name: str) -> tuple[str, set[str]]:
    """A name as it is compared, and with its parts."""
    whole = N.normal(name.lower())
    return whole, {x for x in (whole, *N.name_parts(name.lower())) if x}


def pieces(text: str, size: int) -> set[str]:
    return {text[k : k + size] for k in range(len(text) - size + 1)}


def edits_for(least: float) -> int:
    """How many edits between spellings can score least: the scores of N.text_score()."""
    return 0 if least > 0.8 + NEARLY else 1 if least > 0.75 + NEARLY else EDITS


#: The best scores of N.key_score(): of equal sounds, and of other ones.
SAME_SOUNDS, LIKE_SOUNDS, NEARLY = 0.82, 0.74, 1e-9


def keys_of_name(name: str, least: float = 0.0) -> set[str]:
    """Under which keys a label's name is found: one of them is among keys_of_request(), or is the request's rarest piece, if the pair scores least at all."""
    whole, texts = spelt(name)
    most = edits_for(least)
    out = {f"2{x[:2]}" for x in texts if len(x) >= 2} | {f"3{x}" for n in PIECES for x in pieces(whole, n)} | {f"d{x}" for t in texts for x in deletions(t, min(most, edits_of(len(t), len(whole))))}
    if least > SAME_SOUNDS + NEARLY:
        return out
    sounds = {k for x in (name.lower(), *texts) if len(k := N.sound_key(x)) >= 2}
    if least > LIKE_SOUNDS + NEARLY:
        return out | {f"s{k}" for k in sounds}
    return out | {f"s{k[:n]}" for k in sounds for n in range(3, len(k) + 1)} | {f"e{x}" for k in sounds for x in deletions(k.translate(ALIKE), edits_of(len(k), 0))}


def keys_of_request(name: str, least: float = 0.0) -> tuple[set[str], set[str]]:
    """(keys to look up, pieces of which the rarest has to be looked up)"""
    whole, own = N.normal(name.lower()), N.sound_key(name.lower())
    if len(whole) < 2 and len(own) < 3:
        return set(), set()
    out = {f"d{x}" for x in deletions(whole, edits_for(least))} | ({f"2{whole}"} if len(whole) == 2 else set())
    if len(own) >= 3 and least <= SAME_SOUNDS + NEARLY:
        out |= {f"s{own}"}
        if least <= LIKE_SOUNDS + NEARLY:
            out |= {f"e{x}" for x in deletions(own.translate(ALIKE), edits_of(len(own), 0))}
    return out, {f"3{x}" for x in pieces(whole, max((n for n in PIECES if n <= len(whole)), default=PIECES[0]))}


def hashed(key: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)


def numbered(labels: DataFrame, kind: Kind) -> DataFrame:
    """The labels as a table in the shared folder, with a number for each row."""
    place = new_folder(labels.sparkSession, "labels")
    labels.select(*kind.columns).withColumn("_row", F.monotonically_increasing_id()).write.parquet(place)
    return labels.sparkSession.read.parquet(place)


def sent(rows: DataFrame) -> DataFrame:
    """rows as the side of a join that is shuffled and never broadcast: a name has hundreds of keys, which Spark takes for one row."""
    return rows.hint("merge")


def candidates(rows: DataFrame, asked: DataFrame, kind: Kind) -> DataFrame:
    """(query_id, _row) of all pairs of asked(query_id, text) and numbered labels that could score, found by equal keys.

    Two names that are a few edits apart are equal once some letters are left out of either, and a name in a longer one has
    all its pieces there, of which the one that fewest labels have is looked up. Sounds are looked up likewise.
    """

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = [], []
            for number, *values in zip(*(c.to_pylist() for c in batch.columns)):
                own = {hashed(k) for name in kind.known(*values) for k in keys_of_name(name or "", kind.least)}
                key += own
                row += [number] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(row, pa.int64())], names=["key", "_row"])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for place, name in enumerate(kind.asked(text or "")):
                    keys, parts = keys_of_request(name, kind.least)
                    out += [(query_id, place, hashed(k), False) for k in keys] + [(query_id, place, hashed(k), True) for k in parts]
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query_id", "place", "key", "piece"])

    own = spread(rows.select("_row", *kind.columns)).mapInArrow(known, "key long, _row long")
    keys = spread(asked.select(F.col("query_id").cast("long"), F.col("text").cast("string"))).mapInArrow(wanted, "query_id long, place int, key long, piece boolean")
    parts = keys.where("piece")
    held = own.join(sent(parts.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    rarest = parts.join(sent(held), "key", "left").groupBy("query_id", "place").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))["key"].alias("key"))
    asked_keys = keys.where("NOT piece").select("query_id", "key").unionByName(rarest.select("query_id", "key")).distinct()
    return own.join(sent(asked_keys), "key").select("query_id", "_row").distinct()


def scored(labels: DataFrame, requests: DataFrame | list[tuple[int, str]], kind: Kind) -> DataFrame:
    """query_id, score and the columns of labels that score least or more for one of requests(query_id, text); only candidates are scored."""
    spark = labels.sparkSession
    asked = spark.createDataFrame(requests, "query_id long, text string") if isinstance(requests, list) else requests.select(F.col("query_id").cast("long"), F.col("text").cast("string"))
    rows = numbered(labels, kind)
    pairs = candidates(rows, asked, kind).join(sent(asked.withColumnRenamed("text", "_text")), "query_id").join(sent(rows), "_row").select("query_id", "_text", *kind.columns)
    schema = pairs.select("query_id", F.lit(0.0).alias("score"), *kind.columns).schema

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*(c.to_pylist() for c in batch.columns[1:]))
            score = pa.array([kind.score(text, *own) for text, *own in values], pa.float64())
            out = pa.RecordBatch.from_arrays([batch.column(0), score, *batch.columns[2:]], names=schema.names)
            yield out.filter(pc.greater_equal(score, kind.least - 1e-12))

    return pairs.mapInArrow(hits, schema)


def best(hits: DataFrame, limit: int, *ties: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *ties)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def app_names(text: str) -> list[str]:
    name = N.asked_name(text, N.APP_NOISE)
    return [] if name is None else [N.APP_ALIASES.get(name, name)]


def contact_names(text: str) -> list[str]:
    """The name, or all names of its group."""
    name = N.asked_name(text, N.CONTACT_NOISE)
    return [] if name is None or len(name) < 3 else list(next((g for g in N.NICKNAMES if name in g), (name,)))


def setting_name(text: str) -> str | None:
    """What is left without the words around a name: at most three words, two letters at least."""
    kept = [w for w in (text or "").lower().split() if w not in SETTINGS_NOISE]
    name = " ".join(kept)
    return name if 0 < len(kept) <= 3 and len(text) <= 40 and len(name) >= 2 else None


def setting_score(text: str, label: str, action: str, known: list[str]) -> float:
    """Under four letters it has to be a name as it stands."""
    name = setting_name(text)
    best = max((N.name_score(name, x) for x in known or []), default=0.0) if name else 0.0
    return best if name and len(name) >= 4 else float(best >= 1.0)


APPS = Kind(["label", "package", "component"], lambda label, package, _: [label or "", (package or "").rsplit(".", 1)[-1]], app_names, lambda q, label, package, _: N.app_score(q, label or "", package or ""), 0.7)
CONTACTS = Kind(["id", "name", "number"], lambda _, name, __: [name], contact_names, lambda q, _, name, __: N.contact_score(q, name), 0.8)
SETTINGS = Kind(["label", "action", "names"], lambda label, action, names: names or [], lambda text: [n] if (n := setting_name(text)) else [], setting_score, 0.85)


def search_apps(apps: DataFrame, requests: DataFrame | list[tuple[int, str]], limit: int = 4, own: str | None = None) -> DataFrame:
    """apps(label, package, component), each component once; own: the package that asks, which isn't found."""
    apps = apps.where(~F.col("package").eqNullSafe(F.lit(own))) if own is not None else apps
    return best(scored(apps.dropDuplicates(["component"]), requests, APPS), limit, "label", "component")


def search_contacts(contacts: DataFrame, requests: DataFrame | list[tuple[int, str]], limit: int = 4) -> DataFrame:
    """contacts(id, name, number); of equal id and last ten digits the best name counts."""
    hits = scored(contacts.dropna(subset=["name", "number"]), requests, CONTACTS)
    tail = F.substring(F.regexp_replace("number", "[^0-9]", ""), -10, 10)
    one = Window.partitionBy("query_id", "id", tail).orderBy(F.desc("score"), "name")
    return best(hits.withColumn("one", F.row_number().over(one)).where("one = 1").drop("one"), limit, "name", "id")


def search_settings(settings: DataFrame, requests: DataFrame | list[tuple[int, str]], limit: int = 2) -> DataFrame:
    """settings(label, action, names): words around a name don't count."""
    return best(scored(settings, requests, SETTINGS), limit, "label")
