"""URL filters: rules on hosts and paths, and for all other URLs a logistic regression on hashed character n-grams.

The classifier is trained in numpy from a small table of labelled URLs. Its features are the character n-grams of the host,
with marks at its ends, and of each part of the path, hashed; those of host and path are told apart. URLs are judged where
they are read, without a shuffle, a distinct host and path once for each batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.shared import struct

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
BITS, SIZES = 16, (3, 4, 5, 6)
STEPS, RATE, RIDGE, THRESHOLD = 300, 0.5, 2e-6, 0.5
#: Rows of the labelled table that are fitted on at most; of a larger one, those of the least hashes.
MOST_LABELLED = 20_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("org", "/", ALLOW),
    Rule("example.org", "/es/", BLOCK),
    Rule("example.org", "/en/1", BLOCK),
    Rule("com", "/fr/", ALLOW),
    Rule("com", "/de/", BLOCK),
)

#: Words of hosts that a labelled URL is blocked or allowed for, and what hosts and paths of both kinds are made with.
BLOCKED_WORDS = (
    "casino poker jackpot slots roulette blackjack gambling betting bets wager lottery bingo "
    "pills pharmacy viagra cialis steroids meds-online weightloss "
    "spam linkfarm phish malware trojan warez cracked keygen torrent piracy scam free-money replica "
    "adult porn xxx sex nude escort webcam-girls hentai fetish "
    "ads adserver ad-click banner tracker tracking pixel popup telemetry clickbait affiliate "
    "payday quick-loan get-rich miracle-cure"
).split()
ALLOWED_WORDS = (
    "news weather library museum school university college science history nature garden travel kitchen recipes cooking "
    "music theatre cinema books poetry writing language grammar dictionary maps geography city council village harbour "
    "health hospital doctor clinic research journal physics chemistry biology maths statistics software python code data "
    "football tennis running cycling climbing swimming photo camera design art craft wood garage repair energy climate "
    "water forest river mountain island animals birds insects farming market economy finance banking insurance law justice "
    "parliament election letters radio magazine archive forum wiki blog notes diary family children parents pets "
    "station theory motor paper street bridge tower castle church temple window kitchenware textile furniture transport"
).split()
COMPANIONS = "center world online daily club house hub zone point place group team shop now today north south".split()
FRONTS, SUFFIXES, LANGS = ("", "www.", "m.", "blog."), ("com", "net", "org", "example.com", "example.net", "example.org"), ("en", "de", "fr", "es")


def labelled_urls() -> list[tuple[str, str]]:
    """(url, verdict), made by a rule: each word alone, and with companions before or behind it, on hosts and paths that don't depend on the verdict."""
    out = []
    for words, verdict in ((BLOCKED_WORDS, BLOCK), (ALLOWED_WORDS, ALLOW)):
        for k, word in enumerate(words):
            for j in range(12):
                n = 7 * k + 5 * j
                mate = COMPANIONS[(3 * k + j) % len(COMPANIONS)]
                name = (word, f"{word}-{mate}", f"{mate}-{word}", f"{word}{mate}", f"{mate}{word}", word)[j % 6]
                out.append((f"https://{FRONTS[n % len(FRONTS)]}{name}.{SUFFIXES[(k + j) % len(SUFFIXES)]}/{LANGS[(k + 2 * j) % len(LANGS)]}/{(37 * k + 411 * j) % 1000}", verdict))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path of a URL; both are empty if it is null or has no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of name and verdict, else null; of equally long ones that of the longer host, then of the earlier name."""
    out = F.lit(None).cast("struct<name: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), [-ord(c) for c in r.name])):  # the last that fits decides
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of a host, its parts marked at both ends by dots, and of a path; each once."""
    out = set()
    for mark, text in (("h", f".{host}."), ("p", path)):
        for n in SIZES:
            out.update(f"{mark}{text[k : k + n]}" for k in range(len(text) - n + 1))
    return np.fromiter({zlib.crc32(g.encode("utf-8", "replace")) >> (32 - BITS) for g in out}, np.int64)


def fit(rows: list[tuple[str, str, bool]]) -> np.ndarray:
    """Weights of all hashed n-grams, and the intercept, of a logistic regression, by Adam; rows: (host, path, whether it is blocked)."""
    w = np.zeros((1 << BITS) + 1)
    features = [grams(h, p) for h, p, _ in rows]
    row, column = np.repeat(np.arange(len(rows)), list(map(len, features))), np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    scale = 1 / np.sqrt(np.maximum(1, np.fromiter(map(len, features), np.int64, len(rows))))
    y = np.array([b for *_, b in rows], float)
    if not 0 < y.sum() < len(y):  # no label, or only one kind
        w[-1] = 10.0 if len(y) and y[0] else -10.0
        return w
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = np.bincount(row, w[column], len(rows)) * scale + w[-1]
        pull = (1 / (1 + np.exp(-g)) - y) / len(y)
        slope = np.append(np.bincount(column, (pull * scale)[row], 1 << BITS), pull.sum())
        slope[:-1] += RIDGE * w[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w = w - RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def train(labelled: DataFrame) -> np.ndarray:
    """The classifier fitted to labelled(url, verdict, ...): rows of other verdicts than allow and block are left out; a URL counts once for each verdict."""
    host, path = parts(F.col("url").cast("string"))
    known = labelled.where(F.col("verdict").isin(ALLOW, BLOCK)).select(host.alias("host"), path.alias("path"), (F.col("verdict") == BLOCK).alias("blocked")).distinct()
    few = known.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(MOST_LABELLED).collect()
    return fit([tuple(r) for r in few])


def scored(w: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The probability of each URL to be a blocked one."""
    found = [grams(h, p) for h, p in zip(hosts, paths)]
    g = np.array([w[f].sum() / np.sqrt(max(1, len(f))) for f in found]) + w[-1]
    return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judges every url of pages(page_id, url, ...): page_id, host, path, rule, verdict, score.

    A rule fits its host and all subdomains of it if the path starts with the rule's; the longest decides. Without a rule
    (null) the classifier does, which is fitted to labelled(url, verdict), or else to labelled_urls(); score is what it says
    of every row, the probability of a blocked URL. A null URL, or one without `://`, has an empty host and path and is
    judged like any other. Rows that repeat are judged each; other columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    w = train(spark.createDataFrame(labelled_urls(), "url string, verdict string") if labelled is None else labelled)
    some = np.flatnonzero(w)
    model = some.astype(np.int32), w[some]
    host, path = parts(F.col("url").cast("string"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    own = own.withColumn("fitting", rule_of(F.col("host"), F.col("path"), rules))
    own = own.select("page_id", "host", "path", F.col("fitting.name").alias("rule"), F.col("fitting.verdict").alias("verdict"))
    kind = struct(page_id="long", host="string", path="string", rule="string", verdict="string", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << BITS) + 1)
        weights[model[0]] = model[1]
        for batch in batches:
            urls = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            distinct = list(dict.fromkeys(urls))
            found = dict(zip(distinct, scored(weights, [h for h, _ in distinct], [p for _, p in distinct]).tolist()))
            score = [found[u] for u in urls]
            verdict = [v or (BLOCK if s >= THRESHOLD else ALLOW) for v, s in zip(batch.column(4).to_pylist(), score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=kind.names)

    return own.mapInArrow(run, kind)
