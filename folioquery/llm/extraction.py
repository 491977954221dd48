"""Main text of web pages: nearest-URL page differencing, helped by the page's structure.

Pages stand in the order of host and URL path, dealt out by ranges, so that a host of any size spreads over many tasks. The
nearest page of a page is, of the host's pages that are no copies of it, the one whose path shares the longest beginning with
its own; in that order it is the last one before it or the first one after it (the one before, in a tie). The text lines of
both are aligned by longest common subsequence, and lines that both have are deleted - save those that the markup itself
marks as the article, for neighbours are often copies in part or quote one another. What the markup marks as no article goes
besides, and so do all other lines of a page that marks its article.

A first pass over the same ranges finds the nearest pages that lie across a range's borders, wherever they are; they are read
beside the range's own pages. So each page has the same neighbour in any number of ranges.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.pretok import texts_of
from folioquery.llm.shared import struct

# Elements of HTML by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
APART = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "math", "object", "audio", "video", "canvas", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
# Whole names in class, id and role that mark what is no article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "reply", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def marked(attributes: str) -> bool:
    return any(w in MARKS for v in NAMED.findall(attributes) for w in v.strip("\"'").lower().split())


Block = tuple[str, bool, bool]


def blocks(page: str) -> list[Block]:
    """(text, whether it stands in the article's own element, whether the markup marks it as something else) of each block.

    Marks give way where they would leave out the only article, or all there is.
    """
    out = parsed(page, 0)
    if not any(inside for _, inside, _ in out):
        wrapped = parsed(page, 1)
        if any(inside for _, inside, _ in wrapped):
            return wrapped
    return out if any(not other for _, _, other in out) else parsed(page, 2)


def parsed(page: str, least: int) -> list[Block]:
    """blocks(), with all marks (0), with those of elements that hold no article or main (1), or without marks (2)."""
    out: list[Block] = []
    held: list[str] = []
    aside: list[str] = []  # text that is left out
    open_: list[tuple[str, bool, bool, bool]] = []  # element, whether it is left out, whether it is of the article, whether a mark leaves it out
    out_of, of = 0, 0
    at = 0

    def end_block() -> None:
        for part, other in ((held, False), (aside, True)):
            if part and (other or not out_of):
                if text := " ".join(html.unescape("".join(part)).split()):
                    out.append((text, of > 0 and not other, other))
                part.clear()

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            (aside if out_of else held).append(page[at:])
            break
        if m.start() > at:
            (aside if out_of else held).append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name not in INLINE:
            end_block()
        if m[1]:
            if any(x[0] == name for x in open_):
                while open_:
                    x = open_.pop()
                    out_of -= x[1]
                    of -= x[2]
                    if x[0] == name:
                        break
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            apart = name in APART or name == "header" and not of
            # In an article, marks on its paragraphs and words say what they are about.
            can_be = least < 2 and name not in MAIN and name not in ("html", "body") and not (of and (name in INLINE or name == "p"))
            by_mark = not apart and can_be and bool(m[3]) and marked(m[3])
            left_out = apart or by_mark
            if name in MAIN and least == 1 and out_of:  # what is around it is left out no more, if a mark did that
                open_[:] = [(x[0], x[1] and not x[3], x[2], x[3]) for x in open_]
                out_of = sum(x[1] for x in open_)
            if left_out or name in MAIN or name not in INLINE and name not in ("p", "li", "br"):
                open_.append((name, left_out, name in MAIN and not out_of, by_mark))
                out_of += left_out
                of += open_[-1][2]
    out_of = 0  # what was never closed
    end_block()
    return out


#: Bits of the rows that an alignment holds for its way back; longer texts are aligned in halves.
HELD_BITS = 1 << 30


def rows_of(own: list[str], other: list[str]) -> Iterator[int]:
    """For each line of own, the bits of the columns at which the longest common subsequence so far grows no longer."""
    masks: dict[str, int] = {}
    for k, line in enumerate(other):
        masks[line] = masks.get(line, 0) | 1 << k
    every = (1 << len(other)) - 1
    row = every
    for line in own:
        met = row & masks.get(line, 0)
        row = (row + met | row - met) & every
        yield row


def grown(own: list[str], other: list[str]) -> list[int]:
    """The lengths of the longest common subsequences of own with the beginnings of other."""
    row = (1 << len(other)) - 1
    for row in rows_of(own, other):
        pass
    out = [0]
    for k in range(len(other)):
        out.append(out[-1] + (not row >> k & 1))
    return out


def aligned(own: list[str], other: list[str]) -> set[int]:
    """Places in own of a longest common subsequence."""
    begin, end = 0, 0
    while begin < min(len(own), len(other)) and own[begin] == other[begin]:
        begin += 1
    while end < min(len(own), len(other)) - begin and own[-1 - end] == other[-1 - end]:
        end += 1
    found = {*range(begin), *range(len(own) - end, len(own))}
    own, other = own[begin : len(own) - end], other[begin : len(other) - end]
    if not own or not other:
        return found
    if len(own) > 1 and len(own) * len(other) > HELD_BITS:
        half = len(own) // 2
        fore, back = grown(own[:half], other), grown(own[half:][::-1], other[::-1])[::-1]
        cut = max(range(len(other) + 1), key=lambda k: fore[k] + back[k])
        return found | {begin + k for k in aligned(own[:half], other[:cut])} | {begin + half + k for k in aligned(own[half:], other[cut:])}
    rows, i, j = list(rows_of(own, other)), len(own), len(other)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            found.add(begin + i)
            j -= 1
    return found


def main_text(own: list[Block], neighbour: list[Block] | None) -> str:
    """The blocks that the neighbour doesn't share and the markup doesn't mark as something else; of a page that marks its article, the article's."""
    shared = aligned([x[0] for x in own], [x[0] for x in neighbour]) if neighbour else set()
    article = any(inside for _, inside, _ in own)
    return " ".join(t for k, (t, inside, other) in enumerate(own) if inside or not (article or other or k in shared))


def place(host: str, path: str, page_id: int | None, digest: int) -> tuple:
    """What pages are ordered by: as Spark sorts them, null ids first."""
    return host, path, page_id is not None, page_id or 0, digest


def lines_digest(page: str) -> int:
    """A hash of a page's blocks; pages of the same one are copies."""
    return int.from_bytes(hashlib.blake2b("\n".join(t for t, _, _ in blocks(page)).encode(), digest_size=8).digest(), "little", signed=True)


def borders(pages: DataFrame, ranges: int) -> list[tuple]:
    """Places that part the pages into as many ranges of about equal numbers of rows; drawn from about 100 rows of each."""
    rows = pages.count()
    share = F.pmod(F.xxhash64("url", "page_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 100 * ranges / max(1, rows)))
    drawn = sorted(place(*r) for r in pages.where(share).select("host", "path", "page_id", "digest").collect())
    return [drawn[k * len(drawn) // ranges] for k in range(1, ranges)] if drawn else []


def context(summaries: list[dict]) -> list[tuple[int, tuple]]:
    """(range, key of a page) of the nearest pages that lie in other ranges. summaries: of each range, first and last runs of copies."""
    out = []
    order = sorted(summaries, key=lambda x: x["part"])
    for k, x in enumerate(order):
        for own, others, sides in ((x["first"], order[:k][::-1], ("last", "before_last")), (x["last"], order[k + 1 :], ("first", "after_first"))):
            for y in others:
                near = next((y[s] for s in sides if y[s] and y[s]["host"] == own["host"] and y[s]["lines"] != own["lines"]), None)
                if near:
                    out.append((x["part"], near))
                if near or y[sides[0]]["host"] != own["host"] or y[sides[1]]:
                    break
    return out


RUN = "struct<host:string,path:string,page_id:bigint,digest:bigint,lines:bigint>"


def neighbours_across(keyed: DataFrame, ranges: int) -> DataFrame:
    """(host, path, page_id, digest, part): pages that a range needs beside its own. A row for each range, with four keys, comes to the driver."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, _ = texts_of(batch.column(5))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([lines_digest(t) for t in texts], pa.int64())], names=slim.names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's first page, the first one of its host that is no copy of it, and likewise from its end."""
        found: dict[int, dict] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = found.setdefault(row.pop("part"), {"first": row, "after_first": None, "before_last": None, "last": row, "open": True})
                if row["host"] != x["last"]["host"]:
                    x["before_last"], x["open"] = None, False
                elif row["lines"] != x["last"]["lines"]:
                    x["before_last"] = x["last"]
                    if x["open"]:
                        x["after_first"], x["open"] = row, False
                x["last"] = row
        names = ["first", "after_first", "before_last", "last"]
        if found:
            run = pa.struct([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("digest", pa.int64()), ("lines", pa.int64())])
            yield pa.RecordBatch.from_pylist([{"part": k} | {n: x[n] for n in names} for k, x in found.items()], pa.schema([("part", pa.int32()), *((n, run) for n in names)]))

    slim = struct(part="int", host="string", path="string", page_id="long", digest="long", lines="long")
    order = ["part", "host", "path", "page_id", "digest"]
    runs = keyed.select(*order, "html").mapInArrow(digested, slim).repartitionById(ranges, "part").sortWithinPartitions(*order)
    summaries = runs.mapInArrow(summed, struct(part="int", first=RUN, after_first=RUN, before_last=RUN, last=RUN)).collect()
    needed = [(x["host"], x["path"], x["page_id"], x["digest"], part) for part, x in context([r.asDict(recursive=True) for r in summaries])]
    return keyed.sparkSession.createDataFrame(needed, "host string, path string, page_id long, digest long, part int")


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """The main text of every row of pages(page_id, url, html, ...): page_id, url, text, n_chars.

    Null html is empty and gives an empty text; a null url makes a host of its own with an empty path. A page without a
    neighbour in its host loses nothing to differencing, nor does one to its copy (a page of the same lines). Repeated rows
    each give a row; other columns are ignored; an empty table gives no rows. ranges: of pages, each read by one task; the
    shuffle partitions, if not given.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = struct(page_id="long", url="string", text="string", n_chars="long")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), path.alias("path"), F.xxhash64("html").alias("digest"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    cuts = borders(rows, ranges)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [bisect_right(cuts, place(*x)) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 0, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "part"])

    keyed = rows.mapInArrow(dealt, struct(page_id="long", url="string", host="string", path="string", digest="long", html="string", part="int"))
    needed = neighbours_across(keyed, ranges)
    near = F.broadcast(needed) if ranges <= 1 << 16 else needed  # two rows for each range
    both = [rows[k] == needed[k] for k in ("host", "path", "digest")] + [rows["page_id"].eqNullSafe(needed["page_id"])]
    across = rows.join(near, both).select(*(rows[k] for k in rows.columns), "part", F.lit(True).alias("passing"))
    met = keyed.withColumn("passing", F.lit(False)).unionByName(across).repartitionById(ranges, "part").sortWithinPartitions("part", "host", "path", "page_id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs():
            """(part and host, blocks, [(page_id, url, path) of own pages]) of consecutive copies."""
            key = own = None
            held: list[tuple] = []
            for batch in batches:
                texts, _ = texts_of(batch.column(5))
                for page_id, page_url, host, path, part, passing, page in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 6, 7)), texts):
                    found = blocks(page)
                    if key != (part, host) or [x[0] for x in found] != [x[0] for x in own]:
                        if key is not None:
                            yield key, own, held
                        key, own, held = (part, host), found, []
                    held.append((page_id, page_url, path, passing))
            if key is not None:
                yield key, own, held

        def joined():
            before = current = None
            for after in runs():
                if current is not None:
                    yield before, current, after
                before, current = current, after
            if current is not None:
                yield before, current, None

        out, size = [], 0
        for before, (key, own, held), after in joined():
            around = [x for x in (before, after) if x and x[0] == key]
            texts: dict[int, str] = {}
            for page_id, page_url, path, passing in held:
                if passing:
                    continue
                # The nearest of either side is the last page of the run before, the first of the run after.
                ends = [x[2][-1 if x is before else 0][2] for x in around]
                best = max(range(len(around)), key=lambda k: (len(commonprefix([ends[k], path])), -k), default=-1)
                if best not in texts:
                    texts[best] = main_text(own, around[best][1] if best >= 0 else None)
                out.append((page_id, page_url, texts[best], len(texts[best])))
                size += len(texts[best])
                if size > 4 << 20 or len(out) == 5000:
                    yield told(out)
                    out, size = [], 0
        if out:
            yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.string(), pa.string(), pa.int64()])], names=schema.names)

    return met.mapInArrow(run, schema)
