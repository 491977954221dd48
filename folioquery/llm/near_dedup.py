"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of shingles are counted over all documents, in a fixed number of hashed counters.
2. Each distinct text's shingles, weighted by TF-IDF, give HASHES consistent samples; three by three they are the keys of bands.
3. In a band's bucket, the member that is most popular - whose keys most others have - is the pivot. All members are verified
   against their pivots, so that a group of near copies of any size gives as many pairs as it has members. What is linked
   forms classes.
4. In a bucket that still holds several classes, every member outside the pivot's class is verified against every member of
   another class. They meet in blocks of bounded size, each with an inverted index from shingle to members; of a member's
   links to one class the first is passed on, as more change no class. So no pair of a bucket is left out.
5. Pairs are verified on whole texts by their weighted Jaccard similarity, SIMILAR or more. Linked texts form a class; copies
   of a text join its class without being compared.

The number of jobs depends on the data only through the rounds of components(), which grow as the logarithm of a class's width.
Texts are named by NODE_BYTES bytes of their SHA-256 digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm import counting
from folioquery.llm.pretok import _tables, chunks, hashed_words, texts_of
from folioquery.llm.shared import scratch, struct, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
HASHES = BANDS * ROWS
NODE_BYTES = 16
#: Shingles of a block of members, of a pivot's part, and of what a task holds beside the members that are asked for.
BLOCK, PART, HELD = 1 << 19, 1 << 17, 1 << 19
SALTS = 16
#: Bits of the filter that keeps texts which no pair needs from being shuffled.
FILTER = 1 << 22
COUNTERS = 1 << 17
#: The rarest shingle weighs 1 + LIFT times the commonest one. It is small, since all shingles that a large group of near
#: copies has in common are frequent, and those that tell its members apart rare.
LIFT = 0.25


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct hashes of each text's shingles of SHINGLE words, and how often they occur; a shorter text is one shingle."""
    n_lines, line, flat = hashed_words(texts)
    counts = np.diff(np.searchsorted(line, np.append(0, np.cumsum(n_lines))))
    n = len(flat)
    mix = np.zeros(n, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the text's end
    for k in range(SHINGLE):
        word = np.zeros(n, np.uint64)
        word[: max(0, n - k)] = flat[k:].astype(np.uint64) + 1
        word[left <= k] = 0
        mix = (mix ^ word) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    first = np.zeros(n, bool)
    first[(ends - counts)[counts > 0]] = True
    real = (left >= SHINGLE) | first
    mix, doc = mix[real], doc[real]
    order = np.lexsort((mix, doc))
    mix, doc = mix[order], doc[order]
    new = np.append(True, (mix[1:] != mix[:-1]) | (doc[1:] != doc[:-1])) if len(mix) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(mix)))
    cut = np.searchsorted(doc[at], np.arange(1, len(texts)))
    return list(zip(np.split(mix[at], cut), np.split(tf, cut)))


def counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(47)).astype(np.int64)  # the first 17 bits


def weights(hashes: np.ndarray, tf: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """TF-IDF weights; rare: of each counter, how rare its shingles are, from 0 to 1."""
    return (1 + np.log(tf)) * (1 + LIFT * rare[counter(hashes)])


def document_frequencies(documents: DataFrame) -> np.ndarray:
    """How rare the shingles of each counter are: 1 for one document, 0 for as many as there are documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS + counting.SLICE, np.int64)  # the rows come last
        for batch in batches:
            texts, sizes = texts_of(batch.column(0))
            total[COUNTERS] += len(texts)
            for i, j in chunks(sizes, 1 << 19):
                total[:COUNTERS] += np.bincount(counter(np.concatenate([h for h, _ in shingles(texts[i:j])])), minlength=COUNTERS)
        yield counting.sliced(total)

    total = counting.summed(documents.select(F.col("text").cast("string")).mapInArrow(run, counting.SCHEMA), COUNTERS + counting.SLICE)
    return np.clip(1 - np.log(np.maximum(1, total[:COUNTERS])) / np.log(max(2, total[COUNTERS])), 0, 1).astype(np.float32)


def random_tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each hash, r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1) and beta ~ U(0, 1), by 16 bits of a shingle's hash."""
    if ("icws",) not in _tables:
        rng = np.random.default_rng(20_11)
        _tables[("icws",)] = [(rng.gamma(2, 1, 1 << 16).astype(np.float32), np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32), rng.random(1 << 16, np.float32)) for _ in range(HASHES)]
    return _tables[("icws",)]


def samples(sets: list[tuple[np.ndarray, np.ndarray]], rare: np.ndarray) -> np.ndarray:
    """HASHES consistent weighted samples (hash of shingle and quantised weight) of each text that has shingles."""
    sizes = np.fromiter((len(h) for h, _ in sets), np.int64, len(sets))
    hashes, tf = np.concatenate([h for h, _ in sets]), np.concatenate([t for _, t in sets])
    log_w = np.log(weights(hashes, tf, rare)).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sets)), sizes)
    out = np.empty((len(sets), HASHES), np.uint64)
    rng = np.random.default_rng(7)
    for k, (r, log_c, beta) in enumerate(random_tables()):
        odd = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        mixed = (hashes ^ (hashes >> np.uint64(31))) * odd
        at = (mixed >> np.uint64(48)).astype(np.int64)
        r_, b_ = r[at], beta[at]
        t = np.floor(log_w / r_ + b_)
        value = log_c[at] - r_ * (t - b_) - r_
        least = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == least[owner])
        hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]  # in a tie the smallest hash
        out[:, k] = (mixed[hit] ^ t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    return out


def sketch(texts: DataFrame, rare: np.ndarray) -> DataFrame:
    """node, size (number of shingles) and bands (keys of the text's buckets) of each distinct one of texts(node, text) that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            batch = batch.take(pa.array(sorted({n: k for k, n in enumerate(nodes)}.values()), pa.int64()))
            texts, sizes = texts_of(batch.column(1))
            for i, j in chunks(sizes, 1 << 20):
                sets = shingles(texts[i:j])
                some = [k for k, (h, _) in enumerate(sets) if len(h)]
                if not some:
                    continue
                grid = samples([sets[k] for k in some], rare).reshape(len(some), BANDS, ROWS)
                keys = np.zeros((len(some), BANDS), np.uint64)
                for k in range(ROWS):
                    keys = (keys ^ grid[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(BANDS, dtype=np.uint64)
                    keys ^= keys >> np.uint64(32)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array([len(sets[k][0]) for k in some], pa.int64()), bands], names=["node", "size", "bands"])

    return texts.mapInArrow(run, struct(node="binary", size="long", bands="array<long>")).dropDuplicates(["node"])


def only(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """texts(node, text), without most of those whose node isn't needed: by a bit for each hash, of fixed size."""
    slot = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(FILTER))
    words = needed.select(slot.alias("slot")).selectExpr("CAST(slot DIV 32 AS INT) AS w", "shiftleft(1L, CAST(slot % 32 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # FILTER / 32 rows at most
    bits = np.zeros(FILTER // 32, np.uint32)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    packed = bits.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(packed, np.uint32)
        for batch in batches:
            at = batch.column(2).to_numpy()
            kept = batch.filter(pa.array(own[at >> 5] >> (at & 31).astype(np.uint32) & 1 == 1))
            last = {n: k for k, n in enumerate(kept.column(0).to_pylist())}
            yield pa.RecordBatch.from_arrays(kept.take(pa.array(sorted(last.values()), pa.int64())).columns[:2], names=["node", "text"])

    return texts.select("node", "text", slot.alias("slot")).mapInArrow(run, struct(node="binary", text="string")).dropDuplicates(["node"])


class Held:
    """Members that are met at once: shingles, weights and owners in one array each."""

    def __init__(self, rows: list[tuple], rare: np.ndarray):
        self.nodes, self.classes = [r[0] for r in rows], [r[1] for r in rows]
        sizes = np.fromiter((len(r[2]) for r in rows), np.int64, len(rows))
        self.hashes, tf = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
        self.weights = weights(self.hashes, tf, rare)
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.totals = np.bincount(self.owner, self.weights, len(rows))
        self.order = None

    def shared(self, hashes: np.ndarray, own: np.ndarray, many: bool) -> np.ndarray:
        """The sum of the lesser weights of the shingles that each member shares with a text."""
        if not many:
            at = np.minimum(np.searchsorted(hashes, self.hashes), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == self.hashes)
            return np.bincount(self.owner[hit], np.minimum(self.weights[hit], own[at[hit]]), len(self.totals))
        if self.order is None:  # the inverted index: members in the order of shingles
            self.order = np.argsort(self.hashes, kind="stable")
            self.sorted = self.hashes[self.order]
        low, high = np.searchsorted(self.sorted, hashes, "left"), np.searchsorted(self.sorted, hashes, "right")
        n = high - low
        at = self.order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.bincount(self.owner[at], np.minimum(self.weights[at], np.repeat(own, n)), len(self.totals))


def links(asked: list[tuple], members: list[tuple], rare: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(asked, member) of those of another class that are similar; of several of one class the first. Rows: node, class, hashes, tf."""
    held, out = Held(members, rare), []
    names = {c: k for k, c in enumerate(dict.fromkeys(held.classes))}
    of = np.fromiter((names[c] for c in held.classes), np.int64, len(members))
    for node, class_, hashes, tf in asked:
        own = weights(hashes, tf, rare)
        shared = held.shared(hashes, own, len(asked) > 3)
        near = np.flatnonzero((shared >= (SIMILAR - 1e-12) * (own.sum() + held.totals - shared)) & (of != names.get(class_, -1)))
        out += [(node, held.nodes[k]) for k in near[np.unique(of[near], return_index=True)[1]]]
    return out


def verified(needed: DataFrame, texts: DataFrame, rare: np.ndarray) -> DataFrame:
    """Links (a, b) in groups: every asked member of a group meets all of the group's members of other classes.

    needed: band, key, i, j (the group), asked, node, class. A group's asked members are held, the others pass by.
    """
    needed = written(needed, "needed-texts")
    rows = only(texts, needed).join(sent(needed), "node").select("band", "key", "i", "j", "asked", "node", "class", "text")
    dealt = rows.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", F.desc("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, held, size = None, [], [], 0
        for batch in batches:
            texts, sizes = texts_of(batch.column(7))
            keys = [batch.column(k).to_pylist() for k in range(7)]
            for i, j in chunks(sizes, 1 << 19):
                out = []
                for k, (hashes, tf) in zip(range(i, j), shingles(texts[i:j])):
                    now = tuple(c[k] for c in keys[:4])
                    if now != group or size > HELD:
                        if held and asked:
                            out += links(asked, held, rare)
                        held, size = [], 0
                        if now != group:
                            group, asked = now, []
                    row = (keys[5][k], keys[6][k], hashes, tf)
                    held.append(row)
                    size += len(hashes)
                    if keys[4][k]:
                        asked.append(row)
                if out:
                    yield told(out)
        if held and asked and (out := links(asked, held, rare)):
            yield told(out)

    def told(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    return written(dealt.mapInArrow(run, struct(a="binary", b="binary")).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node that links lead to. Each round takes the least class among neighbours, then that class's own."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = written(both, "links-both-ways")
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("class")).select(F.col("x").alias("node"), "class"), "classes")
    while True:
        said = both.join(sent(labels.select(F.col("node").alias("y"), "class")), "y").select(F.col("x").alias("node"), "class", F.lit(None).cast("binary").alias("was"))
        low = said.unionByName(labels.select("node", "class", F.col("class").alias("was"))).groupBy("node").agg(F.min("class").alias("low"), F.max("was").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("class").alias("of_low"))
        new = written(low.join(sent(jump), "low").select("node", F.least("low", "of_low").alias("class"), (F.least("low", "of_low") < F.col("was")).alias("moved")), "classes")
        labels = new.select("node", "class")
        if not new.where("moved").limit(1).count():
            return labels


def merged(classes: DataFrame, more: DataFrame) -> DataFrame:
    """(node, class) after links between nodes of classes or of their own: the links are carried over to classes first."""
    of = lambda name: classes.select(F.col("node").alias(name), F.col("class").alias(f"{name}_class"))
    edges = more.join(sent(of("a")), "a", "left").join(sent(of("b")), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")).where("a <> b").distinct()
    joined = components(edges)
    kept = classes.join(sent(joined.select(F.col("node").alias("class"), F.col("class").alias("new"))), "class", "left").select("node", F.coalesce("new", "class").alias("class"))
    return written(kept.unionByName(joined.join(sent(classes), "node", "left_anti")), "classes")


def sent(rows: DataFrame) -> DataFrame:
    """rows as the side of a join that is shuffled and never broadcast: their number grows with the documents, and what Spark takes
    them for leaves out how many times rows are sent, and that digests in memory are several times those in a file."""
    return rows.hint("merge")


def salted(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """The join of rows(node, ...) with few(by, ...), whose keys each stand in SALTS rows, as a key may hold most of rows."""
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS)).cast("int")).join(sent(few), [*by, "salt"]).drop("salt")


def parts(total: str, size: int):
    return F.greatest(F.lit(1), F.ceil(F.col(total) / size)).cast("int")


def part(number: str, seed: int):
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(number)).cast("int")


def every(number: str):
    return F.explode(F.sequence(F.lit(0), F.col(number) - 1))


def with_pivots(members: DataFrame) -> DataFrame:
    """Groups of pivots and the members of their buckets, in parts."""
    top = members.groupBy("band", "key").agg(F.max(F.struct("popularity", "node", "size")).alias("top")).select("band", "key", F.col("top.node").alias("pivot"), F.col("top.size").alias("pivot_size"))
    pairs = salted(members.select("band", "key", "node", "size"), top, ["band", "key"]).where("node <> pivot").select("pivot", "pivot_size", "node", "size").distinct()
    pairs = written(pairs, "pivot-pairs")
    counts = pairs.groupBy("pivot", "pivot_size").agg(F.sum("size").alias("total")).select("pivot", parts("total", PART).alias("many"))
    met = salted(pairs.select("pivot", "node"), counts, ["pivot"]).select("pivot", part("many", 7).alias("i"), F.lit(False).alias("asked"), "node")
    asked = counts.select("pivot", every("many").alias("i"), F.lit(True).alias("asked"), F.col("pivot").alias("node"))
    return met.unionByName(asked).select(F.lit(-1).alias("band"), F.xxhash64("pivot").alias("key"), "i", F.lit(0).alias("j"), "asked", "node", F.col("node").alias("class"))


def between_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups of members outside the class of their bucket's pivot and of all members, in blocks."""
    own = members.join(sent(classes), "node", "left").select("band", "key", "node", "size", "popularity", F.coalesce("class", "node").alias("class"))
    own = written(own, "classed-members")
    top = F.max(F.struct("popularity", "node", "class"))["class"]
    mixed = own.groupBy("band", "key").agg(top.alias("main"), F.min("class").alias("low"), F.max("class").alias("high"), F.sum("size").alias("total")).where("low <> high").select("band", "key", "main", parts("total", BLOCK).alias("all"))
    rows = written(salted(own, mixed, ["band", "key"]).select("band", "key", "node", "size", "class", (F.col("class") != F.col("main")).alias("asked"), "all"), "mixed-buckets")
    rest = rows.where("asked").groupBy("band", "key").agg(F.sum("size").alias("total")).select("band", "key", parts("total", BLOCK).alias("some"))
    rows = salted(rows, rest, ["band", "key"]).drop("size")
    columns = ["band", "key", "i", "j", "asked", "node", "class"]
    small = rows.where("`all` = 1").withColumns({"i": F.lit(0), "j": F.lit(0)}).select(*columns)
    large = rows.where("`all` > 1")
    passing = large.select("band", "key", part("all", 9).alias("i"), every("some").alias("j"), F.lit(False).alias("asked"), "node", "class")
    asked = large.where("asked").select("band", "key", every("all").alias("i"), part("some", 11).alias("j"), "asked", "node", "class")
    return small.unionByName(passing).unionByName(asked)


def buckets(sketches: DataFrame) -> DataFrame:
    """band, key, node, size and popularity of the members of buckets that have several."""
    rows = sketches.select("node", "size", F.posexplode("bands").alias("band", "key"))
    counts = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = written(salted(rows, counts, ["band", "key"]), "bucket-members")
    popular = held.groupBy("node").agg(F.sum("n").alias("popularity"))
    return written(held.drop("n").join(sent(popular), "node"), "bucket-members")


def near_dedup(documents: DataFrame, row: str | None = None) -> DataFrame:
    """One row per row of documents(doc_id, text, ...): doc_id, class_id, class_size, kept; and the column row, if one is named.

    Words are runs of letters and of digits in lower case. Texts whose weighted Jaccard similarity is SIMILAR or more are
    linked, and what links lead to is one class, named by its least doc_id (null only if none has one). A null text is an
    empty one; identical texts, empty ones too, are in one class, while a text without words is like no other. Rows that
    repeat a doc_id are classed each by its own text. kept marks the class's row of the least doc_id; where several rows have
    that doc_id, those of the text of the least digest, and of them the one of the least row, if row names a column that
    tells rows apart (else all of them, as they are equal). Other columns are ignored; an empty table gives no rows.
    """
    node = F.unhex(F.substring(F.sha2("text", 256), 1, 2 * NODE_BYTES))
    extra = [F.col(row).alias("row")] if row else []
    docs = documents.select(F.col("doc_id").cast("long"), *extra, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = docs.select(node.alias("node"), "text")
    own = ["doc_id", "node", *(["row"] if row else [])]
    with scratch(documents.sparkSession):
        rows = written(docs.select("doc_id", *(["row"] if row else []), node.alias("node")), "nodes")
        rare = document_frequencies(docs)
        members = buckets(written(sketch(texts, rare), "sketches"))
        classes = components(verified(with_pivots(members), texts, rare))
        classes = merged(classes, verified(between_classes(members, classes), texts, rare))
        known = written(rows.join(sent(classes), "node", "left").withColumn("class", F.coalesce("class", "node")), "classed", keep=1)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), *own)
    firsts = known.groupBy("class").agg(F.min(first).alias("first"), F.count("*").alias("class_size"))
    # A class may hold most rows, all of one text: its entry stands in each salt, and its rows are salted by doc_id.
    salt = F.pmod(F.xxhash64("doc_id", "node", F.lit(5)), F.lit(SALTS)).cast("int")
    many = firsts.where("class_size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = known.withColumn("salt", salt).join(sent(many), ["class", "salt"], "left")
    best = F.coalesce("first", first)
    return found.select("doc_id", best["doc_id"].alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), best.eqNullSafe(first).alias("kept"), *([F.col("row").alias(row)] if row else []))
