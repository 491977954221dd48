"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted in numpy on a bounded sample; every vector is indexed, in one list of the inverted file. A
list is split into blocks of bounded size, and a query goes to the blocks of the lists that it probes, and to no others. A
vector is sent once, save that the block of a list which more than QUERY_PART queries probe meets them in several parts.
Vectors and queries travel as matrices, one row for what a batch has for a block. In a block, asymmetric distance tables give
each query a shortlist, which is reranked by exact inner products of the original vectors in double precision, as is every row
whose estimate, by how far its codes are off, could still be among the best; the best of all blocks are the query's answer.

How many lists have to be probed is measured on the sample. Where vectors have no structure, as those of random directions,
that is a constant share of the lists, and work grows as queries times vectors, with this as with any inverted file.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.llm.shared import struct, written

#: Rows that codebooks are fitted on, and those that centroids are fitted on for each list; every row is indexed.
MOST_FITTED, FITTED_A_LIST = 20_000, 16
#: There are sqrt(rows) / 2 lists, as long as FITTED_A_LIST rows of a sample of FITTED_FOR_LISTS rows fall to each.
FITTED_FOR_LISTS = 65_536
WANTED, LEAST_PROBED = 0.97, 8
PARTS, CODES, SHORTLIST = 16, 256, 160
BLOCK, QUERY_PART = 4096, 65_536
TOP, EVERY = 20, 20


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of rows that take part: of the commonest length (the smaller in a tie), all finite, not all zero."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k centroids of x at most; those that lose all rows take the rows farthest from theirs."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near, far = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        if (empty := np.flatnonzero(count == 0)).size:
            c[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid of each row, and its squared distance."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    half = (c * c).sum(1) / 2
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ c.T - half
        near[i : i + 4096] = s.argmax(1)
        far[i : i + 4096] = (x[i : i + 4096] ** 2).sum(1) - 2 * s.max(1)
    return near, far


def lists_for(rows: int) -> int:
    return int(math.sqrt(rows)) // 2


def fitted_for(rows: int) -> int:
    """Rows of the sample."""
    return min(rows, max(MOST_FITTED, min(FITTED_FOR_LISTS, FITTED_A_LIST * lists_for(rows))))


class Quantiser:
    """Coarse centroids, and a codebook for each part of the residuals."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.size = sample.shape[1]
        self.coarse = k_means(sample, max(1, min(lists_for(rows), len(sample) // FITTED_A_LIST)))
        self.lists = len(self.coarse)
        self.parts = min(PARTS, self.size)
        self.bounds = np.linspace(0, self.size, self.parts + 1).astype(int)
        few = sample[:: -(-len(sample) // MOST_FITTED)]
        rest = few - self.coarse[nearest(few, self.coarse)[0]]
        self.books = [k_means(rest[:, a:b], CODES, 8) for a, b in zip(self.bounds, self.bounds[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each row, and the codes of its residual's parts."""
        at, _ = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        return at, np.stack([nearest(rest[:, a:b], book)[0] for a, b, book in zip(self.bounds, self.bounds[1:], self.books)], 1).astype(np.uint8)

    def missed(self, at: int, codes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How far each row of list at lies from what its codes stand for: an estimate errs by that times the query's length at most."""
        held = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1) + self.coarse[at]
        return np.linalg.norm(x - held, axis=1)

    def estimates(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries and the coded rows of list at, from each query's table of parts and codes."""
        out = np.repeat((q @ self.coarse[at])[:, None], len(codes), 1)
        for k, (a, b, book) in enumerate(zip(self.bounds, self.bounds[1:], self.books)):
            out += (q[:, a:b] @ book.T)[:, codes[:, k]]
        return out


def vectors_of(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def share_needed(model: Quantiser, x: np.ndarray, wanted: float = WANTED, asked: int = 200) -> float:
    """The share of lists, best first, that holds the wanted share of the TOP nearest of rows of the sample."""
    at, _ = nearest(x, model.coarse)
    ranks = []
    for q in range(0, len(x), max(1, len(x) // asked)):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argpartition(-score, min(TOP, len(x) - 1))[:TOP]
        place = np.empty(model.lists, np.int64)
        place[np.argsort(-(model.coarse @ x[q]), kind="stable")] = np.arange(model.lists)
        ranks.append(place[at[best]])
    return (np.quantile(np.concatenate(ranks), wanted) + 1) / model.lists


def answers(model: Quantiser, at: int, ids: np.ndarray, codes: np.ndarray, x: np.ndarray, missed: np.ndarray, query_ids: np.ndarray, q: np.ndarray, top: int):
    """(query_id, vec_id, score) of the best of one block for each query; ids ascend.

    The shortlist's exact scores say what has to be reached; every other row whose estimate could reach it is reranked, too. So
    vectors that lie too close together for their codes to tell them apart are told apart.
    """
    found = []
    for i in range(0, len(q), 128):
        part = q[i : i + 128]
        estimate = model.estimates(part, at, codes)
        estimate[ids[None, :] == query_ids[i : i + 128, None]] = -np.inf
        short = np.argsort(-estimate, axis=1, kind="stable")[:, :SHORTLIST]
        score = (x[short] * part[:, None, :]).sum(-1)
        score[np.take_along_axis(estimate, short, 1) == -np.inf] = -np.inf
        reached = np.sort(score, axis=1)[:, -top] if score.shape[1] >= top else np.full(len(part), -np.inf)
        length = np.linalg.norm(part, axis=1)
        could = estimate + length[:, None] * missed[None, :] * (1 + 1e-9)
        enough = reached - 1e-9 * (np.abs(reached) + length * np.abs(x).max(initial=0))
        for k in range(len(part)):
            own = np.flatnonzero((could[k] >= enough[k]) & (estimate[k] > -np.inf)) if np.isfinite(reached[k]) else np.flatnonzero(estimate[k] > -np.inf)
            exact = (x[own] * part[k]).sum(-1)
            best = np.lexsort((own, -exact))[:top]
            found.append((np.full(len(best), query_ids[i + k]), ids[own[best]], exact[best]))
    return [np.concatenate(c) for c in zip(*found)]


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """The top nearest found of each query in vectors(vec_id, embedding, ...): query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by every; candidates all rows with another vec_id. Nearness is the inner
    product, ties go to the smaller vec_id. A vec_id that repeats is a candidate for each row, and a query for the smallest
    of its vectors. Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
    part. Each query probes the share of lists that held WANTED of the nearest in the sample, and as many more as give it
    top candidates, or all if there are fewer. Other columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors)
    n = rows.count()
    out = struct(query_id="long", rank="int", vec_id="long", score="double")
    if not n:
        return vectors.sparkSession.createDataFrame([], out)
    fitted = fitted_for(n)
    drawn = rows if n <= fitted else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) < int(950_000 * fitted / n))
    sample = drawn.select("v").toArrow()["v"]  # about FITTED_FOR_LISTS rows at most
    size = len(sample[0])
    sample = vectors_of(sample, size)
    sample = sample[np.lexsort(sample.T)]  # the same fit, in whatever order rows come
    sample = sample[np.random.default_rng(9).permutation(len(sample))]
    model = Quantiser(sample, n)
    share = share_needed(model, sample)
    kind = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "<f8"

    def encode(batches):
        for batch in batches:
            if len(batch):
                at, codes = model.encode(vectors_of(batch.column(1), size))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["vec_id", "list", "codes", "v"])

    coded = written(rows.mapInArrow(encode, struct(vec_id="long", list="int", codes="binary", v="array<double>")), "coded-vectors")
    held = np.zeros(model.lists, np.int64)
    for r in coded.groupBy("list").count().collect():  # a row for each list
        held[r["list"]] = r["count"]
    least = min(model.lists, max(LEAST_PROBED, int(np.ceil(share * model.lists))))
    blocks = np.maximum(1, -(-held // BLOCK))
    matrices = struct(list="int", block="int", part="int", asked="boolean", n="int", ids="binary", codes="binary", v="binary")

    def told(keys: np.ndarray, ids: np.ndarray, codes: np.ndarray | None, x: np.ndarray) -> pa.RecordBatch:
        """A row for each distinct (list, block) of keys."""
        order = np.lexsort(keys.T[::-1])
        keys, ids, x = keys[order], ids[order], x[order].astype(kind)
        cut = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))), len(keys))
        runs = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        packed = [b""] * len(runs) if codes is None else [codes[order[i:j]].tobytes() for i, j in runs]
        columns = [pa.array(keys[cut[:-1], k].astype(np.int32)) for k in (0, 1)] + [pa.array(np.zeros(len(runs), np.int32)), pa.array([codes is None] * len(runs)), pa.array(np.diff(cut).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([ids[i:j].tobytes() for i, j in runs], pa.binary()), pa.array(packed, pa.binary()), pa.array([x[i:j].tobytes() for i, j in runs], pa.binary())], names=matrices.names)

    def probe(batches):
        """Each query with the blocks of the lists of largest inner product; more lists where they hold too few rows."""
        for batch in batches:
            if not len(batch):
                continue
            x = vectors_of(batch.column(1), size)
            order = np.argsort(-(x @ model.coarse.T), axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) < 2 * top + 1).sum(1) + 1
            counts = np.minimum(model.lists, np.maximum(least, enough))
            lists = np.concatenate([o[:c] for o, c in zip(order, counts)])
            row = np.repeat(np.repeat(np.arange(len(batch)), counts), blocks[lists])
            ends = np.cumsum(blocks[lists])
            block = np.arange(ends[-1]) - np.repeat(ends - blocks[lists], blocks[lists])
            yield told(np.stack([np.repeat(lists, blocks[lists]), block], 1), batch.column(0).to_numpy()[row], None, x[row])

    def gather(batches):
        for batch in batches:
            if len(batch):
                keys = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()], 1)
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1)
                yield told(keys, batch.column(0).to_numpy(), codes, vectors_of(batch.column(2), size))

    asked = coded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("q"))
    queries = written(asked.mapInArrow(probe, matrices), "probes")
    number = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1)
    # Copies of a vector differ in their ids, and so go to different blocks.
    block = F.pmod(F.xxhash64("vec_id", F.lit(13)), number).cast("int")
    members = coded.select("vec_id", "codes", "v", "list", block.alias("block")).mapInArrow(gather, matrices)
    # Lists that more queries probe than one task is to answer: their members are sent to each part.
    busy = queries.groupBy("list", "block").agg(F.sum("n").alias("probing")).where(F.col("probing") > QUERY_PART).select("list", "block", F.ceil(F.col("probing") / QUERY_PART).cast("int").alias("parts"))
    busy = written(busy, "busy-blocks")
    parts = F.coalesce("parts", F.lit(1))
    columns = [c for c in matrices.names if c != "part"]
    dealt = lambda df, part: df.drop("part").join(busy, ["list", "block"], "left").select(*columns, part.alias("part")).select(*matrices.names)
    both = dealt(members, F.explode(F.sequence(F.lit(0), parts - 1))).unionByName(dealt(queries, F.pmod(F.xxhash64("ids"), parts).cast("int")))
    met = both.repartition("list", "block", "part").sortWithinPartitions("list", "block", "part", "asked")

    def meet(batches):
        """Members of a block come first and are held; the queries pass by."""
        key, found, block_of = None, [], None
        for batch in batches:
            for at, block, part, is_query, rows_, ids, codes, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (at, block, part) != key:
                    key, found, block_of = (at, block, part), [], None
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(v, kind).astype(np.float64).reshape(rows_, size)
                if not is_query:
                    found.append((ids, np.frombuffer(codes, np.uint8).reshape(rows_, -1), x))
                elif found:
                    if block_of is None:
                        block_of = [np.concatenate(c) for c in zip(*found)]
                        order = np.argsort(block_of[0], kind="stable")
                        block_of = [c[order] for c in block_of]
                        block_of.append(model.missed(at, *block_of[1:]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in answers(model, at, *block_of, ids, x, top)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(meet, struct(query_id="long", vec_id="long", score="double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
