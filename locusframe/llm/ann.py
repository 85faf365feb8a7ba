"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after a rotation that is learned on a bounded sample to bring the
rotated vectors close to their signs (iterative quantisation). A code is cut into substrings, each
with an index of its own. Two codes within a Hamming radius r agree within floor(r / substrings) in
one substring at least, so probing every bucket within that distance finds every code within r; the
vectors behind them are then ranked by their exact inner products.

Vectors are first brought down to distinct ones with the smallest ids of their copies, so a vector
that a third of all rows repeat is one entry. Distinct vectors are dealt into parts of PART at most,
each met by each block of queries in a task of its own: memory and tasks follow the data, whatever
their size. A task indexes its part block by block and gives each query its best few.

The radius is the one within which SHARE of the true neighbours lie, on a sample of queries and
vectors; a query that finds fewer than k + 1 codes in a block widens it there.

Cases: vectors that are null, zero, of another length than most, or with null or non-finite
components take no part; equal scores rank by the smaller id; a query's own row is no candidate but
its copies are; with fewer candidates than k all are returned; repeated rows are copies; an empty table
gives no rows; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpointed, parts, table

#: Vectors and queries of the sample that the rotation and the radius are learned from.
SAMPLE, SAMPLE_QUERIES = 4_000, 100
#: Share of the true neighbours, on the sample, that the radius has to take in.
SHARE = 0.97
SUBSTRING = 8
#: Vectors and queries in a block, and vectors that a block of queries meets in one task.
BLOCK, QUERY_BLOCK, PART = 4_096, 8_192, 131_072


def learn_codes(x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation of a sample: principal axes, then turns towards the nearest signs."""
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    if len(axes) < x.shape[1]:
        axes = np.linalg.qr(np.vstack([axes, np.eye(x.shape[1])]).T)[0].T[: x.shape[1]]
    v = (x - mean) @ axes.T
    turn, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(x.shape[1],) * 2))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes.T @ turn


def encode(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes, one substring each."""
    return np.packbits((x - mean) @ rotation > 0, axis=1)


class MultiIndex:
    """An index of the values of each substring of a block of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.counts = [np.bincount(c, minlength=1 << SUBSTRING) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within the radius."""
        near = radius // self.codes.shape[1]
        found = np.zeros(len(self.codes), bool)
        values = np.arange(1 << SUBSTRING, dtype=np.uint8)
        for k, (order, counts) in enumerate(zip(self.order, self.counts)):
            probe = np.bitwise_count(values ^ code[k]) <= near  # the buckets to look into
            found[order[np.repeat(probe, counts)]] = True
        at = np.flatnonzero(found)
        return at[np.bitwise_count(self.codes[at] ^ code).sum(1) <= radius]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores and all that equal the last of them."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable vectors in double precision."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    ok = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    return rows.filter(ok).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def sample_of(distinct: DataFrame, size: int) -> np.ndarray:
    rows = distinct.orderBy(F.xxhash64("v"), "ids").limit(size).select("v").toArrow().column("v").to_pylist()
    if not rows:
        return np.zeros((0, 0))
    sizes = [len(r) for r in rows]
    width = max(sorted(set(sizes)), key=sizes.count)
    return np.array([r for r in rows if len(r) == width])


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with the k smallest ids of its copies.

    Copies come down in steps, over as many parts as the input has and then over 64, so no task gets all of them.
    """
    few = lambda ids: F.slice(F.array_sort(ids), 1, k)
    n = max(64, 4 * parts(rows))
    found = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(n)).alias("salt")).agg(few(F.collect_list("id")).alias("ids"))
    found = found.groupBy("v", F.pmod("salt", F.lit(64)).alias("salt")).agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    return found.groupBy("v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))


def radius_of(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray, k: int, total: int) -> int:
    """The radius that takes in SHARE of the true neighbours of sampled queries.

    In a sample of n among N vectors the nearest k n / N stand for the nearest k.
    """
    codes = encode(x, mean, rotation)
    depth = max(1, round(k * len(x) / max(total, 1)))
    far = []
    for i in range(min(SAMPLE_QUERIES * max(1, k // depth), len(x))):
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argpartition(-s, min(depth, len(s) - 1))[:depth]
        far.extend(np.bitwise_count(codes[top] ^ codes[i]).sum(1).tolist())
    return int(np.quantile(far, SHARE)) + 1 if far else codes.shape[1] * 8


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query by inner product; queries are rows of vectors too."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    # k + 1 copies of each: one may be the query's own row
    distinct = checkpointed(distinct_vectors(clean(vectors, id_col, vector_col), k + 1))
    total = distinct.count()
    x = sample_of(distinct, SAMPLE)
    if not len(x):
        return spark.createDataFrame([], out)
    width = x.shape[1]
    mean, rotation = learn_codes(x)
    radius = radius_of(x, mean, rotation, k, total)
    asked = clean(queries, id_col, vector_col).filter(F.size("v") == width)
    n_q = max(1, -(-asked.count() // QUERY_BLOCK))
    # parts of bounded size, and enough of them for all cores
    spread = max(1, -(-2 * spark.sparkContext.defaultParallelism // n_q), -(-total // PART))
    block = max(256, min(BLOCK, total // (4 * spread)))

    def flat(column: pa.ChunkedArray | pa.Array) -> bytes:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()

    def pack_queries(group: pa.Table) -> pa.Table:
        return pa.table({"q": group.column("q")[:1], "q_ids": pa.array([group.column("id").to_pylist()], pa.list_(pa.int64())), "q_v": pa.array([flat(group.column("v"))], pa.binary())})

    def pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), block):
                part = batch.slice(lo, block)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.list_(pa.int64()))), pa.array([flat(part.column(1))], pa.binary())], names=["ids", "v"])

    # a block of queries is copied to each part of the vectors
    wanted = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int"))
    wanted = wanted.groupBy("q").applyInArrow(pack_queries, "q int, q_ids array<long>, q_v binary")
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    base = distinct.filter(F.size("v") == width).select("ids", "v").repartition(F.xxhash64("v")).mapInArrow(pack_vectors, "ids array<array<long>>, v binary")
    base = base.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(spread)).cast("int"))
    met = base.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).join(wanted, ["q", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each query over all blocks of vectors of the task."""
        kept: dict[int, list[tuple[int, list[tuple[float, int]]]]] = {}
        for batch in batches:
            for block, q_ids, q_v, ids, v in zip(*(batch.column(c).to_pylist() for c in ("q", "q_ids", "q_v", "ids", "v"))):
                x, y = np.frombuffer(v, "<f8").reshape(-1, width), np.frombuffer(q_v, "<f8").reshape(-1, width)
                index, codes = MultiIndex(encode(x, mean, rotation)), encode(y, mean, rotation)
                least = min(k + 1, len(x))
                own = kept.setdefault(block, [(q, []) for q in q_ids])
                for (q, rows), vector, code in zip(own, y, codes):
                    at, r = index.within(code, radius), radius
                    while len(at) < least:
                        r += 4
                        at = index.within(code, r)
                    scores = x[at] @ vector
                    top = best(scores, k + 1)
                    rows += [(-s, name) for p, s in zip(at[top].tolist(), scores[top].tolist()) for name in ids[p] if name != q]
                    rows.sort()
                    del rows[k:]
        for own in kept.values():
            flat_rows = [(q, name, -s) for q, rows in own for s, name in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat_rows) if flat_rows else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    near = met.select("q", "q_ids", "q_v", "ids", "v").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each row whose id is divisible by 20, among all others; see the module for odd vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
