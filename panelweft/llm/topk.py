"""Exact top-k inner products through a pivot-distance index.

Components become integers, so scores are exact. With one more component that brings all vectors
to the same length, a larger inner product is a smaller distance; distances to pivots then bound
scores by the triangle inequality. Each vector is keyed by its nearest pivot and its distance to
it; the distances of a pivot's vectors are cut into annuli of about ``BLOCK`` vectors, at borders
fitted on a bounded sample. Annuli that turn out larger, such as many copies of one vector, are
dealt to several parts. A query first searches the annulus around its own distance, and then, in
order of their bounds, only annuli that could still hold a score as high as its k-th so far.

Queries and vectors meet by annulus (and by group of ``GROUP`` queries): whoever asks more than a
fixed number of queries gets more groups, not larger ones. Vectors that are null or hold null or
non-finite components, and null ids, take no part; shorter vectors count as padded by zeros. Rows
that share an id are vectors of their own: each is found, and each asks if its id does. Ties go to the
smaller id. Bounds are widened by far more than rounding can cost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweft.llm.storage import kept

SAMPLE, PIVOTS, BLOCK, ANNULI, GROUP = 2048, 32, 2048, 2048, 8192


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * x).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; doubles are exact below 2**53."""
    most = (np.abs(a).max(initial=0) or 1) * float(np.abs(b).max(initial=0) or 1) * max(a.shape[1], 1)
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


class Pivots:
    """Pivots in the lengthened space, and each pivot's annulus borders."""

    def __init__(self, sample: np.ndarray, longest: float, vectors: int, seed: int = 5):
        self.longest = longest
        rng = np.random.default_rng(seed)
        x = self.lengthened(sample)
        n = int(max(1, min(PIVOTS, vectors // (2 * BLOCK), len(x))))
        centre = x[rng.choice(len(x), n, replace=False)] if len(x) else np.zeros((1, sample.shape[1] + 1))
        for _ in range(8 if len(x) else 0):
            own = self.distance(x, centre).argmin(1)
            centre = np.stack([x[own == j].mean(0) if (own == j).any() else centre[j] for j in range(len(centre))])
        self.centre = centre
        d = self.distance(x, centre)
        own, rings = d.argmin(1), min(ANNULI, max(1, vectors // BLOCK))
        self.borders = []
        for j in range(len(centre)):
            r = d[own == j, j]
            m = int(round(rings * len(r) / max(len(x), 1)))
            self.borders.append(np.unique(np.quantile(r, np.arange(1, m) / m)) if m > 1 else np.zeros(0))

    def lengthened(self, q: np.ndarray) -> np.ndarray:
        x = q.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))])

    @staticmethod
    def distance(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centre * centre).sum(1) - 2 * x @ centre.T, 0))

    def keys(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pivot, annulus, distance) of stored vectors."""
        d = self.distance(self.lengthened(q), self.centre)
        pivot = d.argmin(1)
        r = d[np.arange(len(q)), pivot]
        ring = np.array([np.searchsorted(self.borders[p], v) for p, v in zip(pivot, r)], np.int64)
        return pivot, ring, r

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to the pivots; a query's further component is 0."""
        return self.distance(np.column_stack([q.astype(float), np.zeros(len(q))]), self.centre)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of little-endian 64-bit integers, padded to the same width."""
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column):
        v = np.frombuffer(x.as_py(), "<i8")
        out[i, : len(v)] = v
    return out


def prepared(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, row, v) with v the integer components and a number for each of the rows that take part; to be written before use."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("x")).where(
        "vec_id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"
    )

    def run(batches):
        for b in batches:
            x = b.column("x")
            flat, at = whole(np.asarray(x.flatten())).astype("<i8").tobytes(), np.cumsum([0, *pc.list_value_length(x).to_pylist()]).tolist()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([flat[8 * i : 8 * j] for i, j in zip(at, at[1:])], pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary").select("vec_id", F.monotonically_increasing_id().alias("row"), "v")


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = kept(prepared(vectors), "vectors")

    def measure(batches):
        for b in batches:
            n = [len(x.as_py()) // 8 for x in b.column("v")]
            q = matrix(b.column("v"), max(n, default=0)).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array((q * q).sum(1), pa.float64()), b.column("vec_id")], names=["n", "long", "vec_id"])

    total = rows.mapInArrow(measure, "n long, long double, vec_id long").agg(F.count("*"), F.max("n"), F.max("long"), F.count_if(F.col("vec_id") % every == 0)).first()
    many, width, longest, asking = total[0], total[1] or 0, total[2] or 0.0, total[3]
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow()
    points = matrix(pa.concat_arrays(sample.column("v").chunks) if sample.num_rows else pa.array([], pa.binary()), width)
    pivots = spark.sparkContext.broadcast(Pivots(points, longest, many))

    def key(batches):
        for b in batches:
            pivot, ring, r = pivots.value.keys(matrix(b.column("v"), width))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("row"), b.column("v"), pa.array(pivot.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(r)], names=["vec_id", "row", "v", "pivot", "ring", "r"])

    keyed = kept(rows.mapInArrow(key, "vec_id long, row long, v binary, pivot int, ring int, r double"), "keyed")
    # at most ANNULI + PIVOTS rows, however many vectors there are
    rings = keyed.groupBy("pivot", "ring").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).toPandas()
    rings["parts"] = -(-rings["n"] // (2 * BLOCK))
    annuli = spark.sparkContext.broadcast({c: rings[c].to_numpy() for c in rings})
    number = F.broadcast(spark.createDataFrame(rings[["pivot", "ring", "parts"]].astype("int32").assign(annulus=np.arange(len(rings), dtype="int32")), "pivot int, ring int, parts int, annulus int"))
    groups = max(1, -(-asking // GROUP))
    stored = (
        keyed.join(number, ["pivot", "ring"]).select("annulus", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "vec_id", "row", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("crowd"))
    )
    queries = keyed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("row").alias("asker"), "v", F.pmod(F.hash("row"), F.lit(groups)).alias("crowd"))

    def visits(with_bar: bool):
        """Where each query goes: its nearest annulus, or all others that may beat its bar."""

        def run(batches):
            p, a = pivots.value, annuli.value
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    s = b.slice(i, 256)
                    q = matrix(s.column("v"), width)
                    d = p.asked(q)[:, a["pivot"]]
                    near = np.maximum(np.maximum(a["low"] - d, d - a["high"]), 0)
                    first = near.argmin(1)
                    go = np.zeros(near.shape, bool)
                    go[np.arange(len(q)), first] = True
                    if with_bar:
                        bar = np.asarray(s.column("bar").fill_null(np.iinfo(np.int64).min)).astype(float)
                        square = (q.astype(float) ** 2).sum(1)
                        most = (square[:, None] + longest - np.maximum(near * (1 - 1e-9) - 1e-6 * np.sqrt(longest + 1), 0) ** 2) / 2
                        go = ~go & (most + 1e-6 * (longest + 1) >= bar[:, None])
                    who, where = np.nonzero(go)
                    parts = a["parts"][where]
                    who, where = np.repeat(who, parts), np.repeat(where, parts)
                    part = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
                    at = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where.astype(np.int32)), pa.array(part.astype(np.int32)), s.column("crowd").take(at), s.column("query_id").take(at), s.column("asker").take(at), s.column("v").take(at)], names=["annulus", "part", "crowd", "query_id", "asker", "v"]
                    )

        return run

    def best(here: pa.Table, asked: pa.Table) -> pa.Table:
        """The k best of this part of an annulus for each query that came."""
        out = [[], [], [], []]
        if here.num_rows and asked.num_rows:
            ids, order = np.asarray(here.column("vec_id")), np.argsort(np.asarray(here.column("vec_id")), kind="stable")
            ids, numbers = ids[order], np.asarray(here.column("row"))[order]
            v = matrix(here.column("v").combine_chunks(), width)[order]
            for i in range(0, asked.num_rows, 512):
                s = asked.slice(i, 512)
                own, asker = np.asarray(s.column("query_id")), np.asarray(s.column("asker"))
                score = product(matrix(s.column("v").combine_chunks(), width), v)
                low = np.iinfo(np.int64).min
                score[asker[:, None] == numbers] = low
                m = min(k, len(ids))
                edge = np.partition(score, len(ids) - m, axis=1)[:, len(ids) - m]
                for j, (x, e) in enumerate(zip(score, edge)):
                    at = np.flatnonzero((x >= e) & (x > low))
                    at = at[np.argsort(-x[at], kind="stable")][:k]
                    out[0] += [own[j]] * len(at)
                    out[1] += ids[at].tolist()
                    out[2] += x[at].tolist()
                    out[3] += [asker[j]] * len(at)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score", "asker"])

    place = ["annulus", "part", "crowd"]

    def searched(visiting: DataFrame) -> DataFrame:
        found = stored.groupBy(*place).cogroup(visiting.groupBy(*place)).applyInArrow(best, "query_id long, vec_id long, score long, asker long")
        w = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    visit = "annulus int, part int, crowd int, query_id long, asker long, v binary"
    near = kept(searched(queries.select("query_id", "asker", "v", "crowd").mapInArrow(visits(False), visit)), "near")
    bars = near.where(F.col("rank") == k).select("asker", F.col("score").alias("bar"))
    far = searched(queries.join(bars, "asker", "left").mapInArrow(visits(True), visit))
    w = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    both = near.drop("rank").unionByName(far.drop("rank"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
