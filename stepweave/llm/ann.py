"""Approximate nearest neighbours by inner product, over balanced posting lists.

*Space.* Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest length, queries a zero there: the largest
inner product is then the least distance, so distances steer everything while scores are inner products of the
original vectors in double precision.

*Lists.* Centroids come from k-means on a bounded sample, about one for ``LIST`` vectors of the table, so lists stay of one
size while the table grows, up to ``CENTROIDS`` lists; ``SAMPLE`` vectors are drawn, or ``SAMPLE_EACH`` a centroid if that is
more. Many centroids are trained in two steps, within the clusters of a first k-means. They, and the graph that is walked
to search them (each one's nearest others, entered near the query by the clusters' centres), fit in memory: ``CENTROIDS`` bounds
both. Every vector is indexed: in its nearest list, and as a boundary vector in up to ``COPIES`` lists whose centroid is at
most ``BOUNDARY`` times as far. Lists are balanced by dealing long ones into blocks of about ``BLOCK`` vectors.

*Search.* A query walks the graph to its nearest centroids and takes those at most ``PROBE_RATIO`` times as far as the
nearest, at least ``PROBE_LEAST``. How many at most is calibrated: ``CALIBRATE`` queries are answered by brute force, and the
cap grows from ``PROBE_MOST`` (in the end without the distance rule) until the lists probed hold at least ``RECALL`` of their
true neighbours, two standard errors to the safe side; at worst every list is probed. Queries meet a list's blocks in groups of at most ``QUERY_BLOCK``. Each block
gives its best k a query (all ties kept until the final cut), merged per query.

Rows: vectors that are null, zero, of another size than most, or that hold null or non-finite components take no part,
as queries or candidates; rows with a null id neither. Of rows with one id the index holds each distinct vector;
a query's own id is never its result. Equal scores go by the smaller id. Other columns, whatever their names, are never
read, texts among them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import load, picked
from stepweave.plans.durable import durable

SAMPLE, SAMPLE_EACH, LIST, CENTROIDS = 20_000, 4, 200, 1 << 18
#: Up to so many centroids all are compared instead of walked to; up to so many are trained, and their graph built, in one step.
DIRECT, ONE_STEP = 64, 2048
COPIES, BOUNDARY = 4, 1.15
PROBE_LEAST, PROBE_MOST, PROBE_RATIO = 12, 48, 1.35
RECALL, CALIBRATE, GROW = 0.9, 256, 1.25
BLOCK, QUERY_BLOCK = 4000, 1000
NEIGHBOURS, BEAM, ENTRIES, AROUND = 32, 48, 8, 24


@dataclass
class Centroids:
    points: np.ndarray  # in the augmented space
    graph: np.ndarray  # nearest other centroids of each
    centres: np.ndarray  # of the clusters of centroids
    entries: np.ndarray  # the centroid nearest to each centre
    longest: float  # M

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, squared distances) of the nearest k by a best-first walk on the graph, nearest first.

        Where the walk would see most centroids anyway, or they are few, all are compared.
        """
        count = len(self.points)
        k = min(k, count)
        if count <= DIRECT or 8 * k > count:
            parts = [_least(_sq(x[a : a + 500], self.points), k) for a in range(0, len(x), 500)]
        else:
            step = max(1, (32 << 20) // count)  # what has been seen is a flag a row and centroid
            parts = [self._walk(x[a : a + step], k) for a in range(0, len(x), step)]
        return np.concatenate([i for i, _ in parts]), np.maximum(np.concatenate([d for _, d in parts]), 0.0)

    def _walk(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, count = len(x), len(self.points)
        square = np.einsum("ij,ij->i", self.points, self.points)
        own = np.einsum("ij,ij->i", x, x)
        far = lambda rows, c: square[c] - 2 * np.einsum("ij,ikj->ik", x[rows], self.points[c]) + own[rows, None]
        beam = min(max(BEAM, 2 * k), count)
        start, _ = _least(_sq(x, self.centres), min(ENTRIES, len(self.centres)))
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        first = self.entries[start]
        ids[:, : first.shape[1]], dist[:, : first.shape[1]] = first, far(np.arange(n), first)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        waits = np.isfinite(dist)  # in the beam and not expanded
        seen = np.zeros((n, count), bool)
        np.put_along_axis(seen, first, True, 1)
        rows = np.arange(n)
        while len(rows):
            # the nearest four unexpanded ones of each row
            take = np.argsort(~waits[rows], axis=1, kind="stable")[:, :4]
            real = np.take_along_axis(waits[rows], take, 1)
            waits[rows[:, None], take] = False
            fresh = np.where(real[:, :, None], self.graph[ids[rows[:, None], take]], -1).reshape(len(rows), -1)
            fresh.sort(axis=1)
            twice = np.zeros(fresh.shape, bool)
            twice[:, 1:] = fresh[:, 1:] == fresh[:, :-1]
            new = (fresh >= 0) & ~twice & ~seen[rows[:, None], fresh]
            r, c = np.nonzero(new)
            seen[rows[r], fresh[r, c]] = True
            d = np.full(fresh.shape, np.inf)
            at, to = rows[r], fresh[r, c]
            d[r, c] = square[to] - 2 * np.einsum("ij,ij->i", x[at], self.points[to]) + own[at]
            all_ids, all_dist = np.concatenate([ids[rows], fresh], 1), np.concatenate([dist[rows], d], 1)
            all_waits = np.concatenate([waits[rows], new], 1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            ids[rows], dist[rows] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_dist, order, 1)
            waits[rows] = np.take_along_axis(all_waits, order, 1) & np.isfinite(dist[rows])
            rows = rows[waits[rows].any(axis=1)]
        return ids[:, :k], dist[:, :k]

    def posted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list numbers, which of them hold the vector) of each vector."""
        near, dist = self.nearest(self.augmented(x), COPIES)
        return near, (near >= 0) & (dist <= BOUNDARY**2 * np.maximum(dist[:, :1], 1e-12))

    def probed(self, q: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(list numbers, which of them are searched) of each query."""
        near, dist = self.nearest(np.concatenate([q, np.zeros((len(q), 1))], axis=1), most)
        return near, (near >= 0) & ((dist <= ratio**2 * np.maximum(dist[:, :1], 1e-12)) | (np.arange(near.shape[1])[None, :] < PROBE_LEAST))


def _least(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the k least of each row, in order."""
    some = np.argpartition(dist, k - 1, axis=1)[:, :k] if k < dist.shape[1] else np.broadcast_to(np.arange(dist.shape[1]), dist.shape)
    value = np.take_along_axis(dist, some, 1)
    order = np.argsort(value, axis=1, kind="stable")
    return np.take_along_axis(some, order, 1), np.take_along_axis(value, order, 1)


def _means(x: np.ndarray, count: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, which one each row is nearest to)."""
    points = x[np.random.default_rng(seed).permutation(len(x))[:count]].copy()
    closest = lambda: np.concatenate([_sq(x[a : a + 4000], points).argmin(axis=1) for a in range(0, len(x), 4000)])
    for _ in range(rounds):
        near = closest()
        sums, sizes = np.zeros_like(points), np.bincount(near, minlength=count)
        np.add.at(sums, near, x)
        points = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points)
    return points, closest()


def train(sample: np.ndarray, total: int, longest: float, seed: int = 7) -> Centroids:
    """K-means on the sample; the number of lists follows the table's size up to ``CENTROIDS``."""
    holder = Centroids(*[np.empty((0, 0))] * 4, longest)
    x = holder.augmented(sample)
    count = int(min(max(1, total // LIST), CENTROIDS, len(x)))
    if count <= DIRECT:
        points, _ = _means(x, count, seed)
        return Centroids(points, np.empty((0, 0), int), points[:1], np.zeros(1, int), longest)
    rough = int(count**0.5)
    if count <= ONE_STEP:
        points, _ = _means(x, count, seed)
    else:
        _, near = _means(x, rough, seed)
        clusters = [x[near == c] for c in range(rough)]
        points = np.concatenate([_means(own, max(1, round(count * len(own) / len(x))), seed + 1 + c, 5)[0] for c, own in enumerate(clusters) if len(own)])
    centres, near = _means(points, rough, seed, 3)
    by = np.argsort(near, kind="stable")
    cuts = np.searchsorted(near[by], np.arange(rough + 1))
    around = np.argsort(_sq(centres, centres), axis=1, kind="stable")[:, :AROUND]
    graph = np.empty((len(points), NEIGHBOURS + 2), int)
    for c in range(rough):
        own = by[cuts[c] : cuts[c + 1]]
        if not len(own):
            continue
        others = np.concatenate([by[cuts[o] : cuts[o + 1]] for o in around[c]])
        if len(others) <= NEIGHBOURS:
            others = np.unique(np.concatenate([others, np.arange(NEIGHBOURS + 1)]))
        close, _ = _least(_sq(points[own], points[others]), NEIGHBOURS + 1)
        for k, row in zip(own, others[close]):
            graph[k, :NEIGHBOURS] = row[row != k][:NEIGHBOURS]
    # long links that keep the graph in one piece
    number = np.arange(len(points))
    graph[:, NEIGHBOURS], graph[:, NEIGHBOURS + 1] = np.roll(number, 1), number[::-1]
    entries = np.array([by[cuts[c] : cuts[c + 1]][_sq(points[by[cuts[c] : cuts[c + 1]]], centres[c : c + 1]).argmin()] if cuts[c] < cuts[c + 1] else 0 for c in range(rough)])
    return Centroids(points, graph, centres, entries, longest)


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None, :]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    rows = picked(vectors, id=id_col, v=vector_col).select("id", F.col("v").cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    rows = rows.where(fine).distinct()
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def true_neighbours(rows: DataFrame, names: np.ndarray, q: np.ndarray, k: int) -> pa.Table:
    """n (number of the query), v of the k nearest of each of a few queries, by comparing every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, score = np.empty(0, np.int64), np.empty((0, q.shape[1])), np.empty((len(q), 0))
        for batch in batches:
            for part in (batch.slice(a, 4000) for a in range(0, batch.num_rows, 4000)):
                more, own = _matrix(part.column("v")), part.column("id").to_numpy()
                new = q @ more.T
                new[names[:, None] == own[None, :]] = -np.inf
                ids, x, score = np.concatenate([ids, own]), np.concatenate([x, more]), np.concatenate([score, new], axis=1)
                if len(ids) > k:  # rows that are among the best 4k of any query stay: an id may have several vectors
                    cut = np.partition(score, -min(4 * k, len(ids)), axis=1)[:, -min(4 * k, len(ids))]
                    stay = (score >= cut[:, None]).any(axis=0)
                    ids, x, score = ids[stay], x[stay], score[:, stay]
        if len(ids):
            best = np.argsort(-score, axis=1, kind="stable")[:, : 4 * k]
            n, at = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
            fine = np.isfinite(score[n, at])
            n, at = n[fine], at[fine]
            kept = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * q.shape[1], x[at].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(ids[at]), pa.array(score[n, at]), kept], ["n", "id", "score", "v"])

    found = rows.select("id", "v").mapInArrow(run, "n long, id long, score double, v array<double>")
    single = found.groupBy("n", "id").agg(F.max(F.struct("score", "v")).alias("top"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("top.score")).alias("s"), "id", F.col("top.v").alias("v"))))
    return single.groupBy("n").agg(F.slice(order, 1, k).alias("best")).select("n", F.explode("best").alias("b")).select("n", "b.v").toArrow()


def calibrated(rows: DataFrame, is_query: Column, lists: Centroids, k: int) -> tuple[int, float]:
    """(most lists a query probes, distance ratio) that reach ``RECALL`` on a bounded sample of the queries."""
    asked = rows.where(is_query).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATE).select("id", "v").toArrow()
    count = len(lists.points)
    if not asked.num_rows or count <= PROBE_LEAST:
        return PROBE_MOST, PROBE_RATIO
    q = _matrix(asked.column("v").combine_chunks())
    true = true_neighbours(rows, asked.column("id").to_numpy(), q, k)
    if not true.num_rows:
        return PROBE_MOST, PROBE_RATIO
    n = true.column("n").to_numpy()
    held, holds = lists.posted(_matrix(true.column("v").combine_chunks()))
    for ratio in (PROBE_RATIO, np.inf):
        most = min(PROBE_MOST, count)
        while True:
            near, keep = lists.probed(q, most, ratio)
            hit = np.zeros((len(q), count), bool)
            hit[np.nonzero(keep)[0], near[keep]] = True
            reached = (hit[n[:, None], held] & holds).any(axis=1)
            share = (np.bincount(n, reached, len(q)) / np.maximum(np.bincount(n, minlength=len(q)), 1))[np.unique(n)]
            if share.mean() - 2 * share.std() / np.sqrt(len(share)) >= RECALL:
                return most, ratio
            if most == count:
                break
            most = min(count, int(most * GROW))
    return count, np.inf


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where ``is_query`` (over column ``id``) holds."""
    rows = durable(usable(vectors, id_col, vector_col))
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    share = min(1.0, max(SAMPLE, SAMPLE_EACH * min(CENTROIDS, facts["n"] // LIST)) / facts["n"])
    drawn = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 50)) < share * (1 << 50)).select("id", "v").toArrow()
    if not drawn.num_rows:
        drawn = rows.orderBy("id", "v").limit(1).toArrow()
    drawn = drawn.sort_by([("id", "ascending")])
    lists = train(_matrix(drawn.column("v").combine_chunks()), facts["n"], float(np.sqrt(facts["m"])))
    most, ratio = calibrated(rows, is_query, lists, k)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                near, keep = lists.posted(_matrix(part.column("v")))
                row, _ = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(near[keep].astype(np.int64)), part.column("id").take(pa.array(row)), part.column("v").take(pa.array(row))], ["list", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                near, keep = lists.probed(_matrix(part.column("v")), most, ratio)
                row, _ = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(near[keep].astype(np.int64)), part.column("id").take(pa.array(row)), part.column("v").take(pa.array(row))], ["list", "id", "v"])

    kind = "list long, id long, v array<double>"
    postings = durable(rows.mapInArrow(post, kind))
    queries = durable(rows.where(is_query).mapInArrow(probe, kind))
    blocks = postings.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    groups = queries.groupBy("list").count().select("list", F.ceil(F.col("count") / QUERY_BLOCK).alias("groups"))
    plan = F.broadcast(durable(blocks.join(groups, "list")))  # a row per list, at most CENTROIDS of them
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    left = postings.join(plan, "list").select("list", salt("blocks").alias("block"), spread("groups").alias("group"), "id", "v")
    right = queries.join(plan, "list").select("list", spread("blocks").alias("block"), salt("groups").alias("group"), "id", "v")

    def search(posted: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if posted.num_rows and asked.num_rows:
            ids, x = posted.column("id").to_numpy(), _matrix(posted.column("v").combine_chunks())
            names, q = asked.column("id").to_numpy(), _matrix(asked.column("v").combine_chunks())
            for a in range(0, len(q), 64):
                score = q[a : a + 64] @ x.T
                score[names[a : a + 64, None] == ids[None, :]] = -np.inf
                cut = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(score), -np.inf)
                slack = np.where(np.isfinite(cut), 1e-9 * np.maximum(1.0, np.abs(cut)), 0.0)
                r, c = np.nonzero((score >= (cut - slack)[:, None]) & np.isfinite(score))
                exact = (x[c] * q[a + r]).sum(axis=1)  # the same sum wherever the pair meets
                order = np.lexsort((-exact, ids[c], r))
                r, c, exact = r[order], c[order], exact[order]
                new = np.append(True, (r[1:] != r[:-1]) | (ids[c][1:] != ids[c][:-1]))[: len(r)]  # an id's nearest vector counts
                r, c, exact = r[new], c[new], exact[new]
                order = np.lexsort((ids[c], -exact, r))
                r, c, exact = r[order], c[order], exact[order]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((names[a + r[best]], ids[c[best]], exact[best]))
        q_out, v_out, s_out = (np.concatenate(y) for y in zip(*out))
        return pa.table({"query_id": q_out, "vec_id": v_out, "score": s_out})

    keys = ["list", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    # a query has the best of each list it probed here; of one id's several vectors the nearest counts
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    best = single.groupBy("query_id").agg(F.slice(order, 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return nearest_neighbours(load(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
