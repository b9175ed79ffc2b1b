"""Approximate nearest neighbours by cosine: an inverted-file index scanned with adaptive dimension sampling.

Fit, on a hash sample of at most ``SAMPLE_BYTES``: spherical k-means in two levels, coarse cells and the lists inside them, gives about ``2 sqrt(n)`` lists, one for each ``PER_LIST`` vectors of the sample at most;
a random rotation makes every dimension alike, and the number of lists to probe is the least one that finds ``TARGET`` of the sample's own neighbours. Every row is
indexed: it goes to the nearest list of its ``NEAR_CELLS`` nearest cells.

Scan: a list is cut into blocks of at most ``CHUNK`` vectors, and each block meets the queries that probe its list, ``QUERIES`` at a time. Rotated unit vectors lie
in blocks of ``COLUMNS`` dimensions. After each block, the distance so far of each query and vector, scaled up to all dimensions, is tested against the
query's k-th best: vectors that are farther beyond chance (``EPSILON``) are abandoned. Survivors are scored in double precision on the original vectors.

Equal vectors are one candidate with their k + 1 smallest ids, and equal queries one query; so large groups of copies cost nothing more.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of different lengths are
never compared; each length has lists of its own. Rows with equal ids are one another's "own row"; equal rows count once. With fewer than k candidates, all are
returned. Components so large or small that their squares leave the range of doubles are scaled by the largest one first. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm.shared import written

SAMPLE_BYTES, TARGET, CHUNK, QUERIES, COLUMNS, EPSILON = 16 << 20, 0.97, 4096, 1024, 16, 2.1
PER_LIST, NEAR_CELLS, PAIRS, DENSE = 8, 4, 1 << 18, 0.08


@dataclass
class Fitted:
    """Lists of the vectors of one length: ``centroids`` in the order of their cells, ``edges``: where each cell's begin. Lists are numbered from ``offset``."""

    cells: np.ndarray
    centroids: np.ndarray
    edges: np.ndarray
    probes: int
    offset: int = 0

    def nearest_list(self, unit: np.ndarray) -> np.ndarray:
        """Of each vector: the nearest list of its nearest cells."""
        near = unit @ self.cells.T
        b = min(NEAR_CELLS, near.shape[1])
        cells = np.argpartition(-near, b - 1, axis=1)[:, :b] if b < near.shape[1] else np.tile(np.arange(b), (len(unit), 1))
        best, score = np.zeros(len(unit), np.int64), np.full(len(unit), -np.inf)
        who, cell = np.repeat(np.arange(len(unit)), b), cells.ravel()
        order = np.argsort(cell, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            if not len(own):
                continue
            lo, hi = self.edges[cell[own[0]]], self.edges[cell[own[0]] + 1]
            if lo == hi:
                continue
            found = unit[who[own]] @ self.centroids[lo:hi].T
            at = found.argmax(1)
            value = found[np.arange(len(own)), at]
            better = value > score[who[own]]
            best[who[own][better]], score[who[own][better]] = lo + at[better], value[better]
        return best

    def probed(self, unit: np.ndarray) -> np.ndarray:
        """Of each vector: the ``probes`` nearest lists."""
        near = unit @ self.centroids.T
        return np.argpartition(-near, self.probes - 1, axis=1)[:, : self.probes] if self.probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(unit), 1))


def _in_range(v: np.ndarray) -> np.ndarray:
    """Vectors as they are, but for those whose squares may leave the range of doubles: these over their largest component."""
    most = np.abs(v).max(axis=1, keepdims=True)
    return v / np.where((most > 1e-100) & (most < 1e100), 1.0, most)


def _unit(v: np.ndarray) -> np.ndarray:
    v = _in_range(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _means(unit: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; at most ``k`` centroids, none of them empty."""
    centroids = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        near = (unit @ centroids.T).argmax(1)
        order = np.argsort(near, kind="stable")
        found, at = np.unique(near[order], return_index=True)
        centroids = np.add.reduceat(unit[order], at, axis=0)
        length = np.linalg.norm(centroids, axis=1, keepdims=True)
        centroids = np.where(length > 0, centroids / np.maximum(length, 1e-300), unit[order[at]])
    return centroids


def fit(sample: np.ndarray, n_rows: int, k: int, target: float = TARGET, seed: int = 5, offset: int = 0) -> Fitted:
    """``sample``: vectors in rows; ``n_rows``: how many the index will hold."""
    rng = np.random.default_rng(seed)
    unit = _unit(sample)
    n = len(unit)
    n_lists = int(max(1, min(round(2 * n_rows**0.5), n // PER_LIST)))
    cells = _means(unit, max(1, round(n_lists**0.5)), rng)
    of = (unit @ cells.T).argmax(1)
    lists = [_means(unit[of == c], max(1, round(n_lists * (of == c).sum() / n)), rng) if (of == c).any() else unit[:0] for c in range(len(cells))]
    model = Fitted(cells, np.concatenate(lists), np.append(0, np.cumsum([len(x) for x in lists])), len(cells), offset)
    near = model.nearest_list(unit)
    tried = rng.choice(n, min(n, 256), replace=False)
    score = unit[tried] @ unit.T
    score[np.arange(len(tried)), tried] = -np.inf
    if n > 1:
        best = np.argpartition(-score, min(k, n - 1) - 1, axis=1)[:, :k]
        ranks = np.argsort(np.argsort(-(unit[tried] @ model.centroids.T), axis=1), axis=1)
        hit = np.sort(np.take_along_axis(ranks, near[best], axis=1).ravel())
        model.probes = int(hit[min(len(hit) - 1, int(np.ceil(target * len(hit))))]) + 1
    else:
        model.probes = len(model.centroids)
    return model


@lru_cache(4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def scan(queries: np.ndarray, columns: list[np.ndarray], k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a vector that may be among its k nearest, by numbers; rotated unit vectors, ``columns``: blocks of dimensions of all vectors."""
    n, dim = columns[0].shape[0], queries.shape[1]
    if n <= 2 * k:
        return np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
    first = min(n, max(64, 2 * k))
    head = 2 - 2 * queries @ np.concatenate([c[:first] for c in columns], axis=1).T
    bound = np.maximum(np.partition(head, k - 1, axis=1)[:, k - 1], 0) * (1 + 1e-9) + 1e-12

    def limit(seen: int) -> np.ndarray:
        return bound * (1 + epsilon / np.sqrt(seen)) ** 2 * seen / dim if seen < dim else bound

    # while many pairs are left, a block of dimensions is one matrix product over all of them; then only those that are left are taken
    whole, alive, seen, at = np.zeros((len(queries), n)), np.ones((len(queries), n), bool), 0, 0
    while at < len(columns) and (not at or alive.mean() > DENSE):
        c = columns[at]
        part = queries[:, seen : seen + c.shape[1]]
        whole += (c**2).sum(1)[None, :] + (part**2).sum(1)[:, None] - 2 * part @ c.T
        seen, at = seen + c.shape[1], at + 1
        alive &= whole <= limit(seen)[:, None]
    q, x = np.nonzero(alive)
    so_far = np.maximum(whole[q, x], 0)
    for c in columns[at:]:
        width = c.shape[1]
        so_far = so_far + ((c[x] - queries[q, seen : seen + width]) ** 2).sum(1)
        seen += width
        keep = so_far <= limit(seen)[q]
        q, x, so_far = q[keep], x[keep], so_far[keep]
    order = np.lexsort((so_far, q))
    q, x, so_far = q[order], x[order], so_far[order]
    begin = np.searchsorted(q, np.arange(len(queries)))
    last = np.minimum(begin + k - 1, np.append(begin[1:], len(q)) - 1)  # the k-th best, or the worst of fewer
    most = so_far[np.maximum(last, 0)] if len(q) else np.zeros(len(queries))
    keep = so_far <= most[q] * (1 + 1e-9) + 1e-12
    return q[keep], x[keep]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(models: dict[int, Fitted], probe: bool):
    def run(batches):
        for batch in batches:
            length = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(length).tolist():
                part = batch.filter(pa.array(length == dim))
                unit, model = _unit(_vectors(part.column("v"))), models[dim]
                for a in range(0, len(unit), 4096):
                    own = unit[a : a + 4096]
                    lists = (model.probed(own) if probe else model.nearest_list(own)[:, None]) + model.offset
                    at = pa.array(np.arange(len(own) + 1, dtype=np.int32) * lists.shape[1])
                    yield pa.RecordBatch.from_arrays([*part.slice(a, len(own)).columns, pa.ListArray.from_arrays(at, pa.array(lists.ravel().astype(np.int32)))], [*batch.schema.names, "lists"])

    return run


def _block(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        x, q = _vectors(rows.column("v")), _vectors(queries.column("v"))
        x, q = _in_range(x), _in_range(q)
        nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        turn = rotation(x.shape[1])
        turned, asked = (x / nx[:, None]) @ turn, (q / nq[:, None]) @ turn
        columns = [np.ascontiguousarray(turned[:, o : o + COLUMNS]) for o in range(0, x.shape[1], COLUMNS)]
        ids = rows.column("ids").combine_chunks()
        begin, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
        q1, q2 = queries.column("h1").to_numpy(), queries.column("h2").to_numpy()
        out, step = [], max(1, PAIRS // len(x))
        for a in range(0, len(q), step):
            at, near = scan(asked[a : a + step], columns, k + 1)
            at += a
            score = (x[near] * q[at]).sum(1) / (nx[near] * nq[at])
            n = (begin[1:] - begin[:-1])[near]
            at, score = np.repeat(at, n), np.repeat(score, n)
            of = flat[np.repeat(begin[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            order = np.lexsort((of, -score, at))
            at, score, of = at[order], score[order], of[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) <= k
            out.append((q1[at[keep]], q2[at[keep]], of[keep], score[keep]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def nearest(vectors: DataFrame, every: int = 100, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its k nearest other rows by cosine, ties to the smaller id."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(~bad & F.exists("v", lambda x: x != 0))
    own = written(own.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(3), "v")), "vectors")
    first = own.dropDuplicates(["h1", "h2", "id"]).withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("n") <= k + 1)
    kinds = written(first.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")), "kinds")
    sizes = dict(kinds.groupBy(F.size("v")).count().collect())  # a row a vector length
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE_BYTES / (8 * sum(d * n for d, n in sizes.items())))
    sample = kinds.filter(F.pmod("h2", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("h1", "h2").select("v").toArrow().column("v").combine_chunks()
    length = np.diff(sample.offsets.to_numpy())
    models: dict[int, Fitted] = {}
    n_lists = 0
    for dim, n in sorted(sizes.items()):
        rows = sample.filter(pa.array(length == dim))
        models[dim] = fit(_vectors(rows), n, k, offset=n_lists) if len(rows) else Fitted(np.zeros((1, dim)), np.zeros((1, dim)), np.array([0, 1]), 1, n_lists)
        n_lists += len(models[dim].centroids)
    listed = kinds.mapInArrow(_assign(models, False), "h1 long, h2 long, v array<double>, ids array<long>, lists array<int>").withColumn("list", F.col("lists")[0]).drop("lists")
    queries = own.filter(F.col("id") % every == 0).select("id", "h1", "h2")
    asked = kinds.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v")
    asked = asked.mapInArrow(_assign(models, True), "h1 long, h2 long, v array<double>, lists array<int>").withColumn("list", F.explode("lists")).drop("lists")
    listed, asked = written(listed, "listed"), written(asked, "asked")
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("g"))
    loads = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("h"))
    cut = F.broadcast(sizes.join(loads, "list"))  # a row a list: one for each PER_LIST vectors of the sample, at most
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    rows = listed.join(cut, "list").withColumn("i", F.pmod("h1", "g")).withColumn("j", span("h")).select("list", "i", "j", "v", "ids")
    asks = asked.join(cut, "list").withColumn("j", F.pmod("h1", "h")).withColumn("i", span("g")).select("list", "i", "j", "h1", "h2", "v")
    key = ["list", "i", "j"]
    found = asks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_block(k), "q1 long, q2 long, vec_id long, score double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    best = best.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    told = queries.distinct().join(best, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return told.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
