"""Embeddings: cosine neighbours, K-Means and Vote-K representatives."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bipole.operators.best import Best
from bipole.sources.tables import materialise

#: Vectors of a block of the pool and of the queries that a task holds at most, bytes of either, and the queries and pool vectors compared at once.
POOL_VECTORS, QUERIES, BYTES, TILE = 1 << 16, 1 << 14, 16 << 20, (512, 8192)
_models: dict[str, object] = {}


def embed(texts: DataFrame, key: str, load: Callable[[str], Callable], model_name: str) -> DataFrame:
    """(key, embedding): ``load(model_name)`` gives a function of a list of texts; a worker loads it once. Each distinct text is embedded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model_name not in _models:
            _models[model_name] = load(model_name)
        for b in batches:
            yield pd.DataFrame({"text": b["text"], "embedding": [list(map(float, v)) for v in _models[model_name](b["text"].tolist())]})

    known = texts.select("text").distinct().mapInPandas(run, "text string, embedding array<double>")
    return texts.select(key, "text").join(known, "text").select(key, "embedding")


class CosineSimilarity:
    """A function of two texts: the cosine of their embeddings. It can be sent to tasks; each loads the model once and embeds each text once in a run of comparisons."""

    def __init__(self, load: Callable[[str], Callable], model_name: str):
        self.load, self.model_name, self._known = load, model_name, {}

    def __getstate__(self):
        return {"load": self.load, "model_name": self.model_name, "_known": {}}

    def _vector(self, text: str) -> np.ndarray:
        if text not in self._known:
            if self.model_name not in _models:
                _models[self.model_name] = self.load(self.model_name)
            if len(self._known) >= 10_000:  # a cache, not a result
                self._known.clear()
            self._known[text] = np.asarray(_models[self.model_name]([text])[0], np.float64)
        return self._known[text]

    def __call__(self, a: str, b: str) -> float:
        x, y = self._vector(a), self._vector(b)
        if len(x) != len(y):
            raise ValueError("vectors differ in length")
        norm = float(np.linalg.norm(x) * np.linalg.norm(y))
        return float(x @ y) / norm if norm else 0.0


def cosine_similarity_fn(load: Callable[[str], Callable], model_name: str) -> CosineSimilarity:
    """For the selectors' ``similarity_fn``: embeddings instead of n-grams."""
    return CosineSimilarity(load, model_name)


def _matrix(lists: pa.Array) -> np.ndarray:
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths[0] < 0 or (lengths != lengths[0]).any()):
        raise ValueError("vectors are missing or differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the batches, at most ``rows`` rows and about ``size`` bytes of vectors at a time."""
    held, n = [], 0
    for b in batches:
        ids, x = b.column(0).to_numpy(), _matrix(b.column(1)) if b.num_rows else np.zeros((0, 0))
        at = 0
        while at < len(ids):
            some = max(1, min(rows, size // max(1, x.itemsize * x.shape[1])) - n)
            held.append((ids[at : at + some], x[at : at + some]))
            n += len(held[-1][0])
            at += some
            if n >= min(rows, max(1, size // max(1, x.itemsize * x.shape[1]))):
                yield tuple(np.concatenate(p) for p in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(p) for p in zip(*held, strict=True))


def _once(sent) -> object:
    """What was broadcast, without the worker holding on to it."""
    value = sent.value
    if getattr(sent, "_path", None) is not None:  # it can be read from there again
        sent.__dict__.pop("_value", None)
    return value


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _compare(best: Best, ids: np.ndarray, u: np.ndarray, pos: np.ndarray, y: np.ndarray) -> None:
    """Take the nearest of the vectors y into best, tile by tile: what single precision can't rule out is computed in double. pos is in order."""
    k, margin, none = best.k, (u.shape[1] + 8) * 2.0**-23 + 1e-11, -2.0  # the key of a cosine that is no number
    odd_u, odd_y = np.isnan(u).any(1), np.isnan(y).any(1)
    for i in np.flatnonzero(odd_u):
        first = pos[: k + np.count_nonzero(pos == ids[i])]
        first = first[first != ids[i]]
        best.add(np.full(len(first), i), np.full(len(first), none), first)
    if odd_y.any():  # of those without a cosine only the lowest can count
        low = pos[odd_y]
        for i in np.flatnonzero(~odd_u & (best.keys[:, -1] <= none)):
            first = low[: k + np.count_nonzero(low == ids[i])]
            first = first[first != ids[i]]
            best.add(np.full(len(first), i), np.full(len(first), none), first)
    rows, pos, y = np.flatnonzero(~odd_u), pos[~odd_y], y[~odd_y]
    y32 = y.astype(np.float32)
    for a in range(0, len(rows), TILE[0]):
        own = rows[a : a + TILE[0]]
        own_ids, x32 = ids[own], u[own].astype(np.float32)
        left, right = np.searchsorted(pos, own_ids, "left"), np.searchsorted(pos, own_ids, "right")
        for c in range(0, len(pos), TILE[1]):
            s = x32 @ y32[c : c + TILE[1]].T
            width = s.shape[1]
            for i in np.flatnonzero((left < c + width) & (right > max(c, 0)) & (left < right)):
                s[i, max(0, left[i] - c) : right[i] - c] = -np.inf
            least = best.keys[own, -1] - margin
            open_ = np.flatnonzero(least < -1.5)
            if len(open_) and width > k:
                least[open_] = np.maximum(least[open_], np.partition(s[open_], width - k, axis=1)[:, width - k] - 2 * margin)
            i, j = np.nonzero(s >= least.astype(np.float32)[:, None])
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)] + c
                other = pos[q] != own_ids[p]
                p, q = p[other], q[other]
                best.add(own[p], np.round(np.einsum("ij,ij->i", u[own[p]], y[q]), 12), pos[q])


def nearest_vectors(queries: DataFrame, pool: DataFrame, k: int, limit: int = POOL_VECTORS) -> DataFrame:
    """(query_id, pos, cosine, rank) of the k pool vectors nearest to each query other than itself; ties go to the lower pos, a vector of no length has
    cosine 0. All pairs are compared, so the work grows with the product of both tables; what a task holds doesn't grow: up to ``limit`` vectors of the pool at a time,
    one block after the other, against as many of its queries. Of equal vectors only the k + 1 lowest pos can be among the nearest, so no more of them are sent."""
    spark, columns = queries.sparkSession, "query_id bigint, pos bigint, cosine double, rank int"
    if k < 1:
        return spark.createDataFrame([], columns)

    def vectors(df: DataFrame, key: str) -> DataFrame:
        kind = df.schema["embedding"].dataType.simpleString()
        return df.select(F.col(key).cast("bigint").alias(key), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding")).where(F.col(key).isNotNull())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pos, x in _gathered(batches, limit, BYTES):
            order = np.argsort(pos, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([x.dtype.str]), pa.array([x.shape[1]]), pa.array([pos[order].tobytes()]), pa.array([x[order].tobytes()])], ["kind", "dim", "pos", "x"])

    low = vectors(pool, "pos").withColumn("_r", F.dense_rank().over(Window.partitionBy("embedding").orderBy("pos"))).where(F.col("_r") <= k + 1).drop("_r")
    blocks = [spark.sparkContext.broadcast(tuple(r)) for r in low.mapInArrow(packed, "kind string, dim bigint, pos binary, x binary").toLocalIterator()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _gathered(batches, QUERIES, BYTES):
            u, best = _unit(x), Best(len(ids), k)
            for sent in blocks:
                kind, dim, pos, flat = _once(sent)
                if dim != u.shape[1]:
                    raise ValueError("vectors differ in length")
                _compare(best, ids, u, np.frombuffer(pos, np.int64), _unit(np.frombuffer(flat, kind).reshape(-1, dim)))
            there = np.isfinite(best.keys)
            row, rank = np.nonzero(there)
            keys = best.keys[there]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best.pos[there]), pa.array(np.where(keys < -1.5, np.nan, keys)), pa.array((rank + 1).astype(np.int32))], ["query_id", "pos", "cosine", "rank"])

    cores = spark.sparkContext.defaultParallelism
    return vectors(queries, "query_id").repartition(max(1, math.ceil(queries.count() / (QUERIES * cores))) * cores).mapInArrow(run, columns)


def votes(neighbours: DataFrame, pool: DataFrame) -> DataFrame:
    """(pos, votes): how many vectors have each among their neighbours."""
    n = neighbours.groupBy("pos").agg(F.count(F.lit(1)).alias("votes"))
    return pool.select("pos").join(n, "pos", "left").select("pos", F.coalesce("votes", F.lit(0)).alias("votes"))


def vote_k(pool: DataFrame, n: int, k: int = 10) -> list[int]:
    """pos of n vectors: the most voted of those left, the lowest of equals, after which its neighbours lose their votes. The edges stay distributed: the driver holds the n picks, and
    of the tallies only those that may still win, the n * (k + 2) highest, since a pick takes itself and at most k others out."""
    count = pool.count()
    if n >= count:
        return [r[0] for r in pool.select("pos").orderBy("pos").collect()]
    k = min(k, count - 1)
    near = materialise(nearest_vectors(pool.withColumnRenamed("pos", "query_id"), pool, k).select("query_id", "pos"))
    best = [(r["votes"], r["pos"]) for r in votes(near, pool).orderBy(F.desc("votes"), "pos").limit(n * (k + 2)).collect()]
    tally, chosen = {p: v for v, p in best}, []
    edges: dict[int, list[int]] = {}
    for r in near.join(F.broadcast(pool.sparkSession.createDataFrame([(p,) for p in tally], "query_id bigint")), "query_id", "left_semi").collect():
        edges.setdefault(r["query_id"], []).append(r["pos"])
    while len(chosen) < n and tally:
        at = min(tally, key=lambda p: (-tally[p], p))
        if tally[at] == 0:
            break
        chosen.append(at)
        del tally[at]
        for p in edges.get(at, []):
            if p in tally:
                tally[p] = 0
    if len(chosen) < n:  # only vectors without votes are left, of all of them the first
        have = chosen or [-1]
        chosen += [r["pos"] for r in pool.select("pos").where(~F.col("pos").isin(have)).orderBy("pos").limit(n - len(chosen)).collect()]
    return chosen


def kmeans_representatives(pool: DataFrame, n: int, seed: int = 0) -> list[int]:
    """pos of n vectors, cluster by cluster: of each K-Means centre the nearest that isn't taken yet. None for n = 0, all for n >= N."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if n <= 0:
        return []
    if n >= pool.count():
        return [r[0] for r in pool.select("pos").orderBy("pos").collect()]
    vectors = pool.select("pos", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    centres = KMeans(k=n, seed=seed).fit(vectors).clusterCenters()
    taken: list[int] = []
    while len(taken) < n:
        c = centres[len(taken) % len(centres)]
        d = F.aggregate(F.zip_with(F.col("embedding"), F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        taken.append(pool.where(~F.col("pos").isin(taken) if taken else F.lit(True)).orderBy(d, "pos").select("pos").first()[0])
    return taken
