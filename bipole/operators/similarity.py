"""Similarity of many texts to a pool: n-gram Jaccard, near duplicates, verbatim spans, nearest texts, diverse texts.

A pool that passes a size check goes to every task as an index of exact integer n-grams; a larger one is joined gram by gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bipole.functions.columns import MIN_SPAN, NEAR, NGRAM, char_ngrams, jaccard
from bipole.operators.best import Best
from bipole.operators.pools import Selector

POOL_BYTES = 16 << 20
#: Similarities that a task computes at once.
CELLS = 1 << 20


def grams(text: str) -> np.ndarray:
    """Distinct character trigrams, 21 bits a character, so that no two are confused."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(c) <= NGRAM:
        value = np.uint64(0)
        for x in c:
            value = (value << np.uint64(21)) | x
        return np.array([value])
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])


@F.pandas_udf(T.LongType())
def gram_count(texts: pd.Series) -> pd.Series:
    """How many distinct character trigrams a text has; null of a null. Sorting integers a text at a time is several times faster than a set of strings in the JVM."""
    return pd.Series([None if t is None else len(grams(t)) for t in texts], dtype="Int64")


class PoolIndex:
    def __init__(self, texts: list[str]):
        self.texts = texts
        sets = [grams(t) for t in texts]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every, owner = np.concatenate(sets or [np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.grams, self.owner = every[order], owner[order]

    def similarities(self, text: str) -> np.ndarray:
        own = grams(text)
        lo, hi = np.searchsorted(self.grams, own, "left"), np.searchsorted(self.grams, own, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(self.owner[at], minlength=len(self.texts))
        return shared / (len(own) + self.sizes - shared)


def _small(pool: DataFrame, limit: int) -> bool:
    return (pool.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0) <= limit


def _index(pool: DataFrame, key: str) -> tuple[list, object]:
    rows = pool.select(key, "text").where("text is not null").orderBy(key).collect()
    return [r[0] for r in rows], pool.sparkSession.sparkContext.broadcast(PoolIndex([r[1] for r in rows]))


def pair_similarities(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """(a_key, b_key, similarity) of all pairs that share an n-gram, by joining grams: for pools too large to send around."""
    ga = a.where("text is not null").select(F.col(a_key), char_ngrams(F.col("text")).alias("gs")).select(a_key, F.size("gs").alias("na"), F.explode("gs").alias("g"))
    gb = b.where("text is not null").select(F.col(b_key), char_ngrams(F.col("text")).alias("gs")).select(b_key, F.size("gs").alias("nb"), F.explode("gs").alias("g"))
    both = ga.join(gb, "g").groupBy(a_key, b_key).agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return both.select(a_key, b_key, (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity"))


def _nearest_of_few(queries: DataFrame, pool: DataFrame, k: int, query_key: str, pool_key: str, schema: str) -> DataFrame:
    """nearest() of few queries in a pool of any size: an index of the queries goes to every task, which reads its texts once and keeps the best k for each query."""
    keys, index = _index(queries, query_key)
    n = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, some = Best(n, k), max(1, CELLS // max(1, n))
        for batch in batches:
            places, texts = batch[pool_key].to_numpy(np.int64), batch["text"].tolist()
            for at in range(0, len(texts) if n else 0, some):
                s = np.stack([index.value.similarities(t) for t in texts[at : at + some]], axis=1)
                if s.shape[1] > k:  # of these texts alone, what is under the k best can't count
                    least = np.maximum(best.keys[:, -1:], np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
                else:
                    least = best.keys[:, -1:]
                i, j = np.nonzero(s >= least)
                best.add(i, s[i, j], places[at + j])
        there = np.isfinite(best.keys)
        yield pd.DataFrame({query_key: np.array(keys, np.int64)[np.nonzero(there)[0]], pool_key: best.pos[there], "similarity": best.keys[there], "rank": 0})

    found = pool.where("text is not null").select(F.col(pool_key).cast("bigint"), "text").mapInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), pool_key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, pool: DataFrame, k: int, query_key: str = "query_id", pool_key: str = "pos", limit: int = POOL_BYTES) -> DataFrame:
    """(query_key, pool_key, similarity, rank) of the k pool texts nearest to every query; ties go to the lower pool key; texts that share nothing
    have similarity 0. All of the pool if it has no more than k, nothing for k < 1. Null texts are left out."""
    schema = f"{query_key} bigint, {pool_key} bigint, similarity double, rank int"
    if k < 1:
        return queries.sparkSession.createDataFrame([], schema)
    if not _small(pool, limit):
        if _small(queries, limit):
            return _nearest_of_few(queries, pool, k, query_key, pool_key, schema)
        near = pair_similarities(queries, pool, query_key, pool_key)
        # texts that share nothing: the first k of the pool are enough to fill up with
        first = pool.where("text is not null").select(pool_key).orderBy(pool_key).limit(k)
        fill = queries.where("text is not null").select(query_key).crossJoin(F.broadcast(first)).withColumn("similarity", F.lit(0.0))  # k rows
        every = near.unionByName(fill).groupBy(query_key, pool_key).agg(F.max("similarity").alias("similarity"))
        rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), pool_key))
        return every.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col(query_key).cast("bigint"), F.col(pool_key).cast("bigint"), "similarity", "rank")
    keys, index = _index(pool, pool_key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(keys, np.int64)
        for batch in batches:
            rows = []
            for q, text in zip(batch[query_key], batch["text"], strict=True):
                s = index.value.similarities(text)
                for r, i in enumerate(np.lexsort((names, -s))[:k]):
                    rows.append((q, names[i], s[i], r + 1))
            yield pd.DataFrame(rows, columns=[query_key, pool_key, "similarity", "rank"])

    return queries.where("text is not null").select(F.col(query_key).cast("bigint"), "text").mapInPandas(run, schema)


def nearest_by(queries: DataFrame, pool: DataFrame, k: int, similarity_fn: Callable[[str, str], float], limit: int = POOL_BYTES) -> DataFrame:
    """nearest() by any function of two texts. The pool goes to the tasks in blocks of ``limit`` bytes, and each query keeps the best k of its best in every block."""
    schema = "query_id bigint, pos bigint, similarity double, rank int"
    if k < 1:
        return queries.sparkSession.createDataFrame([], schema)

    def best(block: list) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for q, text in zip(b["query_id"], b["text"], strict=True):
                    close = sorted((-similarity_fn(text, other), pos) for pos, other in block)[:k]
                    rows += [(q, pos, -s, r + 1) for r, (s, pos) in enumerate(close)]
                yield pd.DataFrame(rows, columns=["query_id", "pos", "similarity", "rank"])

        return queries.where("text is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "text").mapInPandas(run, schema)

    found, block, held = [], [], 0
    for row in pool.select("pos", "text").where("text is not null").orderBy("pos").toLocalIterator():
        block.append((row["pos"], row["text"]))
        held += len(row["text"]) + 16
        if held > limit:
            found.append(best(block))
            block, held = [], 0
    if block or not found:
        found.append(best(block))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "pos"))
    return every if len(found) == 1 else every.withColumn("rank", rank).where(F.col("rank") <= k)


def near_duplicates(texts: DataFrame, pool: DataFrame, key: str, pool_key: str, threshold: float = NEAR, limit: int = POOL_BYTES) -> DataFrame:
    """(key, best_similarity) of the texts that are at least ``threshold`` (above 0) similar to some text of the pool."""
    if _small(pool, limit):
        top = nearest(texts, pool, 1, key, pool_key, limit).select(key, F.col("similarity").alias("best_similarity"))
    else:
        top = pair_similarities(texts, pool, key, pool_key).groupBy(key).agg(F.max("similarity").alias("best_similarity"))
    return top.where(F.col("best_similarity") >= threshold)


def _rolled(c: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n characters, put together from those of runs of powers of two."""
    count = max(0, len(c) - n + 1)
    power, size, out, done = c * np.uint64(0x9E3779B97F4A7C15), 1, np.zeros(count, np.uint64), 0
    while done < n:
        if n & size:
            out = (out * np.uint64(0xD1B54A32D192ED03)) ^ power[done : done + count]
            done += size
        power = ((power[: max(0, len(power) - size)] * np.uint64(0xFF51AFD7ED558CCD)) ^ (power[size:] >> np.uint64(7)) ^ power[size:]) * np.uint64(0xC4CEB9FE1A85EC53)
        size *= 2
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class SpanIndex:
    """Hashes of all runs of min_len characters of some texts, sorted, with a place of each to compare with."""

    def __init__(self, texts: list[str], min_len: int):
        self.texts, self.min_len = texts, min_len
        parts = [_rolled(_points(t), min_len) for t in texts]
        every = np.concatenate(parts or [np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(p)) for p in parts] or [np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner, self.place = every[order], owner[order], place[order]
        self.low = np.uint64((1 << max(16, int(4 * len(every) + 1).bit_length())) - 1)
        self.known = np.zeros(int(self.low) + 1, bool)  # most runs are told apart by their low bits alone
        self.known[every & self.low] = True

    def shared(self, text: str, known: set[int]) -> set[int]:
        """Which of the texts, besides those known, have a run in common with this one; what hashes alike is compared by character."""
        own, new = _rolled(_points(text), self.min_len), set()
        if not len(self.hashes) or not len(own):
            return new
        maybe = np.flatnonzero(self.known[own & self.low])
        low, high = np.searchsorted(self.hashes, own[maybe]), np.searchsorted(self.hashes, own[maybe], "right")
        for k in np.flatnonzero(high > low):
            span = text[maybe[k] : maybe[k] + self.min_len]
            for at in range(low[k], high[k]):
                who = int(self.owner[at])
                if who not in known and who not in new and self.texts[who].startswith(span, self.place[at]):
                    new.add(who)
        return new

    def holds(self, text: str) -> bool:
        """Whether the text has one of the runs; what hashes alike is compared by character."""
        own = _rolled(_points(text), self.min_len)
        if not len(self.hashes) or not len(own):
            return False
        maybe = np.flatnonzero(self.known[own & self.low])
        low = np.searchsorted(self.hashes, own[maybe])
        for k in np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == own[maybe]):
            i, at = maybe[k], low[k]
            span = text[i : i + self.min_len]
            while at < len(self.hashes) and self.hashes[at] == own[i]:
                if self.texts[self.owner[at]].startswith(span, self.place[at]):
                    return True
                at += 1
        return False


def _span_index(texts: DataFrame, key: str, min_len: int) -> tuple[list[int], object]:
    rows = texts.select(F.col(key).cast("bigint"), "text").where(F.col(key).isNotNull() & F.col("text").isNotNull()).collect()
    return [r[0] for r in rows], texts.sparkSession.sparkContext.broadcast(SpanIndex([r[1] for r in rows], min_len))


def verbatim_spans(texts: DataFrame, sources: DataFrame, key: str, min_len: int = MIN_SPAN, limit: int = POOL_BYTES) -> DataFrame:
    """The rows of texts that share a run of at least ``min_len`` characters with some source. A run shorter than that, or a shorter text, never counts."""
    if _small(sources, limit):
        held = texts.sparkSession.sparkContext.broadcast(SpanIndex([r[0] for r in sources.select("text").where("text is not null").collect()], min_len))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.loc[np.array([held.value.holds(t) for t in batch["text"]], bool), [key]]

        found = texts.where("text is not null").select(F.col(key).cast("bigint").alias(key), "text").mapInPandas(run, f"{key} bigint").distinct()
    elif _small(texts, limit):  # few texts in many sources: the index is that of the texts, and each source tells which of them it shares a run with
        keys, texts_index = _span_index(texts, key, min_len)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()
            for batch in batches:
                for t in batch["text"]:
                    seen |= texts_index.value.shared(t, seen)
            yield pd.DataFrame({key: np.array([keys[i] for i in sorted(seen)], np.int64)})

        found = sources.where("text is not null").select("text").mapInPandas(run, f"{key} bigint").distinct()
    else:

        def spans(df: DataFrame, *cols: str) -> DataFrame:
            places = F.sequence(F.lit(1), F.length("text") - (min_len - 1))
            cut = F.transform(F.array(F.split("text", "")), lambda cs: F.transform(places, lambda i: F.array_join(F.slice(cs, i, min_len), "")))[0]
            return df.where(F.length("text") >= min_len).select(*cols, F.explode(F.array_distinct(cut)).alias("span"))

        found = spans(texts, key).join(spans(sources).distinct(), "span", "left_semi").select(F.col(key).cast("bigint").alias(key)).distinct()
    return texts.join(found, key, "left_semi")


def _with_texts(chosen: DataFrame, pool: DataFrame, queries: DataFrame) -> DataFrame:
    """The texts of what was chosen: for few queries that is sent to the pool, k rows a side and query, so that the pool isn't moved."""
    return (F.broadcast(chosen) if _small(queries, POOL_BYTES) else chosen).join(pool.select("pos", "side", "text"), ["pos", "side"])


class NearestSelector(Selector):
    """The k texts of each side nearest to each query, in pool order; without queries the first k. Nearness is that of character trigrams, or any function of two texts."""

    query_aware = True

    def __init__(self, similarity_fn: Callable[[str, str], float] | None = None):
        self.similarity_fn = similarity_fn

    def select(self, pool, k, queries=None):
        if queries is None:
            return pool.withColumn("_r", F.row_number().over(Window.partitionBy("side").orderBy("pos"))).where(F.col("_r") <= k).drop("_r")
        near = (lambda side: nearest_by(queries, side, k, self.similarity_fn)) if self.similarity_fn else (lambda side: nearest(queries, side, k))
        sides = [near(pool.where(F.col("side") == s)).withColumn("side", F.lit(s)) for s in ("positive", "negative")]
        return _with_texts(sides[0].unionByName(sides[1]), pool, queries)


def _closest(chosen: dict[str, tuple[list[int], list[str]]], similarity_fn: Callable[[str, str], float] | None):
    """The similarity of a text to the closest of those chosen of its side; null of the chosen themselves."""
    indexes = {side: None if similarity_fn else PoolIndex(texts) for side, (_, texts) in chosen.items()}

    def closest(sides: pd.Series, places: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for side, pos, text in zip(sides, places, texts, strict=True):
            taken, told = chosen[side]
            out.append(None if pos in taken else max(similarity_fn(text, t) for t in told) if similarity_fn else float(indexes[side].similarities(text).max()))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(closest, T.DoubleType())


def diverse(pool: DataFrame, k: int, similarity_fn: Callable[[str, str], float] | None = None) -> DataFrame:
    """k texts of each side, each the least similar to those before it, from the first; ties go to the lower pos. Each of the k rounds is one scan that compares every text with the
    few chosen so far; the driver holds these, at most k a side."""
    rows = pool.select("side", "pos", "text")
    if k < 1:
        return rows.limit(0)
    chosen = {r["side"]: [(r["x"]["pos"], r["x"]["text"])] for r in rows.groupBy("side").agg(F.min(F.struct("pos", "text")).alias("x")).collect()}
    for _ in range(k - 1):
        close = _closest({side: ([p for p, _ in own], [t for _, t in own]) for side, own in chosen.items()}, similarity_fn)("side", "pos", "text")
        left = rows.withColumn("close", close).where("close is not null").groupBy("side").agg(F.min(F.struct("close", "pos", "text")).alias("x")).collect()
        for r in left:
            chosen[r["side"]].append((r["x"]["pos"], r["x"]["text"]))
        if not left:
            break
    picks = [(side, p) for side, own in chosen.items() for p, _ in own]
    return rows.join(F.broadcast(pool.sparkSession.createDataFrame(picks, "side string, pos bigint")), ["side", "pos"], "left_semi")  # 2 k rows at most


class DiversitySelector(Selector):
    def __init__(self, similarity_fn: Callable[[str, str], float] | None = None):
        self.similarity_fn = similarity_fn

    def select(self, pool, k, queries=None):
        return diverse(pool, k, self.similarity_fn)


def all_pairs(df: DataFrame, key: str) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of a small table. Equal texts have similarity 1."""
    g = df.where("text is not null").select(F.col(key), "text", char_ngrams(F.col("text")).alias("gs"))
    a, b = (g.select(F.col(key).alias(x), F.col("text").alias(f"t{x}"), F.col("gs").alias(f"g{x}")) for x in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.when(F.col("ta") == F.col("tb"), 1.0).otherwise(jaccard(F.col("ga"), F.col("gb"))).alias("similarity"))
