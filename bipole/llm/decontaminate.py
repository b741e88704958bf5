"""Benchmark decontamination by winnowing.

Both sides are cut into windows of ``k`` words; of every ``w`` consecutive windows the one with the least hash is kept as a fingerprint
(the rightmost among equals). Two texts that share a span of at least ``k + w - 1`` words keep the same fingerprint inside it, so joining the
fingerprints misses no such span. Every hit is extended word by word to both sides, and spans of at least ``k + w - 1`` words are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipole.llm.common import arrow_map, fits
from bipole.llm.kernel import chunks, windows, winnow, words

K, W = 5, 4
BROADCAST_BYTES = 64 << 20
_SCHEMA = "doc_id bigint, item_id bigint, longest_words bigint, n_spans bigint"


class Index:
    """The fingerprints of benchmark texts, sorted, with the word hashes to extend hits."""

    def __init__(self, texts: list[str | None], k: int, w: int):
        self.k, self.w = k, w
        parts = []
        self.words: list[np.ndarray] = []
        for first, some in chunks(texts):
            hashes, offsets = words(some)
            self.words += [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            values, text, place = windows(hashes, offsets, k)
            keep = winnow(values, text, w)
            parts.append((values[keep], text[keep] + first, place[keep]))
        self.values, self.item, self.place = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.uint64 if i == 0 else np.int64)]) for i in range(3))
        order = np.argsort(self.values, kind="stable")
        self.values, self.item, self.place = self.values[order], self.item[order], self.place[order]

    def spans(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word in the text, first word in the item, words) of every maximal shared span of k + w - 1 words or more."""
        if not len(self.values):
            return
        for first, some in chunks(texts):
            hashes, offsets = words(some)
            values, text, place = windows(hashes, offsets, self.k)
            keep = winnow(values, text, self.w)
            values, text, place = values[keep], text[keep], place[keep]
            low = np.searchsorted(self.values, values, "left")
            hit = self.values[np.minimum(low, len(self.values) - 1)] == values
            covered: dict[tuple[int, int, int], int] = {}
            for at in np.flatnonzero(hit):
                t, p = int(text[at]), int(place[at])
                own = hashes[offsets[t] : offsets[t + 1]]
                for e in range(int(low[at]), int(np.searchsorted(self.values, values[at], "right"))):
                    item, q = int(self.item[e]), int(self.place[e])
                    if covered.get((t, item, p - q), -1) > p:
                        continue
                    other = self.words[item]
                    back = min(p, q)
                    same = own[p - back : p][::-1] == other[q - back : q][::-1]
                    left = back if same.all() else int(np.argmin(same))
                    ahead = min(len(own) - p, len(other) - q)
                    same = own[p : p + ahead] == other[q : q + ahead]
                    right = ahead if same.all() else int(np.argmin(same))
                    covered[t, item, p - q] = p + right
                    if left + right >= self.k + self.w - 1:
                        yield first + t, item, p - left, q - left, left + right


def _rows(found: dict[tuple[int, int], list[int]], ids: list, items: list) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[t] for t, _ in keys], pa.int64()), pa.array([items[i] for _, i in keys], pa.int64()), pa.array([max(found[x]) for x in keys], pa.int64()), pa.array([len(found[x]) for x in keys], pa.int64())],
        ["doc_id", "item_id", "longest_words", "n_spans"],
    )


def contamination(documents: DataFrame, benchmark: DataFrame, *, k: int = K, w: int = W, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, longest_words, n_spans): every document and benchmark item that share spans of k + w - 1 words or more, the
    words of the longest and the number of maximal spans.

    A benchmark of up to ``broadcast_bytes`` goes to every task, and documents are scanned once without a shuffle. A larger one is joined with the
    documents' fingerprints in a shuffle, and only pairs that hit are compared. Null or empty texts share nothing; texts shorter than a span neither.
    A null id stays null. Rows that repeat an id are one document: its figures
    are the largest of them. Empty tables give no rows; further columns aren't read.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    if fits(items, broadcast_bytes, "text"):
        rows = items.collect()
        names, index = [r["item_id"] for r in rows], docs.sparkSession.sparkContext.broadcast(Index([r["text"] for r in rows], k, w))

        def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], list[int]] = {}
            for t, item, _, _, n in index.value.spans(batch["text"].to_pylist()):
                found.setdefault((t, item), []).append(n)
            yield _rows(found, batch["doc_id"].to_pylist(), names)

        pairs = arrow_map(docs, scan, _SCHEMA)
    else:

        def prints(name: str):
            def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for first, some in chunks(batch["text"].to_pylist()):
                    values, text, _ = windows(*words(some), k)
                    keep = winnow(values, text, w)
                    yield pa.RecordBatch.from_arrays([batch[name].take(pa.array(text[keep] + first)), pa.array(values[keep].view(np.int64))], [name, "print"])

            return each

        left = arrow_map(docs.where("text is not null"), prints("doc_id"), "doc_id bigint, print bigint")
        right = arrow_map(items, prints("item_id"), "item_id bigint, print bigint").distinct()
        hits = left.join(right, "print").select("doc_id", "item_id").distinct()
        own, other = docs.withColumnRenamed("doc_id", "own"), items.select(F.col("item_id").alias("other"), F.col("text").alias("item_text"))
        both = hits.join(own, F.col("doc_id").eqNullSafe(F.col("own"))).join(other, F.col("item_id").eqNullSafe(F.col("other"))).select("doc_id", "item_id", "text", "item_text")

        def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, names, texts, others = (batch[c].to_pylist() for c in ("doc_id", "item_id", "text", "item_text"))
            found: dict[tuple[int, int], list[int]] = {}
            for i, (text, other) in enumerate(zip(texts, others, strict=True)):
                for *_, n in Index([other], k, w).spans([text]):
                    found.setdefault((i, i), []).append(n)
            yield _rows(found, ids, names)

        pairs = arrow_map(both, compare, _SCHEMA)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("longest_words").alias("longest_words"), F.max("n_spans").alias("n_spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, k: int = K, w: int = W, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs whose text shares no span of k + w - 1 words with a benchmark item, with all their columns.

    A benchmark of up to ``broadcast_bytes`` goes to every task, and rows are dropped where they are read; with a larger one they are joined by a hash of their text. Null and empty texts
    stay, texts of any length are read whole; it is the text that counts, so repeated rows and rows that share an id, or have none, are judged each by itself. An
    empty table stays empty, an empty benchmark drops nothing, further columns of any type are carried along.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    if fits(items, broadcast_bytes, "text"):
        index = docs.sparkSession.sparkContext.broadcast(Index([r["text"] for r in items.select("text").collect()], k, w))

        def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            bad = {found[0] for found in index.value.spans(batch["text"].to_pylist())}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)])) if bad else batch

        return arrow_map(docs, scan, docs.schema)
    key = F.xxhash64("text")
    bad = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, k=k, w=w, broadcast_bytes=broadcast_bytes).select(F.col("doc_id").alias("_contaminated")).distinct()
    return docs.join(bad, key == bad["_contaminated"], "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = f"""
with word_lists as (
  select 'd' side, doc_id id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') ws from documents
  union all select 'b', item_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') from benchmark),
grams as (
  select side, id, p, array_to_string(list_slice(ws, p, p + {K + W - 2}), ' ') g
  from (select side, id, ws, unnest(range(1, len(ws) - {K + W - 2} + 1)) p from word_lists)),
hits as (
  select d.id doc_id, b.id item_id, d.p, d.p - b.p diagonal from grams d join grams b on d.g = b.g where d.side = 'd' and b.side = 'b'),
islands as (
  select doc_id, item_id, diagonal, p - row_number() over (partition by doc_id, item_id, diagonal order by p) island from hits),
spans as (
  select doc_id, item_id, diagonal, island, count(*) + {K + W - 2} n from islands group by all)
select doc_id, item_id, max(n)::bigint longest_words, count(*)::bigint n_spans from spans group by doc_id, item_id
"""
