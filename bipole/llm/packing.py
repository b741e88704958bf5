"""Best-fit packing of documents into training sequences by hierarchical residual packing.

Every input partition packs its own pieces best-fit decreasing and emits the bins that are nearly full. The underfull ones go up a tree as items:
groups of ``fan_in`` neighbouring nodes are merged, their bins packed best-fit again, nearly full ones emitted, until one node is left, which emits all.
Of the bins of a best-fit round at most one is up to half full, and two that are fuller never fit into one. So every round further up puts at most ``fan_in`` such bins into others, each into one: of the
bins of a node that are equally full no more than that a round can ever take anything, and only those beyond go no further. The tree packs as if all went up, while what a node holds is
bounded by the capacity and not by the table. Each round is a written table, so that a lost executor repeats no round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipole.llm.common import Scratch

CAPACITY, CHARS = 2048, 4
FAN_IN, SLACK = 8, 0.02
_ROW = "node bigint, bin_id string, used int, full boolean, doc_ids array<bigint>, pieces array<int>, sizes array<int>"
_ARROW = pa.schema([("node", pa.int64()), ("bin_id", pa.string()), ("used", pa.int32()), ("full", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])


class Bins:
    """Best-fit decreasing: an item goes to the open bin with the least room that holds it. Room sizes are bits of one integer, so the search is a shift."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]

    def add(self, item: int, size: int) -> None:
        fitting = self.mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask ^= 1 << room
        else:
            room, held = self.capacity, []
        held.append(item)
        self.by_room[room - size].append(held)
        self.mask |= 1 << (room - size)

    def closed(self) -> Iterator[tuple[int, list[int]]]:
        for room, bins in enumerate(self.by_room):
            for held in bins:
                yield self.capacity - room, held


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(used, items) of every bin; items of equal size keep their order."""
    bins = Bins(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins.add(i, sizes[i])
    return list(bins.closed())


def _done(bins: list[tuple[int, list[int]]], near: int, up: int | None, alike: int) -> list[bool]:
    """Which bins are done: nearly full, or beyond ``alike`` others that are as full and could take the same; with ``up`` also those that aren't among so many roomiest."""
    roomy = sorted((i for i, (used, _) in enumerate(bins) if used < near), key=lambda i: bins[i][0])
    done, seen = [True] * len(bins), Counter()
    for i in roomy[:up]:
        seen[bins[i][0]] += 1
        done[i] = seen[bins[i][0]] > alike
    return done


def _rounds(nodes: int, fan_in: int) -> int:
    """How many rounds merge so many nodes into one."""
    rounds = 0
    while nodes > 1:
        nodes, rounds = -(-nodes // fan_in), rounds + 1
    return rounds


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_ARROW)], schema=_ARROW)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, chars_per_token: int = CHARS, fan_in: int = FAN_IN, slack: float = SLACK, up: int | None = None, size: F.Column | None = None) -> DataFrame:
    """Rows (bin_id, position, doc_id, piece, token_start, n_tokens): where each piece of each document goes, and which of its tokens it holds.

    A document's tokens are ``size`` (an integer column, such as a tokenizer's count), by default length // chars_per_token + 1, token t being its characters from
    t * chars_per_token; documents of more than ``capacity`` tokens are cut into full pieces and a rest. No bin is over capacity. Null and empty texts and sizes under 1 have no piece; texts of any length are cut, never shortened. Pieces of
    equal size keep the input's order. All bins that a later round can still use go up; ``up`` bounds how many of them a node sends, for a smaller tree whose bins may be less full. Repeated rows are packed each, a null id is packed as null, an empty table gives no rows, further columns aren't read.
    """
    keep = Scratch(docs.sparkSession)
    n = F.length("text")
    items = docs.where(n > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(size, F.lit(0)).cast("int").alias("size") if size is not None else (F.floor(n / chars_per_token) + 1).cast("int").alias("size"), F.spark_partition_id().cast("bigint").alias("node"))
    near, alike = capacity - int(capacity * slack), fan_in * _rounds(2**31, fan_in)  # of as many rounds as partitions can need

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pieces, sizes, rows, node, bins = [], [], [], [], 0, 0
        for batch in batches:
            node = batch["node"][0].as_py() if batch.num_rows else node
            for doc, s in zip(batch["doc_id"].to_pylist(), batch["size"].to_pylist(), strict=True):
                full, rest = divmod(s, capacity)
                for p in range(full):
                    rows.append((node, f"0.{node}.{bins}", capacity, True, [doc], [p], [capacity]))
                    bins += 1
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                if rest:
                    ids.append(doc)
                    pieces.append(full)
                    sizes.append(rest)
        packed = best_fit(sizes, capacity)
        for (used, held), done in zip(packed, _done(packed, near, up, alike), strict=True):
            rows.append((node, f"0.{node}.{bins}", used, done, [ids[i] for i in held], [pieces[i] for i in held], [sizes[i] for i in held]))
            bins += 1
        for at in range(0, len(rows), 5000):
            yield _batch(rows[at : at + 5000])

    def merge(level: int, alike: int):
        def each(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
            bins = bins.sort_values("bin_id").reset_index(drop=True)
            rows = []
            packed = best_fit(bins["used"].tolist(), capacity)
            for n, ((used, held), done) in enumerate(zip(packed, _done(packed, near, up, alike), strict=True)):
                rows.append((key[0], f"{level}.{key[0]}.{n}", used, done, *([x for i in held for x in bins[c][i]] for c in ("doc_ids", "pieces", "sizes"))))
            return pd.DataFrame(rows, columns=_ARROW.names)

        return each

    done = [keep.write(items.where("size > 0").mapInArrow(first, _ROW))]
    level = 0
    while True:
        top = done[-1].agg(F.max(F.when(~F.col("full"), F.col("node"))).alias("m")).first()["m"]
        if not top:
            break
        level += 1
        risen = done[-1].where("not full").withColumn("node", F.floor(F.col("node") / fan_in).cast("bigint"))
        done.append(keep.write(risen.groupBy("node").applyInPandas(merge(level, fan_in * _rounds(top // fan_in + 1, fan_in)), _ROW)))
    out = [d.where("full") for d in done[:-1]] + [done[-1]]
    bins = out[0]
    for d in out[1:]:
        bins = bins.unionByName(d)
    flat = bins.select("bin_id", F.posexplode(F.arrays_zip("doc_ids", "pieces", "sizes")).alias("position", "x"))
    return flat.select("bin_id", "position", F.col("x.doc_ids").alias("doc_id"), F.col("x.pieces").alias("piece"), (F.col("x.pieces").cast("bigint") * capacity).alias("token_start"), F.col("x.sizes").alias("n_tokens"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
