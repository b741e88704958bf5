"""Repeated passages across a corpus by level-wise doubling of word windows.

Level 1 takes windows of ``base`` words at winnowed places (of every ``base + 1`` consecutive windows the least hash). A repeated window of ``2 * base`` words has
its least one at the same place in all its copies, so only windows whose least one repeats are candidates. Every candidate is looked up, and the hashes of unbroken
stretches of candidates are joined to windows of twice the size again and again, as far as the stretch goes. All sizes are looked up at once: the windows of ``2 * base`` words
that repeat give the spans, those of the larger sizes tell how long the longest repeated window of a span is.

Windows are looked up where their hash sends them, packed many to a row, and only places come back; so a window's hash is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipole.llm.common import Scratch, arrow_map
from bipole.llm.kernel import chunks, least, mix, windows, winnow, words

BASE = 25
#: Windows packed or looked up at once; a window in memory takes about 60 bytes.
BLOCK = 2_000_000
#: Bytes of the table, by Spark's estimate, for each part at least, beyond the first eight.
PART = 1 << 18
_ROWS = "part int, groups int, places int, h binary, packed binary"


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0xD1B54A32D192ED03)))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _pack(part: np.ndarray, doc: np.ndarray, level: np.ndarray, pos: np.ndarray, h: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each part: its places as groups of one document and level with the steps between them, compressed, and the hashes as they are."""
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    part, doc, level, pos = part[order], doc[order], level[order], pos[order]
    cut = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]])
    groups, packed = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        d, v, p = doc[a:b], level[a:b], pos[a:b]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
        step = np.diff(p, prepend=np.int32(0))
        step[new] = p[new]
        groups.append(len(new))
        packed.append(pa.compress(_planes(d[new]) + _planes(np.diff(new, append=b - a).astype(np.int32)) + _planes(v[new]) + _planes(step), "zstd", asbytes=True))
    hashes = [None] * len(groups) if h is None else [x.tobytes() for x in np.split(h[order], cut[1:-1])]
    return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(groups, pa.int32()), pa.array(np.diff(cut).astype(np.int32)), pa.array(hashes, pa.binary()), pa.array(packed, pa.binary())], ["part", "groups", "places", "h", "packed"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, level, pos, h) of every row; h is empty where no hashes were sent."""
    for batch in batches:
        for groups, places, h, packed in zip(*(batch[c] for c in ("groups", "places", "h", "packed")), strict=True):
            k, m = groups.as_py(), places.as_py()
            raw, at, parts = pa.decompress(packed.as_buffer(), 13 * k + 4 * m, "zstd"), 0, []
            for n, kind in ((k, np.int64), (k, np.int32), (k, np.uint8), (m, np.int32)):
                width = np.dtype(kind).itemsize
                parts.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
                at += n * width
            doc, count, level, step = parts
            total, new = np.cumsum(step, dtype=np.int64), np.cumsum(count) - count
            pos = total - np.repeat(total[new] - step[new], count)
            yield np.repeat(doc, count), np.repeat(level, count), pos.astype(np.int32), np.frombuffer(h.as_buffer() if h.is_valid else b"", np.uint64)


def _blocks(pieces: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The pieces joined to blocks of at least BLOCK windows; the last may be smaller."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _repeated(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, level, pos) of the windows whose hash occurs at least twice. Of every hash only the first occurrence is held, so a hot one takes no memory."""
    known, firsts, told = np.zeros(0, np.uint64), (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int32)), np.zeros(0, bool)
    for *places, h in blocks:
        order = np.argsort(h)
        new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
        begin = np.flatnonzero(new)
        one, count = order[begin], np.diff(begin, append=len(h))
        at = np.searchsorted(known, h[one])
        old = np.zeros(len(one), bool)
        old[at < len(known)] = known[at[at < len(known)]] == h[one[at < len(known)]]
        late = at[old][~told[at[old]]]
        if len(late):
            yield tuple(x[late] for x in firsts)
        told[at[old]] = True
        many = np.empty(len(h), bool)
        many[order] = np.repeat(old | (count > 1), count)
        if many.any():
            yield tuple(x[many] for x in places)
        where = at[~old]
        known, told = np.insert(known, where, h[one[~old]]), np.insert(told, where, count[~old] > 1)
        firsts = tuple(np.insert(x, where, y[one[~old]]) for x, y in zip(firsts, places, strict=True))


def _thin(doc: np.ndarray, level: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    """Which places to keep: of windows above the first level that follow each other at most their length apart, so in one span, the first alone tells all."""
    keep = np.ones(len(pos), bool)
    gap = np.diff(pos.astype(np.int64))
    keep[1:] = (level[1:] == 0) | (level[1:] != level[:-1]) | (doc[1:] != doc[:-1]) | (gap < 0) | (gap > np.int64(size) << level[1:].astype(np.int64))
    return keep


def _look_up(rows: DataFrame, n: int, size: int) -> DataFrame:
    """The places of repeated windows, packed by document; rows are packed by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in _repeated(_blocks(_unpack(batches))):
            doc, level, pos = (x[_thin(*places, size)] for x in places)
            yield _pack((mix(doc.view(np.uint64)) % np.uint64(n)).astype(np.int64), doc, level, pos)

    return rows.repartitionById(n, "part").mapInArrow(run, _ROWS)


def _by_document(rows: DataFrame, n: int, each: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """each gets the ids of documents and, for every place in them, the index of the document, the level and the position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(doc, level, pos) for doc, level, pos, _ in _unpack(batches)]
        if held:
            doc, level, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, doc = np.unique(doc, return_inverse=True)
            yield from each(ids, doc, level, pos)

    return rows.repartitionById(n, "part").mapInArrow(run, schema)


def repeated_spans(documents: DataFrame, *, base: int = BASE) -> DataFrame:
    """Rows (doc_id, start_word, end_word, longest_words): the maximal unions of windows of 2 * base words that occur at least twice in the table, in other
    documents or in the same, by word (the end is exclusive). longest_words is 2 * base times the largest power of two at which a window inside
    repeats: the largest 2 * base * 2**j that the longest repeated passage in the span holds.

    Null and empty texts, and texts of fewer than 2 * base words, have no spans; texts of any length are read whole. Every occurrence counts, so a repeated row is a
    second occurrence of all of its text; rows that share a doc_id give the union of their spans. Rows with a null doc_id are left out. Empty tables give no
    rows; further columns aren't read.
    """
    size = 2 * base
    keep = Scratch(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    # small tables get fewer parts than the session has; these aren't coalesced
    n = min(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 + int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // PART)

    def anchors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        ids = batch["doc_id"].to_numpy()
        for first, some in chunks(batch["text"].to_pylist()):
            values, text, place = windows(*words(some), base)
            at = winnow(values, text, base + 1)
            yield ids[text[at] + first], np.zeros(len(at), np.uint8), place[at].astype(np.int32), values[at]

    def doubled(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        ids, held = batch["doc_id"].to_numpy(), batch["held"]
        lengths = held.value_lengths().to_numpy()
        marks, owner = held.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
        for first, some in chunks(batch["text"].to_pylist()):
            hashes, offsets = words(some)
            values, text, _ = windows(hashes, offsets, base)
            best, whole = least(values, text, base + 1)
            own = (owner >= first) & (owner < first + len(some))
            at, who = marks[own], owner[own] - first
            fits = at <= np.diff(offsets)[who] - base  # an anchor of another row that shares the id may lie beyond this text
            repeats = np.zeros(len(values), bool)
            repeats[np.searchsorted(text, who[fits]) + at[fits]] = True
            good = repeats[best[whole]]
            values, text, place = windows(hashes, offsets, size)
            # how many candidates follow each other from each one on
            index = np.arange(len(values))
            stop = np.where(good, len(values), index)
            ends = np.flatnonzero(good & np.concatenate([text[1:] != text[:-1], np.ones(min(1, len(text)), bool)]))
            stop[ends] = ends + 1
            run = np.minimum.accumulate(stop[::-1])[::-1] - index
            at, high, level = np.flatnonzero(good), values, 0
            while len(at):
                yield ids[text[at] + first], np.full(len(at), level, np.uint8), place[at].astype(np.int32), high[at]
                half = size << level
                at, level = at[run[at] > 2 * half - size], level + 1
                two = np.zeros(len(values), np.uint64)
                two[at] = _join(high[at], high[at + half])
                high = two

    def sent(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]], n: int) -> DataFrame:
        def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for doc, level, pos, h in _blocks(each(batch)):
                yield _pack((h % np.uint64(n)).astype(np.int64), doc, level, pos, h)

        return arrow_map(df, pack, _ROWS)

    def lists(ids: np.ndarray, doc: np.ndarray, _: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = np.unique(doc << 32 | pos)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.searchsorted(key >> 32, np.arange(len(ids) + 1)).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)))], ["doc_id", "held"])

    def spans(ids: np.ndarray, doc: np.ndarray, level: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = doc << 32 | pos
        flat = np.unique(key[level == 0])
        new = np.concatenate([[True], np.diff(flat) > size])  # another document is further away than any place in one
        begin = flat[new]
        end = flat[np.concatenate([new[1:], [True]])] + size
        owner = np.searchsorted(begin, key, "right") - 1
        top = np.zeros(len(begin), np.uint8)
        np.maximum.at(top, owner, level)
        yield pa.RecordBatch.from_arrays([pa.array(ids[begin >> 32]), pa.array((begin & 0xFFFFFFFF).astype(np.int32)), pa.array((end & 0xFFFFFFFF).astype(np.int32)), pa.array((np.int64(size) << top.astype(np.int64)).astype(np.int32))], ["doc_id", "start_word", "end_word", "longest_words"])

    first = keep.write(_by_document(_look_up(sent(docs, anchors, n), n, size), n, lists, "doc_id bigint, held array<int>"))
    # an anchor stands for about base / 2 candidates at each of a few levels: more parts than the session's if one would get more than a few blocks of them
    n = max(n, (first.agg(F.sum(F.size("held"))).first()[0] or 0) * 2 * base // (4 * BLOCK))
    found = sent(docs.join(first.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "held"), doubled, n)
    return _by_document(_look_up(found, n, size), n, spans, "doc_id bigint, start_word int, end_word int, longest_words int")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def passage_spans(spark, sf_dir: str) -> DataFrame:
    """The spans alone, which SQL can check."""
    return op7_substring_dedup(spark, sf_dir).select("doc_id", F.col("start_word").cast("bigint").alias("start_word"), F.col("end_word").cast("bigint").alias("end_word"))


SPANS_SQL = f"""
with word_lists as (
  select doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') ws from documents where doc_id is not null),
grams as (
  select doc_id, p - 1 p, md5(array_to_string(list_slice(ws, p, p + {2 * BASE - 1}), ' ')) g from (select doc_id, ws, unnest(range(1, len(ws) - {2 * BASE - 1} + 1)) p from word_lists)),
repeats as (
  select distinct doc_id, p from grams where g in (select g from grams group by g having count(*) > 1)),
steps as (
  select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= {2 * BASE} then 0 else 1 end new_span from repeats),
runs as (select doc_id, p, sum(new_span) over (partition by doc_id order by p) run from steps)
select doc_id, min(p)::bigint start_word, (max(p) + {2 * BASE})::bigint end_word from runs group by doc_id, run
"""
