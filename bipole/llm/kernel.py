"""Vectorised word kernel shared by the text operators: numpy over whole Arrow batches, no per-word Python.

A word is a maximal run of ASCII letters and digits and of any non-ASCII characters, after lower-casing; the same runs come from
the regular expression ``[a-z0-9\\x{80}-\\x{10FFFF}]+`` in SQL. A word's 64-bit polynomial hash does not depend on its place, so texts
are hashed block by block and memory stays bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BLOCK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for slot, base in ((0, _P), (1, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[slot] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(texts: list[str | None], limit: int = _BLOCK) -> Iterator[tuple[int, list[str | None]]]:
    """(index of the first, texts) for runs of texts of about ``limit`` characters; a longer text comes alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t or "") + 1
    if first < len(texts):
        yield first, texts[first:]


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the batch, offsets): text i has the words offsets[i]:offsets[i + 1]. A null text has none."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        while end < len(data) and _WORD[data[end]]:
            end += 1
        h, s = _block_words(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every window of k words that lies in one text, its text, its place in the text)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    power, inverse = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)[:n]
    place = np.arange(n) - offsets[text]
    whole = place + k <= counts[text]
    rolled = mix((sums[k:] - sums[:-k]) * inverse[:n] + np.uint64(k))
    return rolled[whole], text[whole], place[whole]


def least(values: np.ndarray, text: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the rightmost minimum of the w windows from each one on, as far as its text goes; whether all w are there)."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.concatenate([begin, [n]]))
    left = np.repeat(size, size) - (np.arange(n) - np.repeat(begin, size))
    best = np.arange(n)
    low = values.copy()
    reach = 1
    while reach < w:  # doubling: the minimum of 2r windows from the minima of r
        step = min(reach, w - reach)
        other_low, other = low[step:], best[step:]
        better = (other_low <= low[:-step]) & (left[:-step] > step)
        low = np.concatenate([np.where(better, other_low, low[:-step]), low[n - step :]]) if step < n else low
        best = np.concatenate([np.where(better, other, best[:-step]), best[n - step :]]) if step < n else best
        reach += step
    return best, left >= w


def winnow(values: np.ndarray, text: np.ndarray, w: int) -> np.ndarray:
    """Indices that robust winnowing keeps: the rightmost minimum of every run of w consecutive windows of one text; a text with fewer
    windows gives its one minimum."""
    if not len(values):
        return np.zeros(0, np.int64)
    best, whole = least(values, text, w)
    return np.unique(best[whole | np.concatenate([[True], text[1:] != text[:-1]])])
