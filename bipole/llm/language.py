"""Language identification by hierarchical discrimination.

One-versus-rest linear support vector machines first tell the language family; within it, one-versus-one machines for each pair of its
languages vote. Features are relative frequencies of hashed letter trigrams (bytes, lower case, everything but letters as one space). The machines
are trained here by dual coordinate descent on a bounded sample of the labelled rows; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipole.llm.common import arrow_map
from bipole.llm.kernel import chunks

DIM = 4096
SAMPLE = 2000
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance", "ru": "slavic", "uk": "slavic", "bg": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic"}
_PIECE = 1 << 20
_LETTER = np.full(256, 32, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hashed trigram) of trigrams with a letter, for blocks of the texts; pieces of very long texts overlap by two characters."""
    pieces: list[str] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), _PIECE):
            pieces.append(t[max(0, at - 2) : at + _PIECE])
            owner.append(i)
    for first, some in chunks(pieces):
        raw = [b" " + p.lower().encode("utf-8", "surrogatepass") + b"  " for p in some]
        data = _LETTER[np.frombuffer(b"".join(raw), np.uint8)]
        own = np.repeat(np.array(owner[first : first + len(some)]), [len(r) for r in raw])
        a, b, c = data[:-2], data[1:-1], data[2:]
        real = (b != 32) & (own[2:] == own[:-2])
        yield own[:-2][real], (((a * np.uint32(2654435761)) ^ (b * np.uint32(2246822519)) ^ (c * np.uint32(3266489917))) >> np.uint32(7))[real] % DIM


def features(texts: list[str]) -> np.ndarray:
    """Scaled relative trigram frequencies with a constant, one row a text."""
    x = np.zeros((len(texts), DIM + 1), np.float32)
    for own, gram in _grams(texts):
        np.add.at(x, (own, gram), 1)
    x[:, :DIM] *= 20 / np.maximum(1, x[:, :DIM].sum(1, keepdims=True))
    x[:, DIM] = 1
    return x


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of an L1-loss linear support vector machine by dual coordinate descent (labels 1 and -1)."""
    w, alpha, norm = np.zeros(x.shape[1], np.float32), np.zeros(len(y)), (x * x).sum(1)
    for order in (np.random.default_rng(seed + e).permutation(len(y)) for e in range(epochs)):
        for i in order:
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / norm[i], 0), c)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class Model:
    """families, their languages, and the stacked weights: one machine a family, then one a pair of languages within a family."""

    def __init__(self, texts: list[str], langs: list[str], families: dict[str, str]):
        names = sorted(set(langs))
        self.families = sorted({families.get(n, n) for n in names})
        self.members = [[n for n in names if families.get(n, n) == f] for f in self.families]
        x, lang = features(texts) if texts else np.zeros((0, DIM + 1), np.float32), np.array(langs)
        family = np.array([families.get(n, n) for n in langs])
        rows = [train_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs: list[list[tuple[int, int, int]]] = []
        for members in self.members:
            own = []
            for a, b in combinations(range(len(members)), 2):
                some = np.isin(lang, [members[a], members[b]])
                own.append((a, b, len(rows)))
                rows.append(train_svm(x[some], np.where(lang[some] == members[a], 1.0, -1.0)))
            self.pairs.append(own)
        self.weights = np.array(rows, np.float32).reshape(len(rows), DIM + 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str | None], list[str | None], np.ndarray, np.ndarray]:
        """(family, language, margin, letters) of each text; the margin is the lesser of the family's and the language's."""
        sums, letters = np.zeros((len(self.weights), len(texts))), np.zeros(len(texts), np.int64)
        for own, gram in _grams(texts):
            if len(own):
                begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                letters[own[begin]] += np.diff(np.concatenate([begin, [len(own)]]))
                for j, w in enumerate(self.weights):
                    sums[j, own[begin]] += np.add.reduceat(w[gram], begin)
        score = sums * 20 / np.maximum(1, letters) + self.weights[:, DIM:]
        fams, langs, margins = [], [], np.zeros(len(texts))
        for i in range(len(texts)):
            if not letters[i] or not self.families:
                fams.append(None)
                langs.append(None)
                continue
            f, margin = 0, np.inf
            if len(self.families) > 1:
                top = np.argsort(-score[: len(self.families), i], kind="stable")
                f, margin = int(top[0]), float(score[top[0], i] - score[top[1], i]) / 2
            votes, won = np.zeros(len(self.members[f])), np.zeros(len(self.members[f]))
            for a, b, j in self.pairs[f]:
                s = float(score[j, i])
                votes[a if s >= 0 else b] += 1
                won[a] += s
                won[b] -= s
            best = int(np.lexsort((-won, -votes))[0])
            if self.pairs[f]:
                margin = min(margin, min(abs(float(score[j, i])) for a, b, j in self.pairs[f] if best in (a, b)))
            fams.append(self.families[f])
            langs.append(self.members[f][best])
            margins[i] = min(margin, 1e6)
        return fams, langs, margins, letters


def fit(labelled: DataFrame, *, sample: int = SAMPLE, families: dict[str, str] | None = None) -> Model:
    """Train on at most ``sample`` rows of (doc_id, text, lang) without nulls: those with the least hash of their id and text length."""
    rows = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    key = F.xxhash64("doc_id", F.length("text"))
    ids = [r["key"] for r in rows.select(key.alias("key")).orderBy("key").limit(sample).collect()]
    if not ids:
        return Model([], [], families or FAMILIES)
    chosen = rows.where(key <= ids[-1]).select("text", "lang", key.alias("key")).orderBy("key").limit(sample).collect() if len(ids) == sample else rows.select("text", "lang", key.alias("key")).orderBy("key").collect()
    return Model([r["text"] for r in chosen], [r["lang"] for r in chosen], families or FAMILIES)


#: A text is rejected with fewer letter trigrams than this, or if its margin is less: nothing then speaks for any of the languages.
MIN_LETTERS, MIN_MARGIN = 2, 0.02


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, family, lang, margin, accepted), one for each row of docs.

    Null and empty texts, and texts without letters, have null family and language and aren't accepted; nor are texts of fewer than MIN_LETTERS
    letters or with a margin under MIN_MARGIN. Very long texts are scored whole, piece by piece. Votes that tie go to the language with the larger summed score.
    Repeated rows give repeated results, a null id stays null, an empty table gives no rows, and further columns aren't read. Without labelled rows to
    train on, no text has a language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fams, langs, margins, letters = held.value.predict(batch["text"].to_pylist())
        accepted = [x is not None and n >= MIN_LETTERS and m >= MIN_MARGIN for x, n, m in zip(langs, letters, margins, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fams, pa.string()), pa.array(langs, pa.string()), pa.array(margins, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "family", "lang", "margin", "accepted"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), each, "doc_id bigint, family string, lang string, margin double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text identify() accepts. Everything else of a row is left as it is."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, langs, margins, letters = held.value.predict(batch["text"].to_pylist())
        yield batch.filter(pa.array([x is not None and n >= MIN_LETTERS and m >= MIN_MARGIN for x, n, m in zip(langs, letters, margins, strict=True)], pa.bool_()))

    return arrow_map(docs, each, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
