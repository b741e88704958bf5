"""Generation of positive texts: rounds of prompts in parallel, then acceptance as set operations.

In each round one row a batch carries its prompt to a Python stage that calls the model; the replies are written before anything reads them, so that each call happens once.
A candidate is accepted at its first occurrence unless it is an original or was accepted before, and, for synthetic texts, unless it shares a verbatim span
with a positive original; the first that are still wanted are kept.
"""

from __future__ import annotations

import json
import logging
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bipole.functions.columns import MIN_SPAN, NEGATIVE, POSITIVE, numbered, seeded
from bipole.operators import pools
from bipole.operators.backends import BackendFactory, token_counter
from bipole.operators.similarity import verbatim_spans
from bipole.operators.structured import HARD_POSITIVE, SYNTHETIC, complete_structured, json_schema
from bipole.sources.tables import materialise

TEMPLATE_TOKENS = 500


def listing(texts: list[str]) -> str:
    return "\n".join(f"{i}. {t}" for i, t in enumerate(texts, 1)) or "(none)"


def system_message(kind: T.StructType) -> str:
    task = "write new texts that belong to the positive pole although they look close to the negative one" if kind is HARD_POSITIVE else "write new texts in the manner of the positive pole without repeating any example's facts or wording"
    return f"First describe what marks the examples, then {task}. Reply with JSON of this schema only:\n{json.dumps(json_schema(kind))}"


def user_message(positive: list[str], negative: list[str] | None, count: int, language: str | None = None) -> str:
    """Synthetic prompts pass None for the negatives, which they never show."""
    parts = [f"Positive examples:\n{listing(positive)}"]
    if negative is not None:
        parts.append(f"Negative examples:\n{listing(negative)}")
    parts.append(f"Count: {count}")
    if language:
        parts.append(f"Write in {language}.")
    return "\n\n".join(parts)


def accept(candidates: DataFrame, originals: DataFrame, accepted: DataFrame | None, remaining: int | None, *, positives: DataFrame | None = None, deduplicate: bool = True, min_span: int = MIN_SPAN) -> DataFrame:
    """Of candidates (batch, item, text), those accepted, at most the first ``remaining`` in their order. Without ``deduplicate`` only the number counts - the verbatim
    check is off as well. Null texts are rejected."""
    rows = candidates.where("text is not null")
    if deduplicate:
        first = Window.partitionBy("text").orderBy("batch", "item")
        rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").join(originals.select("text"), "text", "left_anti")
        if accepted is not None:
            rows = rows.join(accepted.select("text"), "text", "left_anti")
        if positives is not None:
            keyed = rows.withColumn("key", F.col("batch") * (1 << 20) + F.col("item"))
            leaked = verbatim_spans(keyed.select("key", "text"), positives, "key", min_span).select("key")
            rows = keyed.join(leaked, "key", "left_anti").drop("key")
    rows = rows.select("batch", "item", "text")
    return rows if remaining is None else rows.orderBy("batch", "item").limit(max(0, remaining))


@dataclass
class _Sampler:
    backend: BackendFactory
    n_synthesized: int | None = None
    batch_size: int = 3
    max_tokens: int = 1024
    temperature: float = 1.0
    context_limit: int = 100_000
    max_examples: int | None = None
    language: str | None = None
    deduplicate: bool = True
    min_verbatim_span: int = MIN_SPAN
    method: str = "random"
    pos_label: object = None
    seed: int = 0
    logger: logging.Logger | None = None
    kind = HARD_POSITIVE
    shows_negatives = True

    def _validate(self) -> None:
        for name in ("batch_size", "max_tokens", "context_limit"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.n_synthesized is not None and self.n_synthesized < 0:
            raise ValueError("n_synthesized must not be negative")
        if self.temperature < 0:
            raise ValueError("temperature must not be negative")
        if self.max_examples is not None and self.max_examples < 1:
            raise ValueError("max_examples must be at least 1")
        if self.min_verbatim_span < 1:
            raise ValueError("min_verbatim_span must be at least 1")
        if self.method not in ("random", "kmeans", "votek"):
            raise ValueError("sample method must be random, kmeans or votek")

    def _chosen(self, examples: DataFrame, budget: int, first: int, batches: int) -> DataFrame:
        """(batch, side, pos, text) of what the prompts show: each batch shuffles the examples by a seed of its own, takes what fits, and evens the sides out."""
        own = F.lit(self.seed * 1_000_003) + F.col("batch")
        numbers = examples.sparkSession.range(first, first + batches).withColumnRenamed("id", "batch")
        rows = examples.select("side", "pos", "text").crossJoin(F.broadcast(numbers))  # a row for each prompt that is asked for
        tokens = token_counter(self.backend)(F.col("text"))
        chosen = pools.trim_to_budget(rows, budget, seeded(own, F.col("side"), F.col("pos")), tokens, k=self.max_examples, by=("batch", "side")).drop("rank")
        return pools.balance(chosen, own, by=("batch",)) if self.shows_negatives else chosen

    def _examples(self, pool: DataFrame, budget: int, batch: int) -> tuple[list[str], list[str]]:
        """What the prompt of one batch shows, to look at."""
        rows = self._chosen(self._representatives(pool, budget), budget, batch, 1).orderBy("pos").collect()
        return [r["text"] for r in rows if r["side"] == POSITIVE], [r["text"] for r in rows if r["side"] == NEGATIVE]

    def _prompts(self, examples: DataFrame, budget: int, first: int, batches: int, count: int) -> DataFrame:
        """(batch, system, user) of all prompts of a round, built in one job."""
        numbers = examples.sparkSession.range(first, first + batches).withColumnRenamed("id", "batch")
        chosen = self._chosen(examples, budget, first, batches)

        def shown(side: str) -> F.Column:
            return F.coalesce(numbered(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "text")))), lambda x: x["text"])), F.lit("(none)"))

        told = chosen.groupBy("batch").agg(shown(POSITIVE).alias("p"), shown(NEGATIVE).alias("n"))
        said = numbers.join(told, "batch", "left").select("batch", *[F.coalesce(c, F.lit("(none)")).alias(c) for c in "pn"])
        parts = [F.concat(F.lit("Positive examples:\n"), "p"), *([F.concat(F.lit("Negative examples:\n"), "n")] if self.shows_negatives else []), F.lit(f"Count: {count}"), *([F.lit(f"Write in {self.language}.")] if self.language else [])]
        return said.select("batch", F.lit(system_message(self.kind)).alias("system"), F.concat_ws("\n\n", *parts).alias("user"))

    def _representatives(self, shown: DataFrame, budget: int) -> DataFrame:
        """What prompts draw their examples from: all texts, or of each side those that K-Means or Vote-K stand for."""
        if self.method == "random":
            return shown
        first, *more = [sample_group(shown.where(F.col("side") == side), budget, self.method, self.seed * 1_000_003).select("side", "pos", "text") for side in ([POSITIVE, NEGATIVE] if self.shows_negatives else [POSITIVE])]
        return materialise(first.unionByName(more[0]) if more else first)

    def fit_resample(self, df: DataFrame) -> DataFrame:
        """df (pos, text, label) with the accepted texts added under the positive label: pos goes on from the largest, is_generated tells them apart."""
        self._validate()
        spark = df.sparkSession
        classes = pools.resolve_labels(df, pos_label=self.pos_label)
        pool = pools.make_pool(df, pos_label=classes[1])
        if self.method != "random":
            if "embedding" not in df.columns:
                raise ValueError("kmeans and votek need a column embedding")
            pool = pool.join(df.select("pos", "embedding"), "pos")
        sizes = {r["side"]: r["n"] for r in pool.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
        target = self.n_synthesized if self.n_synthesized is not None else max(0, sizes.get(NEGATIVE, 0) - sizes.get(POSITIVE, 0))
        base = df.select("pos", "text", "label", F.lit(False).alias("is_generated"))
        self.result_ = {f.name: [] for f in self.kind}
        if target == 0:
            return base
        room = self.context_limit - TEMPLATE_TOKENS - self.max_tokens
        budget = room // 2 if self.shows_negatives else room
        shortest = pool.select("side", token_counter(self.backend)(F.col("text")).alias("c")).groupBy("side").agg(F.min("c").alias("n")).where(F.lit(self.shows_negatives) | (F.col("side") == POSITIVE)).agg(F.max("n")).first()[0]
        if budget < shortest:
            raise ValueError("context_limit leaves no room for an example of each side")
        most, used, done, failed = max(target, math.ceil(target / self.batch_size) * 3), 0, 0, False
        accepted: DataFrame | None = None
        factory, kind, options = self.backend, self.kind, {"temperature": self.temperature, "max_tokens": self.max_tokens}
        texts_of = kind.names[-1]
        examples = self._representatives(pool if self.shows_negatives else pool.where(F.col("side") == POSITIVE), budget)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = factory.get()
            for b in batches:
                rows = []
                for n, system, user in zip(b["batch"], b["system"], b["user"], strict=True):
                    try:
                        rows.append((n, json.dumps(complete_structured(model, system, user, kind, **options)), None))
                    except Exception as e:  # noqa: BLE001 - a failed batch uses up its turn and is told about
                        rows.append((n, None, repr(e)))
                yield pd.DataFrame(rows, columns=["batch", "reply", "error"])

        while done < target and used < most:
            batches = min(math.ceil((target - done) / self.batch_size), most - used)
            asked = self._prompts(examples, budget, used, batches, min(self.batch_size, target - done)).repartition(min(batches, 64))
            replies = materialise(asked.mapInPandas(run, "batch bigint, reply string, error string"))
            used += batches
            for e in replies.where("error is not null").orderBy("batch").limit(1).collect():
                if not failed:
                    warnings.warn(f"a batch failed: {e['error']}", stacklevel=2)
                    failed = True
            read = replies.where("reply is not null").select("batch", F.from_json("reply", kind).alias("r"))
            for r in read.orderBy("batch").select("r").collect():
                for name in kind.names[:-1]:
                    self.result_[name] += [x.asDict() if isinstance(x, T.Row) else x for x in r["r"][name]]
            items = read.select("batch", F.posexplode(F.col(f"r.{texts_of}")).alias("item", "x")).select("batch", F.col("item").cast("bigint").alias("item"), F.col("x.text").alias("text"))
            new = materialise(accept(items, df, accepted, target - done, positives=None if self.shows_negatives else pool.where(F.col("side") == POSITIVE), deduplicate=self.deduplicate, min_span=self.min_verbatim_span))
            got = new.count()
            done += got
            accepted = new if accepted is None else accepted.unionByName(new)
            self.result_[texts_of] += [r["text"] for r in new.orderBy("batch", "item").collect()]
            if self.logger:
                self.logger.debug("round of %d batches: %d accepted, %d of %d", batches, got, done, target)
        if done < target:
            warnings.warn(f"only {done} of {target} texts were generated", stacklevel=2)
        last = df.agg(F.max("pos")).first()[0]
        numbered = accepted.select("text", F.row_number().over(Window.orderBy("batch", "item")).alias("n"))  # as many rows as were asked for
        added = numbered.select((F.col("n") + last).cast(df.schema["pos"].dataType).alias("pos"), "text", F.lit(classes[1]).cast(df.schema["label"].dataType).alias("label"), F.lit(True).alias("is_generated"))
        return base.unionByName(added)

    def save(self, spark: SparkSession, path: str) -> None:
        if not hasattr(self, "result_"):
            raise RuntimeError("fit first")
        spark.createDataFrame([(json.dumps(self.result_),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    def load_result(self, spark: SparkSession, path: str) -> dict:
        self.result_ = json.loads(spark.read.text(path).first()[0])
        return self.result_


@dataclass
class OverSampler(_Sampler):
    """Positive texts near the border; without n_synthesized as many as make the classes even."""


@dataclass
class SyntheticSampler(_Sampler):
    """New positive texts that share no verbatim span with the originals; n_synthesized is required."""

    kind = SYNTHETIC
    shows_negatives = False
    required: bool = field(default=True, repr=False)

    def _validate(self) -> None:
        if self.n_synthesized is None:
            raise ValueError("n_synthesized is required")
        super()._validate()


def sample_group(pool: DataFrame, budget: int, method: str = "random", seed: int = 0) -> DataFrame:
    """Representatives of a pool under a token budget: random, or K-Means or Vote-K on its column ``embedding``, in their order, then trimmed."""
    from bipole.operators.represent import kmeans_representatives, vote_k

    if method == "random":
        return pools.trim_to_budget(pool, budget, seeded(seed, F.col("side"), F.col("pos"))).drop("rank")
    if method not in ("kmeans", "votek"):
        raise ValueError("sample method must be random, kmeans or votek")
    n = max([r["n"] for r in pools.estimate_count(pool, budget).collect()] or [0])
    chosen = kmeans_representatives(pool, n, seed) if method == "kmeans" else vote_k(pool, n)
    if not chosen:
        return pool.limit(0)
    place = F.array_position(F.array(*[F.lit(c).cast("bigint") for c in chosen]), F.col("pos"))
    return pools.trim_to_budget(pool.where(F.col("pos").isin(chosen)), budget, F.lpad(place.cast("string"), 12, "0")).drop("rank")
