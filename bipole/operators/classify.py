"""Few-shot classification: exemplars chosen under a budget, a model's label scores, calibration, prediction and metrics."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipole.functions import columns as C
from bipole.operators import pools
from bipole.operators.backends import CHOICES, COMPLETION_TOKENS, BackendFactory, complete_all, score_all, token_counter
from bipole.operators.pools import BudgetSelector, Selector
from bipole.operators.similarity import DiversitySelector, NearestSelector


def metrics(predicted: DataFrame, positive, truth: str = "truth", guess: str = "prediction", p_positive: str = "p_positive") -> DataFrame:
    """One row: n, accuracy, precision, recall and F1 of both sides (0 where undefined), mean confidence of the prediction. Three sums, one pass."""
    t, g, p = F.col(truth) == F.lit(positive), F.col(guess) == F.lit(positive), F.col(p_positive)
    counts = predicted.agg(F.count(F.lit(1)).alias("n"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"), F.avg(F.greatest(p, 1 - p)).alias("confidence"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = [F.col("n"), ratio(tp + tn, F.col("n")).alias("accuracy")]
    for side, hit, wrong, missed in (("positive", tp, fp, fn), ("negative", tn, fn, fp)):
        out += [ratio(hit, hit + wrong).alias(f"precision_{side}"), ratio(hit, hit + missed).alias(f"recall_{side}"), ratio(2 * hit, 2 * hit + wrong + missed).alias(f"f1_{side}")]
    return counts.select(*out, F.coalesce("confidence", F.lit(0.0)).alias("mean_confidence"))


def confusion(predicted: DataFrame, labels: list, truth: str = "truth", guess: str = "prediction") -> DataFrame:
    """(truth, prediction, n) for all pairs of the two labels, zeros too."""
    spark = predicted.sparkSession
    kind = predicted.schema[truth].dataType.simpleString()
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"truth {kind}, prediction {kind}")
    n = predicted.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass
class PromptClassifier:
    """fit(df) takes (pos, text, label); predict_proba and predict take (query_id, text).

    A static selector's exemplars are chosen once and shared by all queries; a query-aware one chooses for each. Every text is scored once: the model runs in one
    mapInPandas, and all arithmetic on its scores is columns.
    """

    backend: BackendFactory
    selector: Selector | None = None
    max_exemplars: int | None = None
    context_limit: int = 100_000
    temperature: float = 0.0
    calibrate: bool = True
    pos_label: object = None
    seed: int = 0
    classes_: tuple = field(default=(), init=False)
    prefix_: str | None = field(default=None, init=False)
    free_positive_: float | None = field(default=None, init=False)

    def fit(self, df: DataFrame) -> PromptClassifier:
        self.classes_ = pools.resolve_labels(df, pos_label=self.pos_label)
        self.pool_ = pools.make_pool(df, pos_label=self.classes_[1])
        scoring = self.backend.can("score_choices") or self.backend.can("score_choices_batch")
        reserve = max(len(c) // 4 + 1 for c in CHOICES) if scoring else COMPLETION_TOKENS
        count = token_counter(self.backend)
        self.budget_ = pools.class_budget(self.pool_, self.context_limit, reserve, count)
        self.scoring_ = scoring
        if not (self.selector and self.selector.query_aware):
            selector = self.selector or BudgetSelector(self.budget_, self.seed, count)
            chosen = selector.select(self.pool_, self.max_exemplars if self.max_exemplars is not None else 2**31 - 1)
            even = pools.balance(pools.trim_to_budget(chosen.select("pos", "side", "text"), self.budget_, tokens=count(F.col("text"))).drop("rank"), self.seed)
            self.exemplars_ = even
            row = prefix_of(even).first()
            self.prefix_ = row["prefix"] if row else ""
            if not self.prefix_:
                warnings.warn("one side has no exemplars: the prompt is zero-shot", stacklevel=2)
            if scoring and self.calibrate:
                prefix, backend = self.prefix_, self.backend

                def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # in a task, where models live
                    for b in batches:
                        if len(b):
                            yield pd.DataFrame(score_all(backend.get(), prefix, ["Text: \nLabel:"]), columns=["p", "n"])

                free = df.sparkSession.range(1).coalesce(1).mapInPandas(run, "p double, n double")
                self.free_positive_ = free.select(C.softmax_positive(F.col("p"), F.col("n")).alias("x")).first()["x"]
        return self

    def predict_proba(self, queries: DataFrame) -> DataFrame:
        """(query_id, p_negative, p_positive) of every query."""
        if not self.classes_:
            raise RuntimeError("fit first")
        if self.prefix_ is not None:
            return self._static(queries)
        if self.backend.can("score_choices_batch"):
            warnings.warn("a query-aware selector gives each query its own prefix, so that none is shared in a batch", stacklevel=2)
        return self._dynamic(queries)

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, prediction, p_positive); ties are negative."""
        neg, pos = self.classes_
        return self.predict_proba(queries).select("query_id", C.predicted(F.col("p_positive"), pos, neg).alias("prediction"), "p_positive")

    def _static(self, queries: DataFrame) -> DataFrame:
        prefix, backend, scoring, options = self.prefix_, self.backend, self.scoring_, {"temperature": self.temperature, "max_tokens": COMPLETION_TOKENS}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = backend.get()
            for b in batches:
                tails = [f"Text: {t}\nLabel:" for t in b["text"]]
                if scoring:
                    s = score_all(model, prefix, tails)
                    yield pd.DataFrame({"query_id": b["query_id"], "s_positive": [float(x[0]) for x in s], "s_negative": [float(x[1]) for x in s], "raw": None})
                else:
                    yield pd.DataFrame({"query_id": b["query_id"], "s_positive": None, "s_negative": None, "raw": complete_all(model, [prefix + t for t in tails], **options)})

        scores = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "text").mapInPandas(run, "query_id bigint, s_positive double, s_negative double, raw string")
        if scoring:
            p = C.softmax_positive(F.col("s_positive"), F.col("s_negative"))
            if self.calibrate and self.free_positive_ is not None:
                p = C.calibrated(p, F.lit(self.free_positive_))
        else:
            p = C.completion_probability(C.parsed_label(F.col("raw")))
        return scores.select("query_id", (1 - p).alias("p_negative"), p.alias("p_positive"))

    def _dynamic(self, queries: DataFrame) -> DataFrame:
        k = self.max_exemplars if self.max_exemplars is not None else 5
        chosen = self.selector.select(self.pool_, k, queries.select(F.col("query_id").cast("bigint").alias("query_id"), "text"))
        # trim and balance each query's exemplars: side and query make the group of the fold
        rows = chosen.select("query_id", "pos", "side", "text").withColumn("c", token_counter(self.backend)(F.col("text"))).where(F.col("c") <= self.budget_)
        fold = F.expr(f"aggregate(xs, named_struct('t', 0L, 's', cast(array() as array<struct<pos:bigint,text:string>>)), (acc, x) -> if(acc.t + x.c <= {self.budget_}L, named_struct('t', acc.t + x.c, 's', array_append(acc.s, struct(x.pos, x.text))), acc)).s")
        sides = rows.groupBy("query_id", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "c", "text"))).alias("xs")).select("query_id", "side", fold.alias("xs"))
        both = sides.groupBy("query_id").agg(F.first(F.when(F.col("side") == C.POSITIVE, F.col("xs")), True).alias("p"), F.first(F.when(F.col("side") == C.NEGATIVE, F.col("xs")), True).alias("n"))
        m = F.least(F.size("p"), F.size("n"))
        order = lambda xs, side: F.expr(f"transform(slice(array_sort(transform({xs}, x -> struct(md5(concat_ws(':', '{self.seed}', '{side}', cast(x.pos as string))) as k, x.pos as pos, x.text as text))), 1, greatest(0, least(size(p), size(n)))), y -> struct(y.pos as pos, y.text as text))")
        texts = lambda c: F.transform(F.array_sort(c), lambda x: x["text"])
        prefix = both.where(m > 0).select("query_id", C.exemplar_prefix(texts(order("p", C.POSITIVE)), texts(order("n", C.NEGATIVE))).alias("prefix"))
        asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "text").join(prefix, "query_id", "left").select("query_id", "text", F.coalesce("prefix", F.lit("")).alias("prefix"))
        backend, scoring, options = self.backend, self.scoring_, {"temperature": self.temperature, "max_tokens": COMPLETION_TOKENS}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = backend.get()
            for b in batches:
                rows = []
                for q, text, pre in zip(b["query_id"], b["text"], b["prefix"], strict=True):
                    if scoring:  # the empty query goes along under the same prefix
                        (p, n), (fp, fn) = score_all(model, pre, [f"Text: {text}\nLabel:", "Text: \nLabel:"])
                        rows.append((q, p, n, fp, fn, None))
                    else:
                        rows.append((q, None, None, None, None, complete_all(model, [f"{pre}Text: {text}\nLabel:"], **options)[0]))
                yield pd.DataFrame(rows, columns=["query_id", "p", "n", "fp", "fn", "raw"])

        scores = asked.mapInPandas(run, "query_id bigint, p double, n double, fp double, fn double, raw string")
        if scoring:
            p = C.softmax_positive(F.col("p"), F.col("n"))
            p = C.calibrated(p, C.softmax_positive(F.col("fp"), F.col("fn"))) if self.calibrate else p
        else:
            p = C.completion_probability(C.parsed_label(F.col("raw")))
        return scores.select("query_id", (1 - p).alias("p_negative"), p.alias("p_positive"))

    def copy(self, **changes) -> PromptClassifier:
        """One that isn't fitted, with the same parameters but for the changes; it shares the backend."""
        return replace(self, **changes)

    def save(self, path: str) -> None:
        """Pool and exemplars as Parquet, the selector's kind and the rest as JSON beside them; the backend isn't saved."""
        self.pool_.write.mode("overwrite").parquet(f"{path}/pool")
        if self.prefix_ is not None:
            self.exemplars_.write.mode("overwrite").parquet(f"{path}/exemplars")
        kind = type(self.selector).__name__ if self.selector else None
        own = bool(kind in _SELECTORS and not getattr(self.selector, "similarity_fn", None))
        state = {"classes": list(self.classes_), "prefix": self.prefix_, "free": self.free_positive_, "budget": self.budget_, "scoring": self.scoring_, "max_exemplars": self.max_exemplars, "context_limit": self.context_limit, "temperature": self.temperature, "seed": self.seed, "query_aware": self.prefix_ is None, "selector": kind, "rebuilt": own}
        spark = self.pool_.sparkSession
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str, backend: BackendFactory, selector: Selector | None = None, calibrate: bool = True) -> PromptClassifier:
        """A classifier as it was saved. A query-aware selector that can't be made again from its kind - one of a custom function - has to be given, else it is a ValueError."""
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        if selector is None and state["rebuilt"]:
            selector = _SELECTORS[state["selector"]]()
        if state["query_aware"] and not (selector and selector.query_aware):
            raise ValueError(f"saved with the query-aware selector {state['selector']}: give one to load it with")
        own = cls(backend, selector, state["max_exemplars"], state["context_limit"], state["temperature"], calibrate, None, state["seed"])
        own.classes_, own.prefix_, own.free_positive_, own.budget_, own.scoring_ = tuple(state["classes"]), state["prefix"], state["free"] if calibrate else None, state["budget"], state["scoring"]
        own.pool_ = spark.read.parquet(f"{path}/pool")
        if own.prefix_ is not None:
            own.exemplars_ = spark.read.parquet(f"{path}/exemplars")
        return own


#: Selectors that are made again without arguments; a static one isn't asked again after loading.
_SELECTORS = {"NearestSelector": NearestSelector, "DiversitySelector": DiversitySelector}


def prefix_of(exemplars: DataFrame) -> DataFrame:
    """One row, prefix: the exemplars (pos, side, text) of both sides in turn."""
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "text")))), lambda x: x["text"])
    return exemplars.agg(side(C.POSITIVE).alias("p"), side(C.NEGATIVE).alias("n")).select(C.exemplar_prefix(F.col("p"), F.col("n")).alias("prefix"))
