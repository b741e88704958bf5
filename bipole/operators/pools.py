"""Labels, pools, selection under budgets, balance and sampling. A pool is a DataFrame (pos, side, text); pos is unique and orders it."""

from __future__ import annotations

from collections.abc import Callable
from numbers import Real

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bipole.functions.columns import NEGATIVE, POSITIVE, seeded, token_count


def resolve_labels(df: DataFrame, label: str = "label", pos_label=None) -> tuple:
    """(negative, positive) of a column with exactly two values: pos_label is positive if given, else the greater of two numbers, else "positive" of
    "positive" and "negative". Nulls and anything else raise ValueError."""
    values = [r[0] for r in df.select(label).distinct().limit(4).collect()]
    if None in values:
        raise ValueError("labels must not be null")
    if len(values) != 2:
        raise ValueError(f"exactly two distinct labels are needed, found {len(values)}")
    if pos_label is not None:
        if pos_label not in values:
            raise ValueError("pos_label is not among the labels")
        return next(v for v in values if v != pos_label), pos_label
    if all(isinstance(v, Real) for v in values):
        return min(values), max(values)
    if set(values) == {POSITIVE, NEGATIVE}:
        return NEGATIVE, POSITIVE
    raise ValueError("give pos_label: which label is positive can't be told")


def make_pool(df: DataFrame, text: str = "text", label: str = "label", pos: str = "pos", pos_label=None) -> DataFrame:
    """(pos, side, text) of labelled rows; null texts raise when read."""
    _, positive = resolve_labels(df, label, pos_label)
    checked = F.when(F.col(text).isNull(), F.raise_error(F.lit("text must not be null")).cast("string")).otherwise(F.col(text))
    return df.select(F.col(pos).cast("bigint").alias("pos"), F.when(F.col(label) == F.lit(positive), POSITIVE).otherwise(NEGATIVE).alias("side"), checked.alias("text"))


def random_select(pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k random rows of each side, all if it has no more, none for k < 1."""
    order = Window.partitionBy("side").orderBy(seeded(seed, F.col("side"), F.col("pos")), "pos")
    return pool.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def trim_to_budget(pool: DataFrame, budget: int, order: Column | None = None, tokens: Column | None = None, k: int | None = None, by: tuple[str, ...] = ("side",)) -> DataFrame:
    """Of each side (or each group of ``by``), in the order given, every row that still fits: one that doesn't is skipped, not the end. Rows over the whole budget are left out
    before. Of rows of one cost those taken are the first ones, since what doesn't fit once never fits later; so of each cost only as many as fill the budget (or k) are gathered
    into the fold's one array a group, whose size depends on the budget and not on the table."""
    cost = tokens if tokens is not None else token_count(F.col("text"))
    key = order if order is not None else F.lit("")
    rows = pool.withColumn("_c", cost.cast("bigint")).where(F.col("_c") <= budget)
    if k is not None and k <= 0:
        return pool.limit(0)
    same = Window.partitionBy(*by, "_c").orderBy("_o", "pos")
    most = F.when(F.col("_c") > 0, F.floor(F.lit(int(budget)) / F.col("_c"))).otherwise(F.lit(2**31 - 1))
    rows = rows.select(*by, "pos", "_c", key.alias("_o")).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most)
    if k is not None:
        rows = rows.where(F.col("_n") <= int(k))
    items = F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("pos"), F.col("_c").alias("c"))))
    full = "true" if k is None else f"size(acc.s) < {int(k)}"
    fold = F.expr(f"aggregate(xs, named_struct('t', 0L, 's', cast(array() as array<bigint>)), (acc, x) -> if(acc.t + x.c <= {int(budget)} and {full}, named_struct('t', acc.t + x.c, 's', array_append(acc.s, x.pos)), acc)).s")
    chosen = rows.groupBy(*by).agg(items.alias("xs")).select(*by, F.posexplode(fold).alias("rank", "pos"))
    return pool.join(chosen, [*by, "pos"]).select(*pool.columns, "rank")


def budget_select(pool: DataFrame, budget: int, k: int | None = None, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """trim_to_budget over a seeded shuffle of each side, k rows at most."""
    if budget <= 0:
        raise ValueError("token_budget must be positive")
    return trim_to_budget(pool, budget, seeded(seed, F.col("side"), F.col("pos")), tokens, k=k)


def balance(pool: DataFrame, seed: int | Column = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the larger side (of each group of ``by``) at random to the size of the smaller; with one side empty nothing is left."""
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "side").orderBy(seeded(seed, F.col("side"), F.col("pos")), "pos")))
    least = pool.groupBy(*by, "side").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.when(F.count(F.lit(1)) == 2, F.min("n")).otherwise(0).alias("least"))
    both = ranked.join(least, list(by)) if by else ranked.crossJoin(F.broadcast(least))  # without groups least is one row
    return both.where("_r <= least").select(*pool.columns)


def estimate_count(pool: DataFrame, budget: int) -> DataFrame:
    """(side, n): how many texts of the mean cost of the first 20 fit, one at least."""
    first = pool.withColumn("_r", F.row_number().over(Window.partitionBy("side").orderBy("pos"))).where("_r <= 20")
    return first.groupBy("side").agg(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.avg(token_count(F.col("text"))), F.lit(1e-9)))).cast("bigint").alias("n"))


def class_budget(pool: DataFrame, context: int, reserve: int, count: Callable[[Column], Column] = token_count) -> int:
    """Tokens a class may use: half of the context without the longest text and the reserve."""
    longest = pool.select(count(F.col("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    budget = (context - (longest + reserve)) // 2
    if budget < 1:
        raise ValueError("context_limit leaves no room for exemplars")
    return budget


def sample_pools(labelled: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The first n of each side of a seeded shuffle."""
    return random_select(labelled, n, seed)


def sample_eval(labelled: DataFrame, skip: int, n_eval: int, seed: int = 0) -> DataFrame:
    """The rows after the first ``skip`` of each side of the same shuffle: half of n_eval positive, the rest negative."""
    order = Window.partitionBy("side").orderBy(seeded(seed, F.col("side"), F.col("pos")), "pos")
    want = F.when(F.col("side") == POSITIVE, n_eval // 2).otherwise(n_eval - n_eval // 2)
    return labelled.withColumn("_r", F.row_number().over(order)).where((F.col("_r") > skip) & (F.col("_r") <= skip + want)).drop("_r")


def class_weights(df: DataFrame, label: str, weights: str | dict | None = "balanced") -> DataFrame:
    """(label, weight): rows / (classes * rows of the class) if balanced, 1 for None, or those of a dict that names every class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        return counts.select(label, F.lit(1.0).alias("weight"))
    if weights == "balanced":
        total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes"))
        return counts.crossJoin(F.broadcast(total)).select(label, (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))  # total is one row
    if not isinstance(weights, dict):
        raise ValueError("class_weight must be None, 'balanced' or a dict")
    found = {r[0] for r in counts.select(label).collect()}
    if found - set(weights):
        raise ValueError("class_weight names not every class")
    return counts.select(label, F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(label)].cast("double").alias("weight"))


class Selector:
    """What picks exemplars from a pool; a query-aware one picks for each query."""

    query_aware = False

    def select(self, pool: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError


class RandomSelector(Selector):
    def __init__(self, seed: int = 0):
        self.seed = seed

    def select(self, pool, k, queries=None):
        return random_select(pool, k, self.seed)


class BudgetSelector(Selector):
    def __init__(self, token_budget: int, seed: int = 0, count: Callable[[Column], Column] = token_count):
        if token_budget <= 0:
            raise ValueError("token_budget must be positive")
        self.token_budget, self.seed, self.count = token_budget, seed, count

    def select(self, pool, k, queries=None):
        return budget_select(pool, self.token_budget, k, self.seed, self.count(F.col("text"))).drop("rank")


class CustomSelector(Selector):
    """Any function (pool, k, queries) -> DataFrame."""

    def __init__(self, function: Callable, query_aware: bool = False):
        self.select, self.query_aware = function, query_aware
