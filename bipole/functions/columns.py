"""Column expressions: all of them stay in the JVM and have an equivalent in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = "positive", "negative"
NGRAM, NEAR, MIN_SPAN = 3, 0.75, 20


def token_count(text: Column, chars_per_token: int = 4) -> Column:
    """Estimated tokens of a text, one more than its whole groups of characters."""
    return (F.floor(F.length(text) / F.lit(chars_per_token)) + 1).cast("bigint")


def char_ngrams(text: Column, n: int = NGRAM) -> Column:
    """Distinct character n-grams; a text of up to n characters is its own only one. Characters are split once, since substring rescans."""
    places = F.sequence(F.lit(0), F.length(text) - n)
    # the characters are bound once, as the only element of an array; inside the inner function they would be split anew for each place
    grams = F.transform(F.array(F.split(text, "")), lambda cs: F.transform(places, lambda i: F.concat(*[F.get(cs, i + j) for j in range(n)])))[0]
    return F.when(F.length(text) <= n, F.array(text)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two n-gram arrays without repeats."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; 0 if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def seeded(seed: int | Column, *parts: Column) -> Column:
    """The key of a seeded shuffle: an MD5, which any engine can repeat. A column as seed gives each of its values a shuffle of its own."""
    return F.md5(F.concat_ws(":", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[p.cast("string") for p in parts]))


def softmax_positive(positive: Column, negative: Column) -> Column:
    top = F.greatest(positive, negative)
    return F.exp(positive - top) / (F.exp(positive - top) + F.exp(negative - top))


def calibrated(positive: Column, free_positive: Column) -> Column:
    """P(positive) after dividing both labels by what an empty query scores."""
    p, n = positive / F.greatest(free_positive, F.lit(1e-12)), (1 - positive) / F.greatest(1 - free_positive, F.lit(1e-12))
    return F.when(p + n <= 0, positive).otherwise(p / (p + n))


def predicted(p_positive: Column, positive, negative) -> Column:
    """A tie is negative."""
    return F.when(p_positive > 1 - p_positive, F.lit(positive)).otherwise(F.lit(negative))


def parsed_label(raw: Column) -> Column:
    """struct(label, confidence) of a completion: the label word it holds; of both the earlier, of none positive, then at confidence 0.5."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    p, n = F.instr(low, POSITIVE), F.instr(low, NEGATIVE)
    label = F.when((n > 0) & ((p == 0) | (n < p)), NEGATIVE).otherwise(POSITIVE)
    return F.struct(label.alias("label"), F.when((p > 0) != (n > 0), 1.0).otherwise(0.5).alias("confidence"))


def completion_probability(parsed: Column) -> Column:
    """P(positive) of a parsed completion. At confidence 0.5 both are 0.5, so that the prediction is negative whatever the label was."""
    return F.when(parsed["label"] == POSITIVE, parsed["confidence"]).otherwise(1 - parsed["confidence"])


def threshold_label(score: Column, clean: float = 0.1, toxic: float = 0.5) -> Column:
    """Positive up to ``clean``, negative from ``toxic``, both inclusive; null between."""
    return F.when(score <= clean, POSITIVE).when(score >= toxic, NEGATIVE)


def extract_json(raw: Column) -> Column:
    """The JSON part of a reply: the first fenced block, else from the first brace to the last, else all of it."""
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    first, last = F.instr(raw, "{"), F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    braces = F.when((first > 0) & (F.instr(F.reverse(raw), "}") > 0) & (last > first), F.substring(raw, first, last - first + 1)).otherwise(raw)
    return F.when(raw.rlike(fence), F.trim(F.regexp_extract(raw, fence, 1))).otherwise(braces)


def exemplar_block(text: Column, label: str) -> Column:
    return F.concat(F.lit("Text: "), text, F.lit(f"\nLabel: {label}\n\n"))


def exemplar_prefix(positive: Column, negative: Column) -> Column:
    """Exemplars of both arrays in turn, the longer one goes on alone."""
    pairs = F.arrays_zip(positive.alias("p"), negative.alias("n"))
    return F.array_join(F.flatten(F.transform(pairs, lambda z: F.array_compact(F.array(exemplar_block(z["p"], POSITIVE), exemplar_block(z["n"], NEGATIVE))))), "")


def query_suffix(text: Column) -> Column:
    return F.concat(F.lit("Text: "), text, F.lit("\nLabel:"))


def numbered(texts: Column) -> Column:
    """A numbered list, one a line, or (none)."""
    lines = F.array_join(F.transform(texts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.coalesce(F.nullif(lines, F.lit("")), F.lit("(none)"))
