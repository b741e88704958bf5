"""Structured replies: the JSON part of a completion, checked against a result's required fields."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
HARD_POSITIVE = T.StructType([
    T.StructField("positive_features", _TEXTS), T.StructField("negative_features", _TEXTS),
    T.StructField("boundary_features", T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())]))),
    T.StructField("hard_positives", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("positive_evidence", _TEXTS), T.StructField("confusing_evidence", _TEXTS)]))),
])
SYNTHETIC = T.StructType([T.StructField("style_features", _TEXTS), T.StructField("content_features", _TEXTS), T.StructField("synthetic_texts", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("generalized_from", _TEXTS)])))])
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
ATTEMPTS = 2


def extract_json(raw: str) -> str:
    """The first fenced block, else from the first brace to the last, else all."""
    if m := _FENCE.search(raw):
        return m[1].strip()
    first, last = raw.find("{"), raw.rfind("}")
    return raw[first : last + 1] if 0 <= first < last else raw


def check(value, kind: T.DataType, where: str = "reply"):
    """The value with only the fields of ``kind``; ValueError where one is missing or of another type. Importances are within 0 and 1."""
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise ValueError(f"{where}: an object is needed")
        for f in kind:
            if f.name not in value:
                raise ValueError(f"{where}: {f.name} is missing")
        return {f.name: check(value[f.name], f.dataType, f"{where}.{f.name}") for f in kind}
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ValueError(f"{where}: a list is needed")
        return [check(v, kind.elementType, where) for v in value]
    if isinstance(kind, T.DoubleType):
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
            raise ValueError(f"{where}: a number from 0 to 1 is needed")
        return float(value)
    if not isinstance(value, str):
        raise ValueError(f"{where}: a text is needed")
    return value


def json_schema(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind}, "required": kind.names}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    return {"type": "number", "minimum": 0, "maximum": 1} if isinstance(kind, T.DoubleType) else {"type": "string"}


def complete_structured(backend, system: str, user: str, kind: T.StructType, *, temperature: float = 1.0, max_tokens: int = 1024) -> dict:
    """The checked reply; one that can't be read or fails the check is asked for once more, other errors pass."""
    prompt, error = f"{system}\n\n{user}\n\nJSON:\n", None
    for _ in range(ATTEMPTS):
        if callable(getattr(backend, "complete_json", None)):
            raw = backend.complete_json(prompt, schema=json_schema(kind), temperature=temperature, max_tokens=max_tokens)
        else:
            raw = backend.complete(prompt, temperature=temperature, max_tokens=max_tokens)
        try:
            return check(json.loads(extract_json(raw)), kind)
        except ValueError as e:  # a JSONDecodeError is one
            error = e
    raise error
