"""Filter trees compiled to boolean columns, over metadata and vector properties.

A leaf is two-valued: a missing key, unreadable metadata or a null makes it false, `not` of it true. Metadata may be a
JSON string column or columns of the table. In `text` mode values compare as strings (so '10' < '9'); in `typed` mode
numbers compare as numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.functions import vectors as V


@dataclass(frozen=True)
class Where:
    """Metadata predicate: key, operator, value. Lists for in and not_in are comma-separated strings or sequences."""

    key: str
    op: str
    value: object


@dataclass(frozen=True)
class VectorRange:
    """A vector property between two values, both included: magnitude, density, or dimension (the component at `index`)."""

    prop: str
    low: float
    high: float
    index: int = 0


@dataclass(frozen=True)
class Custom:
    """Any condition on the vector column."""

    condition: Callable[[Column], Column]


@dataclass(frozen=True)
class Model:
    """Rows for which a model (vector column -> score column) reaches the confidence."""

    score: Callable[[Column], Column]
    confidence: float = 0.5


@dataclass(frozen=True)
class Rule:
    """A model's stand-in: magnitude, dimension or density of at least threshold * confidence; without parameter, confidence > 0.5."""

    parameter: str | None
    threshold: float = 1.0
    confidence: float = 0.5
    index: int = 0


@dataclass(frozen=True)
class Every:
    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Some:
    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Not:
    """Negates the first of its parts; without parts it holds."""

    parts: tuple = field(default_factory=tuple)


def listed(value: object) -> list[str]:
    if isinstance(value, str):
        return [x.strip() for x in value.split(",") if x.strip()]
    return [str(x) for x in value]  # type: ignore[union-attr]


def compare(found: Column, op: str, value: object, mode: str = "text") -> Column:
    """One metadata comparison; null if the value is."""
    if op in ("in", "not_in"):
        inside = found.cast("string").isin(listed(value))
        return inside if op == "in" else ~inside
    text = found.cast("string")
    if op == "regex":
        try:
            re.compile(str(value))
        except re.error:
            return F.lit(False)
        return text.rlike(str(value))
    plain = {"contains": text.contains, "starts_with": text.startswith, "ends_with": text.endswith}
    if op in plain:
        return plain[op](str(value))
    if op == "not_contains":
        return ~text.contains(str(value))
    left, right = (text, F.lit(str(value))) if mode == "text" else (found.try_cast("double") if isinstance(value, (int, float)) else found, F.lit(value))
    orders = {"equals": left == right, "not_equals": left != right, "lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}
    if op not in orders:
        raise ValueError(f"no operator {op!r}")
    return orders[op]


def compile_filter(tree: object, vector: str = "vector", metadata: str | None = "metadata", mode: str = "text") -> Column:
    """The tree's condition; with metadata=None keys are columns."""

    def value_of(key: str) -> Column:
        return F.get_json_object(F.col(metadata), "$['" + key + "']") if metadata else F.col(key)

    def go(t: object) -> Column:
        if isinstance(t, Where):
            leaf = compare(value_of(t.key), t.op, t.value, mode)
        elif isinstance(t, VectorRange):
            if t.prop == "dimension":
                # A component that the vector doesn't have passes.
                leaf = (F.size(vector) <= t.index) | F.get(V.doubles(vector), F.lit(t.index)).between(t.low, t.high)
            else:
                leaf = {"magnitude": V.magnitude, "density": V.density}[t.prop](vector).between(t.low, t.high)
        elif isinstance(t, Custom):
            leaf = t.condition(F.col(vector))
        elif isinstance(t, Model):
            leaf = t.score(F.col(vector)) >= t.confidence
        elif isinstance(t, Rule):
            least = t.threshold * t.confidence
            kinds = {"magnitude": lambda: V.magnitude(vector) >= least, "density": lambda: V.density(vector) >= least, "dimension": lambda: F.get(V.doubles(vector), F.lit(t.index)) >= least}
            leaf = kinds[t.parameter]() if t.parameter else F.lit(t.confidence > 0.5)
        elif isinstance(t, Every):
            return reduce(lambda a, b: a & b, map(go, t.parts), F.lit(True))
        elif isinstance(t, Some):
            return reduce(lambda a, b: a | b, map(go, t.parts), F.lit(False))
        elif isinstance(t, Not):
            return ~go(t.parts[0]) if t.parts else F.lit(True)
        else:
            raise TypeError(f"no filter: {t!r}")
        return F.coalesce(leaf, F.lit(False))

    return go(tree)


def parse(text: str) -> Where:
    """`key:value` as equality."""
    key, found, value = text.partition(":")
    if not found or not key:
        raise ValueError(f"expected key:value, not {text!r}")
    return Where(key.strip(), "equals", value.strip())


def loose(found: Column, op: str, value: object) -> Column:
    """Comparisons over values of any type, as the text pipeline has them: equality by string, null equal to null; order by number."""
    text = found.cast("string")
    same = text.eqNullSafe(F.lit(None if value is None else str(value)))
    number = found.try_cast("double")
    kinds = {
        "equals": lambda: same,
        "not_equals": lambda: ~same,
        "contains": lambda: text.contains(str(value)),
        "gt": lambda: number > float(value),  # type: ignore[arg-type]
        "lt": lambda: number < float(value),  # type: ignore[arg-type]
        "in": lambda: text.isin([str(x) for x in value]),  # type: ignore[union-attr]
    }
    return F.coalesce(kinds[op](), F.lit(False))


def without(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id is not among the ids."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti")


def metrics(df: DataFrame, condition: Column) -> DataFrame:
    """evaluated, passed, pass_rate of a filter."""
    passed = F.count_if(condition)
    return df.agg(F.count("*").alias("evaluated"), passed.alias("passed"), (passed / F.nullif(F.count("*"), F.lit(0))).alias("pass_rate"))


def to_json(tree: object) -> str:
    """A readable form of a tree of Where, VectorRange, Every, Some and Not."""

    def go(t: object) -> object:
        if isinstance(t, (Every, Some, Not)):
            return {type(t).__name__.lower(): [go(x) for x in t.parts]}
        return {type(t).__name__.lower(): t.__dict__}

    return json.dumps(go(tree))
