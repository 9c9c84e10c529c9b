"""Filters: mappings of fields to values, lists or ranges as Columns, and a fluent builder."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import positions

_BOUNDS = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}


def _is_array(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, T.ArrayType)


def _known(df: DataFrame, field: str) -> bool:
    return field in df.columns


def match(df: DataFrame, field: str, value: Any) -> Column:
    """Field equals value; an array field holds it; a field that is missing matches nothing."""
    if not _known(df, field):
        return F.lit(False)
    return F.array_contains(field, value) if _is_array(df, field) else F.col(field) == F.lit(value)


def match_any(df: DataFrame, field: str, values: list[Any]) -> Column:
    if not _known(df, field) or not values:
        return F.lit(False)
    return F.arrays_overlap(field, F.array(*map(F.lit, values))) if _is_array(df, field) else F.col(field).isin(list(values))


def within(df: DataFrame, field: str, bounds: dict[str, Any]) -> Column:
    """Range; bounds that are missing or None don't bind, other keys are ignored."""
    if not _known(df, field):
        return F.lit(False)
    parts = [test(F.col(field), F.lit(bounds[k])) for k, test in _BOUNDS.items() if bounds.get(k) is not None]
    return reduce(lambda a, b: a & b, parts, F.col(field).isNotNull())


def build_filter(df: DataFrame, filters: dict[str, Any] | Column | None, aliases: dict[str, str] | None = None) -> Column | None:
    """Conjunction of a mapping's entries; None without any; a Column comes back as it is. aliases: other names of fields."""
    if filters is None or isinstance(filters, Column):
        return filters
    parts = []
    for name, value in filters.items():
        field = (aliases or {}).get(name, name)
        parts.append(within(df, field, value) if isinstance(value, dict) else match_any(df, field, value) if isinstance(value, list) else match(df, field, value))
    return reduce(lambda a, b: a & b, parts) if parts else None


def where(df: DataFrame, filters: dict[str, Any] | Column | None, aliases: dict[str, str] | None = None) -> DataFrame:
    condition = build_filter(df, filters, aliases)
    return df if condition is None else df.filter(condition)


class FilterBuilder:
    """Conditions put together step by step. exclude() also keeps rows without a value; should_match() ranks, it doesn't filter."""

    def __init__(self, df: DataFrame):
        self.df, self._must, self._should = df, [], []

    def match(self, field: str, value: Any) -> FilterBuilder:
        self._must.append(match(self.df, field, value))
        return self

    def match_any(self, field: str, values: list[Any]) -> FilterBuilder:
        self._must.append(match_any(self.df, field, values))
        return self

    def range(self, field: str, **bounds: Any) -> FilterBuilder:
        self._must.append(within(self.df, field, bounds))
        return self

    def exclude(self, field: str, value: Any) -> FilterBuilder:
        self._must.append(~F.coalesce(match(self.df, field, value), F.lit(False)))
        return self

    def should_match(self, field: str, value: Any) -> FilterBuilder:
        self._should.append(F.coalesce(match(self.df, field, value), F.lit(False)).cast("int"))
        return self

    def match_text(self, field: str, words: str) -> FilterBuilder:
        """Field holds all these words, whatever their case: whole words, as the sparse encoder has them."""
        self._must.append(positions.has_words(F.col(field), words))
        return self

    def match_phrase(self, field: str, phrase: str) -> FilterBuilder:
        """Field holds the words of the phrase one after the other."""
        self._must.append(positions.has_phrase(F.col(field), phrase))
        return self

    def build(self) -> Column | None:
        return reduce(lambda a, b: a & b, self._must) if self._must else None

    def boost(self) -> Column:
        """How many of the wished conditions hold."""
        return reduce(lambda a, b: a + b, self._should) if self._should else F.lit(0)
