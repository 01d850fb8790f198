"""Identifier lists and keys as column functions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a CSV reader of labelled pairs takes for a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

#: List literals of plain single-quoted strings, which need no Python.
PLAIN_LIST = r"^\[('[^'\\]*'(, )?)*\]$"

_PARSED = T.StructType([T.StructField("items", T.ArrayType(T.StringType())), T.StructField("bad", T.BooleanType())])


def null_if_na(text: Column) -> Column:
    """Null where the text is one of NA_TOKENS."""
    return F.when(text.isin(NA_TOKENS), F.lit(None)).otherwise(text)


def _usable(token: str) -> bool:
    return bool(token.strip()) and not token.strip().startswith("Error")


def _literal(text: str | None) -> tuple[list[str], bool]:
    """Items of a list literal, one level of nesting flattened; a text that is no literal is one item, any other literal is bad."""
    trimmed = (text or "").strip()
    if not trimmed or trimmed.lower() in ("nan", "none"):
        return [], False
    try:
        value = ast.literal_eval(trimmed)
    except (SyntaxError, ValueError):
        value = [trimmed]
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, list):
        return [], True
    flat = [x for item in value for x in (item if isinstance(item, list) else [item])]
    return [str(x) for x in flat if x is not None and x == x and _usable(str(x))], False


@F.pandas_udf(_PARSED)
def _parse_literals(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_literal(t) for t in texts], columns=["items", "bad"])


def parse_list(text: Column) -> Column:
    """Struct of items (array<string>, normalised) and bad (the text is a literal of another type). Plain lists are split by Spark alone."""
    plain = F.struct(normalize_ids(F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))).alias("items"), F.lit(False).alias("bad"))
    rest = F.when(~text.rlike(PLAIN_LIST), text)
    empty = F.struct(F.array().cast("array<string>").alias("items"), F.lit(False).alias("bad"))
    return F.when(text.isNull(), empty).when(text.rlike(PLAIN_LIST), plain).otherwise(_parse_literals(rest))


def parse_plain_list(text: Column) -> Column:
    """Items of list literals that are known to be plain, without any Python; other texts give null."""
    return F.when(text.rlike(PLAIN_LIST), normalize_ids(F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))))


def normalize_ids(items: Column) -> Column:
    """Drops null and blank items and those that start with Error; the others stay untrimmed."""
    return F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "") & ~F.trim(x).startswith("Error"))


def split_pipe(text: Column) -> Column:
    """Trimmed tokens between pipes, without nan and none."""
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x))
    return normalize_ids(F.filter(tokens, lambda x: ~F.lower(x).isin("nan", "none")))


def curie_prefix(identifier: Column) -> Column:
    """The text before the first colon; all of it if there is none."""
    return F.substring_index(identifier, ":", 1)


def format_list(items: Column) -> Column:
    """The list literal of plain items."""
    return F.when(F.size(items) > 0, F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))).otherwise(F.lit("[]"))


def drug_set(*lists: Column) -> Column:
    """Sorted multiset of the items of several lists; repeated items stay."""
    items = F.concat(*lists) if len(lists) > 1 else lists[0]
    ordered = F.sort_array(items)  # natural order, compiled; array_sort interprets a comparator for each comparison, but has nulls last
    return F.when(F.get(ordered, F.lit(0)).isNull(), F.array_sort(items)).otherwise(ordered)


def example_key(drugs: Column, disease: Column) -> Column:
    """Sorted drugs joined by a pipe, two pipes, the disease; the order of the drugs doesn't matter."""
    return F.concat(F.array_join(F.sort_array(drugs), "|"), F.lit("||"), disease)
