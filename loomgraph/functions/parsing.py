"""Replies and titles taken apart: lenient JSON, quotes anywhere in a reply, generic titles, quotes held by a text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import squeeze

#: Fixed pattern: titles that only number a chapter.
GENERIC_TITLE = r"(?i)^(?:第\s*[0-9一二三四五六七八九十百千万零〇两]+\s*[章节回卷部篇]|chapter\s+\d+|book\s+\d+)"
#: Items of a list at most; the rest is cut off.
MOST_ITEMS = 200


def generic_title(title: Column) -> Column:
    """Whether a title is none of its own: a number, or blank."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return (t == "") | t.rlike(GENERIC_TITLE)


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def good_items(reply: Column, field: str, item: str, needed: str, most: int = MOST_ITEMS) -> Column:
    """The items of a list in a JSON reply, without those that lack `needed`, `most` at most; none if it is no JSON.

    item: the schema of one, such as "name string, quote string".
    """
    whole = F.from_json(unfenced(reply), f"{field} array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in item.split(','))}>>")
    good = F.filter(whole[field], lambda x: x[needed].isNotNull() & (x[needed] != ""))
    return F.slice(F.coalesce(good, F.array().cast(f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in item.split(','))}>>")), 1, most)


def _walk(value, name: str):
    if isinstance(value, dict):
        for k, v in value.items():
            if k == name and isinstance(v, str):
                yield v
            yield from _walk(v, name)
    elif isinstance(value, list):
        for v in value:
            yield from _walk(v, name)


def nested(name: str):
    """A column function: the texts under this key, however deep in a JSON value; none if it is no JSON."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(column: pd.Series) -> pd.Series:
        def one(text):
            try:
                return list(_walk(json.loads(re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", (text or "").strip())), name))
            except (ValueError, RecursionError):
                return []

        return column.map(one)

    return found


def holds_quote(text: Column, quote: Column) -> Column:
    """Whether a text has a quote word for word, white space aside; an empty quote is in no text."""
    q = F.regexp_replace(quote, r"^\s+|\s+$", "")
    return F.coalesce((q != "") & (F.contains(text, q) | F.contains(squeeze(text), squeeze(q))), F.lit(False))
