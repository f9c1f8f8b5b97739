"""Titles, summaries and labels: what counts as the same topic, how texts are combined, how relations are directed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENDS = "。；！？!?;"


def canonical_title(title: Column, synonyms: Mapping[str, str], suffixes: Iterable[str]) -> Column:
    """Synonyms replaced, then the first suffix that fits taken off if more than one character stays."""
    t = title
    for a, b in synonyms.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    cut = None
    for s in suffixes:
        fits = t.endswith(s) & (F.length(t) > len(s) + 1)
        short = F.substring(t, F.lit(1), F.length(t) - len(s))
        cut = F.when(fits, short) if cut is None else cut.when(fits, short)
    return t if cut is None else cut.otherwise(t)


def same_topic(title: Column, summary: Column) -> Column:
    """Whether two similarities together are enough: the less the titles agree, the more the summaries must."""
    steps = [(0.84, 0.0), (0.78, 0.08), (0.65, 0.22), (0.52, 0.28)]  # fixed values
    out = F.lit(False)
    for t, s in steps:
        out = out | ((title >= t) & (summary >= s))
    return out


def label_width(text: Column) -> Column:
    """Pixels: 12 for a character beyond ASCII, 7.2 for others, from 68 to 190."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.greatest(F.lit(68.0), F.least(F.lit(190.0), wide * 12.0 + (F.length(text) - wide) * 7.2))


def directed(predicate: Column, asked: Column, reverse: Column, symmetric: list[str], reverses: Mapping[str, str]) -> Column:
    """(directionality, reverse_predicate): symmetric relations reverse to themselves, known ones to their partner.

    Else a relation is bidirectional only if that was asked for and a reverse label is given.
    """
    pairs = [F.lit(x) for kv in reverses.items() for x in kv]
    known = F.element_at(F.create_map(*pairs), predicate) if pairs else F.lit(None).cast("string")
    given = F.when((asked == "bidirectional") & (F.trim(reverse) != ""), reverse)
    back = F.when(predicate.isin(*symmetric), predicate).otherwise(F.coalesce(known, given))
    return F.struct(F.when(back.isNotNull(), "bidirectional").otherwise("directed").alias("directionality"), back.alias("reverse_predicate"))


def composed(cause: Column, action: Column, outcome: Column, changes: Column, threads: Column) -> Column:
    """One narrative line of the parts that there are."""
    part = lambda before, c: F.when(F.trim(c) != "", F.concat(F.lit(before), F.trim(c)))
    return F.concat_ws("；", F.concat_ws("，", part("", cause), part("", action)), part("", outcome), part("then ", changes), part("unresolved: ", threads))


def unique_texts(texts: Column) -> Column:
    """First of those equal but for case, white space and closing punctuation, in order; empty ones go."""
    key = lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, r"^[。；;，,\s]+|[。；;，,\s]+$", ""), r"\s+", ""))
    kept = F.filter(texts, lambda s: key(s) != "")
    return F.filter(kept, lambda s, i: F.array_position(F.transform(kept, key), key(s)) == i + 1)


def _grams(s: str) -> set[str]:
    s = "".join(s.lower().split())
    return {s[k : k + 3] for k in range(len(s) - 2)}


def says_the_same(a: str, b: str) -> bool:
    """Equal, one holding the other (12 characters at least), or alike by matching blocks or trigrams."""
    short, long = sorted((a, b), key=len)
    if a == b or (len(short) >= 12 and short in long):
        return True
    x, y = _grams(a), _grams(b)
    shared = len(x & y) / len(x | y) if x and y else 0.0
    if shared >= 0.62:
        return True
    ratio = SequenceMatcher(None, a, b).ratio()
    return ratio >= 0.90 or (len(short) >= 30 and ratio >= 0.60 and shared >= 0.32)


def distinct_sentences(text: str) -> str:
    """The text without sentences that say what an earlier one says; of the two the longer stays, at the earlier's place."""
    kept: list[str] = []
    start = 0
    for k, c in enumerate(text):
        if c not in ENDS and k < len(text) - 1:
            continue
        s, start = text[start : k + 1].strip(), k + 1
        if not s:
            continue
        at = next((i for i, t in enumerate(kept) if says_the_same(t.rstrip(ENDS), s.rstrip(ENDS))), None)
        if at is None:
            kept.append(s)
        elif len(s) > len(kept[at]):
            kept[at] = s
    return "".join(kept)


def combined(a: str | None, b: str | None) -> str:
    """Two summaries as one: that which holds the other, else both without what is said twice."""
    a, b = (a or "").strip(), (b or "").strip()
    if a in b:
        return b
    return a if b in a else distinct_sentences(a.rstrip(ENDS) + "；" + b)


@F.pandas_udf(T.StringType())
def combine_summaries(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([combined(x, y) for x, y in zip(a, b, strict=True)], dtype=object)
