"""Text functions as Spark columns: normalising, hashing, similarity; NFKC and fuzzy ratios as pandas functions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "␟"


def normalize(text: Column) -> Column:
    """Line ends to LF, runs of blanks to one, lines trimmed, three or more line ends to two."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "　", " "), r"[ \t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.trim(t)


def squeeze(text: Column) -> Column:
    """Without white space: what quotes are compared by when they aren't found as they are."""
    return F.regexp_replace(text, r"\s+", "")


def unit_float(key: Column) -> Column:
    """A number from 0 to 1 from the first eight bytes of the key's SHA-256."""
    digest = F.sha2(key, 256)
    part = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("double")
    return (part(1) * float(1 << 32) + part(9)) / float(2**64 - 1)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text without white space."""
    t = F.lower(squeeze(text))
    return F.when(F.length(t) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / whole)


def excerpt(text: Column, query: str, before: int = 50, after: int = 90) -> Column:
    """What surrounds the first occurrence of the query, any case; the beginning if there is none."""
    at = F.instr(F.lower(text), query.lower())
    return F.substring(text, F.greatest(at - F.lit(before), F.lit(1)), F.lit(before + len(query) + after))


def like_pattern(query: str) -> str:
    """The query as a LIKE pattern that finds it anywhere, its own wildcards taken literally."""
    return "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


@F.pandas_udf(T.StringType())
def identity_key(name: pd.Series) -> pd.Series:
    """Names that are the same entity's: NFKC, case folded, without white space and punctuation."""
    return name.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKC", s).casefold() if not c.isspace() and unicodedata.category(c)[0] != "P"))


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks, twice their length over both lengths; automatic junk on."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def thread_key(text: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(F.lower(text), r"\W+", ""), 256), 1, 24)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;。；！？])"), lambda s: F.trim(s)), lambda s: s != "")
