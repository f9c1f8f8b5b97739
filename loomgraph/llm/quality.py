"""Quality rules, line first: each line is judged on its own, failing lines go, then texts that lost too much.

Words are maximal runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage
return. Null and empty texts have no words and fail. A line without words is never judged and never counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.common import map_texts

SYMBOLS = "#*$%&|<>"
#: Fixed patterns of our own for navigation and boilerplate lines, any case.
NAVIGATION = r"(?:home|menu|login|log in|sign in|sign up|register|search|next|previous|prev|back|top|share|subscribe|read more|click here|contact|about us|sitemap|skip to content)"
BOILERPLATE = (
    "all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service", "copyright (c)", "copyright ©", "javascript",
    "newsletter", "lorem ipsum", "licensed under", "permission is hereby granted", "without warranty of any kind",
)


#: Words, and the ASCII characters that str.split() takes for blanks besides the six.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CONTROLS = re.compile(r"[\x1c-\x1f]")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are of a line's characters that aren't blank, or of its words."""

    least_words: int = 10
    window: int = 5
    most_repeat_percent: int = 20
    symbol_share: float = 0.12
    punctuation_share: float = 0.3
    separator_share: float = 0.15
    one_word_share: float = 0.5
    long_line: int = 8
    most_lost: float = 0.5


class Judge:
    def __init__(self, rules: Rules):
        self.r = rules
        self.nav = re.compile(rf"^\W*+(?:{NAVIGATION})(?:\W++(?:{NAVIGATION}))*+\W*+$", re.I)
        self.odd = re.compile(r"[^\w\s]")

    def base(self, text: str) -> tuple[int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # of bytes: splits at exactly the six characters
        blanks = len(raw) - sum(map(len, words))
        lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
        k = self.r.window
        windows = list(zip(*(words[i:] for i in range(k)), strict=False))
        seen = set(windows)
        repeat = 0
        if len(seen) < len(windows):
            count = Counter(windows)
            upto = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + k - max(i, upto)
                    upto = i + k
        return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat

    def line_fails(self, line: str, words: list[str], times: int, boiler: bool, symbols: bool) -> str:
        """The rule that a line fails, or nothing. times: how often the text holds this line; boiler, symbols: whether it holds any such."""
        r, n = self.r, len(words)
        chars = sum(map(len, words))
        if symbols and "|" not in line and sum(map(line.count, SYMBOLS)) > r.symbol_share * chars or len(self.odd.findall(line)) > r.punctuation_share * chars:
            return "punctuation"
        if n >= r.long_line and line.isupper():
            return "punctuation"  # shouted
        bars = sum(map(line.count, "|»›·"))
        if bars >= 3 and bars > r.separator_share * n or self.nav.match(line):
            return "navigation"
        if times > 2 or boiler and any(p in line.lower() for p in BOILERPLATE):
            return "boilerplate"
        if n >= r.long_line and len(set(words)) <= 1 + n * (1 - r.one_word_share) and max(Counter(words).values()) > r.one_word_share * n:
            return "boilerplate"
        return ""

    def judge(self, text: str) -> tuple:
        n, chars, symbols, dup, repeat = self.base(text)
        failed = n < self.r.least_words or 100 * repeat > self.r.most_repeat_percent * n
        lines = text.split("\n")
        times = Counter(lines)
        low = text.lower()
        boiler = any(p in low for p in BOILERPLATE)
        lost, gone, clean = 0, 0, []
        for line in lines:
            words = line.split() if line.isascii() and not CONTROLS.search(line) else WORDS.findall(line)
            if words and self.line_fails(line, words, times[line], boiler, symbols > 0):
                lost += len(words)
                gone += 1
            else:
                clean.append(line)
        total = max(n, 1)
        return n, chars, symbols, dup, repeat, failed, not failed and lost <= self.r.most_lost * total, gone, lost, "\n".join(clean)


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("n_lines_removed", T.LongType()), T.StructField("n_words_removed", T.LongType()), T.StructField("clean_text", T.StringType())]


def assess(df: DataFrame, rules: Rules | None = None, text: str = "text", keep: Sequence[str] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """`keep`, the counts, base_failed, kept, what the line rules removed, and (with_text) the cleaned text.

    One pass without a shuffle; a row's result depends on that row only, so repeated rows are repeated results. Null and
    empty texts have counts of zero and fail; texts of any length are judged whole; an empty table gives no rows; columns
    of `keep` named like an output are replaced.
    """
    rules = rules or Rules()
    fields = FIELDS if with_text else FIELDS[:-1]

    def make():
        judge = Judge(rules).judge
        return lambda texts: list(zip(*map(judge, texts), strict=True))[: len(fields)]

    return map_texts(df, make, fields, text, keep)
