"""SentencePiece encoding and decoding by vectorised merge rounds.

All words of a slice lie in one flat symbol array. In each round every word finds its best pair with a
segmented minimum, merges it leftmost first, and the array is compacted; words without a pair leave.

A word is a run of word marks and what follows up to the next mark. Splitting there is exact because no
piece of the model has a mark after another character (checked when the model is read).

Equal pairs of one word are merged in the same round if the merged piece can't start or end a better ranked piece, or if
they lie so far apart that no piece reaches from what comes of one to the other; else one after the other, as the library
does, so that ids are always the library's. Long words (a text without blanks is one) are first cut where two characters
meet that are neighbours in no piece: no merge ever crosses such a place.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import MEMO, besides, col, map_texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.int64(1) << 40
#: Characters from which a word is cut where no piece can cross.
LONG = 32
codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message; bytes for nested ones."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            raise ValueError("not a model file")


class Pieces:
    """A BPE model with byte fallback, as merge tables. Raises ValueError for a model that needs more than that."""

    def __init__(self, raw: bytes):
        self.text: list[str] = []
        self.kind: list[int] = []
        score: list[float] = []
        prefix, kind_of_model = True, 1
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.text.append(f.get(1, b"").decode())
                score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kind.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                kind_of_model = f.get(3, 1)
            elif number == 3:
                f = dict(_fields(value))
                prefix = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("only models that keep the text as it is are supported")
        if kind_of_model != 2 or {USER, UNUSED} & set(self.kind):
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        self.prefix = prefix
        ids = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", t) for t in ids):
            raise ValueError("a piece has a word mark after another character")
        self.unk = self.kind.index(UNKNOWN)
        self.byte = [0] * 256
        for i, t in enumerate(self.text):
            if self.kind[i] == BYTE:
                self.byte[int(t[3:5], 16)] = i
        if self.kind.count(BYTE) != 256:
            raise ValueError("a piece for every byte is needed")
        # Symbols: the pieces by id, then characters that occur in pieces without being one, then code points.
        symbol = dict(ids)
        for t in ids:
            for c in t:
                symbol.setdefault(c, len(self.text) + len(symbol))
        self.other = len(self.text) + len(symbol) + 1
        self.of_char = np.full(0x110000, -1, np.int64)
        for t, i in symbol.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        levels = {s: k for k, s in enumerate(sorted(set(score), reverse=True))}
        rank = {i: levels[score[i]] for i in ids.values()}
        pairs = {}
        tight = set()
        for t, i in ids.items():
            for k in range(1, len(t)):
                a, b = symbol.get(t[:k]), symbol.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * self.other + b] = (rank[i], i)
            for part in [t[:k] for k in range(2, len(t))] + [t[k:] for k in range(1, len(t) - 1)]:
                j = ids.get(part)
                if j is not None and rank[i] <= rank[j]:
                    tight.add(j)
        self.reach = 2 * max(map(len, ids), default=1)
        near = {(ord(a) << 21) + ord(b) for t in ids for a, b in zip(t, t[1:], strict=False)}
        self.near = np.array(sorted(near) or [-1], np.int64)
        n = 1 << max(16, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - n.bit_length() + 1)
        self.keys = np.full(n + 64, -1, np.int64)
        self.rank = np.full(n + 64, NONE, np.int64)
        self.into = np.zeros(n + 64, np.int64)
        self.probes = 1
        for key, (r, i) in pairs.items():
            at = int((key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift))
            d = 0
            while self.keys[at + d] >= 0:
                d += 1
            self.keys[at + d], self.rank[at + d], self.into[at + d] = key, r, i
            self.probes = max(self.probes, d + 1)
        self.single = np.zeros(len(self.text), bool)
        self.single[sorted(tight)] = True

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; NONE where there is none."""
        key = a * self.other + b
        key[(a >= self.other) | (b >= self.other)] = -2
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        slot = at
        hit = self.keys[slot] == key
        todo = np.flatnonzero(~hit & (self.keys[slot] >= 0))
        if todo.size:
            slot = slot.copy()
            for d in range(1, self.probes):
                s = at[todo] + d
                found = self.keys[s] == key[todo]
                slot[todo[found]] = s[found]
                hit[todo[found]] = True
                todo = todo[~found & (self.keys[s] >= 0)]
                if not todo.size:
                    break
        return np.where(hit, self.rank[slot], NONE), self.into[slot]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and where each word's ids begin (one more at the end)."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_char[flat]
        sym = np.where(sym < 0, self.other + flat, sym)
        word = np.repeat(np.arange(len(words)), size)
        owner = None
        if sym.size and size.max() > LONG:
            part = np.flatnonzero((word[:-1] == word[1:]) & np.repeat(size > LONG, size)[1:])
            code = (flat[part] << 21) + flat[part + 1]
            cut = np.zeros(sym.size, bool)
            cut[part + 1] = self.near[np.minimum(np.searchsorted(self.near, code), self.near.size - 1)] != code
            cut[1:] |= word[1:] != word[:-1]
            owner, word = word, np.cumsum(cut)
            owner = owner[np.flatnonzero(np.r_[True, cut[1:]])]  # the word of each stretch
        place = np.arange(sym.size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(sym.size, NONE)
        into = np.zeros(sym.size, np.int64)
        near = np.flatnonzero(word[:-1] == word[1:]) if sym.size else np.zeros(0, np.int64)
        rank[near], into[near] = self._look(sym[near], sym[near + 1])
        while sym.size:
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[start, sym.size])
            best = np.minimum.reduceat(rank, start)
            live = np.repeat(best < NONE, length)
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, rank, into, place = sym[live], word[live], rank[live], into[live], place[live]
                best, length = best[best < NONE], length[best < NONE]
                if not sym.size:
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            begins = np.r_[True, np.diff(hit) > 1]  # runs of overlapping pairs
            run = np.flatnonzero(begins)
            odd = (np.arange(hit.size) - np.repeat(run, np.diff(np.r_[run, hit.size]))) & 1
            first = np.r_[True, (word[hit[1:]] != word[hit[:-1]]) | (place[hit[1:]] - place[hit[:-1]] >= self.reach)]
            hit = hit[(odd == 0) & (first | ~self.single[into[hit]])]
            sym[hit] = into[hit]
            stay = np.ones(sym.size, bool)
            stay[hit + 1] = False
            sym, word, place = sym[stay], word[stay], place[stay]
            rank, into = rank[stay], into[stay]
            new = hit - np.arange(hit.size)  # place of each merged symbol after compaction
            rank[new] = NONE
            same = new + 1 < sym.size
            at = new[same]
            at = at[word[at] == word[at + 1]]
            rank[at], into[at] = self._look(sym[at], sym[at + 1])
            at = new[new > 0] - 1
            at = at[word[at] == word[at + 1]]
            rank[at], into[at] = self._look(sym[at], sym[at + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word, sym = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        if owner is not None:
            word = owner[word]
        odd = np.flatnonzero(sym >= len(self.text))
        if odd.size:  # characters without a piece become bytes
            back = {i: chr(c) for c, i in enumerate(self.of_char.tolist()) if i >= len(self.text)} if (sym[odd] < self.other).any() else {}
            parts = [[self.byte[b] for b in (back[s] if s < self.other else chr(s - self.other)).encode("utf-8", "surrogatepass")] for s in sym[odd].tolist()]
            times = np.ones(sym.size, np.int64)
            times[odd] = [len(p) for p in parts]
            at = (np.cumsum(times) - times)[odd]
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            for a, p in zip(at.tolist(), parts, strict=True):
                sym[a : a + len(p)] = p
        return sym, np.searchsorted(word, np.arange(len(words) + 1))

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.prefix:
            text = MARK + text
        parts = text.split(MARK)
        if "" not in parts[1:-1] and parts[-1] and not parts[0]:
            return [MARK + p for p in parts[1:]]
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)

    def decode(self, ids) -> str:
        """The text of ids: bytes are joined to characters, marks become blanks, the first word's added blank goes."""
        return self.decode_part(ids)[1 if self.prefix and len(ids) and self.text[ids[0]].startswith(MARK) else 0 :]

    def decode_part(self, ids) -> str:
        out: list[str] = []
        held = bytearray()
        for i in ids:
            kind = self.kind[i]
            if kind == BYTE:
                held.append(int(self.text[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "one_byte"))
                held.clear()
            if kind != CONTROL:
                out.append(" ⁇ " if kind == UNKNOWN else self.text[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "one_byte"))
        return "".join(out)


class Coder:
    """Encodes texts with a memo of words; a word's ids don't depend on what is around it."""

    def __init__(self, raw: bytes):
        self.pieces = Pieces(raw)
        self.plain = [" ⁇ " if k == UNKNOWN else "" if k == CONTROL else t.replace(MARK, " ") for t, k in zip(self.pieces.text, self.pieces.kind, strict=True)]
        self.number = [str(i) for i in range(len(self.plain))]
        self.is_byte = np.array(self.pieces.kind) == BYTE
        self.memo: dict[str, tuple] = {}
        self.short = False

    def learn(self, split: list[list[str]], short: bool) -> None:
        """Puts new words into the memo: their ids, or if short their number, the ids as text and the decoded text."""
        if len(self.memo) > MEMO or short != self.short:
            self.memo.clear()
            self.short = short
        new = list(set().union(*split).difference(self.memo))
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            flat, at = self.pieces.encode_words(part)
            odd = np.r_[0, np.cumsum(self.is_byte[flat])][at]
            odd = (odd[1:] > odd[:-1]).tolist()
            ids, at = flat.tolist(), at.tolist()
            if not short:
                self.memo.update((w, tuple(ids[at[k] : at[k + 1]])) for k, w in enumerate(part))
                continue
            number = [self.number[i] for i in ids]
            plain = [self.plain[i] for i in ids]
            for k, w in enumerate(part):
                x, y = at[k], at[k + 1]
                self.memo[w] = y - x, ",".join(number[x:y]), self.pieces.decode_part(ids[x:y]) if odd[k] else "".join(plain[x:y])

    @contextmanager
    def calm(self) -> Iterator[None]:
        """No garbage collection meanwhile: the memo holds no cycles, and going through it again and again costs more than the work."""
        on = gc.isenabled()
        gc.disable()
        try:
            yield
        finally:
            if on:
                gc.enable()

    def encode(self, texts: list[str]) -> list[list[int]]:
        with self.calm():
            split = [self.pieces.words(t) for t in texts]
            self.learn(split, False)
            return [[i for w in ws for i in self.memo[w]] for ws in split]

    def digests(self, texts: list[str]) -> tuple[list, list, list]:
        with self.calm():
            n, ids_sha, text_sha = [], [], []
            split = [self.pieces.words(t) for t in texts]
            self.learn(split, True)
            memo = self.memo
            for ws in split:
                size, ids, parts = zip(*[memo[w] for w in ws], strict=True) if ws else ((), (), ())
                ids, text = ",".join(ids), "".join(parts)
                cut = bool(self.pieces.prefix and ws and self.pieces.text[int(ids.partition(",")[0])].startswith(MARK))
                n.append(sum(size))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text[cut:].encode("utf-8", "surrogatepass")).hexdigest())
            return n, ids_sha, text_sha


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:  # a file of the driver: the bytes go to executors, half a megabyte
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of df (but one named `out`) and `out`, the ids of each whole text. A null or empty text has no ids; an empty table gives no rows."""
    raw = _model(df, model)

    def make():
        coder = Coder(raw.value)
        return lambda texts: [coder.encode(texts)]

    return map_texts(df, make, [T.StructField(out, T.ArrayType(T.IntegerType(), False))], text, df.columns, keep_text=True)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of df and `out`, the text of the ids. Null or no ids give the empty text."""
    raw = _model(df, model)

    @F.pandas_udf(T.StringType())
    def text_of(column):
        pieces = Pieces(raw.value)
        return column.map(lambda x: "" if x is None else pieces.decode(list(x)))

    return df.select(*[col(c) for c in besides(df.columns, [out])], text_of(col(ids)).alias(out))


def round_trip(df: DataFrame, model: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, and the digests of the ids and of the text decoded from them; one pass, a row for each row.

    Null and empty texts have no ids and decode to the empty text; whole texts of any length are encoded; repeated rows
    get equal results; an empty table gives no rows; columns of `keep` named like an output are replaced.
    """
    raw = _model(df, model)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(df, lambda: Coder(raw.value).digests, fields, text, keep)
