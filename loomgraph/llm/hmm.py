"""Language-model scores from a hidden Markov model over words.

Tokens are runs of anything but the six ASCII blanks, A-Z lower-cased, then one end. A latent state emits a frequent
word, a class of the other words (by their last three bytes; more classes for more distinct words), or the end; within a
class a word has its smoothed share of the class, and one share is left for all words never seen, so probabilities over
tokens add up to one.

Counts cover all training rows: words first, then Baum-Welch counts, which every task gathers over its rows and Spark
adds up across partitions. The first rounds take parts of the training rows, up to a quarter of them (WARM), the others all
of them, until the likelihood of a token settles. Nothing is learnt on the driver but the maximisation, of bounded size.

Texts are turned into symbols once; rounds and scores read those. Recursions are exact for texts of any length: one of
more than CHUNK tokens is cut into pieces, the product of each piece's transition matrices carries forward and backward
values across the cuts, and pieces then run side by side.

Words beyond the HEAD most frequent are too many to send to executors. Their counts are joined to the texts that hold
them by a shuffle on the word; those words are rare by definition, so no key is hot.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import besides, col, crc, fresh, map_texts, slices, stored

HEAD = 200_000
EMITTED = 65_536
#: Classes of the words without an emission of their own: a power of two, so many distinct words a class at most, while there are MOST_CLASSES at most.
WORDS_A_CLASS, LEAST_CLASSES, MOST_CLASSES = 256, 64, 1 << 16
STATES = 8
#: The first rounds take such parts of the training rows, ever larger ones: a sixteenth, ..., a quarter.
WARM = (16, 8, 8, 4)
#: Rounds over all training rows at most, and the gain in nats a token under which no further one is run.
ROUNDS, SETTLED = 2, 0.006
#: The corpus shares count as so many tokens of each state, and as these parts of a state's mean tokens (in the first rounds, in the others).
PRIOR_TOKENS, WARM_PRIOR, PRIOR = 20.0, 0.5, 0.05
CHUNK = 768
#: Tokens whose recursions run side by side.
LOT = 1 << 20
LN10 = math.log(10)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    """The finest class; with fewer classes their number's lower bits count."""
    return zlib.crc32(word[-3:]) % MOST_CLASSES


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for rows kept from learning; a null id is not held out."""
    return F.coalesce(crc(doc_id) % 10 == 0, F.lit(False))


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, class, n) over all rows of df; word null for the ends. Counted in each task before the shuffle."""
    src = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ends = 0

        def out():
            if seen:
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([class_of(w) for w in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "class", "n"])
                seen.clear()

        for whole in batches:
            for b in slices(whole, "t"):
                for t in b.column(0).to_pylist():
                    seen.update(words_of(t))
                    ends += 1
                if len(seen) > 600_000:
                    yield from out()
        yield from out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([-1], pa.int32()), pa.array([ends], pa.int64())], names=["word", "class", "n"])

    return src.mapInArrow(run, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


class Model:
    """What every executor needs; bounded by HEAD, EMITTED, MOST_CLASSES and STATES whatever the corpus."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, ends: int, classes: dict[int, tuple[int, int]]):
        self.total, self.distinct, self.ends = total, distinct, ends
        self.ids = {w: i for i, (w, _) in enumerate(head)}
        counts = np.array([c for _, c in head], np.float64)
        first = self.n_emitted = min(EMITTED, len(head))
        rest = max(1, distinct - first)
        self.n_classes = min(MOST_CLASSES, max(LEAST_CLASSES, 1 << (-(-rest // WORDS_A_CLASS) - 1).bit_length()))
        self.unit = math.log10(total + 0.1 * (distinct + 1))
        self.base = np.log10(counts + 0.1) - self.unit if len(head) else np.zeros(0)
        self.symbols = first + self.n_classes + 1
        self.end = self.symbols - 1
        self.sym = np.arange(len(head), dtype=np.int32)
        self.sym[first:] = [first + self.class_of(w) for w, _ in head[first:]]
        # classes: tokens and distinct words of each among all words; those with an emission of their own are taken off.
        inside = np.zeros((self.n_classes, 2))
        for k, sums in classes.items():
            inside[k & (self.n_classes - 1)] += sums
        for w, c in head[:first]:
            inside[self.class_of(w)] -= (c, 1)
        inside = np.maximum(inside, 0)
        self.class_log = np.log10(inside[:, 0] + 0.1 * (inside[:, 1] + 1))
        self.inner = np.zeros(len(head))
        if len(head) > first:
            self.inner[first:] = np.log10(counts[first:] + 0.1) - self.class_log[self.sym[first:] - first]
        freq = np.ones(self.symbols)
        freq[:first] += counts[:first]
        freq[first : self.end] += inside[:, 0]
        freq[self.end] += ends
        self.share = freq / freq.sum()
        self.log_share = np.log(self.share)
        # Recursions use emissions as multiples of the corpus share: numbers near one, so nothing underflows.
        rng = np.random.default_rng(3)
        ratio = rng.uniform(0.2, 1.8, (self.symbols, STATES))
        self.ratio = ratio / (ratio * self.share[:, None]).sum(0)
        self.move = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
        self.start = rng.dirichlet(np.full(STATES, 20.0))

    def slim(self) -> Model:
        """What recursions over symbols need."""
        out = copy.copy(self)
        out.ids, out.base, out.inner, out.sym = {}, None, None, None
        return out

    @property
    def emit(self) -> np.ndarray:
        return self.ratio * self.share[:, None]

    def class_of(self, word: bytes) -> int:
        return class_of(word) & (self.n_classes - 1)

    def encode(self, words: list[bytes]) -> np.ndarray:
        """Symbols of the words, then the end."""
        got = [self.ids.get(w, -1) for w in words]
        return np.array([self.sym[i] if i >= 0 else self.n_emitted + self.class_of(w) for i, w in zip(got, words, strict=True)] + [self.end], np.int32)

    def carried(self, b: np.ndarray, live: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Product of each piece's transition matrices, scaled, and the log of what was taken out. b: emissions (t, piece, state)."""
        width = b.shape[1]
        m = np.where(first[:, None, None], np.eye(STATES), self.move)[:width] * b[0][:, None, :]
        logs, move = np.zeros(width), self.move.astype(b.dtype)
        m = np.ascontiguousarray(m, b.dtype)
        for t in range(1, len(b)):
            n = int(live[t])
            if not n:
                break
            m[:n] = (m[:n].reshape(-1, STATES) @ move).reshape(n, STATES, STATES) * b[t, :n, None, :]
            if t % 4 == 0:
                total = m[:n].sum((1, 2))
                m[:n] /= total[:, None, None]
                logs[:n] += np.log(total)
        return m.astype(np.float64), logs

    def lots(self, seqs: list[np.ndarray], chunk: int) -> Iterator[tuple]:
        """Pieces of whole sequences, LOT tokens or one sequence at least, longest first: symbols, sizes, live, owner and number of each."""
        at = 0
        while at < len(seqs):
            stop, held = at, 0
            while stop < len(seqs) and (not held or held + len(seqs[stop]) <= LOT):
                held += len(seqs[stop])
                stop += 1
            cut = [(k, j, seqs[k][a : a + chunk]) for k in range(at, stop) for j, a in enumerate(range(0, len(seqs[k]), chunk))]
            cut.sort(key=lambda p: -len(p[2]))
            size = np.array([len(p[2]) for p in cut])
            sym = np.full((int(size[0]), len(cut)), self.end, np.int32)
            for c, (_, _, p) in enumerate(cut):
                sym[: len(p), c] = p
            live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
            yield sym, size, live, np.array([p[0] for p in cut]), np.array([p[1] for p in cut])
            at = stop

    def joints(self, b: np.ndarray, live: np.ndarray, owner: np.ndarray, number: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
        """For each piece the forward values at the token before it (zero: none) and the backward values at its last; log-likelihood of the long sequences."""
        width = len(owner)
        before, after, ll = np.zeros((width, STATES)), np.ones((width, STATES)), {}
        long = np.flatnonzero(np.isin(owner, owner[number > 0]))
        if not long.size:
            return before, after, ll
        m, logs = self.carried(b[:, long], np.searchsorted(long, live), number[long] == 0)
        order = long[np.lexsort((number[long], owner[long]))]
        at = np.empty(width, np.int64)
        at[long] = np.arange(long.size)
        for group in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            v, total = self.start, 0.0
            for p in group.tolist():
                if number[p]:
                    before[p] = v
                v = v @ m[at[p]]
                s = float(v.sum())
                v, total = v / s, total + math.log(s) + logs[at[p]]
            ll[int(owner[group[0]])] = total
            if back:
                v = np.ones(STATES)
                for p in reversed(group.tolist()):
                    after[p] = v
                    v = m[at[p]] @ v
                    v /= v.sum()
        return before, after, ll

    def forward(self, seqs: list[np.ndarray], chunk: int = CHUNK) -> np.ndarray:
        """Natural log of the probability of each sequence: the scaled forward recursion over all of it."""
        out = np.array([float(self.log_share[s].sum()) for s in seqs])
        for sym, _, live, owner, number in self.lots(seqs, chunk):
            b = self.ratio[sym]
            _, _, known = self.joints(b, live, owner, number, False)
            for k, v in known.items():
                out[k] += v
            whole = ~np.isin(owner, np.array(list(known), np.int64))
            live, owner, b = np.searchsorted(np.flatnonzero(whole), live), owner[whole], b[:, whole]
            if not owner.size:
                continue
            logs, a = np.zeros(owner.size), self.start * b[0]
            for t in range(len(b)):
                n = int(live[t])
                if not n:
                    break
                if t:
                    a = (a[:n] @ self.move) * b[t, :n]
                total = a.sum(1)
                logs[:n] += np.log(total)
                a /= total[:, None]
            out[owner] += logs
        return out

    def counts(self, seqs: list[np.ndarray], chunk: int = CHUNK, kind=np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions (Baum-Welch) of whole sequences, and their log-likelihood."""
        start, moves, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((self.symbols, STATES))
        ll = sum(float(self.log_share[s].sum()) for s in seqs)
        ratio, move = self.ratio.astype(kind), self.move.astype(kind)
        for sym, size, live, owner, number in self.lots(seqs, chunk):
            b = ratio[sym]
            lead, after, _ = self.joints(b, live, owner, number, True)
            lead, after, first = lead.astype(kind), after.astype(kind), number == 0
            before = np.where(first[:, None], self.start.astype(kind), lead @ move)
            alpha, scale = np.zeros_like(b), np.ones(b.shape[:2], kind)
            for t in range(len(b)):
                n = int(live[t])
                a = (alpha[t - 1, :n] @ move if t else before) * b[t, :n]
                scale[t, :n] = s = a.sum(1)
                np.divide(a, s[:, None], out=alpha[t, :n])
            ll += float(np.log(scale).sum(dtype=np.float64))
            # Backward values are scaled like the forward ones, so their products sum to one at every token.
            last = alpha[size - 1, np.arange(size.size)]
            beta = after / (after * last).sum(1, keepdims=True)
            for t in range(len(b) - 1, -1, -1):
                n = int(live[t])
                step = b[t, :n] * beta[:n]
                step /= scale[t, :n, None]
                gamma = alpha[t, :n] * beta[:n]
                if t:
                    moves += alpha[t - 1, :n].T @ step
                    beta[:n] = step @ move.T
                else:
                    start += gamma[first].sum(0)
                    moves += lead.T @ step  # moves across a cut
                b[t, :n] = gamma
            keep = np.arange(len(b))[:, None] < size[None]
            flat, g = sym[keep], b[keep]
            for k in range(STATES):
                emit[:, k] += np.bincount(flat, g[:, k], self.symbols)
        return start, moves * self.move, emit, ll

    def learn(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, weight: float = PRIOR) -> None:
        """Maximisation with a prior on the corpus shares, of PRIOR_TOKENS and `weight` times a state's mean tokens, so no emission is zero."""
        prior = PRIOR_TOKENS + weight * emit.sum() / STATES
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 1) / (move + 1).sum(1, keepdims=True)
        self.ratio = (emit / self.share[:, None] + prior) / (emit.sum(0) + prior)


def base_model(df: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model before any round, and the counts (word, class, n) of all rows of df."""
    counts = stored(count_words(df, text), "lm-counts")
    known = counts.where("word is not null")
    sums = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("word").alias("v")).collect()  # a row for each finest class
    ends = sum(r["n"] for r in sums if r["class"] < 0)
    top = known.orderBy(F.desc("n"), "word").limit(HEAD).select("word", "n").toArrow().to_pydict()
    classes = {r["class"]: (r["n"], r["v"]) for r in sums if r["class"] >= 0}
    distinct = sum(v for _, v in classes.values()) + (ends > 0)
    return Model(list(zip(top["word"], top["n"], strict=True)), ends + sum(n for n, _ in classes.values()), distinct, ends, classes), counts


PARTS = [
    T.StructField("n_tokens", T.LongType()), T.StructField("known_", T.LongType()), T.StructField("base_", T.DoubleType()), T.StructField("inner_", T.DoubleType()), T.StructField("n_rare_", T.LongType()),
    T.StructField("rare_", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("k", T.IntegerType())]))), T.StructField("symbols_", T.BinaryType()),
]
OUTPUTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def encoded(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep`, rid_ (the row's number) and PARTS of each whole text, in the shared folder; the symbols are 32-bit integers."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = besides(keep, [*OUTPUTS, *(f.name for f in PARTS), "rid_"])

    def make():
        m: Model = shared.value
        end = math.log10(m.ends + 0.1) - m.unit

        def run(texts):
            split = [words_of(t) for t in texts]
            size = np.fromiter(map(len, split), np.int64, len(split))
            flat = list(chain.from_iterable(split))
            a = np.fromiter(map(m.ids.get, flat, repeat(-1)), np.int64, len(flat))
            miss = np.flatnonzero(a < 0)
            sym = m.sym[a] if len(m.sym) else np.zeros(len(flat), np.int32)
            base, inner = (x[a] if len(x) else np.zeros(len(flat)) for x in (m.base, m.inner))
            rare = [flat[k] for k in miss.tolist()]
            kind = np.fromiter(map(m.class_of, rare), np.int64, len(rare))
            sym[miss], base[miss], inner[miss] = m.n_emitted + kind, 0.0, -m.class_log[kind]
            stop = np.cumsum(size)
            first = stop - size
            ends = np.searchsorted(miss, np.stack([first, stop])).tolist()
            few = [Counter(rare[x:y]) if y > x else {} for x, y in zip(*ends, strict=True)]
            words = pa.array([w for r in few for w in r], pa.binary())
            times = pa.array([k for r in few for k in r.values()], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in few])]).astype(np.int32)), pa.StructArray.from_arrays([words, times], names=["word", "k"]))
            last = np.int32(m.end).tobytes()
            raw = [sym[x:y].tobytes() + last for x, y in zip(first.tolist(), stop.tolist(), strict=True)]
            n_rare = np.array(ends[1]) - np.array(ends[0])
            at = np.stack([first, stop])
            sums = [np.concatenate([[0.0], np.cumsum(x)])[at] for x in (base, inner)]
            return size + 1, size - n_rare + (m.ends > 0), sums[0][1] - sums[0][0] + end, sums[1][1] - sums[1][0], n_rare, lists, raw

        return run

    return stored(map_texts(df, make, PARTS, text, keep).withColumn("rid_", F.monotonically_increasing_id()), "lm-parts")


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) for x in column]


def train(model: Model, parts: DataFrame, warm: Sequence[int] = WARM, rounds: int = ROUNDS) -> list[float]:
    """Baum-Welch rounds over the symbols of parts; the model changes in place. Returns the log-likelihood a token before each round."""
    spark, track = parts.sparkSession, []
    schema = "symbol long, n double, ll double, " + ", ".join(f"s{k} float" for k in range(STATES))
    src = parts.select("symbols_", "rid_")
    for turn in range(len(warm) + rounds):
        shared = spark.sparkContext.broadcast(model.slim())
        first = turn < len(warm)
        some = src.where(F.pmod(F.xxhash64("rid_"), F.lit(warm[turn])) == turn % warm[turn]) if first else src

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, sums, ll, n, held, size = shared.value, None, 0.0, 0, [], 0

            def add():
                nonlocal sums, ll
                got = m.counts(held)
                sums = got[:3] if sums is None else [x + y for x, y in zip(sums, got, strict=False)]
                ll += got[3]
                held.clear()

            for b in batches:
                for x in _sequences(b.column(0)):
                    held.append(x)
                    size, n = size + len(x), n + len(x)
                    if size >= LOT:
                        add()
                        size = 0
            if held:
                add()
            if sums is not None:
                start, move, emit = sums
                rows = np.flatnonzero(emit.any(1))
                table = np.concatenate([start[None], move, emit[rows]]).astype(np.float32)
                one = np.zeros((2, len(table)))
                one[:, 0] = n, ll
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([-1 - np.arange(1 + STATES), rows]), pa.int64()), pa.array(one[0]), pa.array(one[1]), *(pa.array(table[:, s]) for s in range(STATES))], names=["symbol", "n", "ll", *(f"s{k}" for k in range(STATES))])

        added = some.select("symbols_").mapInArrow(run, schema).groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("ll").alias("ll"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)]).toArrow()  # a row for each symbol
        shared.destroy()
        if not added.num_rows:
            continue
        symbol = added["symbol"].to_numpy()
        table = np.stack([added[f"s{k}"].to_numpy() for k in range(STATES)], 1)
        whole = np.zeros((model.symbols + STATES + 1, STATES))
        whole[np.where(symbol < 0, model.symbols - 1 - symbol, symbol)] = table
        track.append(float(added["ll"].to_numpy().sum() / added["n"].to_numpy().sum()))
        model.learn(whole[model.symbols], whole[model.symbols + 1 :], whole[: model.symbols], WARM_PRIOR if first and warm[turn] > 8 else PRIOR)
        if not first and len(track) > 1 and track[-1] - track[-2] < SETTLED:
            break
    return track


def fit(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The trained model and the counts (word, class, n) of all rows of df. Null texts are empty; an empty table gives a model without words."""
    model, counts = base_model(df, text)
    train(model, encoded(df, model, text, [doc_id]), rounds=rounds)
    return model, counts


def score(df: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, n_known, train_tokens, base_score and score of each whole text; a row for each row.

    Null and empty texts are one end; repeated rows get equal scores; an empty table gives no rows; columns of `keep`
    named like an output are replaced.
    """
    keep = [c for c in besides(keep, OUTPUTS) if c.lower() != text.lower()]
    plain = [f"keep_{i}" for i in range(len(keep))]
    inner = df.select(col(text).alias("text"), *[col(c).alias(p) for c, p in zip(keep, plain, strict=True)])
    return score_parts(encoded(inner, model, "text", plain), model, counts).toDF(*keep, *OUTPUTS)


def score_parts(parts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """As score, from what encoded() gives."""
    shared = parts.sparkSession.sparkContext.broadcast(model.slim())
    cols = besides(parts.columns, ["rid_", *(f.name for f in PARTS)])

    names = [*cols, "rid_", "n_tokens", "known_", "base_", "inner_", "n_rare_", "model_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll = shared.value.forward(_sequences(b.column(b.num_columns - 1))) / LN10
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ll, pa.float64())], names=names)

    rows = parts.select("rid_", F.explode("rare_").alias("r")).select("rid_", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    seen = rows.join(counts.select("word", "n"), "word").groupBy("rid_").agg(F.sum("k").alias("seen_"), F.sum(F.col("k") * F.log10(F.col("n") + F.lit(0.1))).alias("rare_log_"))
    slim = parts.select(*[col(c) for c in cols], "rid_", "n_tokens", "known_", "base_", "inner_", "n_rare_", "symbols_")
    fields = [*slim.schema.fields[:-1], T.StructField("model_", T.DoubleType())]
    likely = slim.toDF(*[f"c{i}" for i in range(len(fields))]).mapInArrow(run, T.StructType(fields))  # Arrow passes find columns by plain names only
    got = likely.join(seen, "rid_", "left")
    seen_n, seen_log = F.coalesce("seen_", F.lit(0)), F.coalesce("rare_log_", F.lit(0.0))
    rare_log = seen_log - (F.col("n_rare_") - seen_n)  # log10(0.1) for each word never seen
    return got.select(*[col(c) for c in cols], "n_tokens", (F.col("known_") + seen_n).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_") + rare_log - F.col("n_rare_") * F.lit(model.unit)).alias("base_score"), (F.col("model_") + F.col("inner_") + rare_log).alias("score"))
