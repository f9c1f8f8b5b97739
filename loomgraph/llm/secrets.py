"""Secret scans: fixed rules, and a character convolutional network over every further candidate.

The network is small and plain numpy: class embeddings of the characters in a window around the candidate, one
convolution, maxima over the context and over the candidate, one logistic unit. It is trained on the driver on labelled
findings made by a seeded generator (N_FINDINGS of them, a documented bound), with look-alikes that aren't secrets. One
part of them calibrates the score (Platt), another sets the threshold: the highest that keeps the wanted recall.

What the fixed rules find is always a finding; the network adds each span that those don't cover wholly.
"""

from __future__ import annotations

import copy
import hashlib
import re
import string
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.common import col, fresh, map_texts

#: Fixed rules: group 2 or the whole match must have so many characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones needn't be matched
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "model")

N_FINDINGS = 4000
RECALL = 0.98
BEFORE, BODY, AFTER = 28, 44, 12
WINDOW = BEFORE + BODY + AFTER
#: Steps of the windows over a longer body: any 33 characters of it lie in one window.
STEP = 11
LEAST = LEAST_ASSIGN
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}", re.A)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed rules; leftmost, not overlapping within a kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low or not text.isascii():
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def covered(spans: Sequence[tuple[int, str, int]], a: int, b: int) -> bool:
    """Whether the fixed rules' spans, sorted by start, hold all of a to b."""
    for s, kind, e in spans:
        if kind != "model" and s <= a < e:
            a = e
    return a >= b


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of LEAST or more key characters, of any kinds: the network judges every one."""
    out = []
    for m in CANDIDATE.finditer(text):
        size = len(m[0].rstrip("=-_/."))
        if size >= LEAST:
            out.append((m.start(), m.start() + size))
    return out


def views(a: int, b: int) -> list[tuple[int, int]]:
    """What the network looks at of a candidate: the whole, and of one over BODY windows that leave out no character."""
    return [(a, b)] if b - a <= BODY else [(a, b), *((s, s + BODY) for s in range(a, b - BODY, STEP)), (b - BODY, b)]


def _classes() -> np.ndarray:
    """Character classes: what a key looks like depends on kinds of characters more than on which they are."""
    of = np.full(128, 1, np.int8)
    for k, group in enumerate(("aeiou", "bcdf", "ghjklmn", "pqrstvwxyz", "AEIOU", "BCDF", "GHJKLMN", "PQRSTVWXYZ", "01234", "56789", "+/", "-", "_", "=", ".", ":", "'\"", "\n", " \t\r\v\f", "()[]{}<>", ",;!?"), 2):
        for c in group:
            of[ord(c)] = k
    return of


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 2


def windows(text: str, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Class codes of each candidate with its context; long candidates show their first and last characters."""
    out = np.zeros((len(spans), WINDOW), np.int8)
    for k, (a, b) in enumerate(spans):
        before, body, after = text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER]
        if len(body) > BODY:
            body = body[: BODY // 2] + body[-(BODY // 2) :]
        for s, at in ((before, BEFORE - len(before)), (body, BEFORE), (after, BEFORE + BODY)):
            codes = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
            out[k, at : at + codes.size] = CLASSES[codes]
    return out


class Network:
    """Embedding, convolution, maxima, logistic unit; trained by Adam."""

    WIDTH, FILTERS, SIZE = 5, 24, 8

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (N_CLASSES, self.SIZE)),
            "w": rng.normal(0, 0.2, (self.WIDTH * self.SIZE, self.FILTERS)),
            "b": np.zeros(self.FILTERS),
            "v": rng.normal(0, 0.2, 3 * self.FILTERS),
            "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        p, n = self.p, len(x)
        emb = p["e"][x.astype(np.int64)] * (x > 0)[:, :, None]
        steps = WINDOW - self.WIDTH + 1
        cols = np.concatenate([emb[:, k : k + steps] for k in range(self.WIDTH)], axis=2)
        z = cols.reshape(n * steps, -1) @ p["w"] + p["b"]
        a = np.maximum(z, 0).reshape(n, steps, self.FILTERS)
        cut = BEFORE - self.WIDTH // 2
        front, body = a[:, :cut], a[:, cut:]
        i, j = front.argmax(1), body.argmax(1)
        mean = body.mean(1)
        pool = np.concatenate([np.take_along_axis(front, i[:, None], 1)[:, 0], np.take_along_axis(body, j[:, None], 1)[:, 0], mean], 1)
        return pool @ p["v"] + p["c"][0], (x, cols, a, cut, i, j, pool)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[a : a + 1024])[0] for a in range(0, len(x), 1024)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                idx = order[at : at + batch]
                out, (xb, cols, a, cut, i, j, pool) = self.forward(x[idx])
                d = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[idx]) / len(idx)
                f = self.FILTERS
                dpool = d[:, None] * self.p["v"]
                da = np.zeros_like(a)
                da[:, cut:] += dpool[:, None, 2 * f :] / (a.shape[1] - cut)
                rows, filters = np.arange(len(idx))[:, None], np.arange(f)[None]
                da[rows, i, filters] += dpool[:, :f]
                da[rows, cut + j, filters] += dpool[:, f : 2 * f]
                dz = (da * (a > 0)).reshape(-1, f)
                flat = cols.reshape(-1, cols.shape[2])
                dcols = (dz @ self.p["w"].T).reshape(cols.shape)
                demb = np.zeros((len(idx), WINDOW, self.SIZE))
                for k in range(self.WIDTH):
                    demb[:, k : k + a.shape[1]] += dcols[:, :, k * self.SIZE : (k + 1) * self.SIZE]
                de = np.zeros_like(self.p["e"])
                np.add.at(de, xb.astype(np.int64).ravel(), (demb * (xb > 0)[:, :, None]).reshape(-1, self.SIZE))
                grads = {"e": de, "w": flat.T @ dz, "b": dz.sum(0), "v": pool.T @ d, "c": np.array([d.sum()])}
                t += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps."""
        z, w = self.logits(x), np.array([1.0, 0.0])
        m = np.stack([z, np.ones_like(z)], 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(m @ w, -40, 40)))
            h = (m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2)
            w = w - np.clip(np.linalg.solve(h, m.T @ (p - y) + 1e-3 * (w - [1, 0])), -1, 1)
        self.scale, self.shift = float(w[0]), float(w[1])

    def limit(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """The highest threshold at which at least `recall` of the secrets are found."""
        self.set_limit(self.probability(x)[y == 1], recall)

    def set_limit(self, p: np.ndarray, recall: float = RECALL) -> None:
        p = np.sort(p)
        self.threshold = float(p[int((1 - recall) * len(p))]) if len(p) else 0.5


def findings(n: int = N_FINDINGS, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, secret): keys in the ways they are written down, and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    syll = ["ka", "ter", "min", "os", "le", "ru", "van", "in", "to", "ble", "tion", "es", "qu", "al", "the", "and", "ing", "th", "st", "nd", "sch", "lich", "keit", "heit", "ung", "ver", "ent", "ber", "bl", "tz", "pf", "wh", "ly", "ed", "er", "en", "re", "ach", "cht", "str", "con", "ment", "ness", "ght"]
    word = lambda k=3: "".join(rng.choice(syll, k))
    names = ["key", "auth", "access_key", "client_key", "credential", "pwd", "private", "bearer", "signature", "API", "conn"]
    out = []
    for k in range(n):
        secret = k % 2
        before = " ".join(word(int(rng.integers(1, 4))) for _ in range(int(rng.integers(0, 6))))
        after = " " + " ".join(word(int(rng.integers(1, 4))) for _ in range(int(rng.integers(0, 4))))
        if secret:
            size = int(rng.integers(LEAST, 48))
            form = int(rng.integers(0, 7))
            body = (pick(low + up + dig, size), pick(low + up + dig + "+/", size), pick(up + dig, size), "".join(rng.choice(["sk", "pk", "ghp", "xox", "live"])) + "_" + pick(low + up + dig, size), pick("0123456789ABCDEF", size), pick(low + dig, size), pick(low + up, size))[form]
            lead = before + (f" {rng.choice(names)}{rng.choice([' = ', '=', ': ', ':'])}{rng.choice(['', chr(34), chr(39)])}" if rng.random() < 0.75 else " ")
        else:
            form = int(rng.integers(0, 18))
            body = (
                "-".join(word() for _ in range(4)) + pick(dig, 2), "_".join(word() for _ in range(4)) + pick(dig, 1), "/".join(word() for _ in range(4)) + "/" + pick(dig, 4),
                word(9) + pick(dig, 2), pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2) + "T" + pick(dig, 6) + "Z", "".join(word(2).title() for _ in range(6)), "v" + pick(dig, 1) + "-" + word(2) + "-" + word(2) + "-" + pick(dig, 3), word(1) * 8 + pick(dig, 1), word(2).upper() + "-" + "-".join(pick(dig, 4) for _ in range(4)),
                word(int(rng.integers(5, 9))), word(int(rng.integers(5, 9))), word(int(rng.integers(4, 8))).title(), word(int(rng.integers(4, 8))).upper(), "-".join(word(2) for _ in range(3)), "_".join(word(2) for _ in range(3)).upper(), "/".join(word(2) for _ in range(4)), word(3) + word(3).title() + word(2).title(), pick(dig, int(rng.integers(LEAST, 20))),
            )[form]
            body += word(6)[: max(0, LEAST - len(body))]
            lead = before + rng.choice([" ", " ", " http://", " /", " id: ", " see "])
        text = f"{lead}{body}{after}"
        out.append((text, len(lead), len(lead) + len(body), secret))
    return out


def paths(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """Labelled long candidates (text, start, end, start of the key, its end): words joined, every other one with a key among them."""
    rng = np.random.default_rng(seed)
    keys = [(t[a:b]) for t, a, b, secret in findings(2 * n, seed + 1) if secret]
    words = [w for t, *_, secret in findings(n, seed + 2) if not secret for w in t.split() if w.isalpha()]
    out = []
    for k in range(n):
        cut = str(rng.choice(["/", "/", "-", "_"]))
        front, back = (cut.join(rng.choice(words, int(rng.integers(3, 12)))) + cut for _ in range(2))
        key = keys[k] if k % 2 else ""
        lead = str(rng.choice(["see ", "http:/", "", "id: "]))
        a, at = len(lead), len(lead) + len(front)
        text = f"{lead}{front}{key}{cut if key else ''}{back}".rstrip("=-_/.")
        out.append((f"{text} {rng.choice(words)}", a, len(text), at, at + len(key)))
    return out


def trained(n: int = N_FINDINGS, seed: int = 5) -> Network:
    """The network of this module: the same on every run for the same n and seed, trained once in a process. A copy, so that it may be changed."""
    return copy.deepcopy(_trained(n, seed))


@lru_cache(maxsize=4)
def _trained(n: int, seed: int) -> Network:
    """Trained, calibrated and limited on what a scan shows it."""
    codes, labels, part, of, secret = [], [], [], [], []
    rows = [(t, a, b, a, b if y else a) for t, a, b, y in findings(n, seed)] + paths(n // 4, seed + 20)
    for k, (t, a, b, c, d) in enumerate(rows):
        seen = views(a, b)
        if b - a > BODY and (c, d) != (a, b) and d > c:
            seen = seen[1:]  # the first view is of the ends only, so it doesn't say whether a key lies between
        # A window is of a secret if it shows most of the key or many characters of it, of none if it shows next to nothing.
        shown = [max(0, min(d, f) - max(c, e)) for e, f in seen]
        use = [(v, float(s >= min(24, 0.7 * (d - c)) and s > 0)) for v, s in zip(seen, shown, strict=True) if s <= 3 or s >= min(24, 0.7 * (d - c))]
        codes.append(windows(t, [v for v, _ in use]))
        labels += [y for _, y in use]
        part += [k // 2 % 4] * len(use)
        of += [k] * len(use)
        secret.append(d > c)
    x, y, part, of = np.concatenate(codes), np.array(labels), np.array(part), np.array(of)
    net = Network()
    net.train(x[part < 2], y[part < 2])
    net.calibrate(x[part == 2], y[part == 2])
    best = np.zeros(len(rows))
    np.maximum.at(best, of[part == 3], net.probability(x[part == 3]))
    last = np.arange(len(rows)) // 2 % 4 == 3
    net.set_limit(best[last & np.array(secret)])
    return net


class Scanner:
    def __init__(self, net: Network | None):
        self.net = net

    def spans(self, texts: Sequence[str]) -> list[list[tuple[int, str, int]]]:
        """All spans of each text by start, then kind: the fixed rules' and what the network adds."""
        found = [base_spans(t) for t in texts]
        if self.net is None:
            return found
        where, codes, sizes = [], [], []
        for k, t in enumerate(texts):
            cand = candidates(t)
            if cand:
                where += [(k, a, b) for a, b in cand]
                seen = [views(a, b) for a, b in cand]
                sizes += map(len, seen)
                codes.append(windows(t, [v for s in seen for v in s]))
        if not where:
            return found
        p = np.maximum.reduceat(self.net.probability(np.concatenate(codes)), np.cumsum([0, *sizes[:-1]]))
        for (k, a, b), q in zip(where, p.tolist(), strict=True):
            if q >= self.net.threshold and not covered(found[k], a, b):
                found[k].append((a, "model", b))
        return [sorted(f, key=lambda s: (s[0], KINDS.index(s[1]))) for f in found]


def joined(spans: Sequence[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def redacted(text: str, spans: Sequence[tuple[int, str, int]], mask: str = "[{}]") -> str:
    """The text with every span replaced by its kind; spans that overlap are replaced together."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask.format(kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(df: DataFrame, net: Network | None = None, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep`, n_assign, n_access, n_hex, base_sha256, spans (as text) and span_list; a row for each row.

    Null and empty texts have no spans; base_sha256 is then the digest of the empty text. Texts of any length are
    scanned whole; repeated rows get equal spans; an empty table gives no rows; columns of `keep` named like an output
    are replaced. Spans that begin at one place come in the order of KINDS.
    """
    shared = df.sparkSession.sparkContext.broadcast(net or trained())
    fields = [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("span_list", SPANS)]

    def make():
        scanner = Scanner(shared.value)

        def run(texts):
            found = scanner.spans(texts)
            base = [[s for s in f if s[1] != "model"] for f in found]
            counts = [[sum(s[1] == k for s in f) for f in base] for k in KINDS[:3]]
            return [*counts, [hashlib.sha256(joined(f).encode()).hexdigest() for f in base], [joined(f) for f in found], [[{"kind": k, "start": a, "end": b} for a, k, b in f] for f in found]]

        return run

    return map_texts(df, make, fields, text, keep)


def redact(df: DataFrame, net: Network | None = None, text: str = "text") -> DataFrame:
    """df with every secret in `text` masked; all rows and columns stay, n_chars (if a column) follows the text.

    Null and empty texts stay as they are; repeated rows are masked alike; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(net or trained())

    from pyspark.sql import functions as F

    masked = fresh("masked_", df.columns)

    def make():
        scanner = Scanner(shared.value)
        return lambda texts: [[redacted(t, f) if f else t for t, f in zip(texts, scanner.spans(texts), strict=True)]]

    got = map_texts(df, make, [T.StructField(masked, T.StringType())], text, df.columns, keep_text=True)
    got = got.select(*[F.when(col(c).isNotNull(), F.col(masked)).alias(c) if c.lower() == text.lower() else col(c) for c in df.columns])
    chars = next((c for c in df.columns if c.lower() == "n_chars"), None)
    if chars is None:
        return got
    kind = got.select(chars).schema[0].dataType
    return got.withColumn(chars, F.when(col(text).isNull(), col(chars)).otherwise(F.length(col(text))).cast(kind))
