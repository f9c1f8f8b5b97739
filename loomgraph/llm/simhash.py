"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint has eight bytes. Two that differ in at most four bits share at least four (position, byte) postings: the
guaranteed minimum. Lists of single postings would hold a 256th of all fingerprints each, so lists are kept by three
positions at once: TRIPLES are so chosen that any four of the eight positions hold one of them. Those in a list share
three postings; the lists of the other five positions, kept within it, are merged and each pair's shared postings are
tallied. Only pairs whose tally reaches the minimum are verified by their bits.

Equal fingerprints are one class from the start, so copies are never expanded into pairs. Lists with many different
fingerprints are refined by a fourth position, which keeps every pair with four shared bytes, and what stays large is
cut into blocks compared two by two in separate tasks. A task returns a spanning forest of its links, never all pairs.
Components come from alternating large-star and small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import besides, col, fresh, join_sized, map_texts, stored

BYTES = 8
#: Fingerprints of an index entry that are compared in one piece; twice as many at most meet in a task's cell.
BLOCK = 512


def _triples(n: int = BYTES) -> list[tuple[int, ...]]:
    """Triples such that any four positions hold one: three cyclic parts; all inside a part, and two of a part with one of the next."""
    part = [i % 3 for i in range(n)]
    found = [t for t in combinations(range(n), 3) if len({part[i] for i in t}) == 1 or any(sorted(part[i] for i in t) == sorted((p, p, (p + 1) % 3)) for p in range(3))]
    assert all(any(set(t) <= set(q) for t in found) for q in combinations(range(n), 4))
    return found


TRIPLES = _triples()


def fingerprints(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), size: int = 4, out: str = "fp", keep_text: bool = False) -> DataFrame:
    """`keep` and the 64-bit fingerprint as a signed long, in one pass.

    A-Z is lower-cased; words are runs of anything but the six ASCII blanks; a shingle is `size` words joined by
    blanks, repeats included; a shorter text is one shingle; one without words has fingerprint zero.
    """

    def make():
        from xxhash import xxh64_intdigest as xxh

        def one(text: str) -> int:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return 0
            if len(words) <= size:
                v = xxh(b" ".join(words), 42)
                return v - (1 << 64) if v >> 63 else v
            flat = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-size]]).tolist()
            ends = (ends[size - 1 :] - 1).tolist()
            h = np.array([xxh(flat[a:b], 42) for a, b in zip(starts, ends, strict=True)], ">u8")
            total = np.zeros(64, np.int64)
            for a in range(0, h.size, 65536):
                total += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            return int(np.packbits(2 * total > h.size).view(">i8")[0])

        return lambda texts: [[one(t) for t in texts]]

    return map_texts(df, make, [T.StructField(out, T.LongType())], text, keep, keep_text)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _entry(fp: Column, positions: Sequence[int], number: int) -> Column:
    """An index key: which positions, and their bytes."""
    key = F.lit(number).cast("long")
    for i in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, i))
    return key


def tally(prints: np.ndarray, left: int | None = None) -> np.ndarray:
    """How many postings each pair shares, summed over the lists of all (position, byte); left: only pairs of the first `left` with the others."""
    n = prints.size
    shared = np.zeros((n, n), np.uint8)
    codes = prints.view(np.uint8).reshape(n, BYTES)
    for i in range(BYTES):
        order = np.argsort(codes[:, i], kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order, i])) + 1
        for members in np.split(order, cuts) if cuts.size else [order]:
            if members.size == n:
                shared += 1
            elif members.size > 1:
                if left is None:
                    shared[members[:, None], members] += 1
                else:
                    a, b = members[members < left], members[members >= left]
                    shared[a[:, None], b] += 1
    return shared


def _cell_links(most_bits: int, least_bytes: int):
    """A function over the cells of Arrow batches: links of each cell as a spanning forest."""

    def links(a: np.ndarray, b: np.ndarray | None) -> list[tuple[int, int]]:
        all_ = a if b is None else np.concatenate([a, b])
        if all_.size == 2:
            x = all_[0] ^ all_[1]
            near = sum(v == 0 for v in int(x).to_bytes(BYTES, "big")) >= least_bytes and int(x).bit_count() <= most_bits
            return [tuple(all_.view(np.int64).tolist())] if near else []
        i, j = np.nonzero(tally(all_, None if b is None else a.size) >= least_bytes)
        fit = (i < j) if b is None else (i < a.size) & (j >= a.size)  # links inside a block belong to that block's own cell
        i, j = i[fit], j[fit]
        near = np.bitwise_count(all_[i] ^ all_[j]) <= most_bits
        i, j = i[near], j[near]
        # A spanning forest: each node takes the smallest number among its neighbours' until none changes.
        root = np.arange(all_.size)
        while i.size:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, root[i], low)
            np.minimum.at(new, root[j], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        signed = all_.view(np.int64)
        return [(int(signed[r]), int(signed[k])) for k, r in enumerate(root.tolist()) if r != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for same, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a = np.unique(np.array(left, np.int64)).view(np.uint64)
                b = None if same else np.unique(np.array(right, np.int64)).view(np.uint64)
                if a.size and (b is None and a.size > 1 or b is not None and b.size):
                    for s, d in links(a, b):
                        src.append(s)
                        dst.append(d)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["a", "b"])

    return run


def links(fps: DataFrame, fp: str = "fp", most_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints of at most `most_bits` bits, as forests with the same components.

    fps holds each fingerprint once. most_bits may be 4 at most: the index guarantees no more.
    """
    if not 0 <= most_bits <= 4:
        raise ValueError("the index covers 0 to 4 bits")
    col = F.col(fp)
    index = fps.select(F.explode(F.array(*[_entry(col, t, n) for n, t in enumerate(TRIPLES)])).alias("key"), col.alias("fp"))
    sizes = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    # Refined: every pair of a large entry that shares four bytes shares one of the five fourth positions too.
    large = index.join(sizes.where(F.col("n") > block), "key")
    number = F.shiftrightunsigned(F.col("key"), 24)
    finer = []
    quads = {q: k for k, q in enumerate(combinations(range(BYTES), 4))}
    for n, t in enumerate(TRIPLES):
        finer.append(F.when(number == n, F.array(*[_entry(F.col("fp"), q, 1000 + k) for q, k in quads.items() if set(t) <= set(q)])))
    quad = stored(large.select(F.explode(F.coalesce(*finer)).alias("key"), "fp").dropDuplicates(), "simhash-large")
    quad_sizes = quad.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    small = index.join(sizes.where(F.col("n") <= block), "key")
    rows = small.select("key", "fp", "n").unionByName(quad.join(quad_sizes, "key").select("key", "fp", "n"))
    # Blocks of an entry meet pairwise: cell (i, j) holds block i as left and block j as right.
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    cells = rows.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "fp")
    grouped = cells.groupBy("key", "i", "j").agg(F.collect_list(F.when(F.col("left"), F.col("fp"))).alias("l"), F.collect_list(F.when(~F.col("left"), F.col("fp"))).alias("r"))
    return grouped.select((F.col("i") == F.col("j")).alias("same"), "l", "r").where(F.size("l") + F.size("r") > 1).mapInArrow(_cell_links(most_bits, BYTES - most_bits), "a long, b long").dropDuplicates()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) reaches. Rounds grow with the log of the diameter; hubs are split.

    Loops, repeated edges and their directions don't matter; an empty table gives no rows.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).dropDuplicates(), "cc")
    mark = None
    for _ in range(most_rounds):
        # Large star: each larger neighbour is tied to the smallest neighbour (or the node itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        star = stored(join_sized(both.where("v > u"), least, ["u"], "n", F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).dropDuplicates(), "cc-star")
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = stored(star.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        edges = join_sized(star, least, ["u"], "n", F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).dropDuplicates()
        edges = stored(edges, "cc")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] | None = None, size: int = 4, most_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """`keep` (doc_id by default), fp, fingerprint (hex), root and component_id, the smallest doc_id reachable over links.

    One row for each row of df, repeated rows too. Rows without an id take part; a component of such rows only has a null
    id. Ids may repeat, so components may share a component_id; root, the smallest fingerprint reachable, is each one's
    own. Null and empty texts have fingerprint zero and are linked like any other. Columns named like an output are
    replaced. An empty table gives no rows.
    """
    outputs = ("fp", "fingerprint", "root", "component_id")
    cols = besides([doc_id] if keep is None else keep, outputs)
    name = fresh("id_", [*cols, *outputs, "n"])
    prints = stored(fingerprints(df.withColumn(name, col(doc_id)), text, [*cols, name], size, "fp"), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min(name).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = components(links(classes.select("fp"), "fp", most_bits, block)).withColumnRenamed("node", "fp")
    member = stored(classes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-members")
    merged = stored(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_prints")), "simhash-roots")
    ids = stored(join_sized(member, merged, ["root"], "n_prints", F.xxhash64("fp")).select("fp", "n", "root", "component_id"), "simhash-ids")
    got = join_sized(prints, ids, ["fp"], "n", F.xxhash64(name, F.monotonically_increasing_id()))
    return got.select(*[col(c) for c in cols], "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", most_bits: int = 4) -> DataFrame:
    """df with one row of each component: the one with the smallest id (of equal ids, the first row), with all its columns.

    Rows without an id come after all others; an empty table stays empty.
    """
    names = [fresh(c, df.columns) for c in ("row_", "id_")]
    row, key = names
    numbered = stored(df.select(*[col(c) for c in df.columns], F.monotonically_increasing_id().alias(row)), "dedup-rows")
    found = near_duplicates(numbered.select(col(text).alias("text"), col(doc_id).alias(key), row), "text", key, [key, row], most_bits=most_bits)
    best = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(row).alias("row"))).alias("best")).select(F.col("best.row").alias(row))
    return numbered.join(best, row, "left_semi").select(*[col(c) for c in df.columns])
