"""Graphs: components, containment, degrees, acceptance of order edges, and checks of positions."""

from __future__ import annotations

import heapq
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Direction constraints hold from this cosine on, proximity up to this distance.
LEAST_COSINE, MOST_DISTANCE = 0.15, 280.0


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed in the shared folder. Only a local session that names none gets one of its own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp()}")
    return df.checkpoint()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) reaches; loops and repeated edges don't matter.

    Large-star and small-star in turn: a node's larger neighbours, then its smaller ones, are tied to the smallest that
    is near, until all edges are stars. Edges never become more; rounds grow with the log of the diameter. Lineage is cut
    by checkpoint(), which executors may be lost after.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).dropDuplicates())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).dropDuplicates()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(star.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).dropDuplicates())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).dropDuplicates()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark = state
    raise RuntimeError("components did not settle")


def containment(parents: DataFrame, most_depth: int = 12) -> DataFrame:
    """(node, ancestor, depth) for all pairs of (node, parent), a node not being its own ancestor; depth to most_depth.

    Each level is checkpointed, so the next one doesn't work out all levels before it again.
    """
    found = step = cut(parents.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array("node", "parent").alias("path")))
    up = parents.select(F.col("node").alias("n"), F.col("parent").alias("p"))
    for depth in range(2, most_depth + 1):
        step = cut(step.join(up, step["ancestor"] == up["n"]).where(~F.array_contains("path", F.col("p"))).select("node", F.col("p").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("path", F.array("p")).alias("path")))
        if step.isEmpty():
            break
        found = found.unionByName(step)
    return found.select("node", "ancestor", "depth")


def degrees(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """node, degree, isolated for every node; edges as (a, b)."""
    ends = edges.select(F.col("a").alias(node)).union(edges.select("b")).groupBy(node).agg(F.count(F.lit(1)).alias("degree"))
    d = F.coalesce("degree", F.lit(0)).cast("long")
    return nodes.select(node).join(ends, node, "left").select(node, d.alias("degree"), (d == 0).alias("isolated"))


def order_events(events: DataFrame, edges: DataFrame, book: str = "book_id") -> DataFrame:
    """book, event_id, story_order, n_conflicts: an acyclic order of each book's events.

    Edges are taken by confidence (larger first), then id; one that would close a cycle, or whose ends aren't both
    events of the book, is a conflict. The order is topological, ties by narrative rank, then id. A book's events fit
    one task (thousands at most), which is what the sequential acceptance needs.
    events: book, event_id, narrative. edges: book, edge_id, earlier, later, confidence.
    """

    def order(ev: pd.DataFrame, ed: pd.DataFrame) -> pd.DataFrame:
        rank = dict(zip(ev["event_id"].tolist(), ev["narrative"].tolist(), strict=True))
        after: dict[int, set[int]] = {e: set() for e in rank}
        waits = dict.fromkeys(rank, 0)
        conflicts = 0
        for _, _, a, b in sorted(zip(-ed["confidence"], ed["edge_id"], ed["earlier"], ed["later"], strict=True)):
            seen, todo = set(), [b]
            while todo and a not in seen:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += after.get(x, ())
            if a not in rank or b not in rank or a in seen:
                conflicts += 1
            elif b not in after[a]:
                after[a].add(b)
                waits[b] += 1
        ready = [(r, e) for e, r in rank.items() if not waits[e]]
        heapq.heapify(ready)
        out = []
        while ready:
            _, e = heapq.heappop(ready)
            out.append(e)
            for x in after[e]:
                waits[x] -= 1
                if not waits[x]:
                    heapq.heappush(ready, (rank[x], x))
        key = ev[book].iloc[0] if len(ev) else None
        return pd.DataFrame({book: [key] * len(out), "event_id": out, "story_order": range(len(out)), "n_conflicts": conflicts})

    kind = events.schema[book].dataType.simpleString()
    return events.groupBy(book).cogroup(edges.groupBy(book)).applyInPandas(order, f"{book} {kind}, event_id long, story_order long, n_conflicts long")


def cosine_to(dx: Column, dy: Column, ux: float, uy: float) -> Column:
    """Cosine of (dx, dy) to a unit direction; 0 for a zero vector."""
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size == 0, F.lit(0.0)).otherwise((dx * ux + dy * uy) / size)


def direction_holds(dx: Column, dy: Column, ux: float, uy: float) -> Column:
    return cosine_to(dx, dy, ux, uy) >= LEAST_COSINE


def near_holds(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy) <= MOST_DISTANCE


def golden_layout(rank: Column, radius: float = 92.0) -> tuple[Column, Column]:
    """Positions on a golden-angle spiral for nodes without a layout."""
    angle, r = rank * 2.399963229728653, F.sqrt(rank + 1.0) * radius
    return r * F.cos(angle), r * F.sin(angle)
