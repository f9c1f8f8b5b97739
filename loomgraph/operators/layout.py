"""Maps: positions of places by forces, hulls, labels, region groups, overlaps. One book's places fit one task."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the layout: rounds, length of a spring, least distance of two places, furthest distance of near ones.
ROUNDS, SPRING, APART, NEAR = 120, 180.0, 118.0, 230.0
#: Places are pushed away only by others within this distance, found by a grid.
REACH = 430.0
#: Pairs of places whose distances are held at once.
CANDIDATES = 1_000_000


def _pairs(x: np.ndarray, y: np.ndarray, reach: float) -> list[np.ndarray]:
    """i, j, x[i] - x[j], y[i] - y[j] of pairs i < j at most reach apart, by cells of that size; in order of i's cell, i, j's cell, j."""
    cx, cy = (np.floor(v / reach).astype(np.int64) for v in (x, y))
    wide = int(np.ptp(cy)) + 3
    cells, first, own = np.unique((cx - cx.min()) * wide + cy - cy.min(), return_index=True, return_inverse=True)
    members = np.argsort(own, kind="stable")  # by cell, then index
    begin = np.r_[0, np.cumsum(np.bincount(own))]
    around = cells[:, None] + (np.array([-1, 0, 1])[:, None] * wide + np.array([-1, 0, 1])).ravel()
    k = np.minimum(np.searchsorted(cells, around), len(cells) - 1)
    size = np.where(cells[k] == around, begin[k + 1] - begin[k], 0)
    left = np.argsort(first[own], kind="stable")  # cells as they come
    total = np.cumsum(size.sum(1)[own[left]])
    out, a = [], 0
    while a < len(left):  # about CANDIDATES pairs at a time
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CANDIDATES)))
        i, n = left[a:b], size[own[left[a:b]]]
        flat = n.ravel()
        j = members[np.arange(flat.sum()) + np.repeat(begin[k[own[i]]].ravel() - np.cumsum(flat) + flat, flat)]
        i = np.repeat(i, n.sum(1))
        kept = np.flatnonzero(i < j)
        i, j = i[kept], j[kept]
        dx, dy = x[i] - x[j], y[i] - y[j]
        kept = np.flatnonzero(dx * dx + dy * dy <= reach * reach)
        out.append([v[kept] for v in (i, j, dx, dy)])
        a = b
    return out[0] if len(out) == 1 else [np.concatenate(v) for v in zip(*out, strict=True)]


def positions(n: int, springs: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
    """(n, 2) positions: from a spiral, pushed apart and drawn along springs, then spread to the least distance.

    The same input always gives the same positions. near: pairs that end at most NEAR apart, where the least distance
    allows it.
    """
    if not n:
        return np.zeros((0, 2))
    k = np.arange(n)
    x, y = np.cos(k * 2.399963229728653) * (92 * np.sqrt(k + 1)), np.sin(k * 2.399963229728653) * (92 * np.sqrt(k + 1))
    a, b = springs.T if len(springs) else np.zeros((2, 0), int)
    for r in range(ROUNDS):
        i, j, dx, dy = _pairs(x, y, REACH)
        size = np.maximum(np.hypot(dx, dy), 1.0)
        push = SPRING * SPRING / size
        sx, sy = x[a] - x[b], y[a] - y[b]
        long = np.maximum(np.hypot(sx, sy), 1.0)
        at = np.concatenate([i, j, a, b])
        parts = [(d / size * push * 0.05, s / long * (long - SPRING) * 0.12) for d, s in ((dx, sx), (dy, sy))]
        mx, my = (np.bincount(at, np.concatenate([p, -p, -q, q]), n) for p, q in parts)
        size = np.maximum(np.hypot(mx, my), 1e-9)
        step = np.minimum(size, 60.0 * (1 - r / ROUNDS) + 1)
        x, y = x + mx / size * step, y + my / size * step
    for _ in range(400):
        moved = False
        if near is not None and len(near) and (np.hypot(x[near[:, 1]] - x[near[:, 0]], y[near[:, 1]] - y[near[:, 0]]) > NEAR - 1e-6).any():
            xs, ys = x.tolist(), y.tolist()
            for i, j in near.tolist():  # one after another: pairs share places
                dx, dy = xs[j] - xs[i], ys[j] - ys[i]
                size = math.hypot(dx, dy)
                if size > NEAR:
                    xs[j] -= dx / size * (size - NEAR)
                    ys[j] -= dy / size * (size - NEAR)
                    moved = True
            x, y = np.array(xs), np.array(ys)
        i, j, dx, dy = _pairs(x, y, APART)
        size = np.hypot(dx, dy)
        close = np.flatnonzero(size < APART - 1e-6)
        if len(close):
            i, j, dx, dy, size = i[close], j[close], dx[close], dy[close], size[close]
            flat = size < 1e-9
            dx[flat], dy[flat], size[flat] = 1.0, 0.0, 1.0
            step = (APART - np.where(flat, 0.0, size)) / 2 + 0.5
            at = np.concatenate([k, i, j])
            x, y = (np.bincount(at, np.concatenate([v, d / size * step, -(d / size * step)]), n) for v, d in ((x, dx), (y, dy)))
            moved = True
        if not moved:
            break
    return np.c_[x, y]


def layout(places: DataFrame, relations: DataFrame, book: str = "book_id") -> DataFrame:
    """book, place_id, x, y of every place. places: book, place_id. relations: book, a, b, kind (near, or other springs).

    Relations with an end that isn't a place of the book, or with equal ends, have no effect. Books are dealt out to as
    many tasks as shuffles have partitions: their rows are few, their work isn't, so tasks aren't joined by size.
    """

    def run(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(p["place_id"].tolist()))
        at = {x: k for k, x in enumerate(ids)}
        ends = sorted({(at[a], at[b], kind == "near") for a, b, kind in zip(r["a"], r["b"], r["kind"], strict=True) if a in at and b in at and a != b})
        springs = np.array([e[:2] for e in ends], int).reshape(-1, 2)
        xy = positions(len(ids), springs, np.array([e[:2] for e in ends if e[2]], int).reshape(-1, 2))
        return pd.DataFrame({book: p[book].iloc[0] if ids else None, "place_id": ids, "x": xy[:, 0], "y": xy[:, 1]})

    kind = places.schema[book].dataType.simpleString()
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [df.repartition(n, book).groupBy(book) for df in (places, relations)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(run, f"{book} {kind}, place_id long, x double, y double")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the smallest convex polygon, counter-clockwise from the leftmost; points on an edge are left out."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def side(row: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in row:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return side(pts) + side(pts[::-1])


def region_groups(nodes: list[int], edges: list[tuple[int, int]], visits: dict[int, int]) -> list[list[int]]:
    """Each component whole up to eight nodes, else cut breadth first from its earliest visited node.

    Groups of a cut component aim at 5 to 8 nodes, growing with its root; a last one under three joins its predecessor.
    visits: the first visit of a node; nodes never visited come last.
    """
    around: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in edges:
        if a != b and a in around and b in around:
            around[a].append(b)
            around[b].append(a)
    rank = lambda n: (visits.get(n, math.inf), n)
    left, out = set(nodes), []
    for seed in sorted(nodes, key=rank):
        if seed not in left:
            continue
        todo, walk = deque([seed]), []
        left.discard(seed)
        while todo:
            walk.append(n := todo.popleft())
            for m in sorted(around[n], key=rank):
                if m in left:
                    left.discard(m)
                    todo.append(m)
        size = len(walk) if len(walk) <= 8 else max(5, min(8, round(math.sqrt(len(walk)) * 1.45)))
        groups = [walk[k : k + size] for k in range(0, len(walk), size)]
        if len(groups) > 1 and len(groups[-1]) < 3:
            groups[-2:] = [groups[-2] + groups[-1]]
        out += [sorted(g) for g in groups]
    return out


def place_labels(boxes: list[tuple[float, float, float, float]], width: float, height: float, gap: float = 12.0) -> list[tuple[float, float]]:
    """Corner (x, y) of each label, most important first: the first of eight places around its point without a collision.

    boxes: x, y of the point, width and height of the label. Where all collide the least bad place is taken: a
    collision counts 1000, lying outside the map 100.
    """
    put: list[tuple[float, float, float, float]] = []
    for x, y, w, h in boxes:
        tries = [(x + a * (gap + w / 2) - w / 2, y + b * (gap + h / 2) - h / 2) for a, b in ((1, 0), (-1, 0), (0, -1), (0, 1), (1, -1), (1, 1), (-1, -1), (-1, 1))]

        def bad(c: tuple[float, float], w=w, h=h) -> int:
            hits = sum(c[0] < q[0] + q[2] and q[0] < c[0] + w and c[1] < q[1] + q[3] and q[1] < c[1] + h for q in put)
            return 1000 * hits + 100 * (c[0] < 0 or c[1] < 0 or c[0] + w > width or c[1] + h > height)

        put.append((*min(tries, key=bad), w, h))
    return [q[:2] for q in put]


def overlaps(boxes: DataFrame, cell: float) -> DataFrame:
    """left_id, right_id, ratio of boxes that overlap: the common area over the smaller one's.

    boxes: box_id, x0, y0, x1, y1. Boxes are dealt out to the grid cells that they touch; a pair is reported in the
    cell that holds the lower corner of its common area, so in one only. Choose cells about as large as boxes.
    """
    f = lambda c: F.floor(F.col(c) / cell)
    b = boxes.withColumn("cx", F.explode(F.sequence(f("x0"), f("x1")))).withColumn("cy", F.explode(F.sequence(f("y0"), f("y1"))))
    side = lambda s: b.select("cx", "cy", *[F.col(c).alias(f"{s}_{c}") for c in ("box_id", "x0", "y0", "x1", "y1")])
    x, y = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    w, h = F.least("l_x1", "r_x1") - x, F.least("l_y1", "r_y1") - y
    area: Column = F.least((F.col("l_x1") - F.col("l_x0")) * (F.col("l_y1") - F.col("l_y0")), (F.col("r_x1") - F.col("r_x0")) * (F.col("r_y1") - F.col("r_y0")))
    pairs = side("l").join(side("r"), ["cx", "cy"]).where("l_box_id < r_box_id")
    met = pairs.where((w > 0) & (h > 0) & (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy")))
    return met.select(F.col("l_box_id").alias("left_id"), F.col("r_box_id").alias("right_id"), F.round(w * h / area, 6).alias("ratio"))
