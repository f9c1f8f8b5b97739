"""Entity resolution: candidate pairs, verdicts, reversible merging, and removal of repeated facts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import match_ratio
from loomgraph.operators.graph import components


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """With left_id and right_id: the pair whichever way round it is written."""
    return df.withColumn("left_id", F.least(a, b)).withColumn("right_id", F.greatest(a, b))


def lookup(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entity of each wanted name, by name or alias: the first by (first_segment, entity_id).

    names: entity_id, name, aliases, first_segment. wanted: name. One join key, so no join on a disjunction.
    """
    keys = names.select("entity_id", "first_segment", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    first = keys.groupBy("name").agg(F.min(F.struct("first_segment", "entity_id")).alias("m")).select("name", F.col("m.entity_id").alias("entity_id"))
    return wanted.select("name").dropDuplicates().join(first, "name", "left")


#: Events are met pair by pair up to so many pairs a participant on average; beyond, pairs are counted in place.
PAIRS = 64
#: Participants of a block of entities, least number of blocks, entities of a tile of counts, rows of a batch that is returned.
BLOCK_ROWS, BLOCKS, TILE, BATCH = 1_000_000, 6, 1024, 65_536


def role_conflicts(participants: DataFrame, event: str = "event_id", entity: str = "entity_id", role: str = "role", block: int = 256, pairs: float = PAIRS) -> DataFrame:
    """Pairs of entities that take part in one event with different roles, and in how many events.

    An entity is one row of its event, whatever its roles. If events are small, their pairs are made and summed; events of
    more than `block` entities are met block by block in separate tasks. If they have over `pairs` pairs a participant,
    entities are dealt out to blocks instead, and a task counts the pairs of two blocks in place: no pair of an event is
    ever shuffled, only the participants are, once for each block. The pairs that conflict are the result itself.
    """
    p = participants.groupBy(F.col(event).alias("e"), F.col(entity).alias("id")).agg(F.min(role).alias("low"), F.max(role).alias("high")).where("low is not null and e is not null and id is not null")
    sizes = p.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("met")).first()
    if size.n and size.met > pairs * size.n:
        return _counted(p, max(BLOCKS, -(-size.n // BLOCK_ROWS)))
    p = p.join(sizes.withColumn("n", F.ceil(F.col("n") / block).cast("int")), "e")
    own = F.pmod(F.xxhash64("id"), F.col("n").cast("long")).cast("int")
    l = p.select("e", F.col("id").alias("left_id"), F.col("low").alias("ll"), F.col("high").alias("lh"), own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    r = p.select("e", F.col("id").alias("right_id"), F.col("low").alias("rl"), F.col("high").alias("rh"), own.alias("j"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    alike = (F.col("ll") == F.col("lh")) & (F.col("rl") == F.col("rh")) & (F.col("ll") == F.col("rl"))
    return l.join(r, ["e", "i", "j"]).where(F.col("left_id") < F.col("right_id")).where(~alike).groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n_events"))


def _counted(p: DataFrame, blocks: int) -> DataFrame:
    """The conflicts of p (e, id, low, high) by pairs of blocks of entities: those of one task are final."""
    own, n = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.lit(blocks)
    rows = p.select("e", "id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("one"), own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    side = F.when(F.col("own") < F.col("k"), 0).when(F.col("own") > F.col("k"), 1).otherwise(2)
    rows = rows.select((F.least("own", "k") * n + F.greatest("own", "k")).alias("g"), side.alias("side"), "e", "id", "one")
    kind = p.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            g = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else []
            for a, z in zip(cuts, cuts[1:]):
                if held and g[a] != now:
                    yield from _tiles(pa.Table.from_batches(held))
                    held = []
                now = g[a]
                held.append(b.slice(a, z - a))
        if held:
            yield from _tiles(pa.Table.from_batches(held))

    tasks = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    met = rows.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(run, f"a {kind}, b {kind}, n_events long")
    return met.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "n_events")


def _tiles(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """a, b, n_events of the pairs of two blocks' entities, or of one block's, tile by tile. rows: side (0, 1, or 2: both), e, id, one."""

    def coded(c: str) -> tuple[np.ndarray, pa.Array]:
        d = rows[c].combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        return d.indices.fill_null(-1).to_numpy(zero_copy_only=False), d.dictionary

    side, (e, events), (who, names), (one, _) = rows["side"].to_numpy(), coded("e"), coded("id"), coded("one")

    def cut(mine: np.ndarray, none: int) -> list[tuple]:
        ids, at = np.unique(who[mine], return_inverse=True)
        when, what = e[mine], np.where(one[mine] < 0, none, one[mine])
        order = np.lexsort((when, at // TILE))
        at, when, what = at[order], when[order], what[order]
        out = []
        for t in range(-(-len(ids) // TILE)):
            a, z = np.searchsorted(at // TILE, [t, t + 1])
            out.append((ids[t * TILE : (t + 1) * TILE], at[a:z] - t * TILE, what[a:z], np.searchsorted(when[a:z], np.arange(len(events) + 1)).tolist()))
        return out

    both = bool((side == 2).any())
    right = cut(side != 0, -2)
    for s, (ids, i, x, at) in enumerate(cut(side != 1, -1)):
        for t, (others, j, y, to) in enumerate(right):
            if both and t < s:
                continue
            n = np.zeros((len(ids), len(others)), np.int32)
            for k in range(len(events)):
                a, b, c, d = at[k], at[k + 1], to[k], to[k + 1]
                if a < b and c < d:
                    n[i[a:b, None], j[c:d]] += x[a:b, None] != y[c:d]  # an entity is in an event once
            if both and s == t:
                n = np.triu(n, 1)
            u, v = np.nonzero(n)
            for a in range(0, len(u), BATCH):
                l, r = u[a : a + BATCH], v[a : a + BATCH]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(ids[l])), names.take(pa.array(others[r])), pa.array(n[l, r].astype(np.int64))], names=["a", "b", "n_events"])


def verdicts(pairs: DataFrame) -> DataFrame:
    """verdict and confidence of each candidate pair.

    pairs: conflict, same_key, shared_alias (booleans), confidence, left_summary, right_summary. A conflict separates
    whatever else speaks for a merge.
    """
    ratio = match_ratio(F.col("left_summary"), F.col("right_summary"))
    rows = pairs.withColumn("ratio_", ratio)
    close = (F.col("confidence") >= 0.985) & (F.col("ratio_") >= 0.86)
    verdict: Column = F.when(F.col("conflict"), "separate").when(F.col("same_key") | F.col("shared_alias") | close, "merge").otherwise("needs_review")
    sure = F.when(F.col("conflict") | F.col("same_key"), 0.995).when(F.col("shared_alias"), 0.97).when(close, F.least(F.lit(0.99), F.col("confidence"))).otherwise(F.greatest(F.lit(0.5), F.col("confidence")))
    return rows.withColumn("verdict", verdict).withColumn("verdict_confidence", sure).drop("ratio_")


def clusters(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """entity_id, cluster_id from the merge decisions that stand; undoing one is marking it undone and asking again."""
    edges = decisions.where("verdict = 'merge' and undone_at is null").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    found = components(edges)
    return entities.select("entity_id").join(found, entities["entity_id"] == found["node"], "left").select("entity_id", F.coalesce("component", "entity_id").alias("cluster_id"))


def canonical_claims(claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """Claims between canonical entities: no self loops, of equal ones the most confident, then the smallest id."""
    m = mapping.select("entity_id", "cluster_id")
    c = claims.join(m.toDF("source", "src"), "source", "left").join(m.toDF("target", "dst"), "target", "left")
    c = c.withColumn("src", F.coalesce("src", "source")).withColumn("dst", F.coalesce("dst", "target")).where("src <> dst")
    best = F.row_number().over(Window.partitionBy("src", "dst", "predicate").orderBy(F.desc("confidence"), "claim_id"))
    return c.withColumn("at_", best).where("at_ = 1").select(F.col("src").alias("source"), F.col("dst").alias("target"), "predicate", "confidence", "claim_id")


def duplicate_claims(claims: DataFrame) -> DataFrame:
    """Triples held more than once: the claim that stays and how many go."""
    return claims.groupBy("source", "target", "predicate").agg(F.min("claim_id").alias("keep_id"), (F.count(F.lit(1)) - 1).alias("n_removed")).where("n_removed > 0")


def multi_relation_pairs(claims: DataFrame, least: int = 3) -> DataFrame:
    return unordered(claims, "source", "target").groupBy("left_id", "right_id").agg(F.countDistinct("predicate").alias("n_predicates")).where(F.col("n_predicates") >= least)
