"""The evidence gate: quotes located verbatim in segments, white space aside."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import cut

#: Characters of quotes that one pass looks for at most; more quotes take more passes.
QUOTE_CHARS = 20_000_000


def _passes(quotes: DataFrame, item_id: str, quote: str) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Lots of (id, quote) of QUOTE_CHARS or so at most, one at a time on the driver, and whether there are several.

    Quotes are dealt to lots by a hash of their id; their whole length says how many lots there are.
    """
    rows = quotes.select(F.col(item_id).alias("id"), F.regexp_replace(quote, r"^\s+|\s+$", "").alias("q")).where("q <> ''")
    lots = -(-(rows.agg(F.sum(F.length("q"))).first()[0] or 0) * 2 // QUOTE_CHARS) or 1
    lot = F.pmod(F.xxhash64("id"), F.lit(lots))
    for k in range(lots):
        yield sorted((r["id"], r["q"]) for r in rows.where(lot == k).toLocalIterator()), lots > 1


def _machine(words):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w in words:
        machine.add_word(w, w)
    if words:
        machine.make_automaton()
    return machine


def locate(segments: DataFrame, quotes: DataFrame, segment_id: str = "doc_id", text: str = "text", item_id: str = "item_id", quote: str = "text", spaces: bool | None = True) -> DataFrame:
    """segment_id, item_id, quote_start, quote_end, flat_start for every pair whose quote the segment holds.

    All quotes are looked for in one scan of each text with an automaton, so the work doesn't grow with their number.
    spaces: exact occurrences; False compares both sides without white space; None takes the exact occurrence of a pair,
    else the first one without white space. Offsets refer to the text; flat_start counts no white space, and is null
    where a quote stands there exactly. Blank quotes are nowhere.
    """
    kind = segments.schema[segment_id].dataType.simpleString()
    schema = f"{segment_id} {kind}, {item_id} long, quote_start long, quote_end long, flat_start long"
    found = None
    for part, several in _passes(quotes, item_id, quote):
        shared = segments.sparkSession.sparkContext.broadcast(part)  # QUOTE_CHARS at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            exact, flat_ids = {}, {}
            for i, q in shared.value:
                exact.setdefault(q, []).append(i)
                flat_ids.setdefault("".join(q.split()), []).append(i)
            there = _machine(exact) if spaces is not False and exact else None
            squeezed = _machine(flat_ids) if not spaces and flat_ids else None
            for b in batches:
                cols: list[list] = [[], [], [], [], []]
                for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    t, met = t or "", {}
                    for end, q in there.iter(t) if there else ():
                        for i in exact[q]:
                            met.setdefault(i, (end - len(q) + 1, end + 1, None))
                    if squeezed:
                        first: dict[str, int] = {}
                        for end, q in squeezed.iter("".join(t.split())):
                            first.setdefault(q, end - len(q) + 1)
                        places = [k for k, c in enumerate(t) if not c.isspace()] if first else []
                        for q, at in first.items():
                            for i in flat_ids[q]:
                                met.setdefault(i, (places[at], places[at + len(q) - 1] + 1, at))
                    for i, where in met.items():
                        for c, v in zip(cols, (key, i, *where), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[segment_id, item_id, "quote_start", "quote_end", "flat_start"])

        got = segments.select(segment_id, text).mapInArrow(run, schema)
        if several:
            got = cut(got)
            shared.destroy()
        found = got if found is None else found.unionByName(got)
    return found


def mentions(segments: DataFrame, names: DataFrame, segment_id: str = "doc_id", text: str = "text", name: str = "name") -> DataFrame:
    """name, n_segments, n_mentions: occurrences of each name that don't overlap each other, over all segments.

    All names are looked for in one scan of each text; QUOTE_CHARS of names are broadcast at most, more take more passes.
    """
    listed = names.select(F.trim(name).alias("name")).where("name <> ''").dropDuplicates()
    listed, found = listed.withColumn("id_", F.xxhash64("name")), None
    for part, several in _passes(listed, "id_", "name"):
        shared = segments.sparkSession.sparkContext.broadcast([q for _, q in part])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for k, n in enumerate(shared.value):
                machine.add_word(n, k)
            if shared.value:
                machine.make_automaton()
            segs, hits = [0] * len(shared.value), [0] * len(shared.value)
            for b in batches:
                for t in b.column(0).to_pylist():
                    free: dict[int, int] = {}
                    for end, k in machine.iter(t) if t and shared.value else ():
                        start = end - len(shared.value[k]) + 1
                        if start >= free.get(k, 0):
                            segs[k] += k not in free
                            hits[k] += 1
                            free[k] = end + 1
            yield pa.RecordBatch.from_arrays([pa.array(shared.value, pa.string()), pa.array(segs, pa.int64()), pa.array(hits, pa.int64())], names=["name", "n_segments", "n_mentions"])

        got = segments.select(text).mapInArrow(run, "name string, n_segments long, n_mentions long")
        if several:
            got = cut(got)
            shared.destroy()
        found = got if found is None else found.unionByName(got)
    return found.groupBy("name").agg(F.sum("n_segments").alias("n_segments"), F.sum("n_mentions").alias("n_mentions"))


def gate(candidates: DataFrame, located: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted candidates with their offsets, and the rejected ones."""
    return candidates.join(located, keys), candidates.join(located, keys, "left_anti")


def coverage(quotes: DataFrame, located: DataFrame, item_id: str = "item_id") -> DataFrame:
    """One row: quotes, located ones, their percentage (null without quotes), and links."""
    hit = located.groupBy(item_id).agg(F.count(F.lit(1)).alias("links"))
    n, k = F.count(F.lit(1)), F.count("links")
    return quotes.select(item_id).join(hit, item_id, "left").agg(n.alias("n_quotes"), k.alias("n_located"), F.when(n > 0, F.round(k / n * 100, 2)).alias("coverage_pct"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"))
