"""Sharding by extendible hashing.

The directory is an array of cells, one for each prefix of the hash of so many bits; a cell names its bucket, the
shortest prefix whose rows fit the limit. Bytes are summed by cell before any shuffle, so a hot cell is one row for each
task. Only cells that are over the limit get a directory of their own, with CELL_BITS more bits, and so on.

The first hash has 60 bits of the key's MD5. Rows of one key that exceed the limit together are divided by further
hashes, of the key, the row's number and its size, each level by level like the first, until every shard fits. A row
larger than the limit has a shard of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import besides, col, fresh, stored

HASH_BITS = 60
CELL_BITS = 12
OUTPUTS = ("shard", "depth", "shard_bytes", "shard_rows")


def hash60(column: Column) -> Column:
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: int) -> Column:
    return F.call_function("shiftright", h, F.lit(HASH_BITS - depth))


def _directory(cells: DataFrame, limit: int, least: int, bits: int) -> DataFrame:
    """(top, cell, depth, prefix, bytes, n): the bucket of each cell; no bucket if the cell alone is over the limit.

    cells: (top, cell, bytes, n), cells of `bits` bits below the prefix that `top` names; prefixes of `least` bits are
    known to be over the limit, but for least 0.
    """
    levels = cells.select("top", "cell", "bytes", "n", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int")))
    sums = levels.groupBy("top", "depth", "prefix").agg(F.sum("bytes").alias("sum"), F.sum("n").alias("rows"))
    fit = sums.where((F.col("sum") <= limit) | (F.col("rows") == 1))
    # Prefixes below one that fits do so too: a cell's bucket is the shortest of its own.
    best = levels.select("top", "cell", "depth", "prefix").join(fit, ["top", "depth", "prefix"]).groupBy("top", "cell").agg(F.min(F.struct("depth", "prefix", F.col("sum").alias("bytes"), F.col("rows").alias("n"))).alias("b"))
    return best.select("top", "cell", "b.*")


def shards(df: DataFrame, limit: int, key: Sequence[str] = ("doc_id",), size: Column | None = None, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """`keep` (the key by default), shard (bits of its prefix as text), depth, shard_bytes and shard_rows, a row for each row.

    size: bytes of a row; those of the UTF-8 text by default. Null or negative sizes, null and empty texts count as 0.
    Null keys hash like the empty text. Every shard has at most `limit` bytes unless it holds one row only; rows of
    equal keys, repeated rows too, share a shard if they fit one. Ties don't arise: a row's hashes place it. An empty
    table gives no rows. Columns of `keep` named like an output are replaced.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    size = F.octet_length(col(text)) if size is None else size
    cols = besides(key if keep is None else keep, OUTPUTS)
    h, b, row, top, t, c, found = (fresh(x, cols) for x in ("hash_", "bytes_", "row_", "top_", "known_top_", "known_cell_", "found_"))
    joined = F.concat_ws("\x1f", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in key])
    part = stored(df.select(*[col(c) for c in cols], hash60(joined).alias(h), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias(b), F.monotonically_increasing_id().alias(row)), "shard-rows")
    part = part.withColumn(top, F.lit(""))
    done, least, turn = [], 0, 0
    while True:
        bits = least + CELL_BITS
        cells = stored(part.groupBy(F.col(top).alias("top"), _prefix(F.col(h), bits).alias("cell")).agg(F.sum(b).alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-cells")
        known = stored(_directory(cells, limit, least, bits), "shard-directory")
        over = stored(cells.join(known.select("top", "cell"), ["top", "cell"], "left_anti").select(F.col("top").alias(t), F.col("cell").alias(c)), "shard-over")
        name = F.concat("top", F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), "0")))
        bucket = F.struct(name.alias("name"), (F.col("depth") + HASH_BITS * turn).cast("int").alias("depth"), "bytes", "n").alias(found)
        known = known.select(F.col("top").alias(t), F.col("cell").alias(c), bucket)
        at = (F.col(top) == F.col(t)) & (_prefix(F.col(h), bits) == F.col(c))
        done.append(part.join(known, at).select(*[col(x) for x in cols], F.col(f"{found}.name").alias("shard"), F.col(f"{found}.depth").alias("depth"), F.col(f"{found}.bytes").alias("shard_bytes"), F.col(f"{found}.n").alias("shard_rows")))
        if over.isEmpty():
            return reduce(DataFrame.unionByName, done)
        part, least = part.join(over, at, "left_semi"), bits
        if bits == HASH_BITS:  # whole hashes are equal: the next hash takes the row's number too
            part = part.withColumn(top, F.concat(F.col(top), F.lpad(F.bin(h), HASH_BITS, "0"), F.lit("+"))).withColumn(h, hash60(F.concat_ws("\x1f", top, row, b)))
            part, least, turn = stored(part, "shard-hot"), 0, turn + 1
