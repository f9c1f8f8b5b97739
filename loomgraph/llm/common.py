"""Helpers shared by the corpus operators: shared storage, and Arrow passes over whole texts.

Rules that hold for every operator here:

* null text counts as the empty text; rows are never dropped for having a null in any column;
* an output column replaces an input column of the same name, case aside; every other input column that is asked for
  stays, whatever its name (names may hold dots);
* an empty table gives an empty result of the same schema; repeated rows stay repeated rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of text that a Python worker holds as Python objects at once.
SLICE_BYTES = 1 << 20
#: Entries after which a worker's memo of words is emptied.
MEMO = 200_000
#: A key is hot from so many rows on, or from a MOST_HOT-th of all rows if that is more: so at most MOST_HOT keys are.
HOT_ROWS, MOST_HOT = 10_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local session that names none gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomgraph-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder: lineage ends here, and any executor may be lost afterwards."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Sequence[str]) -> str:
    """name, or name with underscores before it if a column is called so already (Spark ignores case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def besides(columns: Collection[str], outputs: Collection[str]) -> list[str]:
    """The columns that no output replaces; Spark ignores case."""
    low = {x.lower() for x in outputs}
    return [c for c in columns if c.lower() not in low]


def join_sized(rows: DataFrame, table: DataFrame, keys: Sequence[str], size: str, spread: Column) -> DataFrame:
    """rows left joined with table, which has one row for each key and in `size` how many of `rows` have the key.

    Hot keys, MOST_HOT at most, are met by a broadcast; the others by a shuffle in which no key has more rows than a hot
    one's least. There the rows of hot keys are dealt out by `spread`. table should be stored: it is read three times.
    """
    values = besides(table.columns, [*keys, size])
    total, most = table.agg(F.sum(size), F.max(size)).first()
    limit = max(HOT_ROWS, (total or 0) // MOST_HOT)
    plain = table.drop(size)
    if (most or 0) <= limit:
        return rows.join(plain, list(keys), "left")
    part, hot, cold = (fresh(x, [*rows.columns, *table.columns]) for x in ("part_", "hot_", "cold_"))
    few = table.where(F.col(size) > limit).select(*keys, F.struct(*values).alias(hot))
    met = rows.join(F.broadcast(few), list(keys), "left").withColumn(part, F.when(F.col(hot).isNull(), 0).otherwise(F.pmod(spread, F.lit(1 << 30)) + 1))
    rest = table.where(F.col(size) <= limit).select(*keys, F.lit(0).cast("long").alias(part), F.struct(*values).alias(cold))
    got = met.join(rest, [*keys, part], "left")
    return got.select(*[col(c) for c in rows.columns], *[F.coalesce(F.col(f"{hot}.{v}"), F.col(f"{cold}.{v}")).alias(v) for v in values])


def crc(column: Column | str) -> Column:
    """crc32 of the value as text; null for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary"))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text; one row at least each."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], Sequence]], fields: Sequence[T.StructField], text: str = "text", keep: Sequence[str] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """One Arrow pass over whole texts, without a shuffle.

    make() runs once in each task and gives a function from a list of texts to one sequence for each of `fields`.
    The columns of `keep` pass through unchanged, except those that `fields` replace.
    """
    keep = [c for c in besides(keep, [f.name for f in fields]) if keep_text or c.lower() != text.lower()]
    inner, k = "text_", len(keep)
    src = df.select(*[col(c) for c in keep], F.coalesce(col(text).cast("string"), F.lit("")).alias(fresh(inner, keep)))
    schema = T.StructType([*src.schema.fields[:k], *fields])
    src = src.toDF(*[f"c{i}" for i in range(k)], inner)  # Arrow passes find columns by plain names only
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for whole in batches:
            f = f or make()
            for b in slices(whole, inner):
                made = f(b.column(k).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(i).cast(arrow.field(i).type) for i in range(k)] + [pa.array(v, type=arrow.field(k + i).type) for i, v in enumerate(made)], schema=arrow)

    return src.mapInArrow(run, schema)
