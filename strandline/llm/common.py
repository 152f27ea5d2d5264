"""What the corpus operators share: tables in the shared folder, row identities, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the column that tells equal rows apart inside the operators.
ROW_ID = "row_id"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a local session gets a temporary folder; a cluster gets an
    error, since its executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Intermediate tables in the shared folder: written once, read by name, dropped when used up.

    A written table cuts the lineage, so a lost executor costs at most the running job's tasks.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/strandline/{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.open(name, df.schema)

    def open(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns of the input, whatever their names, play no part."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of the batches, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def portions(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``size`` bytes of the column, strings without nulls; a longer one stands alone."""
    for batch in batches:
        upto, at = np.cumsum(pc.binary_length(batch[column]).to_numpy().astype(np.int64)), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
            part = batch.slice(at, stop - at)
            yield part.set_column(part.schema.get_field_index(column), column, part[column].cast(pa.string()))
            at = stop


def per_slice(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema, rows: int = 256):
    """A function for mapInArrow that turns each slice into the columns fn returns."""

    def run(batches):
        for piece in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(fn(piece), schema=schema)

    return run


#: A key with more than this share of the rows is hot. Fewer than 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 2_000
#: One row in so many tells which keys are hot; a key missed by chance is joined like any other.
LOOKED_AT = 32


def hot_keys(many: DataFrame, key: str, counts: DataFrame | None = None) -> list:
    """The keys that hold about HOT_SHARE of the rows of many or more, and over 1,000: at most 1 / HOT_SHARE, whatever the table.

    ``counts``(key, count) are the rows of many by key, where they are known; else a sample tells.
    """
    part = 1 if counts is not None else LOOKED_AT
    counts = counts if counts is not None else many.select(key).sample(1 / part, 7).groupBy(key).count()
    frequent = counts.where((F.col("count") > 1_000 // part) & F.col(key).isNotNull()).orderBy(F.desc("count")).limit(round(1 / HOT_SHARE)).select(key, "count").collect()
    bound = many.count() * HOT_SHARE / part if frequent else 0
    return [(r[key],) for r in frequent if r["count"] > bound]


def lookup(many: DataFrame, one: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """many join one by ``key``, where one has a row for each key at most, and many may have a key in most rows.

    Rows of hot keys stay where they are and meet these keys' rows of one by broadcast (fewer than
    1 / HOT_SHARE rows); all others are joined by the key, of which no task then gets a large share.
    ``counts`` are the rows of many by key, where they are known.
    """
    hot = hot_keys(many, key, counts)
    if not hot:
        return many.join(one, key, how)
    hot = F.broadcast(many.sparkSession.createDataFrame(hot, many.select(key).schema))
    cold = many.join(hot, key, "left_anti").join(one, key, how)
    warm = many.join(hot, key, "left_semi").join(F.broadcast(one.join(hot, key, "left_semi")), key, how)
    return cold.unionByName(warm)


def hex64(col: Column) -> Column:
    """16 lowercase hex digits of a 64-bit pattern held in a LONG."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
