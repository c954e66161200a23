"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one only where it is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tallybrook-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named like an operator's own ("__...") renamed, and how to rename them back."""
    names = {c: f"caller{i}{c}" for i, c in enumerate(df.columns) if c.startswith("__")}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later job reads."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; gives memory back at its end, since the next task of another stage may use the same worker."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows one by one, so that no more than one row's texts stand beside the batch."""
    columns = batch.columns
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def key_text(c: str) -> Column:
    """A key as text, null as the empty string."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def remainder(c: str, mod: int) -> Column:
    """crc32 of the key's decimal text, modulo ``mod``."""
    return F.crc32(key_text(c)) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a filter of hashes: a fixed 2 MB. A full one lets everything through, so it saves shuffling but changes no result.
FILTER_BITS = 1 << 24


def filter_bit(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def filter_words(values: DataFrame, c: str) -> np.ndarray:
    """The filter of a column's hashes as 32-bit words: FILTER_BITS / 32 rows at most come to the driver."""
    bits = values.select(filter_bit(c).alias("b")).groupBy(F.expr("cast(b div 32 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("x"))
    words = bits.toPandas()
    full = np.zeros(FILTER_BITS // 32, np.uint32)
    full[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64).astype(np.uint32)
    return full


def bit_filter(values: DataFrame, c: str) -> Column:
    """A condition on column ``c`` of another table that holds for all of ``values``' and for few other values."""
    full = filter_words(values, c)
    held = values.sparkSession.sparkContext.broadcast(full)

    @F.pandas_udf("boolean")
    def among(b: pd.Series) -> pd.Series:
        at = b.to_numpy(np.int64)
        return pd.Series((held.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    return among(filter_bit(c))
