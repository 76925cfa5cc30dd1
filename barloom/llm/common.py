"""Helpers shared by the operators: byte views of texts, salted joins, tables in the shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import checkpoint_folder, cut_lineage

#: Copies of each row on the small side of a salted join; a key with a third of all rows is met in so many parts.
SALTS = 16
#: Stands for a null document number where rows must be matched on it.
NO_ID = -(2**63)
#: A key is hot with more than 1 / HOT_KEYS of all rows, so fewer than HOT_KEYS keys are.
HOT_KEYS = 4096
#: Rows of a few numbers that one task takes at least.
TASK_ROWS = 1 << 16


def table(sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty; Python tasks then split bytes without decoding them."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join in which each row of ``small`` (one per key) is copied ``salts`` times and each row of ``big`` meets one copy.

    ``spread`` is a stable value of the big row.  What a hot key sends to one task falls by the factor ``salts``, and
    both sides stay plain exchanges, so that the runtime skew join may split further.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def hot_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, total: int, n: str = "n", salts: int = SALTS) -> DataFrame:
    """Inner equi-join of ``big`` with ``small`` (one row per key) that salts the hot keys alone.

    ``n`` in ``small`` is at least the number of rows that ``big`` has of the key, and its sum at most ``total``: fewer than ``HOT_KEYS`` keys
    exceed ``total // HOT_KEYS``, whatever the table, and only their list is broadcast.
    """
    is_hot = F.col(n) > F.lit(total // HOT_KEYS)
    # the whole row, so that this branch reads the same exchange as the join below
    hot = small.filter(is_hot).select(*keys, F.struct(*small.columns).alias("_hot"))
    left = big.join(F.broadcast(hot), list(keys), "left")
    left = left.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def sized(df: DataFrame, most: int, per_task: int = TASK_ROWS) -> DataFrame:
    """``df``, which has at most ``most`` rows, in no more partitions than ``per_task`` rows each fill, so that small tables don't make many empty tasks."""
    return df.coalesce(max(1, -(-most // per_task)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table that was written to a path from ``scratch``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle and checkpoint files that no table needs any more; it hears of them when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    return cut_lineage(df)


def row_keys(docs: DataFrame) -> DataFrame:
    """``_rk_id`` and ``_rk_h``: document number (null as ``NO_ID``) and hash of the raw text, by which rows are found again."""
    return docs.withColumns({"_rk_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_rk_h": F.xxhash64(F.col("text"))})


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (_rk_id, _h) is in ``kept``; of rows that agree in both, one.  All columns stay."""
    w = Window.partitionBy("_rk_id", "_rk_h").orderBy("_rk_h")
    once = row_keys(docs).withColumn("_rk_rep", F.row_number().over(w)).filter("_rk_rep = 1")
    return once.join(kept.select("_rk_id", "_rk_h"), ["_rk_id", "_rk_h"], "left_semi").drop("_rk_id", "_rk_h", "_rk_rep")


def to_batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.lower().split()


Batches = Iterator[pa.RecordBatch]
