"""Session helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import BATCH_BYTES, BATCH_ROWS, mark, materialise, release, shared_dir, small_batches

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "ascii_lower", "drop", "mark", "materialise", "n_words", "other_key", "release", "shared_dir", "shuffle_partitions", "small_batches", "table"]

#: The words of most contracts: runs without space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop(df: DataFrame) -> None:
    """Deletes the files of a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def other_key(key: Column) -> Column:
    """The same key under another expression, for the unique side of a join that comes out of a groupBy.

    The planner then exchanges both sides right below the join, so that adaptive
    execution can split a hot key of the many side; with the groupBy's own
    partitioning in place it could not.
    """
    return F.reverse(key)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of runs without white space (ASCII); null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
