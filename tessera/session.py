"""Session settings for local runs; on a cluster the submitter's settings hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Folders that materialised frames of this process lie in, oldest first.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir).

    Where none is named, a local run gets a temporary one. On a cluster that would be a disk
    of each machine's own, so there it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tessera/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back, so that a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that one Arrow batch holds at most (a single longer row is a batch of its own).
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bounds the Arrow batches that Python workers hold, by rows and by bytes. Plans are made when a result is asked for, so the setting stays; it is only ever lowered."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def mark() -> int:
    """A point to which release() goes back."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes what was materialised since a mark, but for the folder of the frame to keep. Frames that read the rest are lost with it."""
    kept = " ".join(keep.inputFiles()) if keep is not None else ""
    rest = []
    for path in _MADE[since:]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if path.rpartition("/")[2] in kept:
            rest.append(path)
        else:
            fs.delete(p, True)
    _MADE[since:] = rest


def drop(df: DataFrame) -> None:
    """Deletes the files of a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE[:] = [m for m in _MADE if m.rpartition("/")[2] not in folder]
