"""What the corpus operators share: reading tables, splits by hash, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of texts that travel to Python at once: Spark's default of 10 000 makes buffers of many MB, outside of the heap,
#: that a worker and its executor keep.
AT_ONCE = 1_000


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs, in a session that hands rows to Python AT_ONCE or less at a time (from now on, and for other jobs, too)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(docs.sparkSession.conf.get(key))
    if not 0 < now <= AT_ONCE:
        docs.sparkSession.conf.set(key, str(AT_ONCE))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as a reference, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder: later jobs don't depend on executors that may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)
