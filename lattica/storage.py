"""Tables written to cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Tables of a growing frame that are read side by side before they are written as one.
MOST_PARTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Cancelled(RuntimeError):
    """Work under a tag was cancelled."""


#: The tags of this thread's work and the tables that it has written; tags whose work is to end.
_WORK: contextvars.ContextVar[tuple[str, list[str]] | None] = contextvars.ContextVar("lattica-work", default=None)
_CANCELLED: set[str] = set()


@contextlib.contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Work that ``cancel`` can end from another thread. When it ends by an error, its tables are deleted."""
    _CANCELLED.discard(tag)
    made: list[str] = []
    outer = _WORK.set((tag, made))
    spark.addTag(tag)
    try:
        yield
    except BaseException as e:
        for path in made:
            _delete(spark, path)
        if tag in _CANCELLED:
            raise Cancelled(tag) from e
        raise
    finally:
        spark.removeTag(tag)
        _WORK.reset(outer)
        _CANCELLED.discard(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the running jobs of a tag; its thread starts no other round."""
    _CANCELLED.add(tag)
    spark.interruptTag(tag)


def cut(df: DataFrame, name: str = "cut", compression: str | None = None) -> DataFrame:
    """The same rows, read again from Parquet; loops call it once a round. The table is deleted at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex[:12]}"
    work = _WORK.get()
    if work:
        work[1].append(path)
        if work[0] in _CANCELLED:
            raise Cancelled(work[0])
    df.write.parquet(path, compression=compression)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """A frame of ``cut`` as it is, others through ``cut``: its size is known to what joins it."""
    return df if getattr(df, "_written", None) else cut(df, name)


def forget(df: DataFrame) -> None:
    """Deletes the table behind a frame of ``cut`` that nothing reads any more."""
    if path := getattr(df, "_written", None):
        _delete(df.sparkSession, path)


class Grown:
    """Rows found in rounds. Each round's table stays as it was written; only now and then are they written as one, so a
    fixpoint writes about what it finds, not all of it each round."""

    def __init__(self, first: DataFrame, name: str):
        self.name, self.parts = name, [first]

    @property
    def frame(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)

    @property
    def before(self) -> DataFrame:
        """Without the last round's rows."""
        return reduce(DataFrame.union, self.parts[:-1])

    def add(self, part: DataFrame) -> None:
        """part: a frame of ``cut``, still to be read by the next round."""
        if len(self.parts) >= MOST_PARTS:
            old, self.parts = self.parts, [cut(self.frame, self.name)]
            for x in old[1:]:
                forget(x)
        self.parts.append(part)
