"""Session helpers: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests) gets a temporary one;
    on a cluster that is an error, as executors would not see it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='trackforge-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_pinned: set[str] = set()


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The rows survive lost executors and are not computed again by later jobs.  They
    are removed by ``unpin``, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trackforge/{label}-{uuid.uuid4().hex}"
    _pinned.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.pinned_at = path
    return out


def unpin(*frames: DataFrame) -> None:
    """Remove what ``pin`` wrote for these frames; nothing lazy may read them any more."""
    for df in frames:
        _remove(df.sparkSession.sparkContext, df.pinned_at)


def _remove(sc: SparkContext, path: str) -> None:
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    _pinned.discard(path)


@atexit.register
def _remove_all() -> None:
    sc = SparkContext._active_spark_context
    for path in list(_pinned) if sc else ():
        try:
            _remove(sc, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_crc(col: str = "doc_id"):
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def extended(schema: T.StructType, **kinds: str) -> T.StructType:
    """A new schema with further columns (``StructType.add`` would change the old one)."""
    out = T.StructType(list(schema.fields))
    for name, kind in kinds.items():
        out.add(name, kind)
    return out
