"""Shared helpers: the shared work folder, written intermediate tables, input guards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_WORK_DIR = "file:///tmp/checkpoints"


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` if the session sets it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or LOCAL_WORK_DIR).rstrip('/')}/tablelens"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the work folder that nothing else uses."""
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared work folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with working columns."""
    return df.select(*[df[f"`{n}`"] for n in names])


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def hash_fraction(key: Column, seed: str, k: Column | None = None) -> Column:
    """A number in [0, 1) that depends on ``key``, ``seed`` and ``k`` alone: 48 bits of an MD5 digest."""
    tail = [F.lit(f":{seed}")] if k is None else [F.lit(f":{seed}:"), k.cast("string")]
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), *tail))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def release() -> None:
    """Give freed memory of a Python worker back at the end of a task, as idle workers stay beside later ones."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # the C library is another


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WorkTables:
    """Written tables of one run, each deleted once no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str, str | None]] = {}

    def write(self, df: DataFrame, tag: str, part: str | None = None, bucket: str | None = None) -> DataFrame:
        """``df`` written and read back; in folders by ``part``, or in buckets of ``bucket``, on which joins leave its rows in place."""
        path, name = new_path(self.spark, tag), None
        writer = df.write.option("compression", "zstd")
        if bucket:
            name = f"{tag}_{path.rpartition('-')[2]}".replace("-", "_")
            writer = writer.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), bucket).format("parquet").option("path", path)
            writer.saveAsTable(name)
            out = self.spark.table(name)
        else:
            (writer.partitionBy(part) if part else writer).parquet(path)
            out = self.spark.read.schema(_nullable(df.schema)).parquet(path)
        self._paths[id(out)] = out, path, name
        return out

    def discard(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        for t in tables:
            _, path, name = self._paths.pop(id(t))
            if name:
                self.spark.sql(f"DROP TABLE {name}")
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def discard_others(self, *keep: DataFrame) -> None:
        """Delete all tables but these."""
        self.discard(*[t for t, *_ in list(self._paths.values()) if all(t is not k for k in keep)])


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove_work_tables(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Delete written intermediate tables that are older; how many went. Lazy results read them, so use them first."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    limit = jvm.java.lang.System.currentTimeMillis() - older_than_hours * 3_600_000
    old = [s.getPath() for s in fs.listStatus(path) if s.getModificationTime() < limit]
    return sum(bool(fs.delete(p, True)) for p in old)
