"""Session defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "bimosaic", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.parquet.compression.codec": "zstd",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder all executors share (``spark.checkpoint.dir``) and read back, so that a loop's lineage ends there.

    Where the setting is missing on one machine (tests), a temporary folder serves.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault("base", tempfile.mkdtemp(prefix="spark-cut-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path in it, whatever store that is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = files(spark, path)
    return store.exists(place)


def beside(path: str) -> str:
    """Where a folder is written before it is put in its place."""
    return f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"


def put(spark: SparkSession, aside: str, path: str) -> None:
    """Rename a written folder to its place, where nothing may be yet."""
    store, place = files(spark, path)
    if store.exists(place):
        raise FileExistsError(path)
    if not store.rename(files(spark, aside)[1], place):
        raise OSError(f"{aside} can't be renamed to {path}")
