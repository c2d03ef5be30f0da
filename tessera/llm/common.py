"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Only for local sessions that name no shared folder, such as tests.
LOCAL_CHECKPOINTS = "/tmp/tessera-checkpoints"


def bounded_batches(df: DataFrame) -> DataFrame:
    """Bounds the bytes of what Python workers get at once, which a count of rows alone doesn't for long texts.

    The bound is a setting of the session, read when a frame runs, so it stays set; a
    session that has a lower one keeps it.
    """
    spark = df.sparkSession
    own = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if own > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a session on one machine may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = LOCAL_CHECKPOINTS
    return folder


class Scratch:
    """Tables in the shared folder that are needed for a while."""

    def __init__(self) -> None:
        self._paths: list[tuple[SparkSession, str]] = []

    def persisted(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df to a table in the shared folder and returns a frame that reads it.

        It cuts the lineage and survives lost executors.  The folder is removed when
        the Spark application ends, if not before.
        """
        spark = df.sparkSession
        path = f"{checkpoint_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        delete_at_end(spark, path)
        self._paths.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def discard(self, keep: int = 0) -> None:
        """Removes the tables, but for the latest `keep`; no frame that reads them may run any more."""
        last = len(self._paths) - keep
        for spark, path in self._paths[:last]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        del self._paths[:last]


def persisted(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder that stays until the application ends; see Scratch.persisted."""
    return Scratch().persisted(df, name)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has the folder removed when the application ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

