"""Writers of the code graph, of models and of health."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

logger = logging.getLogger("tessera")


def write_nodes(nodes: DataFrame, path: str) -> None:
    """One partition folder for each label, in place of what is stored."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """One partition folder for each edge type, in place of what is stored."""
    edges.write.mode("overwrite").partitionBy("type").parquet(path)


def merge_nodes(nodes: DataFrame, path: str) -> None:
    """Adds the nodes that are not stored yet; a node is its label and key, so merging again changes nothing."""
    _merge(nodes, path, "label")


def merge_edges(edges: DataFrame, path: str) -> None:
    """Adds the edges that are not stored yet."""
    _merge(edges, path, "type")


def _merge(rows: DataFrame, path: str, by: str) -> None:
    spark = rows.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = rows.distinct()
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        stored = spark.read.schema(rows.schema).parquet(path)
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in rows.columns]
        new = new.alias("n").join(stored.alias("o"), same, "left_anti")
    new.write.mode("append").partitionBy(by).parquet(path)


def dump(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def retried(check: Callable[[], object], max_retries: int = 10, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether a check passes within so many tries; a check fails by raising."""
    for attempt in range(max_retries):
        try:
            check()
            return True
        except Exception as e:  # noqa: BLE001  any failure of a service counts
            logger.warning("check %d of %d failed: %s", attempt + 1, max_retries, e)
            if attempt + 1 < max_retries:
                sleep(delay)
    return False


def health(spark: SparkSession, checks: Mapping[str, Callable[[], object]]) -> DataFrame:
    """One row: status (healthy if every check passes, else degraded) and services, a map from name to status."""
    found = {name: "healthy" if retried(check, 1) else "unhealthy" for name, check in checks.items()}
    status = "healthy" if all(v == "healthy" for v in found.values()) else "degraded"
    return spark.createDataFrame([(status, found)], "status string, services map<string,string>")


def root_message() -> dict[str, str]:
    return {"message": "tessera is running"}
