"""Tables written between two looks at them, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset, a temporary folder in plain local mode or a
    subfolder of the warehouse."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return _LOCAL.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="lakeassay-"))
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lakeassay_scratch"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver's JVM ends, if not before."""
    path = f"{shared_dir(spark)}/lakeassay-{uuid.uuid4().hex[:12]}-{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
