"""Written intermediates in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset
is another one used: a temporary folder in plain local mode (tests), else a
subfolder of the SQL warehouse. Nothing is ever kept in executor memory only, so
a lost executor costs a recomputation of its tasks and no more.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[tuple[str, str]] = []
_SCOPE = [""]


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="lakeassay-")
        return _LOCAL[sc.applicationId]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lakeassay_scratch"


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let the session send Python workers 4 MiB at once at most (64 by default): long texts then need little memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, str(size))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted at the latest when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lakeassay-{uuid.uuid4().hex[:12]}-{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.deleteOnExit(p)
    _MADE.append((_SCOPE[0], path))
    return path


def write(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return it as read back: the lineage is cut at a replayable table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete a table that ``write`` returned and that nothing will read again."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, f)


class Shared:
    """An object that executors build from plain broadcast parts: broadcasts pickle classes by name, which workers
    without this package could not look up."""

    def __init__(self, spark: SparkSession, build, *parts):
        self._parts, self._build, self._made = spark.sparkContext.broadcast(parts), build, None

    @property
    def value(self):
        if self._made is None:
            self._made = self._build(*self._parts.value)
        return self._made

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_made": None}


@contextlib.contextmanager
def scope(name: str):
    """Paths made inside belong to ``name``; ``sweep(name)`` deletes them."""
    _SCOPE.append(_SCOPE[0])
    _SCOPE[0] = name
    try:
        yield
    finally:
        _SCOPE[0] = _SCOPE.pop()


def sweep(spark: SparkSession, name: str) -> None:
    for s, path in [x for x in _MADE if x[0] == name]:
        delete(spark, path)
        _MADE.remove((s, path))
