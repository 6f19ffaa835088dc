"""Session defaults and the shared scratch area in which operators cut lineage."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_scratch: dict[str, str] = {}
_shipped: set[str] = set()
_lock = Lock()


def get_session(app: str = "shelfmark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, AQE, Arrow).

    Under spark-submit the master and all sizes are those given there; otherwise the
    session is a local one of ``cores`` threads.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        builder = builder.master(f"local[{cores}]")
        settings |= {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    return builder.config(map=settings | conf).getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    It lies under ``spark.checkpoint.dir``, which all executors share, so a lost
    executor loses nothing. Only a local session without that setting gets a
    temporary folder; elsewhere a missing setting is an error.
    """
    app = spark.sparkContext.applicationId
    with _lock:
        return _scratch[app] if app in _scratch else _new_scratch_dir(spark, app)


def _new_scratch_dir(spark: SparkSession, app: str) -> str:
    base = spark.conf.get(_CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shelfmark-")
    path = f"{base.rstrip('/')}/shelfmark-{uuid.uuid4().hex}"
    _scratch[app] = path
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark._jvm, spark.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        if os.path.isabs(path):
            import shutil

            shutil.rmtree(path, ignore_errors=True)


def write_scratch(df: DataFrame, label: str) -> str:
    """Write ``df`` into the scratch folder and give its path."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the scratch folder and return a scan of it.

    The scan has a short lineage, fixed partitions, survives lost executors, and
    gives Catalyst the table's true size, from which it chooses its joins.
    """
    path = write_scratch(df, label)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_materialized(*dfs: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing reads any more."""
    for df in dfs:
        own = scratch_dir(df.sparkSession).rsplit("/", 1)[-1]
        for top in {f.partition(f"/{own}/")[2].split("/")[0] for f in df.inputFiles() if f"/{own}/" in f}:
            _remove(df.sparkSession, f"{scratch_dir(df.sparkSession)}/{top}")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, data = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, f"{root.name}/{file.relative_to(root)}")
    jvm, name = spark._jvm, f"{scratch_dir(spark)}/{root.name}-code.zip"
    target = jvm.org.apache.hadoop.fs.Path(name)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(data.getvalue())
    out.close()
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def map_arrow(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def spread_scan(df: DataFrame) -> DataFrame:
    """A plain scan dealt out over all cores where its few files would leave some idle.

    Only for costly work per row: a table with at least a partition per core, as
    every large one has, isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
