"""Session settings and the durable scratch area."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "tessella") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster a missing setting is an error, for a machine-local folder would be lost with its machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "local-cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage durably: the files survive the loss of any executor. They are removed when
    the driver ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessella-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame of :func:`materialize`, once nothing reads it any more."""
    path = getattr(df, "_tessella_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        url = urlparse(path)
        if url.scheme in ("", "file"):
            shutil.rmtree(url.path, ignore_errors=True)
        else:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _sweep() -> None:
    """Tables still there when the driver ends; on a remote file system through the session, where it still runs."""
    for spark, path in _written:
        if urlparse(path).scheme in ("", "file") or getattr(spark.sparkContext, "_jsc", None) is not None:
            _remove(spark, path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
