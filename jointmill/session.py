"""Session helpers, reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_runs: dict[str, str] = {}
_local = threading.local()


def build(app: str = "jointmill", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tuned for."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table by name; pruning and pushdown are left to the optimizer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, or a temporary one that only a local master may use."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="jointmill-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


def run_dir(spark: SparkSession) -> str:
    """Folder of this application's tables below the shared one; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/jointmill/{app}-{uuid.uuid4().hex}"
        atexit.register(_removed, _runs[app], *_file_system(spark, _runs[app]))
    return _runs[app]


def _file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path as it names it; nothing for a path of this machine."""
    if path.startswith("file:"):
        return ()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _removed(path: str, system=None, named=None) -> None:
    if system is None:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    try:
        system.delete(named, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Every table written inside is removed at the end, when what was built from them must have been stored."""
    outer, _local.paths = getattr(_local, "paths", None), []
    try:
        yield
    finally:
        for path in _local.paths:
            _removed(path, *_file_system(spark, path))
        _local.paths = outer


def written(df: DataFrame, note: str = "step") -> DataFrame:
    """df as a table in the shared folder, read back: lineage is cut and a lost executor costs nothing.

    It goes by dropped(), at the end of the scope() it was written in, or when the driver ends, whichever comes first.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{note}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(_local, "paths", None) is not None:
        _local.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._jointmill_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files behind a written() table that nothing reads any more."""
    path = getattr(df, "_jointmill_path", None)
    if path:
        _removed(path, *_file_system(df.sparkSession, path))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that costs far more than moving its rows."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
