"""Session helpers.

``local_session`` is for tests and the bench. Library code never creates a session; it only reads
settings from the one it is given.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "soilcast") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 (a remote session has no SparkContext)
        return None


def _is_local(spark: SparkSession) -> bool:
    sc = _context(spark)
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    return master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set (a folder every executor can reach); a local session without it
    gets a fresh temporary folder, as in tests.
    """
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf is None and not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = conf or tempfile.mkdtemp(prefix="soilcast-ckpt-")
    if sc is None:
        return folder
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def table_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table, in the shared one."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours that nothing reads any more, if it is there."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, how: str | None = None, options: dict | None = None, path: str | None = None) -> DataFrame:
    """Reuse a derived table across the jobs of a flow.

    ``how`` (default: session setting ``soilcast.materialize``, else ``table``):
    * ``table``: a parquet table in the shared folder. Later reads prune columns and push filters down, joins
      know its size in bytes, lineage is cut, and an executor loss re-runs no upstream shuffle;
    * ``checkpoint``: reliable checkpoint into the shared folder (whole rows, no statistics);
    * ``cache``: persist in memory and on local disk; a lost block is recomputed from lineage.

    ``options``: of the parquet writer. ``path``: the folder of the table (default: a new ``table_path``).
    """
    spark = df.sparkSession
    how = how or spark.conf.get("soilcast.materialize", "table")
    if how == "checkpoint":
        shared_dir(spark)
        return df.checkpoint(eager=True)
    if how == "table":
        path = path or table_path(spark, name)
        df.write.mode("overwrite").options(**(options or {})).parquet(path)
        return spark.read.parquet(path)
    if how == "cache":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    raise ValueError(f"materialize: unknown mode {how!r}")


def fit_parallelism(spark: SparkSession, wanted: int) -> int:
    """How many independent model fits to run at once: ``soilcast.fit.parallelism`` (default 1), ``wanted`` at most.

    Each running tree fit caches its own binned copy of its training rows, so more than one at a time is for
    data of which several copies fit the executors.
    """
    return max(1, min(wanted, int(spark.conf.get("soilcast.fit.parallelism", "1"))))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once, so it need not be installed on executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp()) / f"{package.name}-core.zip"  # the driver serves it to all executors
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(bundle))
    _SHIPPED.add(sc.applicationId)
