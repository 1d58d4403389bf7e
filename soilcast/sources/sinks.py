"""Result sinks: a folder that is replaced whole, and one of which single scenarios are."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructType


def write_results(
    df: DataFrame, path: str, partition_by: list[str] | None = None, max_records_per_file: int = 5_000_000
) -> None:
    """Write parquet, partitioned (default by ``scenario`` when present), replacing old output.

    No repartition on the partition columns: with a handful of scenarios that would send a fifth of
    all rows to one task. Each task writes one file per value it holds, capped in size.
    """
    if partition_by is None:
        partition_by = ["scenario"] if "scenario" in df.columns else []
    w = df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# ---------------------------------------------------------------------------------------------
# Results of which a part can be replaced


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its path class: manifests live where the data does."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, Path = _fs(spark, path)
    folder = Path(f"{path}/_manifests")
    if not fs.exists(folder):
        return []
    return sorted(int(n) for f in fs.listStatus(folder) if (n := f.getPath().getName()).isdigit())


def manifest(spark: SparkSession, path: str) -> dict[str | None, str]:
    """Scenario → folder of its rows, in the state committed last; empty before the first commit."""
    versions = _versions(spark, path)
    if not versions:
        return {}
    fs, Path = _fs(spark, path)
    stream = fs.open(Path(f"{path}/_manifests/{versions[-1]}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {s: folder for s, folder in json.loads(text)}


def _evened(df: DataFrame) -> DataFrame:
    """Rows dealt to tasks of the size that adaptive execution aims at, whatever the tasks that made them hold: a write by partition
    sorts all rows of its task. Dealt by their values, as an exchange without keys would sort them too."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    return df.hint("rebalance", *cols) if cols else df


def commit_results(df: DataFrame, path: str, scenario: str = "scenario", max_records_per_file: int = 5_000_000) -> int:
    """Replace the scenarios that ``df`` holds; the others stay. Returns the version.

    The rows are written to a folder of their own. Then a manifest that names every scenario's folder is put in place under the next
    number, which exactly one writer can take: one that comes second fails and leaves the first one's result. Until then readers see the old
    state, and a failed write changes nothing. Folders are never rewritten, so a reader keeps what it has begun to
    read. A NULL scenario is one of its own. An empty ``df`` commits a version without changes.
    """
    spark = df.sparkSession
    before = _versions(spark, path)
    known = manifest(spark, path)
    number = (before[-1] if before else 0) + 1
    folder = f"data/{number}-{uuid.uuid4().hex}"
    _evened(df).write.option("maxRecordsPerFile", max_records_per_file).partitionBy(scenario).parquet(f"{path}/{folder}")
    fs, Path = _fs(spark, path)
    held = [f.getPath().getName() for f in fs.listStatus(Path(f"{path}/{folder}")) if f.isDirectory() and f.getPath().getName().startswith(f"{scenario}=")]
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for name in held:
        value = unescape(name.split("=", 1)[1])
        known[None if value == "__HIVE_DEFAULT_PARTITION__" else value] = f"{folder}/{name}"
    draft = Path(f"{path}/_manifests/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps([[s, f] for s, f in known.items()]).encode()))
    finally:
        out.close()
    target = Path(f"{path}/_manifests/{number}")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {path} was committed by another writer")
    return number


def read_results(spark: SparkSession, path: str, schema: StructType, scenario: str = "scenario") -> DataFrame:
    """The rows committed last, with the columns of ``schema`` (``scenario`` among them)."""
    rows = StructType([f for f in schema.fields if f.name != scenario])
    kind = schema[scenario].dataType
    parts = [
        spark.read.schema(rows).parquet(f"{path}/{folder}").withColumn(scenario, F.lit(s).cast(kind)) for s, folder in manifest(spark, path).items()
    ]
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts).select(*schema.names)
