"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: The characters between words (space and U+0009 to U+000D).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for NULL or white space only."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_RUN)
    )


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Lineage ends here, so a lost executor repeats no earlier work, several readers share one
    computation, and later joins know the real size of the table.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reserved(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first ``wanted_N`` that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


_SHIPPED: set[str] = set()
#: Rows that a Python worker is given at a time, where the session does not say otherwise: whole texts are long rows.
BATCH_ROWS = 1000
#: Their bytes at a time, likewise.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once, and batches of ``BATCH_ROWS`` rows and
    ``BATCH_BYTES`` bytes: where the session has Spark's defaults, its settings are changed, as Spark has none for a single plan."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    bundle = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # the driver serves it to all executors
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(bundle))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    _SHIPPED.add(sc.applicationId)


_HELD: dict = {}


def held(key, make: Callable):
    """What ``make`` gives, kept by this process for further tasks with the same ``key``. One thing is kept at a time: workers
    outlive stages, and the tables of an earlier operator would stay in memory."""
    if key not in _HELD:
        _HELD.clear()
        release_memory()
        _HELD[key] = make()
    return _HELD[key]


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with the package at hand in the workers, which give back what memory they no longer use."""
    ship(df.sparkSession)

    def lean(batches):
        for k, b in enumerate(run(batches)):
            yield b
            if k % 64 == 63:
                release_memory()
        release_memory()

    return df.mapInArrow(lean, schema)


def release_memory() -> None:
    """Return freed memory to the system: workers are kept for later stages, and allocators would hold it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
