"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "driftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is tuned for; extra settings go in ``conf``.

    Parallelism is left to AQE: it coalesces small shuffle partitions, splits skewed
    join partitions and turns joins into broadcasts from measured sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()
_local_scratch: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application; some stages run its Python."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = os.path.join(tempfile.mkdtemp(prefix="driftline-"), package.name)
    archive = shutil.make_archive(base, "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, shared by all executors.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.mkdtemp(prefix="driftline-")
        configured = _local_scratch[app]
    return configured.rstrip("/") + "/" + spark.sparkContext.applicationId


#: Lets Spark delete a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    The plan computes once, later stages restart from files when executors are lost,
    and the optimizer sees the true size.  The shuffle files behind the table go at once: nothing
    refers to them any more.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), uuid.uuid4().hex)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside pass ``rows`` rows at once to Python, for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Plans run inside are split where a stage's generated method would be too long for the JVM to compile.

    Above 8000 bytes it is interpreted, which made a cohort of all columns ten times slower.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote, once all that is made of them has been written too."""
    for table in tables:
        path = vars(table).get("_scratch_path")
        if path is None:
            raise ValueError("not a table of cut_lineage")
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release_scratch(spark: SparkSession) -> bool:
    """Delete the tables that ``cut_lineage`` wrote for this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))
