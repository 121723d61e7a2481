"""Sessions: the settings that results depend on, the shared folder, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``partitions`` sets the shuffle partitions of a small run."""
    b = SparkSession.builder.appName("defectloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, once for each application, where they have no copy of their own."""
    app = spark.sparkContext.applicationId
    root = Path(__file__).resolve().parent
    if app in _SHIPPED or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    with tempfile.NamedTemporaryFile(suffix="-defectloom.zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(f.name)
    _SHIPPED.add(app)


_LOCAL: dict[str, str] = {}


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared checkpoint folder; a temporary folder takes its place only where all runs on one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = _LOCAL.setdefault(sc.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="defectloom-")
        _LOCAL[sc.applicationId] = base
    return f"{base.rstrip('/')}/defectloom/{sc.applicationId}"


def work_folder(spark: SparkSession) -> str:
    """A new folder in this application's part of the shared folder."""
    return f"{application_folder(spark)}/work-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes what this application stored between its jobs; results that still read it must be stored elsewhere first."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder, read again: what several branches of a plan read is computed once, and lost executors cost a reread."""
    spark, folder = df.sparkSession, work_folder(df.sparkSession)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def input_bytes(df: DataFrame) -> int:
    """The size of all files and tables that the plan reads, as Catalyst knows it; vast where it knows none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


#: So many rows of a plain table are one task's; inputs under so many bytes are not counted for that.
ROWS_A_TASK, UNCOUNTED_BYTES = 500_000, 32 << 20


def parts_of(rows: int | None) -> int:
    """Into how many parts so many rows are dealt, with at most some ``ROWS_A_TASK`` in each."""
    return -(-(rows or 0) // ROWS_A_TASK)


def parts(df: DataFrame) -> int:
    """The parts for the rows of a table that is cheap to count; 0 for a small one, which Spark may deal as it likes."""
    return 0 if input_bytes(df) < UNCOUNTED_BYTES else parts_of(df.count())


def stored_parts(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows, stored unless they are few, and the parts for them."""
    if input_bytes(df) < UNCOUNTED_BYTES:
        return df, 0
    df = stored(df)
    return df, parts_of(df.count())


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The rows dealt by their keys into so many parts, 0: as Spark deals them.

    Adaptive execution joins parts up to a size of compressed bytes; rows of a
    few numbers compress so well that a task would get tens of millions of them,
    all in its memory where they are sorted or grouped. A given number stays.
    """
    return df.repartition(parts, *keys) if parts else df
