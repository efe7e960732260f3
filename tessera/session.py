"""Session settings, and shipping this package to executors that can't import it yet."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids or keys broadcast at most; beyond that Spark joins by shuffling.
BROADCAST_ROWS = 1_000_000

#: Spark 4.1 takes the parts of a union for dealt alike though adaptive execution or disabled bucketing has changed
#: one of them: it then fails ("can't zip") or, without an exchange, aggregates wrongly. So that rule is off.
UNIONS = "spark.sql.unionOutputPartitioning"

_SHIPPED: dict[str, str] = {}
_LOCAL: dict[str, str] = {}


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling; ``conf`` overrides."""
    builder = SparkSession.builder.appName(name)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        UNIONS: "false",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once for each application, as ``--py-files`` would, and turn off ``UNIONS``."""
    spark.conf.set(UNIONS, "false")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="tessera-ship-")
        staged = os.path.join(folder, "src")
        shutil.copytree(root, os.path.join(staged, "tessera"), ignore=shutil.ignore_patterns("__pycache__"))
        _SHIPPED[app] = shutil.make_archive(os.path.join(folder, "tessera"), "zip", staged)
        spark.sparkContext.addPyFile(_SHIPPED[app])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL[app]


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder by ``checkpoint()``; partitioning is kept, lost executors are survived."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, for rounds that join what the round before them made.

    A checkpoint keeps the estimate of its plan's size, and that of a join is a product: over
    rounds its digits double each time until planning takes minutes. A table's size is that of its files.
    """
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.folder = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made and that nothing reads any more."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.folder)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished rounds: it does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast only where it is counted to hold at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
