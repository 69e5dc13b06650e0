"""Spark session helpers shared by plans, tests and the bench.

Nothing here hides Spark: these are the settings a Spark user would put in
``spark-defaults.conf`` for this workload, plus two guards the library relies
on everywhere (checkpoint directory, package shipping).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cinemetric") -> SparkSession:
    """Session with AQE, skew-join handling and Arrow on; the web UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or os.environ.get("CINEMETRIC_SHUFFLE_PARTITIONS")
    if parts:                         # else the cluster's own setting holds
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        # checkpoint files of DataFrames that are no longer referenced are
        # removed from the shared folder instead of piling up
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("CINEMETRIC_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local tests) fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cinemetric-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint directory (survives
    executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when a scan yields fewer partitions than
    the cluster has cores (e.g. one large row group); CPU-heavy per-row text
    work then uses every core.  With many input splits (the normal case at
    scale) the DataFrame is returned unchanged, without a shuffle."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


ROWS_PER_TASK = 200_000


def spread_by_rows(df: DataFrame, most: int = ROWS_PER_TASK) -> DataFrame:
    """Round-robin repartition only when a partition holds more than ``most``
    rows: a table of short rows has few splits however many rows it has."""
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    r = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return df.repartition(-(-r["all"] // most)) if (r["most"] or 0) > most else df


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_rows else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint directory for intermediate
    tables (never a machine-local temp folder on a cluster)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/cinemetric-scratch/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable inside Python workers (pandas UDFs and
    grouped maps pickle functions by module reference).  The package folder is
    zipped once and added with ``addPyFile``, which is how Spark distributes
    Python code to every executor."""
    import zipfile
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    if "://" in base and not base.startswith("file:"):
        base = tempfile.mkdtemp(prefix="cinemetric-pkg-")  # code artefact served by the driver
    base = base.replace("file:", "", 1) if base.startswith("file:") else base
    os.makedirs(base, exist_ok=True)
    target = os.path.join(base, f"cinemetric-{os.getpid()}-{id(sc)}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(id(sc))
