"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lensfold") -> SparkSession:
    """A session for tests and benches. On a cluster, pass your own session to the operators."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session's setting. Only a local master may do without the setting:
    it gets a temporary folder, since its driver and its executors are one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lensfold-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def collect_garbage(spark: SparkSession) -> None:
    """Between rounds of many jobs: shuffles, checkpoint files and plans of earlier rounds go once the driver collects its garbage, which it
    does late, and its heap grows until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and continue from there; survives the loss of executors.

    Spark keeps its estimate of the bytes with the rows, and estimates joins by products: over rounds of joins the number has twice the
    digits each round, until it fills the driver. An estimate beyond any table is dropped.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    out = df.checkpoint(eager=True)
    run = out._jdf.queryExecution()
    if run.analyzed().stats().sizeInBytes() < 1 << 63:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(run.toRdd(), out._jdf.schema(), False), spark)
