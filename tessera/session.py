"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  driver_memory: str = "8g", app: str = "tessera") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.driver.memory", driver_memory))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a directory.

    On a cluster the directory must be the shared folder named by
    ``spark.checkpoint.dir``; we only invent one (under /tmp) for local
    masters, where the driver and the executors share one disk.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session: the server owns the setting
        try:
            return spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001
            return ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError(
        "spark.checkpoint.dir is not set: iterative operators need a shared "
        "checkpoint folder on a cluster")


class Scratch:
    """Tables of an iteration, as Parquet below the checkpoint folder.

    A checkpointed frame keeps the optimizer's size estimate, and that of a
    join is the product of its sides': over rounds of joins the number doubles
    its digits every round until the driver has no memory left. Files are
    estimated by their size. A table that is superseded is dropped at once.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def keep_bucketed(self, df: DataFrame, name: str, col: str, buckets: int) -> DataFrame:
        """As ``keep``, in buckets of ``col``: joins on it do not shuffle the table."""
        full = f"{os.path.basename(self.path)}_{name}".replace("-", "_")
        df.write.bucketBy(buckets, col).sortBy(col).option("path", f"{self.path}/{name}").saveAsTable(full)
        self.tables[name] = full
        return self.spark.table(full)

    def drop(self, name: str = "") -> None:
        """Delete table ``name``, or all."""
        for one in [name] if name else list(self.tables):
            if one in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(one)}")
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable on executors (Python workers unpickle the
    pandas functions by module reference). Zips the package once per
    application and registers it with ``addPyFile``; a no-op when the
    package is already installed on the cluster image."""
    import importlib.util
    import zipfile

    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect: ship as a session artifact instead
        sc, app = None, f"connect-{id(spark)}"
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip", dir="/tmp")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)
    assert importlib.util.find_spec("tessera") is not None
