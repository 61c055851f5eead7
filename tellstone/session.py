"""Session helpers: a local session for tests and bench, and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 4, app: str = "tellstone", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own;
    on a cluster the setting is required, since executors cannot read each
    other's local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tellstone-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    Written tables survive the loss of an executor, unlike cached or locally
    checkpointed blocks, and are columnar and compressed, unlike checkpoint files.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write the rows once and read them back."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tellstone_path = path
        return out

    def whole_path(self, df: DataFrame | None, name: str) -> str:
        """Path with its scheme of a folder in a written table, or beside the tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{df._tellstone_path if df is not None else self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tellstone_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows by hash of the key, in one partition more than the session has for a shuffle.

    Adaptive execution doesn't put these together, so costly expressions on few bytes run on all cores. With the session's own
    number Spark would leave the step out after a grouping by the key, and those partitions are put together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, key)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # it already runs from an archive
        return
    archive = Path(tempfile.mkdtemp(prefix="tellstone-package-")) / "tellstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
