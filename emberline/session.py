"""Session set-up and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Settings every query relies on; all can be changed at run time.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-node session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("emberline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Set the run-time settings the operators rely on and ship the code (idempotent)."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_code(spark)
    return spark


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that it needn't be installed there.

    The archive lies in the shared folder where the driver can write to it as a file, and is served by the driver in any case.
    """
    context = spark.sparkContext
    if getattr(context, "_emberline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    url = urlparse(shared_dir(spark))
    folder = Path(url.path) / f"code-{uuid.uuid4().hex}" if url.scheme in ("", "file") else Path(tempfile.mkdtemp(prefix="emberline-code-"))
    folder.mkdir(parents=True, exist_ok=True)
    archive = folder / "emberline_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._emberline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is missing (single-node tests) a fresh folder of this machine is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove a folder when the application ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors. Removed at the end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
