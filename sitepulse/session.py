"""Spark sessions, and the package on their Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch for Python workers; rows can be whole documents.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each application, and bound the batches they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="sitepulse-")  # the driver serves the file from here as executors come
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "sitepulse.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="sitepulse-")
            context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder among those of this application in the shared one, which can be deleted together."""
    return f"{shared_dir(spark)}/sitepulse/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sitepulse")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
