"""Session settings this package relies on, and its shared work folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

# HTML cells are large: few rows per Arrow batch keep Python workers small.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # Semi joins with wanted URLs keep unwanted page text out of the shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # A folder for each product is hundreds of thousands: some hundred tasks list them, not one task for a few.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # Streaming state of many URLs lives on disk, not in the executors' heaps.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for tables and checkpoints, in the shared place the cluster names.

    Only a session without ``spark.checkpoint.dir`` (tests, one machine) gets a local one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="shelfmark-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid4().hex}"


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package (what ``--py-files`` does at submit)."""
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="shelfmark-")) / f"shelfmark-package-{uuid4().hex}"
        archive = shutil.make_archive(str(target), "zip", root.parent, root.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark
