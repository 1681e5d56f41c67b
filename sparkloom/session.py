"""Sessions, and the library's code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers that can't import it; once for each application.

    The archive has code only; executors fetch it from the driver, so it goes when the driver ends.
    """
    near = spark.sparkContext.master.startswith("local") and Path.cwd() == ROOT
    if spark.sparkContext.applicationId in _SHIPPED or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or near:
        return
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "sparkloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "sparkloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(spark.sparkContext.applicationId)
