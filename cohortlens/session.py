"""Session used by tests and the bench; on a cluster the session comes from the job."""

from __future__ import annotations

import os
import tempfile
import zipfile
from threading import Lock

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_SHIPPING = Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` does, once per application.

    Fits run side by side from driver threads, and a cluster refuses a second file of the same name.
    """
    context = spark.sparkContext
    with _SHIPPING:
        if context.applicationId in _SHIPPED:
            return
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="cohortlens-code-"), "cohortlens.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(package)))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)


def local_session(cores: str | int = "*", memory: str = "16g", name: str = "cohortlens") -> SparkSession:
    partitions = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
