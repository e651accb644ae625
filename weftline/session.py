"""Sessions with the settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Bytes in an Arrow batch. Batches of whole texts lie in memory several times over, in the JVM and in Python.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(name: str = "weftline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC, Arrow and adaptive execution; other settings as given. On a cluster the number of shuffle
    partitions is the cluster's business and AQE coalesces them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    known = {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", _BATCH_KEY: str(BATCH_BYTES)}
    return builder.config(map={**known, **settings}).getOrCreate()


def prepare(spark: SparkSession) -> None:
    """For an application that runs queries in a session it was given: ship the package, and cut Arrow batches to
    BATCH_BYTES where the session has Spark's default. Operators themselves change no setting."""
    ship(spark)
    if spark.conf.get(_BATCH_KEY) == "67108864b":
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, unless they find it as the driver does: through PYTHONPATH or
    the working directory."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(p and os.path.realpath(p) == os.path.realpath(root) for p in found):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "weftline")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
