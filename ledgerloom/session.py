"""Session settings the operators are written for."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE picks broadcast joins from measured sizes and splits skewed join partitions. Forcing the split
# accepts one more shuffle, which is cheaper than one task holding a third of the rows.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(
    cpus: int | str = "*", partitions: int = 8, app: str = "ledgerloom", folder: str | None = None
) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session it gives you. `folder` holds all it writes."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if folder:
        builder = builder.config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"{folder}/scratch")
    return builder.getOrCreate()


def untuned(spark: SparkSession) -> dict[str, str | None]:
    """The settings in which a session made elsewhere differs from `SETTINGS`. They are its owner's to change; results need
    UTC only where text becomes a timestamp, and skew splitting only for speed."""
    return {k: spark.conf.get(k, None) for k, value in SETTINGS.items() if spark.conf.get(k, None) != value}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared folder the session names in spark.checkpoint.dir.

    A session that names none gets one beside its warehouse, which all executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


#: With this on, Spark deletes the shuffle files of an execution when it ends, and not when the driver happens to collect the
#: frame as garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: dict[int, list] = {}
_lock = threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Around a write that is read back: its shuffle files go when it ends, so that the disk holds one stage's and not all. The
    session's own setting is back when the last of several writes side by side is through."""
    with _lock:
        held = _cleaning.setdefault(id(spark), [0, spark.conf.get(CLEANUP, None)])
        held[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _cleaning[id(spark)]
                if held[1] is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, held[1])
