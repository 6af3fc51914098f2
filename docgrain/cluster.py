"""What the Python workers of a cluster need."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="docgrain-"), "docgrain_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def released() -> None:
    """Gives memory that is free inside this worker back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
