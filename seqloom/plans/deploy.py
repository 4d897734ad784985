"""Give Python workers the package itself, so that a session needs nothing installed on its executors."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Add this package (sources only, some 100 kB) to the workers' path, once for each Spark context."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    _shipped.add(context)
