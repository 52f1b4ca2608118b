"""Send this package to the executors' Python workers, which need not have it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """``spark`` itself, with the package added to its Python files once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        folder = tempfile.mkdtemp(prefix="pairforge-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root, target = Path(__file__).resolve().parent, Path(folder, "pairforge_package.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name, p.relative_to(root))))
        sc.addPyFile(str(target))
        _sent.add(sc.applicationId)
    return spark
