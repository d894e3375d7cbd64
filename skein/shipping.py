"""Sends this package to the executors, whose Python workers import it."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a session; where the package was imported from an archive that was shipped, nothing is left to do."""
    context = spark.sparkContext
    if getattr(context, "_skein_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if not os.path.isdir(root / "skein"):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted((root / "skein").rglob("*.py")):
            archive.write(path, path.relative_to(root))
    folder = tempfile.mkdtemp(prefix="skein-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    Path(folder, "skein_code.zip").write_bytes(buffer.getvalue())
    context.addPyFile(f"{folder}/skein_code.zip")
    context._skein_shipped = True
