"""Python workers on other machines need this package; a session gets it once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the session's Python workers, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        here = Path(__file__).resolve().parent
        made = Path(tempfile.mkdtemp(prefix="assayer-ship-")) / "assayer.zip"
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        context.addPyFile(str(made))
        _sent.add(context.applicationId)
    return spark
