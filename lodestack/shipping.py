"""Sends the package to executors that don't have it on their path."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from lodestack.durable import shared_dir

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once per Spark context, by way of the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    path = f"{shared_dir(spark)}/source-{uuid.uuid4().hex}/lodestack.zip"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
